"""Embeddings: pluggable encoders over Arrow batches, normalisation, similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.profiles import ZH_INSTRUCTION

#: Encoders of this worker by the key they were asked for, so that a model is loaded once.
_LOADED: dict[str, Callable[[list[str]], np.ndarray]] = {}


def hashing_encoder(dim: int = 64, gram: int = 3) -> Callable[[list[str]], np.ndarray]:
    """A deterministic encoder without a model: signed hashed character n-grams; a shorter text is one gram."""

    def encode(texts: list[str]) -> np.ndarray:
        points = [np.frombuffer(t.ljust(gram, "\0").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        if not points:
            return np.zeros((0, dim))
        sizes = np.fromiter(map(len, points), np.int64, len(points))
        flat = np.concatenate(points).astype(np.uint64)
        n = len(flat) - gram + 1
        h = np.zeros(n, np.uint64)
        for k in range(gram):
            h = (h ^ flat[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        inside = owner[:n] == owner[gram - 1 :]
        h, owner = h[inside], owner[:n][inside]
        cells = owner * dim + (h % np.uint64(dim)).astype(np.int64)
        signs = np.where(h >> np.uint64(63), 1.0, -1.0)
        return np.bincount(cells, signs, len(texts) * dim).reshape(len(texts), dim)

    return encode


def encode(text: Column, factory: Callable[[], Callable[[list[str]], np.ndarray]] = hashing_encoder, key: str = "hashing", batch: int = 32, normalise: bool = True) -> Column:
    """Vectors of texts, of length 1 if ``normalise``; null for null. The encoder is made once a worker."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _LOADED.get(key) or factory()
        _LOADED[key] = model
        for texts in batches:
            rows = texts.tolist()
            held = [k for k, t in enumerate(rows) if t is not None]
            out: list = [None] * len(rows)
            for s in range(0, len(held), batch):
                part = held[s : s + batch]
                vectors = np.asarray(model([rows[k] for k in part]), np.float64)
                if normalise:
                    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
                    vectors = vectors / np.where(norm > 0, norm, 1)
                for k, v in zip(part, vectors):
                    out[k] = v.astype(np.float32).tolist()
            yield pd.Series(out)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.ArrayType(T.FloatType()))(text)


def encode_queries(query: Column, instruction: str = ZH_INSTRUCTION, **options) -> Column:
    return encode(F.concat(F.lit(instruction), query), **options)


def clear_encoders() -> None:
    """Forget the encoders of this process."""
    _LOADED.clear()


def encoder_info() -> dict[str, int]:
    return {"loaded": len(_LOADED)}


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null if either is null."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column) -> Column:
    """The vector at length 1, in double precision; a zero vector stays zero."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm > 0, norm).otherwise(1.0))


def similarity(queries: DataFrame, rows: DataFrame, query_id: str, row_id: str, query_vec: str, row_vec: str) -> DataFrame:
    """(query_id, row_id, score) of a set of queries against all rows.

    Meant for whole matrices that are wanted as such; for the best rows of each query see ``retrieval``.
    """
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("_q"))
    r = rows.select(F.col(row_id).alias("row_id"), F.col(row_vec).alias("_r"))
    return q.join(r, F.lit(True)).select("query_id", "row_id", dot(F.col("_q"), F.col("_r")).alias("score"))
