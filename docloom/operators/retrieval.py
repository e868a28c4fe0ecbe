"""Vector search, reranking with boosts from metadata, and two-stage search."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from docloom.operators.embedding import dot
from docloom.profiles import BOOSTS

#: Floats of query vectors held by a worker at once; more queries go in blocks.
MAX_QUERY_FLOATS = 2_000_000


def top_k(rows: DataFrame, row_id: str, row_vec: str, query: list[float], k: int = 20) -> DataFrame:
    """The k rows of the largest inner product with one vector, ties by id; fewer where there are fewer."""
    q = F.array(*(F.lit(float(x)) for x in query))
    score = F.round(dot(F.col(row_vec), q), 4)
    return rows.where(F.col(row_vec).isNotNull()).select(F.col(row_id).alias("row_id"), score.alias("score")).orderBy(F.col("score").desc(), "row_id").limit(k)


def _blocks(spark: SparkSession, queries: DataFrame, query_id: str, query_vec: str, dim: int):
    """The queries in blocks that fit a worker, each as ids and a matrix."""
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("vec")).where("vec is not null")
    n = q.count()
    parts = max(1, -(-n * dim // MAX_QUERY_FLOATS))
    for p in range(parts):
        pdf = q.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p).toPandas()
        if len(pdf):
            yield spark.sparkContext.broadcast((pdf["query_id"].to_numpy(), np.stack([np.asarray(v, np.float64) for v in pdf["vec"]])))


def batch_top_k(queries: DataFrame, rows: DataFrame, query_id: str, row_id: str, query_vec: str, row_vec: str, k: int = 20, digits: int = 4) -> DataFrame:
    """(query_id, row_id, score, rank): for each query the k rows of the largest inner product, exactly.

    Queries go to the workers in blocks of bounded size; each Arrow batch of rows is one matrix product, and a
    task keeps the best k rows a query of all its batches, so that is what is shuffled. Scores are rounded to
    ``digits`` before they are compared, ties go by id. Rows without a vector take no part.
    """
    spark = rows.sparkSession
    source = rows.select(F.col(row_id).alias("row_id"), F.col(row_vec).alias("vec")).where("vec is not null")
    first = source.select(F.size("vec").alias("n")).first()
    dim = first["n"] if first else 1
    kinds = queries.select(query_id).schema[0].dataType.simpleString(), source.schema["row_id"].dataType.simpleString()
    schema = f"query_id {kinds[0]}, row_id {kinds[1]}, score double"
    out = None
    for block in _blocks(spark, queries, query_id, query_vec, dim):

        def run(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            ids, matrix = block.value
            held: list[pd.DataFrame] = []

            def best() -> pd.DataFrame:
                every = pd.concat(held).sort_values(["query_id", "score", "row_id"], ascending=[True, False, True])
                return every.groupby("query_id", sort=False).head(k)

            for pdf in batches:
                if not len(pdf):
                    continue
                vectors = np.stack([np.asarray(v, np.float64) for v in pdf["vec"]])
                rid = pdf["row_id"].to_numpy()
                keep = min(k, len(rid))
                for s in range(0, len(ids), 256):
                    scores = np.round(matrix[s : s + 256] @ vectors.T, digits)
                    # all that tie with the k-th stay, the order by id decides among them
                    limit = np.partition(scores, scores.shape[1] - keep, axis=1)[:, scores.shape[1] - keep]
                    qi, ri = np.nonzero(scores >= limit[:, None])
                    held.append(pd.DataFrame({"query_id": ids[s : s + 256][qi], "row_id": rid[ri], "score": scores[qi, ri]}))
                if sum(map(len, held)) > 4 * k * len(ids):
                    held = [best()]
            if held:
                yield best()

        part = source.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema + ", rank int")
    order = W.Window.partitionBy("query_id").orderBy(F.col("score").desc(), "row_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class IvfIndex:
    """Vectors by the nearest of trained centroids; a search looks only at the nearest cells.

    The centroids are trained by k-means on at most ``sample`` vectors (the ones of the least hashed ids);
    every vector is indexed. With few vectors there is one cell; with many, cells grow as the root of their number.
    """

    def __init__(self, rows: DataFrame, row_id: str, row_vec: str, n_cells: int | None = None, sample: int = 50_000, seed: int = 7) -> None:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        self.spark = rows.sparkSession
        data = rows.select(F.col(row_id).alias("row_id"), F.col(row_vec).alias("vec")).where("vec is not null")
        total = data.count()
        cells = max(1, n_cells or max(min(100, total // 10), isqrt(total) // 4))
        train = data.orderBy(F.xxhash64("row_id")).limit(sample).select(array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
        if cells > 1:
            self.centroids = np.array(KMeans(k=cells, seed=seed, maxIter=20).fit(train).clusterCenters())
        else:
            self.centroids = np.zeros((1, 1))
        self.cells = data.withColumn("cell", self._nearest(1)(F.col("vec"))[0])

    def save(self, path: str) -> None:
        """The cells and centroids as Parquet under a folder."""
        self.cells.write.mode("overwrite").parquet(f"{path}/cells")
        rows = [(k, [float(x) for x in c]) for k, c in enumerate(self.centroids)]
        self.spark.createDataFrame(rows, "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IvfIndex:
        """A saved index; nothing is trained or assigned again."""
        index = cls.__new__(cls)
        index.spark, index.cells = spark, spark.read.parquet(f"{path}/cells")
        index.centroids = np.array([r["centroid"] for r in spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()])
        return index

    def info(self) -> dict[str, int]:
        return {"cells": len(self.centroids), "dim": int(self.centroids.shape[1])}

    def _nearest(self, n: int):
        centroids = self.spark.sparkContext.broadcast(self.centroids)
        n = min(n, len(self.centroids))

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def nearest(vectors: pd.Series) -> pd.Series:
            c = centroids.value
            if len(c) == 1:
                return pd.Series([[0]] * len(vectors))
            v = np.stack([np.asarray(x, np.float64) for x in vectors]) if len(vectors) else np.zeros((0, c.shape[1]))
            d = (c * c).sum(1)[None, :] - 2 * v @ c.T
            return pd.Series([list(map(int, row)) for row in np.argsort(d, axis=1, kind="stable")[:, :n]])

        return nearest

    def search(self, queries: DataFrame, query_id: str, query_vec: str, k: int = 20, probes: int = 8) -> DataFrame:
        """(query_id, row_id, score, rank) among the rows of each query's nearest ``probes`` cells."""
        q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("_q")).where("_q is not null")
        q = q.withColumn("cell", F.explode(self._nearest(probes)(F.col("_q"))))
        hits = q.join(self.cells, "cell").select("query_id", "row_id", F.round(dot(F.col("_q"), F.col("vec")), 4).alias("score"))
        order = W.Window.partitionBy("query_id").orderBy(F.col("score").desc(), "row_id")
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def metadata_boost(query: Column, section_path: Column, has_table: Column, has_list: Column, heading_level: Column) -> Column:
    """What a chunk's metadata adds to its score: each distinct word of the query found in its section path, a table, a list, a high heading."""
    words = F.array_distinct(F.filter(F.split(F.lower(query), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != ""))
    path = F.lower(F.array_join(F.coalesce(section_path, F.array().cast("array<string>")), " "))
    found = F.size(F.filter(words, lambda w: F.contains(path, w)))
    flag = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0.0)
    return F.coalesce(found, F.lit(0)) * BOOSTS["section"] + flag(has_table, BOOSTS["table"]) + flag(has_list, BOOSTS["list"]) + flag(heading_level <= 2, BOOSTS["top_level"])


def lexical_scorer(query: Column, text: Column) -> Column:
    """A deterministic stand-in for a cross-encoder: the share of the query's distinct character pairs that the text holds."""
    pairs = F.when(F.length(query) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(query) - 1), lambda i: F.substring(query, i, F.lit(2))))).otherwise(F.array(query))
    return F.size(F.filter(pairs, lambda p: F.contains(text, p))) / F.greatest(F.size(pairs), F.lit(1))


def pair_scorer(factory: Callable[[], Callable[[list[str], list[str]], list[float]]], batch: int = 16) -> Callable[[Column, Column], Column]:
    """A model of (query, text) pairs as a column function; made once a worker and task."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for queries, texts in batches:
            out: list[float] = []
            for s in range(0, len(queries), batch):
                out += list(model(queries.iloc[s : s + batch].tolist(), texts.iloc[s : s + batch].tolist()))
            yield pd.Series(out, dtype="float64")

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.DoubleType())


def rank_within(hits: DataFrame, query_id: str, score: Column, ties: list[Column], k: int, name: str = "rank") -> DataFrame:
    """Of each query the k hits of the highest score, with their rank."""
    order = W.Window.partitionBy(query_id).orderBy(score.desc_nulls_last(), *ties)
    return hits.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def rerank(hits: DataFrame, scorer: Callable[[Column, Column], Column] = lexical_scorer, k: int = 5, boost: bool = True) -> DataFrame:
    """Hits (query_id, query, chunk_id, text, rank_score, rank, metadata) scored anew and cut to k a query.

    Equal scores keep the order of the first stage. The scorer sees only the hits it is given, so cut the
    first stage before.
    """
    score = scorer(F.col("query"), F.col("text"))
    if boost:
        score = score + metadata_boost(F.col("query"), F.col("metadata.section_path"), F.col("metadata.has_table"), F.col("metadata.has_list"), F.col("metadata.heading_level"))
    scored = hits.withColumn("rerank_score", F.round(score, 6))
    return rank_within(scored, "query_id", F.col("rerank_score"), [F.col("rank").asc(), F.col("chunk_id").asc()], k, "final_rank")


def search(hits: DataFrame, rank_top_k: int = 20, rerank_top_k: int = 5, use_rerank: bool = True, scorer: Callable[[Column, Column], Column] = lexical_scorer) -> DataFrame:
    """Two stages: the best ``rank_top_k`` by the first score, then reranked; or the first ones with no second score."""
    first = rank_within(hits, "query_id", F.col("rank_score"), [F.col("chunk_id").asc()], rank_top_k)
    if use_rerank:
        return rerank(first, scorer, rerank_top_k)
    return first.where(F.col("rank") <= rerank_top_k).withColumn("rerank_score", F.lit(None).cast("double")).withColumn("final_rank", F.col("rank"))
