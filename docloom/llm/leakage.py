"""Evaluation items inside training documents: MinHash containment over windows of one size, verified exactly.

Texts are sets of character shingles. Containment of a short item in a long document cannot be read from
whole-document signatures once an item is only partly there (40 of 170 characters are a small part of one
set and a tiny part of the other), so both sides are partitioned into windows of the size that must be
shared. Two equal windows hold the same shingles, hence have the same minimum: a single MinHash decides,
with a certain collision for every leak. What collides is then verified by exact shingle containment.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.ids import carried, carried_type
from docloom.llm.codepoints import blocks, category_table, code_points, inside_one, rolling_hashes, sliding_min

SHINGLE = 10
#: Characters of items held by a worker at once; more items are taken in blocks, each against all documents.
MAX_ITEM_CHARS = 8_000_000
#: Blocks of items, each a pass over the documents; more items than that meet documents by a join of minima.
MAX_PASSES = 4
_BLOCK = 1_000_000


def normalised(text: str) -> str:
    """NFKC, lower case, letters and digits only (Unicode categories L and N)."""
    low = unicodedata.normalize("NFKC", text).lower()
    points = code_points(low)
    keep = points[category_table("LN")[points]]
    return keep.tobytes().decode("utf-32-le", "surrogatepass")


def window_minima(texts: list[str], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, MinHash) of every window of every text, neighbouring equals once."""
    points = [code_points(t) for t in texts]
    sizes = np.fromiter(map(len, points), np.int64, len(points))
    shingle = min(SHINGLE, window)
    joined = np.concatenate(points) if points else np.zeros(0, np.uint32)
    minima = sliding_min(rolling_hashes(joined, shingle), window - shingle + 1)
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(minima)]
    ok = inside_one(sizes, window, len(joined))
    minima, owner = minima[ok], owner[ok]
    if not len(minima):
        return owner, minima
    fresh = np.concatenate(([True], (minima[1:] != minima[:-1]) | (owner[1:] != owner[:-1])))
    return owner[fresh], minima[fresh]


class ItemIndex:
    """Items by the minima of their windows."""

    def __init__(self, ids: list, texts: list[str], window: int) -> None:
        self.window = window
        self.ids = ids
        self.texts = [normalised(t) for t in texts]
        owner, minima = window_minima(self.texts, window)
        order = np.argsort(minima, kind="stable")
        self.minima, self.owner = minima[order], owner[order]

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(text number, item number, shared windows, windows of the item) of every leak, exactly."""
        norm = [normalised(t) for t in texts]
        owner, minima = window_minima(norm, self.window)
        left = np.searchsorted(self.minima, minima, "left")
        right = np.searchsorted(self.minima, minima, "right")
        found: set[tuple[int, int]] = set()
        for k in np.flatnonzero(right > left):
            found.update((int(owner[k]), int(i)) for i in self.owner[left[k] : right[k]])
        windows: Windows | None = None
        last = -1
        for doc, item in sorted(found):
            if doc != last:
                windows, last = Windows(norm[doc], self.window), doc
            shared, of = windows.shared(self.texts[item])
            if shared:
                yield doc, item, shared, of


class Windows:
    """The windows of a normalised text by their hashes."""

    def __init__(self, text: str, window: int) -> None:
        self.text, self.window = text, window
        hashes = rolling_hashes(code_points(text), window)
        # of equal hashes the first place; the characters there are compared below
        self.held = dict(zip(hashes[::-1].tolist(), range(len(hashes) - 1, -1, -1)))

    def shared(self, wanted: str) -> tuple[int, int]:
        """(windows of ``wanted`` that stand in the text, all its windows), exactly."""
        own = rolling_hashes(code_points(wanted), self.window).tolist()
        n = 0
        for s, h in enumerate(own):
            at = self.held.get(h)
            if at is not None:
                part = wanted[s : s + self.window]
                n += self.text.startswith(part, at) or part in self.text
        return n, len(own)


def _minima(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, texts = pdf["key"].tolist(), pdf["text"].tolist()
            for first, last in blocks([len(t) for t in texts], _BLOCK):
                owner, minima = window_minima([normalised(t) for t in texts[first:last]], window)
                yield pd.DataFrame({"key": [keys[first + k] for k in owner], "minimum": minima.view(np.int64)}).drop_duplicates()

    return run


def _verify(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, part in pdf.groupby("text", sort=False):
                windows = Windows(normalised(text), window)
                for key, item_key, wanted in zip(part["key"], part["item_key"], part["item_text"]):
                    shared, of = windows.shared(normalised(wanted))
                    if shared:
                        out.append((key, item_key, shared, of))
            yield pd.DataFrame(out, columns=["key", "item_key", "shared_windows", "item_windows"])

    return run


def _joined(rows: DataFrame, need: DataFrame, window: int) -> DataFrame:
    """(id, item, shared_windows, item_windows) by a join of minima, each pair of different texts verified once."""
    docs, items = (df.withColumn("key", F.sha2("text", 256)) for df in (rows, need))
    texts, wanted = (df.select("key", "text").dropDuplicates(["key"]) for df in (docs, items))
    met = texts.mapInPandas(_minima(window), "key string, minimum long").join(wanted.mapInPandas(_minima(window), "key string, minimum long").withColumnRenamed("key", "item_key"), "minimum").select("key", "item_key").distinct()
    pairs = met.join(texts, "key").join(wanted.select(F.col("key").alias("item_key"), F.col("text").alias("item_text")), "item_key")
    found = pairs.mapInPandas(_verify(window), "key string, item_key string, shared_windows int, item_windows int")
    return found.join(docs.select("key", "id"), "key").join(items.select(F.col("key").alias("item_key"), "item"), "item_key").select("id", "item", "shared_windows", "item_windows")


def _search(index):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, texts = pdf["id"].tolist(), pdf["text"].tolist()
            for first, last in blocks([len(t) for t in texts], _BLOCK):
                rows = [(ids[first + d], index.value.ids[i], shared, of) for d, i, shared, of in index.value.search(texts[first:last])]
                if rows:
                    yield pd.DataFrame(rows, columns=["id", "item", "shared_windows", "item_windows"])

    return run


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", min_chars: int = 40) -> DataFrame:
    """(doc_id, item_id, shared_windows, item_windows, containment) of documents and items that share a passage.

    A passage is ``min_chars`` consecutive characters after normalisation. ``containment`` is the share of the
    item's windows of that length that the document holds, 1 for an item leaked whole. Null texts and items
    shorter than ``min_chars`` share nothing; equal items are each reported; rows stored twice come out twice.
    Documents are read once and not shuffled. Items are sent to the workers in blocks of at most
    ``MAX_ITEM_CHARS`` characters; each further block is another pass over all documents. Beyond ``MAX_PASSES`` blocks both
    sides are joined by their minima instead, with the same result.
    """
    spark = docs.sparkSession
    kinds = {"id": docs.select(F.col(doc_id)).schema[0].dataType.simpleString(), "item": items.select(F.col(item_id)).schema[0].dataType.simpleString()}
    need = items.select(carried(F.col(item_id), kinds["item"]).alias("item"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    size = need.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = 1 + size // MAX_ITEM_CHARS
    rows = docs.select(carried(F.col(doc_id), kinds["id"]).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    out = _joined(rows, need, min_chars) if parts > MAX_PASSES else None
    for part in range(parts if out is None else 0):
        block = need.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).toPandas()
        index = spark.sparkContext.broadcast(ItemIndex(block["item"].tolist(), block["text"].tolist(), min_chars))
        found = rows.mapInPandas(_search(index), f"id {carried_type(kinds['id'])}, item {carried_type(kinds['item'])}, shared_windows int, item_windows int")
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("id").cast(kinds["id"]).alias(doc_id), F.col("item").cast(kinds["item"]).alias(item_id), "shared_windows", "item_windows", (F.col("shared_windows") / F.col("item_windows")).alias("containment"))
