"""Long verbatim spans shared between records, by a compacted de Bruijn graph.

Tokens are characters, and an edge is a k-mer of the least length a span must have. Edges are never made one by one
at first: neighbouring windows whose least shingle (their minimizer) is the same make a super-k-mer, a stretch
of the graph that is kept whole. Equal windows agree in their minimizer, so only super-k-mers that share one with
another record take part, and nothing is lost. Super-k-mers that come back whole are repeated paths already. Only
where different ones share a minimizer, one of each is opened into its edges, to see which of these they share.
A path or an edge with one predecessor in all its places, itself followed by nothing else, continues a nonbranching
path; a join with the predecessors finds what begins paths. Their source coordinates fetch the characters, and
equal characters make a group of records that share a span.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.codepoints import blocks, code_points, inside_one, rolling_hashes, sliding_min
from docloom.session import cut_lineage

#: Length of the shingles that choose windows, in hundredths of a span.
SHINGLE_SHARE = 60
_BLOCK = 1_000_000
_START = -1  # the predecessor at the beginning of a text


class _Runs:
    """The super-k-mers of some texts: text number, first window, number of windows, and minimizer of each."""

    def __init__(self, texts: list[str], span: int) -> None:
        points = [code_points(t) for t in texts]
        sizes = np.fromiter(map(len, points), np.int64, len(points))
        self.joined = np.concatenate(points)
        # longer shingles are shared by fewer texts that share no span, shorter ones have fewer minima
        shingle = max(1, span * SHINGLE_SHARE // 100)
        windows = np.flatnonzero(inside_one(sizes, span, len(self.joined)))
        least = sliding_min(rolling_hashes(self.joined, shingle), span - shingle + 1)[windows]
        owner = np.repeat(np.arange(len(sizes)), sizes)[windows]
        fresh = np.concatenate(([True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]))) if len(windows) else np.zeros(0, bool)
        at = np.flatnonzero(fresh)
        #: places in the joined texts
        self.begins = windows[at]
        self.counts = np.diff(np.append(at, len(windows)))
        self.owner, self.anchors = owner[at], least[at].view(np.int64)
        self.starts = self.begins - (np.cumsum(sizes) - sizes)[self.owner]


def _by_block(pdf: pd.DataFrame, span: int) -> Iterator[tuple[list, _Runs]]:
    ids, texts = pdf["id"].tolist(), pdf["text"].tolist()
    for first, last in blocks([len(t) for t in texts], _BLOCK):
        runs = _Runs(texts[first:last], span)
        if len(runs.begins):
            yield [ids[first + k] for k in runs.owner], runs


def _anchors(span: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, runs in _by_block(pdf, span):
                yield pd.DataFrame({"id": ids, "anchor": runs.anchors}).drop_duplicates()

    return run


def _places(span: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, runs in _by_block(pdf, span):
                raw = memoryview(runs.joined.tobytes())
                ends = runs.begins + runs.counts + (span - 1)
                digests = b"".join(blake2b(raw[4 * s : 4 * e], digest_size=8).digest() for s, e in zip(runs.begins.tolist(), ends.tolist()))
                body = np.frombuffer(digests, np.int64)
                first = np.concatenate(([True], runs.owner[1:] != runs.owner[:-1]))
                back = lambda a: np.where(first, _START, np.concatenate(([_START], a[:-1])))
                yield pd.DataFrame({"id": ids, "start": runs.starts.astype(np.int32), "n": runs.counts.astype(np.int32), "anchor": runs.anchors, "body": body, "anchor_before": back(runs.anchors), "body_before": back(body)})

    return run


def _edges(span: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["passage"].tolist()
            for first, last in blocks([len(t) for t in texts], _BLOCK):
                points = [code_points(t) for t in texts[first:last]]
                sizes = np.fromiter(map(len, points), np.int64, len(points))
                joined = np.concatenate(points)
                at = np.flatnonzero(inside_one(sizes, span, len(joined)))
                edge = rolling_hashes(joined, span)[at].view(np.int64)
                owner = np.repeat(np.arange(len(sizes)), sizes)[at]
                offset = at - (np.cumsum(sizes) - sizes)[owner]
                before = np.where(offset == 0, _START, np.concatenate(([_START], edge[:-1])))
                part = pdf.iloc[first:last]
                yield pd.DataFrame({"anchor": part["anchor"].to_numpy()[owner], "body": part["body"].to_numpy()[owner], "offset": offset.astype(np.int32), "edge": edge, "before": before})

    return run


class SharedSpans:
    """Spans of at least ``span`` consecutive characters, as stored, that occur in more than one record.

    ``df`` holds one row for each id; rows stored twice are one record. Null texts, texts shorter than
    ``span`` and rows without an id share nothing. A text is taken whole, whatever its length.
    """

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 200) -> None:
        self.span, self.id_col = span, id_col
        self.rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(f"id is not null and length(text) >= {span}")
        kind = self.rows.schema["id"].dataType.simpleString()
        anchors = self.rows.mapInPandas(_anchors(span), f"id {kind}, anchor long")
        several = anchors.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("anchor")
        places = self.rows.mapInPandas(_places(span), f"id {kind}, start int, n int, anchor long, body long, anchor_before long, body_before long")
        #: super-k-mers that share a minimizer with another record; minimizer and body together stand for the characters
        self.places = cut_lineage(places.join(several, "anchor").distinct())
        before = F.struct("anchor_before", "body_before")
        paths = self.places.groupBy("anchor", "body").agg(F.count("*").alias("times"), F.min("id").alias("a"), F.max("id").alias("b"), F.min(before).alias("p"), F.max(before).alias("q"), F.min(F.struct("id", "start", "n")).alias("one"))
        #: each different super-k-mer once, with its places' number, least and greatest record, and predecessor if it has one only
        self.paths = cut_lineage(paths.select("anchor", "body", "times", "a", "b", F.when(F.col("p") == F.col("q"), F.col("p")).alias("before"), "one"))

    @cached_property
    def edges(self) -> DataFrame:
        """(anchor, body, offset, edge, before) of the super-k-mers that share a minimizer with different ones."""
        varied = self.paths.groupBy("anchor").agg(F.count("*").alias("bodies")).where("bodies > 1").select("anchor")
        one = self.paths.join(varied, "anchor").select("anchor", "body", F.col("one.id").alias("id"), F.col("one.start").alias("start"), F.col("one.n").alias("n"))
        passage = F.expr(f"substring(text, start + 1, n + {self.span - 1})").alias("passage")
        opened = one.join(self.rows, "id").select("anchor", "body", passage).dropDuplicates(["anchor", "body"])
        edges = opened.mapInPandas(_edges(self.span), "anchor long, body long, offset int, edge long, before long")
        # only what several super-k-mers have is needed again
        several = edges.groupBy("anchor", "edge").agg(F.count("*").alias("times"), F.min("before").alias("p"), F.max("before").alias("q")).where("times > 1")
        several = several.select("anchor", "edge", "times", F.when(F.col("p") == F.col("q"), F.col("p")).alias("only_before"))
        return cut_lineage(edges.drop("before").join(several, ["anchor", "edge"]))

    def heads(self) -> DataFrame:
        """(anchor, body, offset, size, group) of the beginnings of nonbranching paths: ``size`` characters from ``offset`` on.

        Equal groups stand for equal characters. What is in as many places as the one thing before it is left
        out, since that one's group holds the same records.
        """
        prior = self.paths.where("a <> b").select(F.struct(F.col("anchor").alias("anchor_before"), F.col("body").alias("body_before")).alias("before"), F.col("times").alias("times_before"))
        whole = self.paths.where("a <> b").join(prior, "before", "left").where("times_before is null or times_before <> times")
        whole = whole.select("anchor", "body", F.lit(0).alias("offset"), (F.col("one.n") + self.span - 1).alias("size"), F.struct("anchor", "body").alias("group"))
        edges = self.edges
        known = edges.select("anchor", F.col("edge").alias("only_before"), F.col("times").alias("times_before")).distinct()
        begins = edges.join(known, ["anchor", "only_before"], "left").where("times_before is null or times_before <> times")
        return whole.unionByName(begins.select("anchor", "body", "offset", F.lit(self.span).alias("size"), F.struct("anchor", F.col("edge").alias("body")).alias("group")))

    def groups(self) -> DataFrame:
        """(span, id) of the records that hold the same span, one row for each record of a group.

        The spans are the beginnings of nonbranching paths; ``span`` is the hash of the characters that stand at
        the places found, so records of a group agree in all of them. Linear in the number of places.
        """
        at = self.places.join(self.heads(), ["anchor", "body"]).select("id", (F.col("start") + F.col("offset")).alias("pos"), "size", "group")
        passage = F.sha2(F.expr("substring(text, pos + 1, size)"), 256).alias("span")
        held = at.join(self.rows, "id").select(F.struct("group", passage).alias("group"), "id").distinct()
        return held.select(F.col("group.span").alias("span"), "id").distinct()

    def pairs(self) -> DataFrame:
        """(id_a, id_b), id_a < id_b, of the records that share a span, each pair once: the groups expanded.

        A group of n records has n * (n - 1) / 2 pairs, all of them results; ``groups`` has the same without expansion.
        """
        at = cut_lineage(self.groups())
        return at.withColumnRenamed("id", "id_a").join(at.withColumnRenamed("id", "id_b"), "span").where("id_a < id_b").select("id_a", "id_b").distinct()

    def spans(self) -> DataFrame:
        """(id, start_pos, end_pos) of each record's longest stretches of which every window stands in another record too."""
        shared = self.paths.where("a <> b").select("anchor", "body")
        whole = self.places.join(shared, ["anchor", "body"]).select("id", F.col("start").alias("first"), (F.col("start") + F.col("n") - 1).alias("last"))
        # edges of different super-k-mers, where these are not all of one record
        owners = self.edges.join(self.paths.where("a = b").select("anchor", "body", "a"), ["anchor", "body"], "left")
        mixed = owners.groupBy("anchor", "edge").agg(F.min("a").alias("low"), F.max("a").alias("high"), F.max(F.col("a").isNull()).alias("shared")).where("shared or low <> high").select("anchor", "edge")
        opened = self.edges.join(mixed, ["anchor", "edge"]).select("anchor", "body", "offset").join(shared, ["anchor", "body"], "left_anti")
        single = self.places.join(opened, ["anchor", "body"]).select("id", (F.col("start") + F.col("offset")).alias("first"), (F.col("start") + F.col("offset")).alias("last"))
        ranges = whole.unionByName(single).distinct()
        reached = F.expr("max(last) over (partition by id order by first, last rows between unbounded preceding and 1 preceding)")
        marked = ranges.withColumn("fresh", F.when(F.col("first") > F.coalesce(reached, F.lit(-2)) + 1, 1).otherwise(0))
        numbered = marked.withColumn("number", F.expr("sum(fresh) over (partition by id order by first, last)"))
        out = numbered.groupBy("id", "number").agg(F.min("first").alias("start_pos"), (F.max("last") + self.span).alias("end_pos"))
        return out.select("id", "start_pos", "end_pos")

    def shares(self) -> DataFrame:
        """(id, n_chars, shared_chars, shared_share) of the records of which some part stands in another one."""
        # neighbouring stretches may overlap: each adds what lies before the next one
        following = F.expr("lead(start_pos) over (partition by id order by start_pos)")
        own = F.least("end_pos", F.coalesce(following, "end_pos")) - F.col("start_pos")
        covered = self.spans().withColumn("own", own).groupBy("id").agg(F.sum("own").cast("long").alias("shared_chars"))
        sizes = self.rows.select("id", F.length("text").alias("n_chars")).dropDuplicates(["id"])
        return sizes.join(covered, "id").select(F.col("id").alias(self.id_col), "n_chars", "shared_chars", (F.col("shared_chars") / F.col("n_chars")).alias("shared_share"))
