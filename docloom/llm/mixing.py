"""Mixing sources to target weights under limits of repetition.

Target weights are reached from the natural token shares q by an exponent t: weights go as
q * (target / q) ** t, so 0 is the natural mixture and 1 the target (with equal targets this is the usual
temperature mixing, q ** (1 - t)). The exponent is bisected to the largest that keeps every source within
its limit of repetition and the entropy wanted. The weights become token budgets, and each budget whole passes
over its source and a part of one more: the blocks of a hashed permutation in order, and of the block in which the
budget ends each document that still fits.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.ids import carried
from docloom.session import cut_lineage

#: Exponents tried at once, and how often the interval between two of them is divided again.
_GRID, _ROUNDS = 32, 6
_BLOCK_DOCS = 1_000
_LOADED: dict = {}


def _tokenizer(path: str):
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.encode_special_tokens = True
            _LOADED[path] = lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]
    return _LOADED[path]


def token_count(text: F.Column, tokenizer: str) -> F.Column:
    """Tokens of a text by a public tokenizer's file (JSON, or a sentencepiece model), which every executor reads; 0 for null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = _tokenizer(tokenizer)
        for texts in batches:
            rows = texts.fillna("").tolist()
            out = []
            for k in range(0, len(rows), 256):
                out += count(rows[k : k + 256])
            yield pd.Series(out, dtype="int64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.LongType())(text)


def _raw(exponent: float) -> F.Column:
    """q * (target / q) ** exponent with q as the tokens held, whose sum is the whole; 0 for a source that has or gets nothing."""
    q, t = F.col("tokens").cast("double") / F.col("whole"), F.col("share")
    return F.when((F.col("tokens") > 0) & (t > 0), q * F.pow(t / q, F.lit(float(exponent)))).otherwise(F.lit(0.0))


def _tried(stats: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """For each exponent: the sum of the raw weights, the largest of weight by limit, and the entropy of the weights."""
    aggs = []
    for k, e in enumerate(exponents):
        raw = _raw(e)
        aggs += [F.sum(raw).alias(f"s{k}"), F.max(F.when(raw > 0, raw / F.col("cap"))).alias(f"m{k}"), F.sum(F.when(raw > 0, raw * F.log(raw))).alias(f"l{k}")]
    r = stats.agg(*aggs).first()
    out = []
    for k in range(len(exponents)):
        s, m, ln = r[f"s{k}"] or 0.0, r[f"m{k}"] or 0.0, r[f"l{k}"] or 0.0
        out.append((s, m / s if s else 0.0, math.log(s) - ln / s if s else 0.0))
    return out


def find_exponent(stats: DataFrame, total: int | None, min_entropy: float | None) -> tuple[int, float]:
    """(total tokens, exponent) for ``stats`` with (tokens, whole, share, cap), one row for each source.

    Without ``total`` it is the largest at which the targets are met exactly within the limits. With one, the
    exponent is the largest in [0, 1] that keeps each source within its limit; where none does (the total is
    more than there is) it is 0. ``min_entropy`` asks for the largest exponent whose weights still have that entropy,
    for targets that are narrower than the natural mixture. Sources are weighed in Spark, any number of them.
    """
    whole, most, _ = _tried(stats, [1.0])[0]
    if not whole:
        return 0, 0.0
    if total is None:
        total = int(1 / most)

    def good(exponents: list[float]) -> list[bool]:
        return [m * total <= 1 + 1e-6 and (min_entropy is None or h >= min_entropy - 1e-12) for _, m, h in _tried(stats, exponents)]

    if good([1.0])[0]:
        return total, 1.0
    low, high = 0.0, 1.0
    for _ in range(_ROUNDS):
        points = [low + (high - low) * j / _GRID for j in range(_GRID)]
        held = [p for p, ok in zip(points, good(points)) if ok]
        if not held:
            return total, 0.0
        low, high = held[-1], held[-1] + (high - low) / _GRID
    return total, low


_EDGE = "id string, source string, tokens long, more int"


def _fitting(pdf: pd.DataFrame) -> pd.DataFrame:
    """The documents of the block in which a source's budget ends: each in turn is taken if it still fits."""
    rows = pdf.sort_values(["key", "id"])
    room = int((rows["rest"] - rows["before"]).iloc[0])
    more = []
    for n in rows["tokens"]:
        more.append(int(n <= room))
        room -= n * more[-1]
    return rows.assign(more=more)[["id", "source", "tokens", "more"]]


class Mixture:
    """Documents of several sources combined to target shares.

    ``targets`` has source, target_share, max_repeat; documents of other sources, and those without text or
    tokens, take no part. Null shares and limits below 1 leave a source out. ``used`` is one row for each
    document with the times it is used, ``report`` one for each source of the targets. ``total`` is a number of tokens, or
    ``"held"`` for as many as the sources hold, or None for as many as meet the targets exactly. What a source gives falls short of
    its budget by less than any document of its last block that was not taken.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, tokenizer: str, total: int | str | None = None, min_entropy: float | None = None, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> None:
        want = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeat").alias("max_repeat")).where("source is not null")
        self.id_type = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
        rows = docs.select(carried(F.col(id_col), self.id_type).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")).where("length(text) > 0")
        rows = rows.join(want.select("source"), "source", "left_semi")
        # sizes are counted once; the table of ids, sources and sizes is read again by every step below
        self.docs = cut_lineage(rows.select("id", "source", token_count(F.col("text"), tokenizer).alias("tokens")))
        held = self.docs.where("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
        stats = want.join(held, "source", "left").na.fill(0, ["tokens", "docs"])
        share = F.when((F.col("max_repeat") >= 1) & (F.col("target_share") > 0), F.col("target_share")).otherwise(F.lit(0.0))
        stats = cut_lineage(stats.select("*", share.alias("share")))
        whole = stats.agg(F.sum("tokens")).first()[0] or 0
        total = whole if total == "held" else total
        # in tokens that the sources may give
        stats = stats.withColumn("whole", F.lit(float(max(whole, 1)))).withColumn("cap", F.col("tokens") * F.coalesce("max_repeat", F.lit(0)).cast("double"))
        self.total, self.exponent = find_exponent(stats, total, min_entropy)
        weight = _raw(self.exponent) / F.lit(_tried(stats, [self.exponent])[0][0] or 1.0)
        plan = stats.withColumn("weight", weight).withColumn("budget", F.least(F.floor(F.col("weight") * self.total), F.col("cap").cast("long")))
        plan = plan.withColumn("full", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0))).withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens"))
        # from a million documents on as many blocks as documents in each: neither grows faster than the root
        plan = plan.withColumn("n_blocks", F.greatest(F.lit(1), F.floor(F.col("docs") / F.greatest(F.lit(_BLOCK_DOCS), F.sqrt("docs")))))
        self.plan = cut_lineage(plan.select("source", "target_share", "max_repeat", "docs", F.col("tokens").alias("tokens_held"), "weight", "budget", "full", "rest", "n_blocks"))
        self.seed, self.id_col = seed, id_col

    def used(self) -> DataFrame:
        """(id, source, tokens, times), one row for each document that is used at least once."""
        key = F.xxhash64("id", F.lit(self.seed))
        rows = self.docs.where("tokens > 0").join(self.plan.select("source", "full", "rest", "n_blocks"), "source")
        rows = rows.withColumn("key", key).withColumn("block", F.pmod("key", "n_blocks"))
        sums = rows.groupBy("source", "block", "full", "rest").agg(F.sum("tokens").alias("in_block"))
        before = F.expr("sum(in_block) over (partition by source order by block) - in_block")
        sums = cut_lineage(sums.withColumn("before", before).withColumn("whole", F.col("before") + F.col("in_block") <= F.col("rest")))
        ends = sums.where("not whole and before < rest").select("source", "block", "before")
        edge = rows.join(ends, ["source", "block"]).groupBy("source").applyInPandas(_fitting, _EDGE)
        edge = edge.join(self.plan.select("source", "full"), "source")
        others = rows.join(sums.where("whole or before >= rest").select("source", "block", "whole"), ["source", "block"]).select("id", "source", "tokens", F.col("whole").cast("int").alias("more"), "full")
        out = others.unionByName(edge.select("id", "source", "tokens", "more", "full")).withColumn("times", (F.col("full") + F.col("more")).cast("int"))
        return out.where("times > 0").select(F.col("id").cast(self.id_type).alias(self.id_col), "source", "tokens", "times")

    def report(self) -> DataFrame:
        """Per source: what it holds, its target, the tokens and share it actually gives, and the exponent of the mixture."""
        given = cut_lineage(self.used().groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("taken"), F.max("times").alias("most_times"), F.count("*").alias("docs_used")))
        whole = given.agg(F.sum("taken")).first()[0] or 0
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        out = self.plan.join(given, "source", "left").select("source", "target_share", "max_repeat", "docs", F.col("tokens_held").alias("tokens"), "weight", "budget", zero("taken"), zero("most_times"), zero("docs_used"))
        return out.withColumn("actual_share", F.col("taken") / F.lit(float(max(whole, 1)))).withColumn("off_target", F.abs(F.col("actual_share") - F.coalesce("target_share", F.lit(0.0)))).withColumn("exponent", F.lit(self.exponent))
