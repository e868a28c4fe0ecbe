"""Context assembly within a length, prompts, and answers by a pluggable generator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from docloom.profiles import PROMPT_HEAD, PROMPT_TAIL


def fragment(number: Column, section_path: Column, text: Column) -> Column:
    """A numbered piece of context, under its section path where there is one."""
    head = F.when(F.coalesce(F.size(section_path), F.lit(0)) > 0, F.concat(F.lit("【"), F.array_join(section_path, " > "), F.lit("】\n"))).otherwise("")
    return F.concat(F.lit("文档片段"), number.cast("string"), F.lit("：\n"), head, text, F.lit("\n"))


def _running(hits: DataFrame) -> DataFrame:
    """Hits with ``piece`` and ``used``, the length of the pieces up to this one."""
    order = W.Window.partitionBy("query_id").orderBy("number").rowsBetween(W.Window.unboundedPreceding, 0)
    pieces = hits.withColumn("piece", fragment(F.col("number"), F.col("section_path"), F.col("text")))
    return pieces.withColumn("used", F.sum(F.length("piece")).over(order))


def budgeted(hits: DataFrame, longest: int = 3000) -> DataFrame:
    """Hits (query_id, number, section_path, text) whose pieces fit the context, with ``piece`` and ``used``.

    Pieces are taken in order up to the first that would exceed ``longest``; lengths are positive, so that is
    the running sum up to it. A query's hits are few (the search's k).
    """
    return _running(hits).where(F.col("used") <= longest)


def _gathered(queries: DataFrame, hits: DataFrame, longest: int) -> DataFrame:
    """(query_id, query, context, n_used, n_given) of every query, the hits read once."""
    fitting = F.when(F.col("used") <= longest, F.struct("number", "piece"))
    parts = _running(hits).groupBy("query_id").agg(F.array_sort(F.collect_list(fitting)).alias("p"), F.count("*").alias("n_given"))
    context = F.coalesce(F.array_join(F.transform("p", lambda s: s["piece"]), "\n"), F.lit(""))
    out = queries.join(parts, "query_id", "left")
    return out.select("query_id", "query", context.alias("context"), F.when(F.col("p").isNull(), 0).otherwise(F.size("p")).alias("n_used"), F.coalesce("n_given", F.lit(0)).cast("int").alias("n_given"))


def contexts(queries: DataFrame, hits: DataFrame, longest: int = 3000) -> DataFrame:
    """(query_id, query, context, n_used) of every query; without a piece that fits the context is empty."""
    return _gathered(queries, hits, longest).drop("n_given")


def prompt(query: Column, context: Column) -> Column:
    before, after = PROMPT_TAIL.split("{query}")
    return F.concat(F.lit(PROMPT_HEAD), context, F.lit(before), query, F.lit(after))


def extractive(context: Column) -> Column:
    """A deterministic stand-in for a language model: the first line of the context that is a sentence."""
    return F.coalesce(F.nullif(F.regexp_extract(context, r"(?md)^(?!文档片段|【)(.+)$", 1), F.lit("")), F.lit(""))


def answers(queries: DataFrame, hits: DataFrame, longest: int = 3000, generate: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(query_id, query, answer, num_chunks_used, num_chunks_in_context, prompt_length) of every query.

    ``num_chunks_used`` counts the hits handed in, ``num_chunks_in_context`` those that fitted.
    """
    ctx = _gathered(queries, hits, longest).withColumn("prompt", prompt(F.col("query"), F.col("context")))
    answer = generate(F.col("prompt"), F.col("context")) if generate else extractive(F.col("context"))
    return ctx.select("query_id", "query", answer.alias("answer"), F.col("n_given").alias("num_chunks_used"), F.col("n_used").alias("num_chunks_in_context"), F.length("prompt").alias("prompt_length"))
