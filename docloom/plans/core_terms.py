"""Queries of the two general operators for training data: term counts and splitting oversized texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.oversize import split_oversized
from docloom.operators.termcount import count_terms, mark_terms
from docloom.session import table


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "test_semantic_chunks")
    counts = count_terms(chunks, F.col("chunk_id"), {"key_terms": F.col("metadata.key_terms"), "trigger_words": F.col("metadata.trigger_words")})
    total = chunks.select(F.count_distinct("chunk_id")).scalar()
    return mark_terms(counts.where("n = 1"), total)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).where("mark is not null").select("field", F.element_at("gram", 1).alias("term"), "mark")


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).select("field", F.element_at("gram", 1).alias("term"), "occurrences", "records", F.coalesce("mark", F.lit("")).alias("mark"))


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring values in the lists."""
    chunks = table(spark, sf_dir, "test_semantic_chunks")
    counts = count_terms(chunks, F.col("chunk_id"), {"key_terms": F.col("metadata.key_terms"), "trigger_words": F.col("metadata.trigger_words")})
    return counts.where("n = 2").select("field", F.element_at("gram", 1).alias("first"), F.element_at("gram", 2).alias("second"), "occurrences", "records")


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "test_semantic_chunks"), table(spark, sf_dir, "split_limit"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).select("chunk_id").distinct()


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).dropDuplicates(["chunk_id", "piece_no"])


def p7_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each oversized chunk the text that its pieces' own parts make, whether all fit, and whether neighbours share just the overlap."""
    rows = p7_pieces(spark, sf_dir).join(table(spark, sf_dir, "test_semantic_chunks").select("chunk_id", F.col("metadata.chunk_type").alias("chunk_type")).distinct(), "chunk_id")
    rows = rows.join(table(spark, sf_dir, "split_limit"), "chunk_type")
    own = F.expr("substring(piece, overlap + 1, length(piece))")
    parts = rows.groupBy("chunk_id").agg(
        F.array_sort(F.collect_list(F.struct("piece_no", own.alias("own")))).alias("parts"),
        F.bool_and(F.length("piece") <= F.col("max_chars")).alias("within_limit"),
        F.bool_and(F.col("overlap") == F.when(F.col("piece_no") == 0, 0).otherwise(F.least("overlap_chars", F.col("start_pos") + F.col("overlap")))).alias("overlaps"),
    )
    return parts.select("chunk_id", F.array_join(F.transform("parts", lambda p: p["own"]), "").alias("text"), "within_limit", "overlaps")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p4_found, p4_counts, p4_pairs, p7_found, p7_pieces, p7_rejoined)}

_TERMS = """
terms AS (
  SELECT chunk_id, 'key_terms' AS field, unnest(metadata.key_terms) AS t FROM one UNION ALL
  SELECT chunk_id, 'trigger_words', unnest(metadata.trigger_words) FROM one),
clean AS (
  SELECT chunk_id, field, regexp_replace(t, '^[ 　]+|[ 　]+$', '', 'g') AS term FROM terms WHERE t IS NOT NULL),
counted AS (
  SELECT field, term, count(*) AS occurrences, count(DISTINCT chunk_id) AS records FROM clean WHERE term <> '' GROUP BY ALL),
marked AS (
  SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records * 10 > (SELECT count(*) FROM one) THEN 'common' END AS mark FROM counted)
"""
_ONE = "WITH one AS (SELECT DISTINCT ON (chunk_id) chunk_id, metadata FROM test_semantic_chunks WHERE chunk_id IS NOT NULL), "

ORACLE: dict[str, str] = {
    "p4_found": _ONE + _TERMS + "SELECT field, term, mark FROM marked WHERE mark IS NOT NULL",
    "p4_counts": _ONE + _TERMS + "SELECT field, term, occurrences, records, coalesce(mark, '') AS mark FROM marked",
    "p4_pairs": _ONE
    + """
      lists AS (
        SELECT chunk_id, field, list_filter(list_transform(ts, lambda t: regexp_replace(t, '^[ 　]+|[ 　]+$', '', 'g')), lambda t: t IS NOT NULL AND t <> '') AS ts
        FROM (SELECT chunk_id, 'key_terms' AS field, metadata.key_terms AS ts FROM one UNION ALL SELECT chunk_id, 'trigger_words', metadata.trigger_words FROM one)),
      pairs AS (SELECT chunk_id, field, ts, unnest(range(1, len(ts))) AS i FROM lists)
      SELECT field, ts[i] AS first, ts[i + 1] AS second, count(*) AS occurrences, count(DISTINCT chunk_id) AS records FROM pairs GROUP BY ALL""",
    "p7_rejoined": "SELECT DISTINCT chunk_id, text, true AS within_limit, true AS overlaps FROM test_semantic_chunks c JOIN split_limit l ON c.metadata.chunk_type = l.chunk_type WHERE length(c.text) > l.max_chars",
    "p7_found": "SELECT DISTINCT chunk_id FROM test_semantic_chunks c JOIN split_limit l ON c.metadata.chunk_type = l.chunk_type WHERE length(c.text) > l.max_chars",
}
