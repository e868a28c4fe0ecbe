"""Queries of the operators in this subpackage, with SQL where DuckDB can run it over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.leakage import find_leaks
from docloom.llm.markup import strip_markup
from docloom.llm.mixing import Mixture
from docloom.llm.repetition import repeated_share
from docloom.llm.scannoise import ScanRepair
from docloom.llm.sentences import learn, split_sentences
from docloom.llm.sharedspans import SharedSpans
from docloom.llm.siteboiler import SiteLines
from docloom.session import table

#: A public tokenizer's file, on the machines of the tests.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
INTL = "metadata.source_file like 'data/cleaned/intl/%'"
SCANNED = "(metadata.source_file like 'data/cleaned/scan/%' or metadata.source_file like 'data/cleaned/policy/%')"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "test_semantic_chunks")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the clusters' lines; the exact check asks that this very line be in five chunks
    return SiteLines(_chunks(spark, sf_dir)).repeated().where("line_docs >= 5").select("chunk_id", "line_no").distinct()


def p1_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    marked = chunks.groupBy("chunk_id").agg(F.max(F.size(F.coalesce("metadata.skip_sentences", F.array().cast("array<int>")))).alias("marked_before"))
    return SiteLines(chunks).cleaned(chunks).join(marked, "chunk_id").dropDuplicates(["chunk_id"])


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are removed for their near-duplicates only: too rare themselves, of a cluster in five chunks or more."""
    return SiteLines(_chunks(spark, sf_dir)).repeated().where("line_docs < 5").select("chunk_id", "line_no", "line_docs", "cluster_docs")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    return split_sentences(chunks.where(INTL), learn(chunks)).select("chunk_id", "end_pos").distinct()


def p2_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    return split_sentences(chunks, learn(chunks)).dropDuplicates(["chunk_id", "sentence_no"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    return ScanRepair(chunks.where(SCANNED), chunks).kinds()


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    return ScanRepair(chunks.where(SCANNED), chunks).repaired()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_share(_chunks(spark, sf_dir), "chunk_id", "text").where("excessive").select("chunk_id").distinct()


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    marked = chunks.groupBy("chunk_id").agg(F.max(F.size(F.coalesce("metadata.skip_sentences", F.array().cast("array<int>")))).alias("marked_sentences"))
    return repeated_share(chunks, "chunk_id", "text").dropDuplicates(["chunk_id"]).join(marked, "chunk_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip_markup(_chunks(spark, sf_dir)).select("chunk_id", F.explode("markup_kinds").alias("markup_kind")).distinct()


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip_markup(_chunks(spark, sf_dir)).dropDuplicates(["chunk_id"])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id").distinct()


def p8_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).distinct()


def _mixture(spark: SparkSession, sf_dir: str, total: str | None = None) -> Mixture:
    return Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"), TOKENIZER, total)


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).report()


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).used()


def p9_tempered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tokens as the sources hold, as near to the targets as the limits of repetition let them come: the exponent is below 1."""
    return _mixture(spark, sf_dir, "held").report()


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SharedSpans(table(spark, sf_dir, "documents")).pairs().select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SharedSpans(table(spark, sf_dir, "documents")).shares()


def p10_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SharedSpans(table(spark, sf_dir, "documents")).spans().withColumnRenamed("id", "doc_id")


def p10_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SharedSpans(table(spark, sf_dir, "documents")).groups().withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_cleaned, p1_clusters, p2_found, p2_sentences, p3_found, p3_repaired, p5_found, p5_shares, p6_found, p6_clean, p8_found, p8_containment, p9_report, p9_mixture, p9_tempered, p10_found, p10_shares, p10_spans, p10_groups)
}

_WIDE = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Windows of 200 characters that stand in several documents.
_WINDOWS = """WITH one AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 200),
      windows AS (SELECT doc_id, pos, md5(substring(text, pos + 1, 200)) AS passage FROM (SELECT doc_id, text, unnest(range(0, length(text) - 199)) AS pos FROM one)),
      several AS (SELECT passage FROM windows GROUP BY passage HAVING min(doc_id) <> max(doc_id)),
      places AS (SELECT doc_id, pos, passage FROM windows JOIN several USING (passage))"""

#: NFKC as far as letters and digits of these tables have compatible forms: full-width ones, and the Thai vowel that is two.
_NFKC = "replace(translate(text, '" + "".join(chr(0xFEE0 + ord(c)) for c in _WIDE) + f"', '{_WIDE}'), chr(3635), chr(3634))"
_NORMALISED = f"""WITH docs AS (SELECT DISTINCT doc_id, regexp_replace(lower({_NFKC}), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
      items AS (SELECT DISTINCT item_id, regexp_replace(lower({_NFKC}), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS t FROM benchmark WHERE text IS NOT NULL),
      item_windows AS (SELECT item_id, pos, substring(t, pos, 40) AS w FROM (SELECT item_id, t, unnest(range(1, length(t) - 38)) AS pos FROM items)),
      doc_windows AS (SELECT doc_id, substring(t, pos, 40) AS w FROM (SELECT doc_id, t, unnest(range(1, length(t) - 38)) AS pos FROM docs))"""

ORACLE: dict[str, str] = {
    "p1_found": r"""
      WITH lines AS (
        SELECT chunk_id, metadata.source_file AS source, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line
        FROM (SELECT DISTINCT chunk_id, text, metadata FROM test_semantic_chunks)
        WHERE chunk_id IS NOT NULL AND text IS NOT NULL AND metadata.source_file IS NOT NULL),
      keyed AS (
        SELECT chunk_id, source, line_no, regexp_replace(regexp_replace(line, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', '', 'g'), '[0-9]+', '0', 'g') AS key FROM lines),
      repeated AS (
        SELECT source, key FROM keyed WHERE regexp_matches(key, '[\p{L}\p{N}]') GROUP BY ALL HAVING count(DISTINCT chunk_id) >= 5)
      SELECT DISTINCT chunk_id, line_no::INT AS line_no FROM keyed JOIN repeated USING (source, key)""",
    "p5_found": r"""
      WITH one AS (SELECT DISTINCT chunk_id, regexp_replace(text, '[^\p{L}]', '', 'g') AS letters FROM test_semantic_chunks WHERE text IS NOT NULL),
      windows AS (SELECT chunk_id, length(letters) AS n, i, substring(letters, i, 20) AS w FROM (SELECT chunk_id, letters, unnest(range(1, length(letters) - 18)) AS i FROM one)),
      later AS (SELECT chunk_id, n, i FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, w ORDER BY i) AS k FROM windows) WHERE k > 1),
      own AS (SELECT chunk_id, n, least(20, coalesce(lead(i) OVER (PARTITION BY chunk_id ORDER BY i) - i, 20)) AS letters FROM later)
      SELECT chunk_id FROM own GROUP BY chunk_id, n HAVING sum(letters) * 10 >= n * 3""",
    "p8_found": _NORMALISED + """
      SELECT DISTINCT d.doc_id, i.item_id FROM doc_windows d JOIN item_windows i USING (w)""",
    "p8_containment": _NORMALISED + """,
      shared AS (SELECT doc_id, i.item_id, i.pos FROM item_windows i JOIN (SELECT DISTINCT doc_id, w FROM doc_windows) d USING (w)),
      held AS (SELECT item_id, count(*) AS item_windows FROM item_windows GROUP BY item_id)
      SELECT doc_id, item_id, count(*)::INT AS shared_windows, item_windows::INT AS item_windows, count(*) / item_windows::DOUBLE AS containment FROM shared JOIN held USING (item_id) GROUP BY doc_id, item_id, item_windows""",
    "p10_found": _WINDOWS + """
      SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM places a JOIN places b USING (passage) WHERE a.doc_id < b.doc_id""",
    "p10_spans": _WINDOWS + """,
      islands AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM (SELECT DISTINCT doc_id, pos FROM places))
      SELECT doc_id, min(pos)::INT AS start_pos, (max(pos) + 200)::INT AS end_pos FROM islands GROUP BY doc_id, island""",
    "p10_shares": _WINDOWS + """,
      spans AS (SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS following FROM (SELECT DISTINCT doc_id, pos FROM places)),
      covered AS (SELECT doc_id, sum(least(200, coalesce(following - pos, 200)))::BIGINT AS shared_chars FROM spans GROUP BY doc_id)
      SELECT doc_id, length(text)::INT AS n_chars, shared_chars, shared_chars / length(text)::DOUBLE AS shared_share FROM covered JOIN one USING (doc_id)""",
}
