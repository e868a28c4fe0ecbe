"""Sinks: chunk tables and JSON, cleaned texts, lexicons, and skipping what is done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk_table(chunks: DataFrame, path: str, by: str | None = None, mode: str = "overwrite") -> None:
    """Chunks as Parquet, partitioned by a column if given."""
    writer = chunks.write.mode(mode)
    (writer.partitionBy(by) if by else writer).parquet(path)


def chunk_json(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Chunks as JSON lines, with null fields; ``sentence_infos`` only where there are any."""
    bare = F.to_json(F.struct(*(c for c in chunks.columns if c != "sentence_infos")), {"ignoreNullFields": "false"})
    if "sentence_infos" in chunks.columns:
        full = F.to_json(F.struct(*chunks.columns), {"ignoreNullFields": "false"})
        bare = F.when(F.coalesce(F.size("sentence_infos"), F.lit(0)) > 0, full).otherwise(bare)
    chunks.select(bare.alias("value")).write.mode(mode).text(path)


def chunk_arrays(chunks: DataFrame, path: str, by: str, per: int = 1_000, mode: str = "overwrite") -> None:
    """Chunks as JSON arrays, one a line, each of chunks of one document: about ``per`` of them, more arrays for more.

    So no document, however many chunks it has, comes into one array. Chunks without a document are one of their own.
    """
    rows = chunks.withColumn("_by", F.coalesce(F.col(by).cast("string"), F.lit("")))
    sizes = rows.groupBy("_by").agg(F.ceil(F.count("*") / per).alias("_parts"))
    json = F.to_json(F.struct(*chunks.columns), {"ignoreNullFields": "false"})
    parts = rows.select("_by", "chunk_id", json.alias("_json")).join(sizes, "_by").withColumn("_part", F.pmod(F.xxhash64("chunk_id"), "_parts"))
    arrays = parts.groupBy("_by", "_part").agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("_json")), ","), F.lit("]")).alias("value"))
    arrays.select("value").write.mode(mode).text(path)


def cleaned_text(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """(path, text) rows as Parquet, one row a document: no small file for each."""
    df.select("path", "text").write.mode(mode).parquet(path)


def text_files(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """(path, text) rows as plain text, a folder for each document by the name of its file."""
    name = F.regexp_replace(F.regexp_extract("path", r"([^/\\\\]+)$", 1), r"\.[^.]+$", "")
    df.where("text is not null").select("text", name.alias("document")).write.mode(mode).partitionBy("document").text(path)


def lexicon_json(lexicon: DataFrame) -> DataFrame:
    """One row: the lexicon as a JSON object {standard: [variants in order]}."""
    variants = lexicon.groupBy("standard").agg(F.min("ord").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "variant"))), lambda s: s["variant"]).alias("v"))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("first", "standard", "v"))), lambda s: F.struct(s["standard"], s["v"]))
    return variants.agg(F.to_json(F.map_from_entries(entries)).alias("json"))
