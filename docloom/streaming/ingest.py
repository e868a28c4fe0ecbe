"""Streaming ingestion (an extension): new Markdown files become chunks as they arrive; event windows with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.structure import chunks


def markdown_stream(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """(path, text) of the files of a folder, old and new."""
    raw = spark.readStream.option("wholetext", "true").option("pathGlobFilter", pattern).text(folder)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def ingest(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Each micro-batch through ``transform`` (by default, chunking) into ``sink``; what is there is taken, then it ends.

    The checkpoint remembers the files that are done, which replaces looking for their results.
    """
    work = transform or (lambda df: chunks(df, "path"))
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: sink(work(df), n)).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts by key and time window; rows later than ``late`` behind the newest are dropped, as a watermark means."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
