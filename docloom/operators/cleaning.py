"""Cleaning of document texts, sentence rows, and marks on boilerplate and repetition."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import text as X
from docloom.functions import textlogic
from docloom.profiles import ZH, Profile


def join_broken_lines(text: Column, profile: Profile = ZH) -> Column:
    """Unfinished lines of a text joined with the next, in pairs; null stays null."""
    stops = profile.terminators

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: textlogic.join_broken_lines(t, stops), na_action="ignore")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.StringType())(text)


def basic_clean(text: Column, profile: Profile = ZH, least_repeat: int = 20) -> Column:
    """Page numbers, headers and footers removed and broken lines joined, around tables and images; null stays null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: textlogic.basic_clean(t, profile, least_repeat), na_action="ignore")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.StringType())(text)


def line_rows(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, pos, line); a null text has no lines."""
    return df.select(id_col, F.posexplode(X.lines(F.col(text_col))).alias("pos", "line"))


def sentence_rows(df: DataFrame, id_col: str, text_col: str = "text", profile: Profile = ZH) -> DataFrame:
    """(id, pos, sentence), blank lines included as they stand; a null text has none."""
    return df.select(id_col, F.posexplode(X.sentences(F.col(text_col), profile)).alias("pos", "sentence"))


def denoise(rows: DataFrame, id_col: str, repeat: int = 3, profile: Profile = ZH) -> DataFrame:
    """Sentence rows with ``repeats``, ``reason`` (boilerplate, repetitive or empty) and ``skip_embedding``.

    A sentence that comes ``repeat`` times or more in its document is repetitive, boilerplate goes first, a
    blank one is never skipped. The rows are partitioned by document and sentence, so a long document is
    spread over tasks, and its blank lines are too; counts are aggregated before the exchange and joined back.
    """
    # blank lines have no count to be joined: they go to any task, under keys that no sentence has
    spread = F.concat(F.lit("\n"), F.pmod(F.monotonically_increasing_id(), F.lit(4096)).cast("string"))
    keyed = rows.withColumn("_key", X.strip(F.col("sentence"))).withColumn("_at", F.when(F.col("_key") == "", spread).otherwise(F.col("_key")))
    times = keyed.where("_key <> ''").groupBy(id_col, "_key").agg(F.count("*").alias("repeats")).where(F.col("repeats") >= repeat)
    out = keyed.join(times.withColumnRenamed("_key", "_at"), [id_col, "_at"], "left").drop("_at").withColumn("repeats", F.coalesce("repeats", F.lit(0)))
    reason = F.when(F.col("_key") == "", "").when(X.is_boilerplate(F.col("_key"), profile), "boilerplate").when(F.col("repeats") >= repeat, "repetitive").otherwise("")
    return out.withColumn("reason", reason).withColumn("skip_embedding", F.col("reason") != "").drop("_key")


def clean_and_split(df: DataFrame, id_col: str, text_col: str = "text", repeat: int = 3, profile: Profile = ZH) -> DataFrame:
    """Cleaning, sentences and marks in one."""
    cleaned = df.select(id_col, basic_clean(F.col(text_col), profile).alias("text"))
    return denoise(sentence_rows(cleaned, id_col, "text", profile), id_col, repeat, profile)
