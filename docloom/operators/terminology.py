"""Terms and their variants, as a table (standard, variant, ord) or a small dictionary."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.profiles import ZH_TERMS

#: Variants of a dictionary that is compiled into an expression; a larger lexicon is joined.
MAX_LITERAL = 5_000


def default_lexicon(spark: SparkSession, terms: dict[str, list[str]] = ZH_TERMS) -> DataFrame:
    rows = [(s, v) for s, variants in terms.items() for v in variants]
    return spark.createDataFrame([(s, v, k + 1) for k, (s, v) in enumerate(rows)], "standard string, variant string, ord int")


def variant_index(lexicon: DataFrame) -> DataFrame:
    """(variant, standard): each variant's term; of several the one of the highest ord, then the greatest."""
    known = lexicon.where("variant is not null and variant <> '' and standard is not null")
    return known.groupBy("variant").agg(F.max(F.struct(F.coalesce("ord", F.lit(0)).alias("o"), "standard")).alias("m")).select("variant", F.col("m.standard").alias("standard"))


def standard_terms(lexicon: DataFrame) -> DataFrame:
    return lexicon.select("standard").where("standard is not null").distinct()


def add_terms(lexicon: DataFrame, more: DataFrame) -> DataFrame:
    """The lexicon with the terms of ``more`` in place of its own of the same name, behind all others in order."""
    top = lexicon.agg(F.coalesce(F.max("ord"), F.lit(0))).scalar()
    kept = lexicon.join(more.select("standard").distinct(), "standard", "left_anti").select("standard", "variant", "ord")
    return kept.unionByName(more.select("standard", "variant", (F.col("ord") + top).alias("ord")))


def remove_terms(lexicon: DataFrame, gone: DataFrame) -> DataFrame:
    """The lexicon without the terms of ``gone`` and without any variant that these list, whatever term it stands for."""
    names = gone.select("standard").distinct()
    variants = lexicon.join(names, "standard", "left_semi").select("variant").distinct()
    return lexicon.join(names, "standard", "left_anti").join(variants, "variant", "left_anti").select("standard", "variant", "ord")


def extract_terms(text: Column, terms: dict[str, list[str]]) -> Column:
    """The sorted standard terms of which a variant occurs in the text, for a small dictionary."""
    index = {v: s for s, variants in terms.items() for v in variants}
    if len(index) > MAX_LITERAL:
        raise ValueError(f"a dictionary of over {MAX_LITERAL} variants is joined: see terms_by_join")
    by_term: dict[str, list[str]] = {}
    for v, s in index.items():
        by_term.setdefault(s, []).append(v)
    found = [F.when(reduce(or_, (text.contains(v) for v in variants)), F.lit(s)) for s, variants in sorted(by_term.items())]
    return F.when(text.isNotNull(), F.array_sort(F.array_compact(F.array(*found)))) if found else F.array().cast("array<string>")


def terms_of(texts: DataFrame, id_col: str, text_col: str, lexicon: DataFrame) -> DataFrame:
    """(id, standard) of the terms of which a variant occurs in a text.

    A lexicon of at most ``MAX_LITERAL`` variants becomes an expression and nothing is shuffled but the
    result; a larger one is joined.
    """
    known = variant_index(lexicon).limit(MAX_LITERAL + 1).collect()
    if len(known) > MAX_LITERAL:
        return terms_by_join(texts, id_col, text_col, lexicon)
    terms: dict[str, list[str]] = {}
    for r in known:
        terms.setdefault(r["standard"], []).append(r["variant"])
    return texts.select(id_col, F.explode(extract_terms(F.col(text_col), terms)).alias("standard")).distinct()


def terms_by_join(texts: DataFrame, id_col: str, text_col: str, lexicon: DataFrame, gram: int = 2) -> DataFrame:
    """(id, standard) of the terms of which a variant occurs in a text, for a lexicon of any size.

    Variants meet texts by their first ``gram`` characters, an equi-join on distinct grams of the text, and
    are then looked for whole; variants shorter than ``gram`` meet by their own length.
    """
    index = variant_index(lexicon).withColumn("g", F.least(F.lit(gram), F.length("variant"))).withColumn("key", F.expr("substring(variant, 1, g)"))
    text = F.col(text_col)

    def grams_of(g: int) -> Column:
        places = F.when(F.length(text) >= g, F.sequence(F.lit(1), F.length(text) - (g - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.substring(text, i, F.lit(g)))

    keys = F.explode(F.array_distinct(F.concat(*map(grams_of, range(1, gram + 1)))))
    grams = texts.where(text.isNotNull()).select(id_col, keys.alias("key"))
    near = grams.join(index, "key").select(id_col, "variant", "standard")
    return near.join(texts.select(id_col, text_col), id_col).where(F.contains(text, F.col("variant"))).select(id_col, "standard").distinct()
