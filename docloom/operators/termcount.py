"""Frequency of every distinct value and run of values, by suffix-sorted n-gram counting.

Each record's list of values is cut into suffixes of at most ``sigma`` values. Suffixes are counted
map-side, routed by field, first value and a salt, sorted in reverse lexicographic order, and one pass
with a stack turns them into the counts of all their prefixes. Record counts need no sets: a suffix
carries the shortest prefix that its record had not shown before, and since prefixes nest, a prefix of
length l is new in its record exactly when l is at least that number.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spaces and U+3000 are trimmed; tabs and line ends stay.
_TRIM = r"^[ 　]+|[ 　]+$"

_SUFFIX = "field string, suffix array<string>, fresh int, n long"
_GRAM = "field string, gram array<string>, occurrences long, records long"


def clean_terms(terms: Column) -> Column:
    """The array without null and blank elements, each trimmed of spaces and U+3000; null gives an empty array."""
    trimmed = F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.regexp_replace(t, _TRIM, ""))
    return F.filter(trimmed, lambda t: t.isNotNull() & (t != ""))


def record_suffixes(terms: list[str], sigma: int) -> Iterator[tuple[tuple[str, ...], int]]:
    """The truncated suffixes of one record, each with the length of its shortest prefix not seen before in it."""
    seen: set[tuple[str, ...]] = set()
    for i in range(len(terms)):
        suffix = tuple(terms[i : i + sigma])
        fresh = 1
        while fresh <= len(suffix) and suffix[:fresh] in seen:
            fresh += 1
        for n in range(fresh, len(suffix) + 1):
            seen.add(suffix[:n])
        yield suffix, fresh


def _emit(sigma: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts: Counter = Counter()
            for field, terms in zip(pdf["field"], pdf["terms"]):
                for suffix, fresh in record_suffixes(list(terms), sigma):
                    counts[field, suffix, fresh] += 1
            if counts:
                yield pd.DataFrame([(f, list(s), fresh, n) for (f, s, fresh), n in counts.items()], columns=["field", "suffix", "fresh", "n"])

    return run


def stack_counts(rows: Iterator[tuple[str, list[str], int, int]]) -> Iterator[tuple[str, list[str], int, int]]:
    """Counts of all prefixes of suffixes that come in reverse lexicographic order by field and suffix.

    The stack holds the current suffix's values with the occurrences and records gathered below each;
    when the next suffix leaves a prefix, that prefix is final, is given out, and hands its occurrences
    to the one above.
    """
    field: str | None = None
    path: list[str] = []
    occurrences: list[int] = []
    records: list[int] = []

    def pop() -> tuple[str, list[str], int, int]:
        out = (field, list(path), occurrences[-1], records[-1])
        path.pop()
        n = occurrences.pop()
        records.pop()
        if occurrences:
            occurrences[-1] += n
        return out

    for f, suffix, fresh, n in rows:
        keep = 0
        if f == field:
            while keep < min(len(path), len(suffix)) and path[keep] == suffix[keep]:
                keep += 1
        while len(path) > keep:
            yield pop()
        field = f
        while len(path) < len(suffix):
            path.append(suffix[len(path)])
            occurrences.append(0)
            records.append(0)
        occurrences[len(suffix) - 1] += n
        for k in range(fresh - 1, len(suffix)):
            records[k] += n
    while path:
        yield pop()


def _stack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows() -> Iterator[tuple[str, list[str], int, int]]:
        for pdf in batches:
            yield from zip(pdf["field"], map(list, pdf["suffix"]), pdf["fresh"], pdf["n"])

    out = []
    for row in stack_counts(rows()):
        out.append(row)
        if len(out) == 20_000:
            yield pd.DataFrame(out, columns=["field", "gram", "occurrences", "records"])
            out = []
    if out:
        yield pd.DataFrame(out, columns=["field", "gram", "occurrences", "records"])


def count_terms(df: DataFrame, id_col: Column, fields: dict[str, Column], sigma: int = 2, salts: int = 16) -> DataFrame:
    """(field, gram, n, occurrences, records) of every run of up to ``sigma`` neighbouring values.

    Rows with the same id are one record, and are taken to be equal; rows without an id cannot be told
    apart and are left out. Null, blank and padded values are cleaned by ``clean_terms``; a null list is
    empty. An empty table gives no rows. Other columns of ``df`` are not touched.
    """
    base = df.select(id_col.alias("_id"), *(clean_terms(c).alias(f"_f{k}") for k, c in enumerate(fields.values())))
    base = base.where("_id is not null").dropDuplicates(["_id"])
    lists = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"_f{k}").alias("terms")) for k, f in enumerate(fields))))
    rows = base.select(lists.alias("r")).select("r.field", "r.terms").where(F.size("terms") > 0)
    suffixes = rows.mapInPandas(_emit(sigma), _SUFFIX)
    routed = suffixes.repartition("field", F.element_at("suffix", 1), F.pmod(F.xxhash64("suffix"), F.lit(salts)))
    ordered = routed.sortWithinPartitions(F.col("field").desc(), F.col("suffix").desc())
    partial = ordered.mapInPandas(_stack, _GRAM)
    total = partial.groupBy("field", "gram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return total.select("field", "gram", F.size("gram").alias("n"), "occurrences", "records")


def mark_terms(counts: DataFrame, n_records: Column, rare_below: int = 3, common_share: float = 0.1) -> DataFrame:
    """``counts`` with ``mark``: rare below ``rare_below`` records, common above ``common_share`` of all records, else null.

    A value that is both (few records altogether) is rare.
    """
    # the share is compared in whole numbers, as a millionth, so that a tie is a tie
    common = F.col("records") * 1_000_000 > n_records * round(common_share * 1_000_000)
    return counts.withColumn("mark", F.when(F.col("records") < rare_below, "rare").when(common, "common"))
