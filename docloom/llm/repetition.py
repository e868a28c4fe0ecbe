"""Repetition inside single documents, by suffix arrays.

Suffixes of a block of texts are ranked by prefix doubling. A first pass stops at the window length: texts
without any two equal windows are done. For the others the suffix array is completed, and neighbouring suffixes
give the longest-common-prefix intervals: each interval of the window's depth holds the places of one repeated
substring, and the spans of all its places but the first are united.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.ids import carried, carried_type
from docloom.llm.codepoints import blocks, kept

#: Letters ranked at once; a longer text is ranked alone. Bounds memory, changes no result.
_BLOCK = 1_000_000


def _ranks(key: np.ndarray) -> np.ndarray:
    """Dense ranks of the keys, from 1."""
    order = np.argsort(key)
    fresh = np.empty(len(key), dtype=np.int64)
    if len(key):
        sorted_ = key[order]
        steps = np.concatenate(([1], (sorted_[1:] != sorted_[:-1]).astype(np.int64)))
        fresh[order] = np.cumsum(steps)
    return fresh


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _ranks((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64))


def _shift(a: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(a)
    if by < len(a):
        out[: len(a) - by] = a[by:]
    return out


def window_ranks(letters: np.ndarray, window: int) -> np.ndarray:
    """Ranks of the windows that begin at each letter, regardless of text ends; zeros stand behind the end."""
    a = letters.astype(np.uint64)
    if window < 3:
        rank, have = _ranks(a), 1
    else:
        rank, have = _ranks((a << np.uint64(42)) | (_shift(a, 1) << np.uint64(21)) | _shift(a, 2)), 3
    while have < window:
        step = min(have, window - have)
        rank = _joined(rank, _shift(rank, step))
        have += step
    return rank


def repeats_windows(letters: np.ndarray, sizes: np.ndarray, window: int) -> np.ndarray:
    """Of each text, whether two of its windows are equal."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    valid = np.arange(len(letters)) + window <= np.repeat(np.cumsum(sizes), sizes)
    out = np.zeros(len(sizes), bool)
    # a rank and a text each as one number: what comes twice is a repetition inside a text
    key = np.sort((window_ranks(letters, window)[valid].astype(np.uint64) << np.uint64(32)) | doc[valid].astype(np.uint64))
    out[(key[1:][key[1:] == key[:-1]] & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
    return out


def suffix_array(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, and the longest common prefix of each with the one before (0 for the first).

    Prefix doubling until all ranks differ; the ranks of every doubling give the common prefixes. Takes about
    four bytes for each letter and doubling.
    """
    n = len(letters)
    levels = [_ranks(letters.astype(np.uint64)).astype(np.int32)]
    step = 1
    while levels[-1].max() < n and step < n:
        levels.append(_joined(levels[-1], _shift(levels[-1], step)).astype(np.int32))
        step *= 2
    order = np.argsort(levels[-1], kind="stable")
    left, right = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        inside = (left < n) & (right < n)
        same = np.zeros(n - 1, bool)
        same[inside] = levels[level][left[inside]] == levels[level][right[inside]]
        # behind the end a shorter suffix counts as filled with zeros; equal ranks then would overstate
        same &= (np.maximum(left, right) + (1 << level)) <= n
        lcp[1:][same] += 1 << level
        left[same] += 1 << level
        right[same] += 1 << level
    return order, lcp


def suffix_intervals(letters: np.ndarray, window: int) -> tuple[int, int, int]:
    """(repeated letters, longest repeated substring, maximal repeated substrings of at least ``window`` letters).

    A run of common prefixes of the window's length or more is an interval of suffixes that begin with the same
    window: all its places but the first are repetitions, and the spans of these windows are united. Within it, each
    rise of the common prefix opens an interval of suffixes that share a prefix no wider set shares.
    """
    n = len(letters)
    if n < 2:
        return 0, 0, 0
    order, lcp = suffix_array(letters)
    deep = lcp >= window
    starts = np.flatnonzero(~deep)
    first = np.minimum.reduceat(order, starts)
    interval = np.cumsum(~deep) - 1
    later = order[order != first[interval]]
    # union of the spans [start, start + window): marks of begins and ends, summed up
    edge = np.zeros(n + window + 1, np.int32)
    np.add.at(edge, later, 1)
    np.add.at(edge, later + window, -1)
    covered = int((np.cumsum(edge)[:n] > 0).sum())
    opens = deep & (lcp > np.concatenate(([0], lcp[:-1])))
    return covered, int(lcp.max(initial=0)), int(opens.sum())


def repetition(texts: list[str | None], window: int) -> list[tuple[int, int, int, int]]:
    """(letters, repeated letters, longest repeat, maximal repeats) of each text; of a null text all are 0.

    A letter is repeated when it lies in a window of ``window`` letters that equals one starting earlier.
    """
    out: list[tuple[int, int, int, int]] = [(0, 0, 0, 0)] * len(texts)
    rows = [t or "" for t in texts]
    for first, last in blocks([len(t) for t in rows], _BLOCK):
        letters, sizes = kept(rows[first:last], "L")
        again = repeats_windows(letters, sizes, window)
        ends = np.cumsum(sizes).tolist()
        for k, (n, e) in enumerate(zip(sizes.tolist(), ends)):
            # the letters in no repeated window have no part in what follows
            covered, longest, spans = suffix_intervals(letters[e - n : e], window) if again[k] else (0, 0, 0)
            out[first + k] = (n, covered, longest, spans)
    return out


def _measure(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = np.array(repetition(pdf["text"].tolist(), window), dtype=np.int64).reshape(-1, 4)
            yield pd.DataFrame({"id": pdf["id"], "n_letters": found[:, 0], "repeated_letters": found[:, 1], "longest_repeat": found[:, 2], "n_repeats": found[:, 3]})

    return run


def repeated_share(df: DataFrame, id_col: str, text_col: str, window: int = 20, min_share: float = 0.3, max_longest: int | None = None) -> DataFrame:
    """(id, n_letters, repeated_letters, repeated_share, longest_repeat, n_repeats, excessive) of every row.

    ``excessive`` holds where the repeated letters reach ``min_share`` of the letters, or the longest repeat
    ``max_longest`` letters, if given. A null or empty text, or one without letters, has a share of 0 and is
    not excessive. Rows stored twice come out twice. Texts are measured whole, whatever their length; no
    shuffle is needed.
    """
    kind = df.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    rows = df.select(carried(F.col(id_col), kind).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInPandas(_measure(window), f"id {carried_type(kind)}, n_letters long, repeated_letters long, longest_repeat long, n_repeats long")
    share = F.when(F.col("n_letters") > 0, F.col("repeated_letters") / F.col("n_letters")).otherwise(F.lit(0.0))
    # in millionths, so that a share of exactly the limit counts
    over = (F.col("n_letters") > 0) & (F.col("repeated_letters") * 1_000_000 >= F.col("n_letters") * round(min_share * 1_000_000))
    if max_longest is not None:
        over |= F.col("longest_repeat") >= max_longest
    return out.select(F.col("id").cast(kind).alias(id_col.split(".")[-1]), "n_letters", "repeated_letters", share.alias("repeated_share"), "longest_repeat", "n_repeats", over.alias("excessive"))
