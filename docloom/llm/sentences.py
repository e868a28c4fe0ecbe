"""Sentence boundaries across languages and scripts, with statistics learned from the texts themselves.

One pass counts, for each language: words with and without a final period, what stands at the beginning of
lines and behind unmistakable ends, what follows a closing quotation or an ellipsis, and which word follows which
period. Log-likelihood ratios over these counts tell abbreviations (words that keep company with a period) and
sentence starters (words drawn to beginnings) and collocations (words drawn to the number before a period). A second pass decides each candidate with them. Scripts
without spaces use the first characters in place of the first word; Thai has no marks, so its spaces are
the candidates.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pandas as pd
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.ids import carried, carried_type
from docloom.session import cut_lineage

# Marks of the scripts, not of any language's vocabulary.
FULL_STOPS = "。！？｡।॥؟!?።။۔"
CLOSERS = "\"”’」』）)】》〉»“]"
PAIRS = {"“": "”", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "《": "》", "〈": "〉", "«": "»", "„": "“"}
INVISIBLE = "​‌‍‎‏⁠﻿­"
#: Frequent function words, used only to tell apart languages of the Latin script that may be known; others are counted
#: together as one. Every other script that puts spaces between words counts as a language.
LATIN_HINTS = {
    "en": frozenset("the and of for is are a an to by with on in that when".split()),
    "de": frozenset("der die das und nicht ein eine ist von zum bei dem den".split()),
    "fr": frozenset("le la les et un une des du est au selon sans pour".split()),
}

_ARABIC = re.compile(r"\p{Arabic}")
_DEVANAGARI = re.compile(r"\p{Devanagari}")
_SCRIPTS = [(name.lower(), re.compile(rf"\p{{{name}}}")) for name in ("Cyrillic", "Greek", "Hebrew", "Bengali", "Tamil")]
_ELLIPSIS = re.compile(r"…+|\.{3,}")
_LATIN_WORD = re.compile(r"\p{Latin}+")
_NUMBER = re.compile(r"\d[\d.,]*")
_ONLY_NUMBER = re.compile(r"[\d.,]+")
_LAST_TOKEN = re.compile(r"[^\s　]+$")
_SPACES = re.compile(r"[ \xa0　]+")
_SPACED = re.compile(r"[\p{Latin}\p{Cyrillic}\p{Greek}\p{Arabic}\p{Hebrew}\p{Devanagari}\p{Bengali}\p{Tamil}]")
_THAI = re.compile(r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
_CJK = re.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}々〇]")
_WORDS = re.compile(r"[^\s　]+")
_STRIP = " \t\r\f\v　\xa0" + INVISIBLE
_EDGE = "\"“”‘’«»„「」『』（）()[]【】《》〈〉,;:，、；：!?！？。।؟…—–" + INVISIBLE
_OPENER = re.compile(r"[\"“「『（(\[【《〈«„]")
_AFTER_END = frozenset(FULL_STOPS + CLOSERS + ".:…")
_END = re.compile(rf"[{re.escape(FULL_STOPS)}]+[{re.escape(CLOSERS)}]*")
_THAI_STEM = 4
_CJK_STEM = 2

_STAT = "lang string, kind string, word string, next string, n long"


def latin_language(words: list[str]) -> str:
    votes = {k: sum(w in v for w in words) for k, v in LATIN_HINTS.items()}
    best = max(votes.values())
    first = [k for k, n in votes.items() if n == best]
    return first[0] if best and len(first) == 1 else "latin"


@cache
def _script(c: str) -> str | None:
    """The script of a character; None for marks and spaces that belong to none."""
    if _CJK.match(c):
        return "cjk"
    if _THAI.match(c):
        return "thai"
    if _SPACED.match(c):
        return "spaced"
    if c.isdigit():
        return "digit"
    return None if c in _EDGE or c.isspace() else "other"


def script_of(text: str) -> str:
    """The script that a piece of text begins with: spaced, thai, cjk, digit, or other."""
    for c in text:
        if kind := _script(c):
            return kind
    return "other"


def line_language(line: str) -> str:
    """The language of the words of a line in spaced scripts; only these need one."""
    if _ARABIC.search(line):
        return "ar"
    if _DEVANAGARI.search(line):
        return "hi"
    words = _LATIN_WORD.findall(line)
    if words:
        return latin_language([w.lower() for w in words])
    return next((name for name, pattern in _SCRIPTS if pattern.search(line)), "none")


def word_type(token: str) -> str:
    """A word for counting, as it is written: its numbers as one sign, without a final period and outer marks."""
    core = token.strip(_EDGE)
    core = core[:-1] if core.endswith(".") else core
    return _NUMBER.sub("#", core) if any(map(str.isdigit, core)) else core


def first_key(text: str, lang: str) -> tuple[str, str] | None:
    """(language, beginning) by which the starts of sentences are counted; None where nothing begins."""
    rest = text.lstrip(_STRIP + _EDGE)
    if not rest:
        return None
    kind = script_of(rest)
    if kind == "cjk":
        return "cjk", rest[:_CJK_STEM]
    if kind == "thai":
        return "thai", rest[:_THAI_STEM]
    if kind != "spaced":
        return "any", "#" if kind == "digit" else rest[:1]
    m = _WORDS.match(rest)
    return lang, word_type(m[0]) if m else rest[:1]


def quoted(line: str) -> list[int]:
    """For each character, how many quotations and brackets are open before it; openers without a closer open nothing."""
    depth = [0] * (len(line) + 1)
    if not _OPENER.search(line):
        return depth
    stack: list[tuple[str, int]] = []
    spans = []
    for i, c in enumerate(line):
        if c == '"':
            if stack and any(x == '"' for x, _ in stack):
                while stack[-1][0] != '"':
                    stack.pop()
                spans.append((stack.pop()[1], i))
            else:
                stack.append(('"', i))
        elif stack and any(c == x for x, _ in stack):
            while stack[-1][0] != c:
                stack.pop()
            spans.append((stack.pop()[1], i))
        elif c in PAIRS:
            stack.append((PAIRS[c], i))
    for a, b in spans:
        for i in range(a + 1, b + 1):
            depth[i] += 1
    return depth


def line_counts(line: str, counts: Counter) -> None:
    """The statistics of one line, added to ``counts`` by (language, kind, word, next)."""
    text = line.strip(_STRIP)
    if not text:
        return
    lang = line_language(text)
    if start := first_key(text[:40], lang):
        counts[start[0], "start", start[1], ""] += 1
    plain = None
    for m in _END.finditer(text):
        marks = m[0]
        rest = text[m.end() : m.end() + 80]
        if not rest.strip(_STRIP):
            continue
        plain = plain if plain is not None else quoted(text)
        if plain[m.start()] and plain[m.end()]:
            continue
        nxt = first_key(rest[:60], lang)
        if nxt is None:
            continue
        closed = marks[-1] in CLOSERS
        head = rest.lstrip(_STRIP)[0]
        if closed:
            if not (head in _EDGE and head not in PAIRS and head != '"'):
                counts[nxt[0], "quote", nxt[1], ""] += 1
        elif nxt[0] in ("cjk", "thai") or not head.islower():
            counts[nxt[0], "start", nxt[1], ""] += 1
    for m in _ELLIPSIS.finditer(text):
        nxt = first_key(text[m.end() :][:60], lang)
        if nxt and nxt[0] == "cjk" and text[m.end()] not in _AFTER_END:
            counts["cjk", "ellipsis", nxt[1], ""] += 1
    if lang != "none" or _THAI.search(text):
        tokens = _WORDS.findall(text)
        for k, token in enumerate(tokens):
            kind = script_of(token)
            if kind == "thai":
                counts["thai", "word", token.lstrip(_EDGE)[:_THAI_STEM], ""] += 1
                continue
            if kind == "cjk":
                continue
            where = lang if kind == "spaced" else "any"
            bare = token.rstrip("\"”’」』）)】»]")
            dotted = bare.endswith(".") and not bare.endswith("..")
            word = "#" if kind == "digit" else word_type(bare)
            if not word:
                continue
            counts[where, "dot" if dotted else "word", word, ""] += 1
            if k and kind == "spaced" and tokens[k - 1][-1] not in _AFTER_END:
                counts[where, "mid", word, ""] += 1
            if dotted and k + 1 < len(tokens):
                after = tokens[k + 1].lstrip(_EDGE)
                if after and script_of(after) in ("spaced", "digit"):
                    counts[lang, "pair", word, "#lower" if after[0].islower() else "#digit" if after[0].isdigit() else word_type(after)] += 1


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        counts: Counter = Counter()
        for text in pdf["text"]:
            if text:
                for line in text.split("\n"):
                    line_counts(line, counts)
        if counts:
            yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["lang", "kind", "word", "next", "n"])


def _log_likelihood(k: F.Column, n: F.Column, p0: F.Column) -> F.Column:
    """Twice the log-likelihood ratio of k hits in n under their own rate against the rate p0."""
    own = F.least(F.greatest(k / n, F.lit(1e-6)), F.lit(1 - 1e-6))
    base = F.least(F.greatest(p0, F.lit(1e-6)), F.lit(1 - 1e-6))
    return 2 * (k * (F.log(own) - F.log(base)) + (n - k) * (F.log(1 - own) - F.log(1 - base)))


@dataclass
class SentenceModel:
    """Abbreviations, starters, continuations of quotations and collocations over a period by language: what the decisions need."""

    abbreviations: set[tuple[str, str]] = field(default_factory=set)
    starters: set[tuple[str, str]] = field(default_factory=set)
    continuations: set[tuple[str, str]] = field(default_factory=set)
    collocations: set[tuple[str, str]] = field(default_factory=set)


def count_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(lang, kind, word, next, n) counted over all rows, and written, since several tables are made of it."""
    raw = df.select(F.col(text_col).alias("text")).where("text is not null").mapInPandas(_count, _STAT)
    return cut_lineage(raw.groupBy("lang", "kind", "word", "next").agg(F.sum("n").alias("n")))


def learn_tables(stats: DataFrame, least: int = 1, min_ratio: float = 7.88) -> DataFrame:
    """(kind, lang, word) of the abbreviations, starters, continuations and collocations seen ``least`` times."""
    single = stats.where("kind <> 'pair'").groupBy("lang", F.col("word").alias("w")).agg(
        *(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(f"n_{k}") for k in ("start", "quote", "word", "dot", "mid", "ellipsis"))
    )
    totals = single.groupBy("lang").agg(F.sum("n_start").alias("all_start"), F.sum("n_quote").alias("all_quote"), F.sum(F.col("n_word") + F.col("n_dot")).alias("all_words"), F.sum("n_dot").alias("all_dots"))
    known = single.join(totals, "lang")
    seen = F.col("n_word") + F.col("n_dot")
    # scripts without spaces have no count of all words: there a start is held against what follows quotations
    rate = F.col("n_start") / F.greatest(seen, F.col("n_start"))
    drawn = _log_likelihood(F.col("n_start"), F.greatest(seen, F.col("n_start")), F.col("all_start") / F.greatest(F.col("all_words"), F.lit(1)))
    spaced = (F.col("all_words") > 0) & (F.col("lang") != "cjk")
    starter = spaced & (F.col("n_start") >= least) & (((rate > F.col("all_start") / F.col("all_words")) & (drawn > min_ratio) & (rate > 0.04)) | (rate >= 0.3))
    # every space of Thai text is counted, sentence or not: a beginning is what lines begin with not far below the average
    starter |= (F.col("lang") == "thai") & (F.col("n_start") >= max(2, least)) & (rate >= 0.4 * F.col("all_start") / F.col("all_words"))
    # behind an ellipsis goes on what stands there more often than it begins a sentence
    starter |= (F.col("lang") == "cjk") & (F.col("n_ellipsis") > 0) & (F.col("n_start") >= least) & (F.col("n_start") >= F.col("n_ellipsis"))
    # what follows closing quotations far more often than it begins sentences goes on with the sentence
    n = F.col("n_start") + F.col("n_quote")
    goes_on = (F.col("n_quote") >= max(2, least)) & (_log_likelihood(F.col("n_quote"), n, F.col("all_quote") / (F.col("all_quote") + F.col("all_start"))) > min_ratio) & (F.col("n_quote") / n > 0.6)
    judged = known.select("lang", F.col("w").alias("word"), "n_start", "n_word", "n_dot", "n_mid", "all_words", "all_dots", starter.alias("starter"), goes_on.alias("goes_on"))
    # an abbreviation: the period's affinity, weakened by length and by occurrences without one, and a following word that begins no sentence
    pairs = stats.where("kind = 'pair'").select("lang", "word", "next", "n")
    begins = judged.where("starter").select("lang", F.col("word").alias("next"), F.lit(1).alias("b"))
    inside = pairs.join(begins, ["lang", "next"], "left").groupBy("lang", "word").agg(F.sum("n").alias("followed"), F.sum(F.when(F.col("b").isNull(), F.col("n")).otherwise(0)).alias("inside"))
    length = F.length(F.regexp_replace("word", r"\.", ""))
    affinity = _log_likelihood(F.col("n_dot"), F.col("n_dot") + F.col("n_word"), F.col("all_dots") / F.col("all_words"))
    score = affinity * F.exp(-length / 3) * (1 + F.length("word") - length) * F.pow(length, -F.col("n_word") / (1 + F.col("n_dot")))
    short = judged.where(f"n_dot >= {least} and all_words > 0").join(inside, ["lang", "word"])
    abbreviation = (F.col("n_dot") > F.col("n_word")) & (score >= 0.3) & (F.col("inside") * 5 >= F.col("followed")) & ~F.col("word").contains("#")
    # collocations over a period: what begins no sentence, and stands behind numbers or single letters far more often than
    # its share of all words lets expect, and there for a good part, as months do behind the day
    behind = pairs.where("(word = '#' or length(word) = 1) and next not like '#%'").join(inside.select("lang", "word", "followed"), ["lang", "word"])
    behind = behind.select("lang", F.col("word").alias("first"), F.col("next").alias("word"), F.col("n").alias("n_behind"), "followed")
    told = behind.join(judged.where("n_start = 0 and all_words > 0"), ["lang", "word"])
    bound = _log_likelihood(F.col("n_behind"), F.col("followed"), (F.col("n_word") + F.col("n_dot")) / F.col("all_words"))
    likely = F.col("n_behind") / F.col("followed") > (F.col("n_word") + F.col("n_dot")) / F.col("all_words")
    told = told.where(likely & (bound > min_ratio)).where(f"n_behind >= {max(3, least)} and n_behind * 5 >= n_behind + n_mid")
    collocation = told.select("lang", F.concat_ws(" ", "first", "word").alias("word"))
    return (
        judged.where("starter").select(F.lit("starter").alias("kind"), "lang", "word")
        .unionByName(judged.where("goes_on").select(F.lit("continuation").alias("kind"), "lang", "word"))
        .unionByName(collocation.select(F.lit("collocation").alias("kind"), "lang", "word"))
        .unionByName(short.where(abbreviation).select(F.lit("abbreviation").alias("kind"), "lang", "word"))
    )


#: Entries of the learned tables that may be sent to the executors, about 60 bytes each; more are joined.
MAX_ENTRIES = 1_000_000


def model_of(entries: list[tuple[str, str, str]]) -> SentenceModel:
    model = SentenceModel()
    sets = {"starter": model.starters, "continuation": model.continuations, "abbreviation": model.abbreviations, "collocation": model.collocations}
    for kind, lang, word in entries:
        sets[kind].add((lang, word))
    return model


def learn(df: DataFrame, text_col: str = "text") -> SentenceModel | DataFrame:
    """The statistics of all rows: as a model where it is small enough to send, else as the table of its entries.

    The entries are the same either way, and so are the sentences made with them.
    """
    tables = cut_lineage(learn_tables(count_statistics(df, text_col)))
    if tables.count() > MAX_ENTRIES:
        return tables
    return model_of([tuple(r) for r in tables.select("kind", "lang", "word").collect()])


class _Asked(set):
    """Takes note of what it is asked for, and holds nothing."""

    def __contains__(self, key: object) -> bool:
        self.add(key)
        return False


def asked_for(text: str) -> set[tuple[str, str]]:
    """All (language, word) that the sentences of a text may depend on."""
    asked = _Asked()
    text_sentences(text, SentenceModel(asked, asked, asked, asked))
    return set(asked)


_CANDIDATE = re.compile(rf"(?P<marks>[{re.escape(FULL_STOPS)}…]*[{re.escape(FULL_STOPS)}][{re.escape(FULL_STOPS)}…]*|(?<!\.)\.(?!\.)|\.{{2,}}|…+)(?P<close>(?:[ \xa0 ]?»|[{re.escape(CLOSERS)}])*)")


def sentence_ends(line: str, model: SentenceModel) -> list[int]:
    """The ends of the sentences of one line, as numbers of its characters; a blank line has none."""
    last = len(line.rstrip(_STRIP))
    if not line.strip(_STRIP):
        return []
    lang = line_language(line)
    depth = quoted(line)
    ends: list[int] = []
    for m in _CANDIDATE.finditer(line):
        end, marks, close = m.end(), m["marks"], m["close"]
        # closers that open a quotation of the next sentence, as in 。“ , are not part of this one
        while close and depth[end] > depth[m.start()]:
            end -= 1
            close = close[:-1]
            while close and close[-1] in " \xa0 ":
                end -= 1
                close = close[:-1]
        rest = line[end:]
        body = rest.lstrip(_STRIP)
        if not body or depth[end] > 0 and end < len(line):
            continue
        gap = len(body) < len(rest)
        head = body[0]
        opens = head in PAIRS or head == '"'
        if not opens and head in _EDGE or head in "—–~/":
            continue
        nxt = first_key(body[:60], lang)
        if nxt is None:
            continue
        kind = script_of(body.lstrip(_EDGE))
        starts = nxt in model.starters
        dotted, dots = "." in marks or set(marks) <= {"…"}, len(marks) > 1 or marks == "…"
        full = any(c in FULL_STOPS for c in marks)
        if dotted and not full:
            if marks == "." and not gap and not close:
                continue  # inside numbers, names, addresses
            if head.islower() or (not gap and kind == "spaced"):
                continue
            if dots and not close:
                # an ellipsis goes on unless something that begins sentences stands behind it, and a space where words have them
                if starts and (kind == "cjk" or gap and kind == "spaced" and not head.islower()):
                    ends.append(end)
                continue
            before = _LAST_TOKEN.search(line[: m.start() + len(marks)])
            token = before[0].lstrip(_EDGE) if before else ""
            word = word_type(token)
            if not close:
                where = lang if script_of(token) == "spaced" else "thai" if script_of(token) == "thai" else "any"
                if script_of(token) == "thai":
                    continue  # Thai sentences end at spaces, decided below
                number = _ONLY_NUMBER.fullmatch(token) is not None
                if (where, word) in model.abbreviations:
                    if kind == "digit" or not starts and kind == "spaced":
                        continue
                elif number and kind == "digit" or not opens and (lang, f"{'#' if number else word} {nxt[1]}") in model.collocations:
                    continue
                elif kind == "digit" and len(word) <= 3:
                    continue
        elif head.islower() and kind == "spaced":
            continue
        elif not gap and kind == "spaced" and not close and marks[-1] in "!?" and line[m.start() - 1 : m.start()].isascii():
            continue  # inside an address
        if close and not opens:
            if nxt in model.continuations or (kind in ("spaced", "thai") and not starts):
                continue
        ends.append(end)
    if _THAI.search(line):
        for m in _SPACES.finditer(line):
            body = line[m.end() :]
            if not body or depth[m.start()] or script_of(line[: m.start()][-1:]) not in ("thai", "other", "digit"):
                continue
            if body[0] in _EDGE and body[0] != '"' or script_of(body) != "thai" or body[0] == '"':
                continue
            before = _LAST_TOKEN.search(line[: m.start()])
            if before and before[0].endswith("."):
                continue
            if ("thai", body.lstrip(_EDGE)[:_THAI_STEM]) in model.starters:
                ends.append(m.start())
    ends = sorted({e for e in ends if e < last} | {last})
    return ends


def text_sentences(text: str, model: SentenceModel) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text; a line break ends every sentence."""
    out: list[tuple[int, int]] = []
    at = 0
    for line in text.split("\n"):
        start = 0
        for end in sentence_ends(line, model):
            while start < end and line[start] in _STRIP:
                start += 1
            # padding and invisible characters at the end are no part of the sentence
            stop = start + len(line[start:end].rstrip(_STRIP))
            if stop > start:
                out.append((at + start, at + stop))
            start = end
        at += len(line) + 1
    return out


def _rows(ident, text: str, model: SentenceModel) -> Iterator[tuple]:
    for k, (s, e) in enumerate(text_sentences(text, model)):
        yield ident, k, s, e, text[s:e]


_SENTENCE = ["id", "sentence_no", "start_pos", "end_pos", "sentence"]


def _apply(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [row for i, t in zip(pdf["id"], pdf["text"]) if t for row in _rows(i, t, model.value)]
            if rows:
                yield pd.DataFrame(rows, columns=_SENTENCE)

    return run


def _ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(key, *k) for key, t in zip(pdf["key"], pdf["text"]) if t for k in asked_for(t)]
        if rows:
            yield pd.DataFrame(rows, columns=["key", "lang", "word"])


def _apply_own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for i, t, entries in zip(pdf["id"], pdf["text"], pdf["entries"]):
            if t:
                rows += _rows(i, t, model_of([] if entries is None else [(e["kind"], e["lang"], e["word"]) for e in entries]))
        if rows:
            yield pd.DataFrame(rows, columns=_SENTENCE)


def split_sentences(df: DataFrame, model: SentenceModel | DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(id, sentence_no, start_pos, end_pos, sentence) of every row, positions in characters of the text.

    A null, empty or blank text gives no sentence; a text without any mark gives one for each line; rows
    stored twice give their sentences twice. With a model there is no shuffle; with a table of entries each text is
    joined with those it asks for.
    """
    kind = df.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    rows = df.select(carried(F.col(id_col), kind).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {carried_type(kind)}, sentence_no int, start_pos int, end_pos int, sentence string"
    if isinstance(model, SentenceModel):
        sent = df.sparkSession.sparkContext.broadcast(model)
        out = rows.mapInPandas(_apply(sent), schema)
    else:
        rows = rows.withColumn("key", F.sha2("text", 256))
        asked = rows.select("key", "text").mapInPandas(_ask, "key string, lang string, word string").distinct()
        own = asked.join(model, ["lang", "word"]).groupBy("key").agg(F.collect_set(F.struct("kind", "lang", "word")).alias("entries"))
        out = rows.join(own, "key", "left").select("id", "text", "entries").mapInPandas(_apply_own, schema)
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col.split(".")[-1])
