"""Repair of text from scanned pages: running headers, page numbers, misread characters, broken lines.

Headers and footers are lines that come back in a source up to small differences, and lines built like
those; page numbers are lines, or ends of header lines, of the forms that page numbers have. Everything
else asks the corpus: counts of three neighbouring characters and of words, over all texts, say whether
the characters on both sides of a line end belong together, whether a hyphen there belongs to the word, and whether a
character or word is a misreading of a far more frequent one. Which characters are taken for which is learned from
the same counts, beside a list of look-alikes. Decisions are tables joined with the counts. Misread triples and words
are sent to the workers where they are few, so that a scan notes nothing else; where they are many it notes all
that may be one, and a join decides.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.codepoints import code_points
from docloom.session import cut_lineage

# Characters that recognition takes for one another, misread form first.
MISREAD = {
    "入": "人", "人": "入", "俣": "保", "睑": "险", "朗": "期", "外": "处", "兀": "元", "埋": "理", "末": "未",
    "未": "末", "曰": "日", "夭": "天", "肉": "内", "爱": "受", "単": "单", "己": "已", "巳": "已", "士": "土",
    "土": "士", "干": "千", "千": "干", "大": "太", "太": "大", "住": "往", "佳": "住", "侍": "待", "侯": "候",
    "戍": "成", "戌": "成", "木": "本", "目": "日", "白": "自", "阴": "阳", "免": "兔", "兔": "免", "辨": "辩",
    "晴": "睛", "拔": "拨", "治": "冶", "冶": "治", "今": "令", "令": "今", "由": "田", "田": "由", "甲": "申",
}
#: In words of spaced scripts.
MISREAD_LETTERS = [("c", "e"), ("rn", "m"), ("vv", "w"), ("b", "h"), ("0", "o"), ("9", "g"), ("1", "l"), ("l", "i"), ("ii", "u"), ("cl", "d"), ("nn", "m"), ("5", "s"), ("I", "l")]
#: Letters read for digits inside numbers.
MISREAD_DIGITS = {"O": "0", "o": "0", "l": "1", "I": "1", "S": "5", "Z": "2", "B": "8"}
_NUMERAL = "0-9一二三四五六七八九十百零〇"
#: Forms of page numbers.
PAGE = rf"""(?:[—–\-─·•~]\s*\d{{1,4}}\s*[—–\-─·•~]|第\s*[{_NUMERAL}]{{1,5}}\s*页(?:\s*[/，,、]?\s*共\s*[{_NUMERAL}]{{1,5}}\s*页)?|页码\s*[:：]?\s*\d{{1,4}}|\[\s*\d{{1,4}}\s*\]|\d{{1,4}}\s*/\s*\d{{1,4}}|(?:[Pp]age|[Ss]eite)\s*\d{{1,4}}(?:\s*(?:of|von|/)\s*\d{{1,4}})?|[Pp]\.\s*\d{{1,4}})"""
_PAGE_LINE = re.compile(rf"(?:{PAGE}|\d{{1,4}})", re.V1)
_PAGE_TAIL = re.compile(rf"(?:^|[\s　|]+)({PAGE})$|[\s　]{{2,}}(\d{{1,4}})$", re.V1)
_PAGE_HEAD = re.compile(rf"^({PAGE})[\s　|]+", re.V1)
_SPACE = re.compile(r"[\s　​﻿]+")
_MARKUP = re.compile(r"[=<>{}\\`#*\^~_]|^\s*\||\|\s*$|^\s*[-+•] ")
_STOPPED = re.compile(r"[。！？；：.!?:;…\]】》”」』\"]$")
_INNER_STOP = re.compile(r"[。！？；，]|[a-z][.,;] |[.!?;,]$")
_HYPHEN = "-¬­‐"
_WORD = re.compile(r"(?<![\p{Latin}\p{N}_.@/])(?=[\p{L}\p{N}]*\p{L}\p{M}*)[\p{Latin}\p{N}]{3,}(?![_@/\\])")
_NUMBERISH = re.compile(r"(?<![A-Za-z0-9_./\\#$-])[0-9OolISZB][0-9OolISZB.,]*(?![A-Za-z_\\/])")
#: Words with a hyphen inside, and words that end in one before another, as in "pre- and".
_COMPOUND = re.compile(r"(?<![\p{Latin}\p{N}_.@/-])\p{Latin}{2,}-(?: \p{Ll}{2,}|\p{Latin}{2,})(?![\p{Latin}\p{N}_@/\\-])")
_LAST_LETTERS = re.compile(r"\p{Latin}+$")
_FIRST_LETTERS = re.compile(r"^\p{Latin}+")
_BIT = 21
#: Misread triples, and misread words, that may be sent to the workers (about 50 bytes each).
MAX_SENT = 300_000

_DECISION = "id string, kind string, line_no int, pos int, cand int, size int, repl string, tri long, tri_b long, word string"
_COLUMNS = ["id", "kind", "line_no", "pos", "cand", "size", "repl", "tri", "tri_b", "word"]


def packed(a: str) -> int:
    """Three characters as one number."""
    return (ord(a[0]) << 2 * _BIT) | (ord(a[1]) << _BIT) | ord(a[2])


def _folded(text: str) -> str:
    """Without white space, each run of digits as one 0."""
    return re.sub(r"\d+", "0", _SPACE.sub("", text))


_DIGITS = re.compile(r"\d+")


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of three neighbouring characters within lines (as numbers) and of words, gathered as long as they fit."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    words: Counter = Counter()

    def flush() -> Iterator[pd.DataFrame]:
        if len(keys):
            yield pd.DataFrame({"tri": pd.array(keys, dtype="Int64"), "word": None, "n": counts})
        if words:
            yield pd.DataFrame({"tri": pd.array([None] * len(words), dtype="Int64"), "word": list(words), "n": list(words.values())})

    for pdf in batches:
        for first in range(0, len(pdf), 2_000):
            texts = [t for t in pdf["text"].iloc[first : first + 2_000] if t]
            joined = "\n".join(texts)
            words.update(_WORD.findall(joined))
            words.update(_COMPOUND.findall(joined))
            # line ends stay, other white space goes; digits as in _folded
            flat = _DIGITS.sub("0", re.sub(r"[^\S\n]+|[　​﻿]+", "", joined))
            p = code_points(flat).astype(np.int64)
            if len(p) >= 3:
                han = (p >= 0x3400) & (p < 0xA000)
                ok = (p[:-2] != 10) & (p[1:-1] != 10) & (p[2:] != 10) & (han[:-2] | han[1:-1] | han[2:])
                tri = ((p[:-2] << 2 * _BIT) | (p[1:-1] << _BIT) | p[2:])[ok]
                new, n = np.unique(tri, return_counts=True)
                both = np.concatenate((keys, new))
                keys, where = np.unique(both, return_inverse=True)
                counts = np.bincount(where, weights=np.concatenate((counts, n)), minlength=len(keys)).astype(np.int64)
        if len(keys) > 1_000_000 or len(words) > 500_000:
            yield from flush()
            keys, counts = keys[:0], counts[:0]
            words.clear()
    yield from flush()


def split_page(line: str) -> tuple[str, str]:
    """(rest, page mark) of a stripped line: the mark is empty where there is none."""
    if _PAGE_LINE.fullmatch(line):
        return "", line
    if m := _PAGE_TAIL.search(line):
        return line[: m.start()].strip(" 　|"), m[1] or m[2]
    if m := _PAGE_HEAD.match(line):
        return line[m.end() :].strip(" 　|"), m[1]
    return line, ""


_FOLD = str.maketrans({**{k: v for k, v in MISREAD.items() if MISREAD.get(v) != k}, "O": "0", "o": "0", "l": "1", "I": "1"})


def header_key(rest: str) -> str:
    """What a header line has in common with its repetitions: without spaces, numbers, and recognition's differences."""
    return re.sub(r"\d+", "0", _SPACE.sub("", rest).translate(_FOLD))


def _joins(a: str, b: str) -> tuple[str, int, int]:
    """How line a goes on in line b (both stripped): sure, open with two trigrams to look up, or not."""
    if _MARKUP.search(a) or _MARKUP.search(b):
        return "no", 0, 0
    last, head = a[-1], b[0]
    if last in _HYPHEN and len(a) > 1 and a[-2].isalpha() and head.islower():
        return "sure", 0, 0
    if head in "，。、；：）”」』！？%,.;)" and (last.isalnum()):
        return "sure", 0, 0
    if _STOPPED.search(a):
        return "no", 0, 0
    if last in "，、,":
        return "sure", 0, 0
    if last.isascii() and head.isascii() or "À" <= last <= "ɏ" or "À" <= head <= "ɏ":
        return ("sure" if head.islower() or (last.isdigit() and head.isdigit()) else "no"), 0, 0
    left, right = _folded(a[-8:])[-2:], _folded(b[:8])[:2]
    if len(left) < 2 or len(right) < 2:
        return "no", 0, 0
    if left[-1] == "0" and right[0] == "0":
        right = right[1:] + _folded(b[:12])[2:3]
        return ("open", packed(left + right[0]), packed(left[-1] + right[:2])) if len(right) == 2 else ("no", 0, 0)
    return "open", packed(left + right[0]), packed(left[-1] + right)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    # column by column: numbers of 63 bits beside nulls must not pass through floats
    kinds = {"tri": "Int64", "tri_b": "Int64"}
    return pd.DataFrame({c: pd.array(list(v), dtype=kinds[c]) if c in kinds else list(v) for c, v in zip(_COLUMNS, zip(*rows))})


_EDGES = " \t\r　​﻿"


def _break(ident: str, lines: list[str], a: int, b: int) -> Iterator[tuple]:
    """The row of line number a going on in line number b, if it may: sure or open, with the word's parts around a hyphen."""
    x, y = lines[a].strip(_EDGES), lines[b].strip(_EDGES)
    how, tri, tri_b = _joins(x, y)
    if how == "open" and not (a == 0 and len(x) <= 16 and len(x) * 1.6 < len(y)):  # else a title above its text
        yield ident, "open", a, b, a, 0, None, tri, tri_b, None
    elif how == "sure":
        left, right = (_LAST_LETTERS.search(x[:-1]), _FIRST_LETTERS.search(y)) if x[-1] in _HYPHEN else (None, None)
        yield ident, "sure", a, b, a, 0, None, None, None, f"{left[0]}\n{right[0]}" if left and right else None


def _over_headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Possible breaks between the body lines on both sides of header lines, one or several."""
    for pdf in batches:
        out: list[tuple] = []
        for ident, text, tops in zip(pdf["id"], pdf["text"], pdf["tops"]):
            lines, tops = text.split("\n"), {int(k) for k in tops}
            before, over = None, False
            for k, line in enumerate(lines):
                if k in tops:
                    over = True
                    continue
                s = line.strip().strip("　​﻿").strip()
                if not s or not split_page(s)[0]:
                    continue
                if over and before is not None:
                    out += _break(ident, lines, before, k)
                before, over = k, False
            if len(out) > 20_000:
                yield _frame(out)
                out = []
        if out:
            yield _frame(out)


def _candidates(sent):
    """Of each text: page marks, possible headers, possible breaks, possible misreadings.

    ``sent`` holds the misread characters, and the misread triples and words, or None for either of these where they are too many.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        misread, triples, words = sent.value
        yield from _scan(batches, misread, triples, words)

    return run


def _scan(batches: Iterator[pd.DataFrame], misread: frozenset[str], triples: frozenset[int] | None, words: frozenset[str] | None) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out: list[tuple] = []
        for ident, source, text in zip(pdf["id"], pdf["source"], pdf["text"]):
            lines = text.split("\n")
            starts = np.cumsum([0, *(len(x) + 1 for x in lines)])
            body: list[int] = []
            for k, line in enumerate(lines):
                s = line.strip().strip("　​﻿").strip()
                if not s:
                    continue
                rest, page = split_page(s)
                alone = page and not rest
                if alone:
                    out.append((ident, "page", k, 0, k, 0, None, None, None, None))
                    continue
                if k and not _INNER_STOP.search(rest) and not (_MARKUP.search(line) and not page):
                    key = header_key(rest)
                    if len(key) >= 4:
                        out.append((ident, "line", k, 1 if page else 0, k, 0, source, None, None, key))
                body.append(k)
            for a, b in zip(body, body[1:]):
                out += _break(ident, lines, a, b)
            # misreadings: in the text as it runs on over line ends
            flat, where = [], []
            for k in body:
                base = int(starts[k])
                for i, c in enumerate(lines[k]):
                    if not c.isspace() and c not in "​﻿­":
                        if c.isdigit() and flat and flat[-1] == "0":
                            continue
                        flat.append("0" if c.isdigit() else c)
                        where.append(base + i)
            run = "".join(flat)
            for i in range(1, len(run) - 1):
                if run[i] in misread:
                    tri = packed(run[i - 1 : i + 2])
                    if triples is None or tri in triples:
                        out.append((ident, "char", 0, where[i], 0, 1, None, tri, None, None))
            for m in _NUMBERISH.finditer(text):
                t = m[0].rstrip(".,")
                if not any(c in MISREAD_DIGITS for c in t):
                    continue
                before, after = text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1]
                digits = any(c.isdigit() for c in t)
                held = before in tuple("第年月满过足费后按") and before != "" and after in tuple("条款日月天年个元%岁万类处件档") and after != ""
                if digits and not re.fullmatch(r"\d+[OoIlSZB]?", t) or digits and after and (after in "0123456789" or ord(after) > 0x2E80) or held:
                    out.append((ident, "digit", 0, m.start(), 0, len(t), t.translate(str.maketrans(MISREAD_DIGITS)), None, None, None))
            for m in _WORD.finditer(text):
                if words is None or m[0] in words:
                    out.append((ident, "word", 0, m.start(), 0, len(m[0]), None, None, None, m[0]))
            if len(out) > 20_000:
                yield _frame(out)
                out = []
        if out:
            yield _frame(out)


def _misread_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each word its readings with misread letters put right, at one place or at all."""
    for pdf in batches:
        out = []
        for word, n in zip(pdf["word"], pdf["n"]):
            if word.isdigit():
                continue
            seen = set()
            for bad, good in MISREAD_LETTERS:
                if bad in word:
                    at = [m.start() for m in re.finditer(bad, word)]
                    seen |= {word[:i] + good + word[i + len(bad) :] for i in at} | {word.replace(bad, good)}
            out += [(word, n, v) for v in seen - {word}]
        if out:
            yield pd.DataFrame(out, columns=["word", "n", "better"])


class ScanRepair:
    """Noise of scanned pages in the texts of ``df``, with counts taken over all texts of ``corpus``.

    Rows without an id, and null or empty texts, have no noise. Rows stored twice are judged once. A title on
    the first line is no header. A page number counts on a line of its own or in a header line. ``source`` may
    be null: such rows have no headers. A line of any length takes part.
    """

    def __init__(self, df: DataFrame, corpus: DataFrame, id_col: str = "chunk_id", text_col: str = "text", source_col: str = "metadata.source_file", least: int = 3, ratio: int = 8) -> None:
        self.id_col = id_col.split(".")[-1]
        vocab = corpus.select(F.col(text_col).alias("text")).where("text is not null").mapInPandas(_count, "tri long, word string, n long")
        # counted once, written, and read by every decision
        vocab = cut_lineage(vocab.groupBy("tri", "word").agg(F.sum("n").alias("n")))
        self.tri = vocab.where("tri is not null").select("tri", "n")
        self.words = vocab.where("word is not null").select("word", "n")
        self.rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")).where("id is not null and length(text) > 0")
        self.least, self.ratio = least, ratio
        self.pairs = self._confused()
        self.wrong, self.better = cut_lineage(self._wrong()), cut_lineage(self._better())
        # filtered in the scan where they are few; the joins below decide either way
        triples, words = (None if t.count() > MAX_SENT else frozenset(r[0] for r in t.collect()) for t in (self.wrong.select("tri"), self.better.select("word")))
        sent = df.sparkSession.sparkContext.broadcast((frozenset(self.pairs), triples, words))
        self.found = cut_lineage(self.rows.mapInPandas(_candidates(sent), _DECISION))

    def _parts(self) -> DataFrame:
        mask = F.lit((1 << _BIT) - 1)
        return self.tri.select("tri", "n", F.shiftright("tri", 2 * _BIT).alias("before"), F.shiftright("tri", _BIT).bitwiseAND(mask).alias("middle"), F.col("tri").bitwiseAND(mask).alias("after"))

    def _confused(self) -> dict[str, str]:
        """What each misread character stands for: the list of look-alikes, and what the corpus shows beside it.

        A character is learned as a misreading of another where it stands in at least ``least`` surroundings in which
        the other is far more frequent, and these hold four tenths of all its occurrences. At most one entry for each
        character there is, so the table is bounded by the characters of Unicode.
        """
        han = F.col("middle").between(0x3400, 0x9FFF) & (F.col("before").between(0x3400, 0x9FFF) | F.col("after").between(0x3400, 0x9FFF))
        parts = self._parts().where(han)
        usual = parts.groupBy("before", "after").agg(F.max_by("middle", "n").alias("usual"), F.max("n").alias("n_usual")).where(f"n_usual >= {self.ratio}")
        rare = parts.join(usual, ["before", "after"]).where(f"middle <> usual and n_usual >= n * {self.ratio}")
        shown = rare.groupBy("middle", "usual").agg(F.count("*").alias("surroundings"), F.sum("n").alias("times")).where(f"surroundings >= {self.least}")
        shown = shown.join(parts.groupBy("middle").agg(F.sum("n").alias("all")), "middle").where("times * 10 >= `all` * 4")
        best = shown.groupBy("middle").agg(F.max_by("usual", F.struct("times", "usual")).alias("usual"))
        return {chr(r["middle"]): chr(r["usual"]) for r in best.collect()} | MISREAD

    def _wrong(self) -> DataFrame:
        """(tri, to): triples whose middle character is a misreading of ``to``, the triple with that one being far more frequent."""
        pairs = self.rows.sparkSession.createDataFrame([(ord(a), ord(b)) for a, b in self.pairs.items()], "middle long, `to` long")
        better = (F.shiftleft("before", 2 * _BIT) + F.shiftleft("to", _BIT) + F.col("after")).alias("better")
        suspects = self._parts().join(F.broadcast(pairs), "middle").select("tri", "n", "to", better)
        known = self.tri.select(F.col("tri").alias("better"), F.col("n").alias("n_better")).where(f"n_better >= {self.ratio}")
        return suspects.join(known, "better").where(f"n_better >= n * {self.ratio}").select("tri", "to")

    def _better(self) -> DataFrame:
        """(word, repl): misread words and what they are read for."""
        plain = self.words.where("word not like '%-%'")
        known = plain.select(F.col("word").alias("better"), F.col("n").alias("n_better")).where("n_better >= 10")
        read = plain.mapInPandas(_misread_words, "word string, n long, better string").join(known, "better")
        return read.where(f"n_better >= n * {self.ratio}").groupBy("word").agg(F.max_by("better", "n_better").alias("repl"))

    def _times(self, lines: DataFrame) -> DataFrame:
        """(source, key, times): how many lines of the source are the same up to small differences.

        Lines that agree in their first or last six characters are compared with the most frequent one of these, and
        counted with it where no more than one character in five differs.
        """
        counts = cut_lineage(lines.where("source is not null").groupBy("source", "key").agg(F.count("*").alias("n")))
        ends = F.explode(F.array(F.concat(F.lit("<"), F.substring("key", 1, 6)), F.concat(F.lit(">"), F.substring("key", -6, 6)))).alias("end")
        each = counts.where(F.length("key") >= 8).select("source", "key", "n", ends)
        lead = each.groupBy("source", "end").agg(F.max_by("key", F.struct("n", "key")).alias("lead"))
        near = each.join(lead, ["source", "end"]).where(F.levenshtein("key", "lead") * 5 <= F.length("lead")).select("source", "key", "n", "lead").distinct()
        together = near.groupBy("source", "lead").agg(F.sum("n").alias("together"))
        most = near.join(together, ["source", "lead"]).groupBy("source", "key").agg(F.max("together").alias("together"))
        return counts.join(most, ["source", "key"], "left").select("source", "key", F.greatest("n", F.coalesce("together", "n")).alias("times"))

    def headers(self) -> DataFrame:
        """(id, line_no, with_page) of header and footer lines."""
        lines = self.found.where("kind = 'line'").select("id", "line_no", F.col("pos").alias("with_page"), F.col("repl").alias("source"), F.col("word").alias("key")).distinct()
        known = lines.join(self._times(lines), ["source", "key"], "left")
        ends = F.concat(F.lit("end:"), F.substring("key", -3, 3))
        shape = F.regexp_replace("key", r"[\p{L}\p{M}0]+", "x")
        feats = F.array_compact(F.array(ends, F.when(shape.rlike("[|《》—]"), F.concat(F.lit("shape:"), shape))))
        each = known.select("id", "line_no", "with_page", "times", F.explode(feats).alias("feature"))
        # a line's build speaks for a header where most lines built so are repeated in their source
        often = (F.col("times") >= self.least) | (F.col("with_page") == 1)
        built = each.groupBy("feature").agg(F.count("*").alias("all"), F.sum(often.cast("int")).alias("again")).where("again >= 3 and again * 2 >= `all`").select("feature", (F.col("again") * 10 >= F.col("all") * 6).alias("strong"))
        judged = each.join(built, "feature", "left").groupBy("id", "line_no").agg(F.max("with_page").alias("with_page"), F.max("times").alias("times"), F.max("strong").alias("strong"))
        return judged.where(F.col("strong").isNotNull() & ((F.col("times") >= 2) | F.col("strong")) | (F.col("times") >= self.least + 2) | ((F.col("with_page") == 1) & (F.col("times") >= 1))).select("id", "line_no", "with_page")

    def decisions(self) -> DataFrame:
        """(id, kind, line_no, pos, size, repl) of all noise: kinds header, page, break, char.

        ``repl`` of a char is what it is read for; of a break at a hyphen the two parts of the word, see ``hyphens``.
        """
        f, headers = self.found, cut_lineage(self.headers())
        none = F.lit(None).cast("string")
        zero = F.lit(0)
        head = headers.select("id", F.lit("header").alias("kind"), "line_no", zero.alias("pos"), zero.alias("size"), none.alias("repl"))
        page = f.where("kind = 'page'").select("id", "kind", "line_no", zero.alias("pos"), zero.alias("size"), none.alias("repl"))
        in_head = headers.where("with_page = 1").select("id", F.lit("page").alias("kind"), "line_no", zero.alias("pos"), zero.alias("size"), none.alias("repl"))
        # once headers are known, the lines around them become neighbours
        tops = headers.select("id", "line_no")
        topped = self.rows.select("id", "text").join(tops.groupBy("id").agg(F.collect_set("line_no").alias("tops")), "id")
        pairs = f.unionByName(cut_lineage(topped.mapInPandas(_over_headers, _DECISION)))
        opened = pairs.where("kind = 'open'").select("id", "line_no", F.col("pos").alias("next_no"), F.explode(F.array("tri", "tri_b")).alias("tri"))
        known = opened.join(self.tri.where("n > 1").select("tri"), "tri").groupBy("id", "line_no", "next_no").agg(F.count("*").alias("both")).where("both >= 2").select("id", "line_no", "next_no", none.alias("word"))
        breaks = pairs.where("kind = 'sure'").select("id", "line_no", F.col("pos").alias("next_no"), "word").unionByName(known).distinct()
        # a header at either end is no broken line
        breaks = breaks.join(tops, ["id", "line_no"], "left_anti").join(tops.withColumnRenamed("line_no", "next_no"), ["id", "next_no"], "left_anti")
        breaks = breaks.select("id", F.lit("break").alias("kind"), "line_no", F.col("next_no").alias("pos"), zero.alias("size"), F.col("word").alias("repl"))
        as_text = F.decode(F.unhex(F.lpad(F.hex("to"), 8, "0")), "utf-32")
        chars = f.where("kind = 'char'").join(self.wrong, "tri").select("id", "kind", "line_no", "pos", "size", as_text.alias("repl"))
        digits = f.where("kind = 'digit'").select("id", F.lit("char").alias("kind"), "line_no", "pos", "size", "repl")
        words = f.where("kind = 'word'").drop("repl").join(self.better, "word").select("id", F.lit("char").alias("kind"), "line_no", "pos", "size", "repl")
        out = head
        for part in (page, in_head, breaks, chars, digits, words):
            out = out.unionByName(part)
        return out.distinct()

    def hyphens(self, parts: DataFrame) -> DataFrame:
        """(repl, glue) of the words cut at a hyphen: what stands between their parts in the corpus.

        Nothing where the joined word is the most frequent, or none of the forms is known; a hyphen where the word is mostly
        written with one; a hyphen and a space where the first part stands so before the second one, as in "pre- and".
        """
        left, right = (F.split("repl", "\n")[k] for k in (0, 1))
        forms = parts.select("repl").distinct().select("repl", F.posexplode(F.array(F.concat(left, right), F.concat(left, F.lit("-"), right), F.concat(left, F.lit("- "), right))).alias("form", "word"))
        seen = forms.join(self.words, "word", "left").groupBy("repl").agg(*(F.coalesce(F.max(F.when(F.col("form") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in range(3)))
        glue = F.when((F.col("n2") > F.col("n1")) & (F.col("n2") > F.col("n0")), "- ").when(F.col("n1") > F.col("n0"), "-").otherwise("")
        return seen.select("repl", glue.alias("glue"))

    def kinds(self) -> DataFrame:
        """(id, noise_kind), each kind present in a text once."""
        return self.decisions().select(F.col("id").alias(self.id_col), F.col("kind").alias("noise_kind")).distinct()

    def repaired(self) -> DataFrame:
        """(id, text, noise_kinds) of every text: without headers and page numbers, lines joined, characters put right."""
        every = cut_lineage(self.decisions())
        glued = self.hyphens(every.where("kind = 'break' and repl is not null"))
        every = every.join(glued, "repl", "left").withColumn("repl", F.when(F.col("kind") == "break", F.col("glue")).otherwise(F.col("repl")))
        marks = every.groupBy("id").agg(F.collect_list(F.struct("kind", "line_no", "pos", "size", "repl")).alias("marks"))
        rows = self.rows.select("id", "text").dropDuplicates(["id"]).join(marks, "id", "left")
        out = rows.mapInPandas(_rebuild, "id string, text string, noise_kinds array<string>")
        return out.withColumnRenamed("id", self.id_col)


def rebuild(text: str, marks: list) -> str:
    """The text with the decisions applied."""
    for pos, size, repl in sorted({(m["pos"], m["size"], m["repl"]) for m in marks if m["kind"] == "char"}, reverse=True):
        # positions stay valid from the end to the start; line ends are never part of a replacement
        text = text[:pos] + repl + text[pos + size :]
    lines = text.split("\n")
    gone = {m["line_no"] for m in marks if m["kind"] in ("header", "page")}
    goes_on = {m["line_no"]: (m["pos"], m["repl"]) for m in marks if m["kind"] == "break"}
    out: list[str] = []
    k, joined, glue = 0, False, None
    while k < len(lines):
        if k not in gone:
            line = lines[k].strip(" \t\r　​﻿")
            if joined and out:
                last = out[-1]
                if last[-1:] in _HYPHEN and line[:1].islower():
                    out[-1] = last[:-1] + (glue or "") + line
                else:
                    gap = " " if last[-1:].isascii() and line[:1].isascii() and not (last[-1:].isdigit() and line[:1].isdigit()) else ""
                    out[-1] = last + gap + line
            else:
                out.append(line)
            joined = k in goes_on
            if joined:
                k, glue = goes_on[k]
                continue
        k += 1
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip("\n")


def _rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for ident, text, marks in zip(pdf["id"], pdf["text"], pdf["marks"]):
            found = [] if marks is None else list(marks)
            rows.append((ident, rebuild(text, found) if found else text, sorted({m["kind"] for m in found})))
        if rows:
            yield pd.DataFrame(rows, columns=["id", "text", "noise_kinds"])
