"""Splitting oversized texts at natural boundaries, by packing a structure tree.

A text is a tree: sections nested by the depth of their headings, then paragraphs, list items with
what is indented below them and table rows, lines, sentences, clauses, characters. Sibling subtrees are merged up to the limit, never the parts of different
parents; only a node that is itself over the limit is opened. Every piece but the first begins with the
``overlap`` last characters before its own part, so neighbours share exactly that many characters.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.ids import carried, carried_type

#: Headings of Markdown, wiki, LaTeX and HTML at the beginning of a line. Fixed values.
_HEADING = re.compile(r"^(?:(?P<md>#{1,6}) +(?P<t1>.*)|(?P<wiki>={2,6}) *(?P<t2>[^=\n]+?) *=+ *$|\\(?P<latex>(?:sub)*)section\*?\{(?P<t3>[^{}\n]*)\}|<h(?P<html>[1-6])[^<>]*>(?P<t4>[^<\n]*))", re.M)
#: Boundaries below sections, from strong to weak; a child ends where a match ends. Fixed values.
_LEVELS = [
    re.compile(r"\n[ \t　\r]*\n\s*"),
    re.compile(r"\n(?=(?:[-*+•] |\d{1,3}[.)、] ?|\\item\b|<li\b|\|)\S?)"),
    re.compile(r"\n"),
    re.compile(r"[。！？!?।؟…]+[”’」』）)\]\"']*[ 　]*|\.[”’\"')\]]*[ 　]+|</(?:p|li|tr|div|table|ul)>|\\\\ "),
    re.compile(r"[，、；：,;:،][ 　]*|[ 　]+"),
]


@dataclass
class Section:
    """A stretch of text: a section with its parts, or a run of text of one level below sections."""

    start: int
    end: int
    path: tuple[str, ...] = ()
    level: int = 0
    depth: int = 0
    parts: list[Section] = field(default_factory=list)


def outline(text: str) -> Section:
    """The sections of a text, nested by the depth of their headings; text before the first heading is a part of its own.

    A heading belongs to the first paragraph of its section; where a section begins with another heading it is alone.
    """
    root = Section(0, len(text))
    stack = [root]
    heads = [(m.start(), len(m["md"] or m["wiki"] or "") or (int(m["html"]) if m["html"] else m["latex"].count("sub") + 1), (m["t1"] or m["t2"] or m["t3"] or m["t4"] or "").strip(" #")) for m in _HEADING.finditer(text)]
    if not heads:
        return root
    edges = [h[0] for h in heads] + [len(text)]
    if heads[0][0]:
        root.parts.append(Section(0, heads[0][0]))
    for (start, depth, title), end in zip(heads, edges[1:]):
        while len(stack) > 1 and stack[-1].depth >= depth:
            stack.pop().end = start
        made = Section(start, len(text), (*stack[-1].path, title), 0, depth)
        made.parts.append(Section(start, end, made.path))
        stack[-1].parts.append(made)
        stack.append(made)
    return root


def _children(text: str, node: Section) -> list[Section]:
    if node.parts:
        return node.parts
    cuts = [m.end() for m in _LEVELS[node.level].finditer(text, node.start, node.end) if node.start < m.end() < node.end]
    points = [node.start, *dict.fromkeys(cuts), node.end]
    return [Section(s, e, node.path, node.level + 1) for s, e in zip(points, points[1:])]


def _solid(text: str, at: int) -> bool:
    """Whether a cut before ``at`` would part a character from its combining marks."""
    c = text[at]
    return unicodedata.combining(c) != 0 or unicodedata.category(c) in ("Mn", "Mc", "Me") or c in "‍️"


def pack(text: str, limit: int, overlap: int) -> list[tuple[int, int, tuple[str, ...]]]:
    """Own parts (start, end, headings above the start) of the pieces; piece k > 0 is shown from start - overlap.

    The parts are disjoint and cover the text. A part holds at most ``limit`` characters, the overlap
    included. The overlap must be below the limit.
    """
    if limit <= 0 or not 0 <= overlap < limit:
        raise ValueError("the limit must be positive and the overlap below it")
    root = outline(text)
    out: list[tuple[int, int, tuple[str, ...]]] = []

    def room(start: int) -> int:
        return limit - (overlap if start else 0)

    def characters(node: Section) -> None:
        start = node.start
        while start < node.end:
            size = room(start)
            stop = min(node.end, start + size)
            while stop < node.end and stop > start + 1 and _solid(text, stop):
                stop -= 1
            if stop < node.end and _solid(text, stop):
                stop = min(node.end, start + size)
            out.append((start, stop, node.path))
            start = stop

    def visit(node: Section) -> None:
        if node.end - node.start <= room(node.start):
            if node.end > node.start:
                out.append((node.start, node.end, node.parts[0].path if node.parts else node.path))
        elif not node.parts and node.level == len(_LEVELS):
            characters(node)
        else:
            merged: list[Section] = []
            for child in _children(text, node):
                if merged and child.end - merged[0].start <= room(merged[0].start):
                    merged.append(child)
                    continue
                close(merged)
                merged = []
                if child.end - child.start <= room(child.start):
                    merged = [child]
                else:
                    visit(child)
            close(merged)

    def close(merged: list[Section]) -> None:
        if merged:
            out.append((merged[0].start, merged[-1].end, merged[0].path))

    visit(root)
    return out


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["_id", "piece_no", "n_pieces", "start_pos", "end_pos", "overlap", "piece", "_path", "headings"]
    for pdf in batches:
        out = []
        for ident, text, limit, over, path in zip(pdf["_id"], pdf["_text"], pdf["_limit"], pdf["_over"], pdf["_path"]):
            parts = pack(text, int(limit), int(over))
            for k, (s, e, headings) in enumerate(parts):
                lead = min(int(over), s)
                out.append((ident, k, len(parts), s - lead, e, lead, text[s - lead : e], path, list(headings)))
                if len(out) == 5_000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=columns)


def split_oversized(df: DataFrame, limits: DataFrame, id_col: str = "chunk_id", text_col: str = "text", kind_col: str = "metadata.chunk_type", path_col: str = "metadata.section_path") -> DataFrame:
    """Pieces of the texts that have more characters than ``limits.max_chars`` for their kind.

    Columns: the id, ``chunk_type``, ``piece_no`` from 0, ``n_pieces``, ``start_pos``, ``end_pos`` (characters
    of the text, the overlap included), ``overlap``, ``piece``, ``section_path``, and ``headings``, the titles of the text's
    own sections in which the piece begins. Texts within the limit, null
    texts and kinds without a limit give no piece. Without an overlap 0 is meant; rows stored twice give their
    pieces twice. Several limits for one kind: the smallest is taken. Whole texts are packed, of any length.
    Which side is broadcast is left to Spark, which knows the limit table's size.
    """
    lim = limits.where("chunk_type is not null and max_chars > 0").groupBy("chunk_type").agg(F.min(F.struct("max_chars", "overlap_chars")).alias("l"))
    # an overlap of the whole limit would leave no room for text of its own
    lim = lim.select("chunk_type", F.col("l.max_chars").alias("_limit"), F.least(F.greatest(F.coalesce("l.overlap_chars", F.lit(0)), F.lit(0)), F.col("l.max_chars") - 1).alias("_over"))
    typed = df.select(F.col(id_col)).schema[0].dataType.simpleString()
    rows = df.select(carried(F.col(id_col), typed).alias("_id"), F.col(text_col).alias("_text"), F.col(kind_col).alias("chunk_type"), F.col(path_col).alias("_path"))
    over = rows.join(lim, "chunk_type").where(F.length("_text") > F.col("_limit"))
    schema = f"_id {carried_type(typed)}, piece_no int, n_pieces int, start_pos int, end_pos int, overlap int, piece string, _path array<string>, headings array<string>"
    out = over.select("_id", "_text", "_limit", "_over", "_path").mapInPandas(_pieces, schema)
    return out.select(F.col("_id").cast(typed).alias(id_col.split(".")[-1]), "piece_no", "n_pieces", "start_pos", "end_pos", "overlap", "piece", F.col("_path").alias("section_path"), "headings")
