"""Folds over one text that column expressions cannot state: joining lines, parsing, packing, cutting.

Plain functions, applied to Arrow batches by the operators; each sees one whole text and nothing else.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from functools import cache

from docloom.profiles import HEADING, IMAGE, LIST_ITEM, NUMBERED, SPECIAL_LINE, ZH, Profile, any_of, occurs

_HEADING, _LIST, _SPECIAL, _IMAGE = re.compile(HEADING), re.compile(LIST_ITEM), re.compile(SPECIAL_LINE), re.compile(IMAGE)
_TABLE_SPAN = re.compile(r"<table.*?</table>", re.S)
_IMAGE_SPAN = re.compile(r"!\[.*?\]\(.*?\)")
#: Stand-ins for tables and images while their text is cleaned around them.
_TABLE_MARK, _IMAGE_MARK = "\ue000", "\ue001"


def join_broken_lines(text: str, terminators: str = ZH.terminators) -> str:
    """Unfinished lines joined with the next one, in pairs: a line made by joining is not joined again."""
    rows = text.split("\n")
    out: list[str] = []
    at = 0
    while at < len(rows):
        here = rows[at].strip()
        below = rows[at + 1].strip() if at + 1 < len(rows) else ""
        unfinished = here and not here.startswith("#") and here[-1] not in terminators and not {_TABLE_MARK, _IMAGE_MARK} & {here[0], here[-1]}
        if unfinished and below and not _SPECIAL.match(below) and below[0] not in (_TABLE_MARK, _IMAGE_MARK):
            out.append(f"{here} {below}")
            at += 2
        else:
            out.append(rows[at])
            at += 1
    return "\n".join(out)


def page_lines_gone(text: str, profile: Profile = ZH) -> str:
    pattern = _page(profile)
    return "\n".join(x for x in text.split("\n") if len(x.strip()) > 10 or not pattern.search(x))


@cache
def _page(profile: Profile) -> re.Pattern:
    return re.compile(any_of(profile.page_patterns), re.I)


@cache
def _boiler(profile: Profile) -> re.Pattern:
    return re.compile(any_of(profile.boilerplate))


@cache
def _classes(profile: Profile) -> list[tuple[str, list[tuple[re.Pattern, re.Pattern]]]]:
    return [(name, [(re.compile(occurs(p)), re.compile(p)) for p in patterns]) for name, patterns in profile.classes]


def edge_lines_gone(text: str, least_repeat: int = 20) -> str:
    rows = text.split("\n")
    if len(rows) < 10:
        return text
    k = min(5, len(rows) // 10)
    gone = set()
    for x in {*rows[:k], *rows[-k:]}:
        times, size = rows.count(x), len(x.strip())
        if times >= 2 and size and size >= (max(5, least_repeat // 2) if times > 2 else least_repeat):
            gone.add(x)
    return "\n".join(x for x in rows if x not in gone)


def basic_clean(text: str, profile: Profile = ZH, least_repeat: int = 20) -> str:
    """Page numbers, headers and footers removed and broken lines joined, around tables and images left as they are."""
    text = text.translate({ord(_TABLE_MARK): "�", ord(_IMAGE_MARK): "�"})
    tables, images = _TABLE_SPAN.findall(text), []
    text = _TABLE_SPAN.sub(_TABLE_MARK, text)
    images = _IMAGE_SPAN.findall(text)
    text = _IMAGE_SPAN.sub(_IMAGE_MARK, text)
    text = join_broken_lines(edge_lines_gone(page_lines_gone(text, profile), least_repeat), profile.terminators)
    for mark, kept in ((_IMAGE_MARK, iter(images)), (_TABLE_MARK, iter(tables))):
        text = re.sub(mark, lambda _, kept=kept: next(kept), text)
    return text


def sentences(text: str, profile: Profile = ZH) -> list[str]:
    out: list[str] = []
    for row in text.split("\n"):
        if row.strip():
            out += [s for x in re.findall(f"[^{profile.terminators}]*[{profile.terminators}]|[^{profile.terminators}]+", row) if (s := x.strip())]
        else:
            out.append(row)
    return out


def squeeze_blank(text: str) -> str:
    out: list[str] = []
    blank = 0
    for row in text.split("\n"):
        row = row.rstrip()
        blank = 0 if row else blank + 1
        if blank <= 2:
            out.append(row)
    return "\n".join(out)


@dataclass
class Block:
    kind: str
    content: str
    line: int
    path: list[str]
    level: int
    title: str | None = None


def _opens(row: str) -> str:
    """What a line begins: heading, table, list, text, or blank."""
    s = row.strip()
    if not s:
        return "blank"
    if _HEADING.match(s):
        return "heading"
    if s.startswith("<table"):
        return "table"
    return "list" if _LIST.match(s) else "text"


def parse_blocks(text: str) -> list[Block]:
    """The blocks of a Markdown text: headings, tables up to their end tag, lists with their continuations, paragraphs."""
    rows = text.split("\n")
    kinds = [_opens(r) for r in rows]
    out: list[Block] = []
    path: list[str] = []
    level = at = 0
    while at < len(rows):
        kind, first = kinds[at], at
        at += 1
        if kind == "blank":
            continue
        if kind == "heading":
            marks, title = _HEADING.match(rows[first].strip()).groups()
            level = len(marks)
            path = [*path[: level - 1], title]
            out.append(Block("heading", rows[first], first, path, level, title))
            continue
        if kind == "table":
            while at < len(rows) and "</table>" not in rows[at - 1]:
                at += 1
        elif kind == "list":
            while at < len(rows) and (kinds[at] in ("blank", "list") or rows[at].startswith(("  ", "\t"))):
                at += 1
        else:
            kind = "paragraph"
            while at < len(rows) and kinds[at] == "text":
                at += 1
        out.append(Block(kind, "\n".join(rows[first:at]), first, path, level))
    return out


def classify(text: str, profile: Profile = ZH) -> tuple[str, list[str]]:
    for name, patterns in _classes(profile):
        for quick, whole in patterns:
            if quick.search(text):
                return name, whole.findall(text)
    return profile.other, []


def semantic_atoms(text: str, profile: Profile = ZH, double: bool = True) -> list[tuple[str, str, list[str]]]:
    """(text, class, trigger words) of the stretches of a text that are of one class.

    A stretch ends before a piece of another class, unless what went before had no class, which goes to
    the piece that follows. With ``double`` the trigger words of a piece that gives a stretch its class count twice.
    """
    pieces = [p for p in re.split("([。；\n])", text)]
    atoms: list[tuple[list[str], str, list[str]]] = []
    held: list[str] = []
    words: list[str] = []
    last = None
    for p, stop in zip(pieces[::2], [*pieces[1::2], ""]):
        kind, hits = classify(p, profile)
        fresh = last is None or last == profile.other
        if not fresh and kind != last:
            atoms.append((held, last, words))
            held, words = [], list(hits)
        elif fresh:
            words = hits * 2 if double and kind != profile.other else list(hits)
        else:
            words = words + hits
        held = [*held, p, stop]
        last = kind
    atoms.append((held, last, words))
    out = [(t, kind, words) for parts, kind, words in atoms if (t := "".join(parts).strip())]
    return out or [(text, profile.other, [])]


def split_marked(text: str, longest: int, marked: bool = True) -> list[tuple[str, bool]]:
    """A text in pieces: at numbers of list points, else at punctuation (which is dropped), else by length.

    A numbered piece that is still too long goes on to the next way. With each piece, whether it keeps the trigger
    words of the whole: what stands before the first number and the first numbered piece do; of a text cut at
    punctuation the first piece, unless it is the last as well; of one cut by length the first.
    """
    if len(text) <= longest:
        return [(text, marked)]
    starts = [m.start() for m in re.finditer(NUMBERED, text)]
    if starts and starts != [0]:
        edges = sorted({0, *starts, len(text)})
        parts = [(p, marked and a <= starts[0]) for a, b in zip(edges, edges[1:]) if (p := text[a:b].strip())]
        if len(parts) > 1:
            return [q for p, keeps in parts for q in split_marked(p, longest, keeps)]
    bits = re.split(r"[，。；：]\s*", text)
    if len(bits) > 1:
        packed = [""]
        for bit in bits:
            if len(packed[-1]) + len(bit) > longest:
                packed.append("")
            packed[-1] += bit
        kept = [(s, k < len(packed) - 1) for k, p in enumerate(packed) if (s := p.strip())]
        return [(s, marked and inner and k == 0) for k, (s, inner) in enumerate(kept)] or [(text, marked)]
    return [(text[k : k + longest], marked and k == 0) for k in range(0, len(text), longest)]


def split_long(text: str, longest: int) -> list[str]:
    return [p for p, _ in split_marked(text, longest)]


@dataclass(frozen=True)
class Sizes:
    target: int = 800
    largest: int = 1500
    least: int = 200


def pack_blocks(blocks: list[Block], sizes: Sizes, next_path: bool = False) -> list[list[Block]]:
    """Neighbouring blocks gathered into chunks: tables alone, oversized paragraphs cut at sentences, headings as borders.

    With ``next_path`` the last chunk before a heading carries the path that the heading opens (and its own level).
    """
    out: list[list[Block]] = []
    open_: list[Block] = []
    size = 0

    def close() -> None:
        nonlocal open_, size
        if open_:
            out.append(open_)
        open_, size = [], 0

    for b in blocks:
        n = len(b.content)
        if b.kind == "heading":
            if next_path and open_:
                open_[0] = Block(open_[0].kind, open_[0].content, open_[0].line, b.path, open_[0].level)
            close()
        elif b.kind == "table" or (n > sizes.largest and b.kind != "paragraph"):
            close()
            out.append([b])
        elif n > sizes.largest:
            close()
            run = ""
            for s in re.findall(r"[^。！？\n]*[。！？\n]|[^。！？\n]+", b.content):
                if run and len(run) + len(s) > sizes.largest:
                    out.append([Block("paragraph", run, b.line, b.path, b.level)])
                    run = ""
                run += s
            if run:
                out.append([Block("paragraph", run, b.line, b.path, b.level)])
        else:
            if size + n > sizes.target and (size >= sizes.least or size + n > sizes.largest):
                close()
            open_.append(b)
            size += n
    close()
    return out


@dataclass
class ChunkRow:
    text: str
    chunk_type: str
    section_path: list[str]
    heading_level: int
    image_refs: list[str]
    start_line: int
    end_line: int
    has_table: bool
    has_list: bool
    skip_embedding: bool
    semantic_type: str
    trigger_words: list[str] = field(default_factory=list)
    sentence_infos: list[tuple[str, bool, str]] = field(default_factory=list)


def document_sentences(blocks: list[Block], repeat: int, profile: Profile) -> dict[str, tuple[str, bool, str]]:
    """For each sentence of a document, by its stripped form, its text and why it isn't embedded, if so."""
    found = [s for b in blocks if b.kind != "heading" for s in sentences(b.content, profile)]
    times: dict[str, int] = {}
    for s in found:
        if key := s.strip():
            times[key] = times.get(key, 0) + 1
    boiler = _boiler(profile)
    out: dict[str, tuple[str, bool, str]] = {}
    for s in found:
        key = s.strip()
        why = "" if not key else "boilerplate" if boiler.search(key) else "repetitive" if times[key] >= repeat else ""
        out.setdefault(key, (s, why != "", why))
    return out


def chunk_document(text: str, sizes: Sizes = Sizes(), profile: Profile = ZH, repeat: int = 3, cleaning: bool = True, semantic: bool = True, next_path: bool = False) -> list[ChunkRow]:
    """The chunks of one Markdown text."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    blocks = parse_blocks(squeeze_blank(basic_clean(text, profile) if cleaning else text))
    known = document_sentences(blocks, repeat, profile) if cleaning else {}
    boiler = _boiler(profile)
    out: list[ChunkRow] = []
    for group in pack_blocks(blocks, sizes, next_path):
        whole = "\n\n".join(b.content for b in group)
        table, listed = any(b.kind == "table" for b in group), any(b.kind == "list" for b in group)
        images = sorted(set(_IMAGE.findall(whole)))
        atoms = semantic_atoms(whole, profile) if semantic and not table else [(whole, profile.other, [])]
        for atom, kind, words in atoms:
            parts = split_marked(atom, sizes.largest) if semantic and not table else [(atom, True)]
            for part, keeps in parts:
                infos = []
                if cleaning:
                    for s in sentences(part, profile):
                        bad = boiler.search(s.strip()) is not None
                        infos.append(known.get(s.strip()) or (s, bad, "boilerplate" if bad else ""))
                out.append(ChunkRow(part, "table" if table else "list" if listed else "paragraph", group[0].path, group[0].level, images, group[0].line, group[-1].line, table, listed, bool(infos) and all(i[1] for i in infos), kind, words if keeps else [], infos))
    return out


def chunk_identity(source: str | None, number: int, text: str) -> str:
    return hashlib.sha256(f"{source}\u0001{number}\u0001{text}".encode("utf-8", "surrogatepass")).hexdigest()
