"""Term counts and splitting of oversized texts."""

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.operators.oversize import outline, pack, split_oversized
from docloom.operators.termcount import count_terms, mark_terms, record_suffixes, stack_counts


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=6), max_size=6), st.integers(1, 4))
def test_sorted_suffixes_count_every_run(records, sigma):
    suffixes = Counter()
    for r in records:
        for s, fresh in record_suffixes(r, sigma):
            suffixes[s, fresh] += 1
    rows = sorted(((("f", list(s), fresh, n)) for (s, fresh), n in suffixes.items()), key=lambda x: x[1], reverse=True)
    got = {tuple(g): (c, d) for _, g, c, d in stack_counts(iter(rows))}
    occurrences, holding = Counter(), Counter()
    for r in records:
        runs = [tuple(r[i : i + n]) for n in range(1, sigma + 1) for i in range(len(r) - n + 1)]
        occurrences.update(runs)
        holding.update(set(runs))
    assert got == {g: (occurrences[g], holding[g]) for g in occurrences}


SCHEMA = "chunk_id string, k array<string>, w array<string>, field string, suffix string"


def test_terms_of_records(spark):
    rows = [("1", [" a", "a　", None, "", "　 ", "b"], None, "x", "y"), ("1", [" a", "a　", None, "", "　 ", "b"], None, "x", "y"), ("2", ["a"], ["a"], None, None), (None, ["a"], ["a"], None, None), ("3", None, [], None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["field"], tuple(r["gram"])): (r["occurrences"], r["records"]) for r in count_terms(df, F.col("chunk_id"), {"k": F.col("k"), "w": F.col("w")}).collect()}
    assert got == {("k", ("a",)): (3, 2), ("k", ("b",)): (1, 1), ("k", ("a", "a")): (1, 1), ("k", ("a", "b")): (1, 1), ("w", ("a",)): (1, 1)}
    assert count_terms(df.limit(0), F.col("chunk_id"), {"k": F.col("k")}).count() == 0


def test_marks_at_the_limits(spark):
    df = spark.createDataFrame([("f", 2), ("f", 3), ("f", 10), ("f", 11)], "field string, records long")
    assert [r["mark"] for r in mark_terms(df, F.lit(100)).orderBy("records").collect()] == ["rare", None, None, "common"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab 。\n，#-́", max_size=200), st.integers(3, 40), st.data())
def test_pieces_cover_and_fit(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    parts = pack(text, limit, overlap)
    assert "".join(text[s:e] for s, e, _ in parts) == text
    assert all(e > s for s, e, _ in parts)
    assert all(e - max(0, s - overlap) <= limit for s, e, _ in parts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["# a", "## b", "### c", "word. " * 3, "字。" * 9, "- x", ""]), max_size=14).map("\n".join), st.integers(5, 60))
def test_pieces_keep_to_one_parent(text, limit):
    """A piece is a run of whole siblings of one section, or lies inside one that has no parts."""
    allowed = set()

    def walk(node):
        edges = [x.start for x in node.parts] + [node.end]
        allowed.update((a, b) for i, a in enumerate(edges) for b in edges[i + 1 :])
        allowed.add((node.start, node.end))
        for x in node.parts:
            walk(x)
            if not x.parts:
                leaves.append((x.start, x.end))

    root = outline(text)
    leaves = [] if root.parts else [(0, len(text))]
    walk(root)
    for s, e, _ in pack(text, limit, 0):
        assert (s, e) in allowed or any(a <= s and e <= b for a, b in leaves)


def test_sections_nest():
    text = "intro\n# A\nwords of a\n## A1\nwords of a1\n## A2\nwords of a2\n# B\nwords of b"
    parts = [(text[s:e], headings) for s, e, headings in pack(text, 40, 0)]
    assert [p for p, _ in parts] == ["intro\n", "# A\nwords of a\n## A1\nwords of a1\n", "## A2\nwords of a2\n", "# B\nwords of b"]
    assert [h for _, h in parts] == [(), ("A",), ("A", "A2"), ("B",)]
    text = "\\section{One}\nx\n\\subsection{Two}\n<h3>Three</h3>\n== Four ==\ny"
    inner = outline(text).parts[0].parts[1:]
    assert [(x.start, x.depth, x.path) for x in inner] == [(text.index("\\sub"), 2, ("One", "Two")), (text.index("=="), 2, ("One", "Four"))]


def test_list_items_keep_what_is_below_them():
    text = "- one\n  - one a\n  - one b\n- two\n  - two a\n- three"
    assert [text[s:e] for s, e, _ in pack(text, 26, 0)] == ["- one\n  - one a\n  - one b\n", "- two\n  - two a\n- three"]


def test_natural_boundaries():
    text = "# 一\n" + "甲乙丙丁。" * 10 + "\n\n# 二\n" + "戊己庚辛。" * 10
    cuts = [text[s:e] for s, e, _ in pack(text, 70, 0)]
    assert len(cuts) == 2 and cuts[1].startswith("# 二")
    text = "甲乙丙丁。" * 30
    assert all(text[s:e].endswith("。") for s, e, _ in pack(text, 24, 4))
    with pytest.raises(ValueError):
        pack("x", 5, 5)


def test_only_oversized_texts_are_cut(spark):
    schema = "chunk_id string, text string, metadata struct<chunk_type:string,section_path:array<string>,char_count:int>, piece string, max_chars int"
    rows = [("a", "x" * 11, ("p", ["s"], 3), "c", 1), ("b", "x" * 10, ("p", None, 99), "c", 1), ("c", None, ("p", None, None), None, None), ("d", "x" * 50, (None, None, None), None, None), ("e", "", ("p", None, None), None, None), ("f", "字" * 100_000, ("q", ["u", "v"], None), None, None), (None, "y" * 12, ("p", None, None), None, None)]
    limits = spark.createDataFrame([("p", 10, 3), ("q", 1000, 0), (None, 5, 0), ("z", None, 1)], "chunk_type string, max_chars int, overlap_chars int")
    out = split_oversized(spark.createDataFrame(rows, schema), limits)
    by = {}
    for r in out.collect():
        by.setdefault(r["chunk_id"], []).append(r)
    assert set(by) == {"a", "f", None} and len(by["f"]) == 100
    a = sorted(by["a"], key=lambda r: r["piece_no"])
    assert [(r["start_pos"], r["end_pos"], r["overlap"], r["section_path"]) for r in a] == [(0, 10, 0, ["s"]), (7, 11, 3, ["s"])]
    assert split_oversized(spark.createDataFrame([], schema), limits).count() == 0
