"""Column functions and folds over one text."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.functions import textlogic as L
from docloom.operators import cleaning

GOLDEN = """# 保险责任

被保险人因意外伤害导致身故的，保险人按照合同约定给付保险金。

但被保险人因自杀导致身故的，保险人不承担保险责任。

在保险期间内，如果被保险人发生重大疾病，保险人将按照合同约定给付保险金。

保险费应在保险期间内按时缴纳。保险金额为人民币100万元。"""

TEXTS = [None, "", " ", "\n\n\n", "a\n\n\n\nb  \n\n\n\n\n", "　全角　\n第 3 页\nx", "一。二！三？四；五", "第一页\n正文没有结尾\n继续下去。\n- 列表", "\n".join(["重复的页眉行文字超过二十个字符才会被认出来的一行"] + [f"正文{i}。" for i in range(20)] + ["重复的页眉行文字超过二十个字符才会被认出来的一行"])]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").cache()


def both(df, column, plain):
    got = {r["id"]: r["v"] for r in df.select("id", column.alias("v")).collect()}
    for k, t in enumerate(TEXTS):
        assert got[k] == (None if t is None else plain(t)), repr(t)


def test_columns_and_plain_functions_agree(texts):
    c = F.col("text")
    both(texts, X.squeeze_blank(c), L.squeeze_blank)
    both(texts, X.drop_page_lines(c), L.page_lines_gone)
    both(texts, X.drop_edge_lines(c), L.edge_lines_gone)
    both(texts, X.sentences(c), L.sentences)
    both(texts, cleaning.join_broken_lines(c), L.join_broken_lines)
    both(texts, X.semantic_type(X.first_pattern(c)), lambda t: L.classify(t)[0])
    both(texts, X.trigger_words(c, X.first_pattern(c)), lambda t: L.classify(t)[1])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab #。\n", max_size=30))
def test_joining_is_pairwise(text):
    rows = text.split("\n")
    can = []
    for i, r in enumerate(rows):
        s, n = r.strip(), rows[i + 1].strip() if i + 1 < len(rows) else ""
        can.append(bool(s) and s[0] != "#" and s[-1] != "。" and bool(n) and n[0] != "#")
    out, i = [], 0
    while i < len(rows):
        out.append(rows[i].strip() + " " + rows[i + 1].strip() if can[i] else rows[i])
        i += 2 if can[i] else 1
    assert L.join_broken_lines(text) == "\n".join(out)


def test_headers_need_ten_lines():
    line = "重复的页眉行文字超过二十个字符才会被认出来的一行"
    assert L.edge_lines_gone("\n".join([line] + ["x"] * 7 + [line])) .count(line) == 2
    assert line not in L.edge_lines_gone("\n".join([line] + [f"x{i}" for i in range(8)] + [line]))
    short = "五字的页眉"
    assert L.edge_lines_gone("\n".join([short] + [f"x{i}" for i in range(48)] + [short])).count(short) == 2
    ten = "正好十个字的页眉行文"
    assert ten not in L.edge_lines_gone("\n".join([ten, *[f"x{i}" for i in range(24)], ten, *[f"y{i}" for i in range(23)], ten]))


def test_tables_and_images_are_left_alone():
    text = "前文没有结束\n<table><tr><td>第 1 页</td></tr></table>\n又一行没有结束\n<table>\n第 2 页\n</table>\n![a](x.png) 和 ![b](y.png)\n第 3 页\n结束。"
    out = L.basic_clean(text)
    assert "<table>\n第 2 页\n</table>" in out and "<td>第 1 页</td>" in out and "第 3 页" not in out
    assert "![a](x.png) 和 ![b](y.png)" in out


def test_blocks_and_section_paths():
    blocks = L.parse_blocks("# a\n### c\ntext\nmore\n\n- x\n\n- y\n  z\nafter\n<table>\nq\n</table>\n# b\n#notitle")
    assert [(b.kind, b.line) for b in blocks] == [("heading", 0), ("heading", 1), ("paragraph", 2), ("list", 5), ("paragraph", 9), ("table", 10), ("heading", 13), ("paragraph", 14)]
    assert blocks[2].path == ["a", "c"] and blocks[-1].path == ["b"] and blocks[3].content == "- x\n\n- y\n  z"
    assert L.parse_blocks("<table>\nnever closed\nx")[0].content == "<table>\nnever closed\nx"


def test_heading_paths_nest_by_position(spark):
    rows = [(1, [(1, "h1"), (3, "a"), (3, "b"), (2, "c"), (1, "z")])]
    df = spark.createDataFrame(rows, "id int, hs array<struct<level:int,title:string>>")
    got = df.select(X.heading_paths(F.col("hs")).alias("p")).first()["p"]
    assert got == [["h1"], ["h1", "a"], ["h1", "a", "b"], ["h1", "c"], ["z"]]


def test_known_document():
    chunks = L.chunk_document(GOLDEN, L.Sizes(500, 1000, 100))
    assert [(c.semantic_type, len(c.text)) for c in chunks] == [("给付", 30), ("给付", 25), ("给付", 36), ("定义", 29)]
    assert [c.trigger_words for c in chunks] == [["按照合同约定给付"] * 2, ["承担保险责任"] * 2, ["按照合同约定给付"] * 2, ["保险金额为"] * 2]
    assert all((c.start_line, c.end_line, c.section_path) == (2, 8, ["保险责任"]) for c in chunks)


def test_a_section_keeps_its_own_path():
    chunks = L.chunk_document("# a\n\n第一节的文字。\n\n# b\n\n第二节的文字。", semantic=False)
    assert [c.section_path for c in chunks] == [["a"], ["b"]]
    late = L.chunk_document("# a\n\n第一节的文字。\n\n# b\n\n第二节的文字。", semantic=False, next_path=True)
    assert [c.section_path for c in late] == [["b"], ["b"]]


def test_packing_limits():
    sizes = L.Sizes(40, 60, 10)
    text = "\n\n".join(["短文" * 5, "长" * 30, "句。" * 50, "- " + "列" * 80, "<table>" + "x" * 90 + "</table>"])
    groups = L.pack_blocks(L.parse_blocks(text), sizes)
    for g in groups:
        n = sum(len(b.content) for b in g)
        assert n <= sizes.largest or (len(g) == 1 and g[0].kind in ("list", "table"))
    assert "".join(b.content for g in groups for b in g) == "".join(b.content for b in L.parse_blocks(text))


def test_long_atoms():
    assert L.split_long("短", 10) == ["短"]
    assert L.split_long("前言。1. 第一点内容 2. 第二点内容", 10) == ["前言。", "1. 第一点内容", "2. 第二点内容"]
    assert L.split_long("一二三，四五六。七八九", 6) == ["一二三四五六", "七八九"]
    assert L.split_long("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    # a numbered piece over the limit is cut further instead of for ever
    assert max(map(len, L.split_long("1. " + "字" * 40, 10))) <= 10


def test_repetition_and_boilerplate(spark):
    rows = [(1, "重复句。重复句。重复句。本合同未尽事宜，另行约定。\n\n一次。"), (2, None), (3, "")]
    out = cleaning.clean_and_split(spark.createDataFrame(rows, "doc int, text string"), "doc").collect()
    reasons = {(r["sentence"], r["reason"]) for r in out if r["doc"] == 1}
    assert reasons == {("重复句。", "repetitive"), ("本合同未尽事宜，另行约定。", "boilerplate"), ("", ""), ("一次。", "")}
    assert {r["doc"] for r in out} == {1, 3}


def test_core_sections_and_previews(spark):
    df = spark.createDataFrame([(1, ["总则", "保险责任"], "x" * 201), (2, None, None), (3, [], "y" * 200)], "id int, p array<string>, t string")
    got = {r["id"]: (r["c"], r["v"]) for r in df.select("id", X.is_core_section(F.col("p")).alias("c"), X.preview(F.col("t")).alias("v")).collect()}
    assert got == {1: (True, "x" * 200 + "..."), 2: (False, None), 3: (False, "y" * 200)}


def test_clause_numbers(spark):
    df = spark.createDataFrame([("见第 三 条",), ("第12款和第3项",), ("没有",), (None,)], "t string")
    assert [r[0] for r in df.select(X.clause_number(F.col("t"))).collect()] == ["第 三 条", "第12款", None, None]
