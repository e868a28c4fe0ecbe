"""Markup residue: kinds, roles, cleaning, the tree."""

import pytest

from docloom.llm.markup import KINDS, LABELLED, analyse, clean, labelled_rows, strip_markup, trees
from docloom.llm.tree import decide, grow


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("<p>一段文字</p>", {"html"}), ("A &amp; B", {"html"}), ("<!-- x --> y", {"html"}), ("z</span>", {"html"}), ("<IMG SRC=\"a>b.png\" alt=\"x\">", {"html"}),
        ("a<5 且 b>3", set()), ("填写<姓名>和<签名处>", set()), ("R&D 部门", set()), ("份额<72%且>29", set()),
        ("## 标题\n文字", {"markdown"}), ("标题\n=====", {"markdown"}), ("a **b** c", {"markdown"}), ("见[说明](http://x.invalid/a)", {"markdown"}), ("| a | b |\n|---|---|\n| 1 | 2 |", {"markdown"}), ("```\nx = 1\n```", {"markdown"}), ("> 引文", {"markdown"}), ("- 一项\n- 二项", {"markdown"}), ("字段 `a_b` 由", {"markdown"}),
        ("3*4 与 32*15", set()), ("[注3]以单据为准", set()), ("第#7窗口", set()), ("首页 > 条款 > 正文", set()), ("a_1_b 为估计*值", set()), ("甲 | 乙", set()), ("====", set()),
        ("[[条目]]与{{模板|a=1}}", {"wiki"}), ("'''粗'''", {"wiki"}), ("== 标题 ==", {"wiki"}), ("{| class=\"x\"\n! a !! b\n|-\n| 1 || 2\n|}", {"wiki"}), ("it's the boards' list", set()),
        ("\\section{题}", {"latex"}), ("值为 $a = \\frac{1}{2}$，", {"latex"}), ("见 \\ref{eq:1}", {"latex"}), ("\\( a_x = 4 \\) 是", {"latex"}),
        ("单价$12，另收$5。", set()), ("他抬起头。\n- 好的，她说。\n然后离开了。", set()), ("说明：\n* 以当年规定为准", set()), ("需要：\n* 甲\n* 乙", {"markdown"}), ("归档于C:\\claims\\7备查", set()), ("", set()),
    ],
)
def test_kinds(text, kinds):
    assert analyse(text)[0] == kinds


def test_structure_is_kept():
    assert clean("<h2>题</h2><ul><li>甲</li><li>乙</li></ul>")[0] == "## 题\n- 甲\n- 乙"
    assert clean("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>")[0] == "a | b\n1 | 2"
    assert clean("<pre><code>x = 1\ny = x</code></pre>")[0] == "x = 1\ny = x"
    assert clean("见[说明](http://x.invalid)与**粗体**、~~旧~~。")[0] == "见说明与粗体、旧。"
    assert clean("题\n===\n文")[0] == "# 题\n文"
    assert clean("[[甲|乙]]和'''丙'''。[[分类:丁]]")[0] == "乙和丙。"
    assert clean("== 题 ==")[0] == "## 题"
    assert clean("\\section{题}\n\\textbf{粗} 为 22\\%，$a = \\frac{1}{2}$。")[0] == "# 题\n粗 为 22%，$a = \\frac{1}{2}$。"
    assert clean("\\begin{tabular}{ll} a & 1 \\\\ b & 2 \\end{tabular}")[0].strip() == "a | 1\nb | 2"
    plain = "没有标记的文字。\n第二行 3*4。"
    assert clean(plain) == (plain, [], ["text", "text"])


# lines of other words than the labelled table's
HELD_OUT = [
    ["html text|<p>Der Antrag wird am Schalter in der Halle abgegeben und dort geprüft.</p>", "html heading|<h3>Fristen</h3>", "html list|<ul><li>Ausweis</li><li>Kopie</li></ul>", "- text|Ist x < 4 oder y > 9, so gilt die zweite Spalte der Tafel."],
    ["html chrome|<a href='/'>Start</a> <a href='/n'>Neues</a>", "html chrome|<a href='/k'>Kontakt</a> <a href='/x'>Impressum</a>", "html text|<p>Die Gebühr wird zu Beginn des Monats fällig und per Brief bezahlt.</p>"],
    ["- text|Der Beamte sah von der Akte auf und legte den Stift zur Seite.", "- text|- Gewiss, sagte er, das Formular liegt hier seit gestern bereit.", "- text|Die Besucherin verließ den Raum, ohne noch etwas zu sagen."],
    ["- text|Mitzubringen sind die folgenden Unterlagen des letzten Jahres:", "markdown list|- der Ausweis", "markdown list|- eine Kopie davon"],
    ["- text|Die Beträge stammen aus dem Vorjahr und sind nicht bereinigt.", "- text|* vorbehaltlich der Regeln des Vorstands für dieses Jahr"],
    ["markdown heading|# Gebühren", "markdown text|Die **monatliche** Gebühr steht in [der Tafel](/t) am Ende der Seite.", "markdown chrome|[Start](/) [Hilfe](/h) [Suche](/s)"],
    ["wiki heading|== Anfänge ==", "wiki text|Das '''Amt''' wurde vom [[Rat]] der Stadt im vorletzten Jahr gegründet.", "wiki chrome|[[Kategorie:Ämter]]"],
    ["latex heading|\\section{Beiträge}", "latex formula|Daraus folgt $b = \\frac{3}{4}$ für alle weiteren Jahre der Tafel.", "- text|Das Blatt kostet $4 und die Abschrift $7, wie im Vorjahr."],
    ["markdown table|| Beitrag | fällig |", "markdown table||---|---|", "markdown table|| 7 | März |"],
    ["- text|Siehe [7] und {2} im Anhang, dort stehen die übrigen Beträge.", "- text|Raum #4 ist 5*6 Meter groß und liegt im zweiten Stock."],
]


def accuracy(drop, names):
    """Share of right decisions on the held-out table by trees grown without some features."""
    known, asked = labelled_rows(LABELLED), labelled_rows(HELD_OUT)
    right = total = 0
    for name in names:
        bare = lambda rows: [[0 if f in drop else x for f, x in enumerate(r)] for r in rows]
        tree = grow(bare(known[name][0]), known[name][1])
        right += sum(decide(tree, r) == label for r, label in zip(bare(asked[name][0]), asked[name][1]))
        total += len(asked[name][0])
    return right / total


def test_held_out_accuracy():
    kinds, frame = accuracy((), KINDS), accuracy((), ["frame"])
    print("kinds", kinds, "marks of the block only", accuracy(range(3, 10), KINDS), "no marks", accuracy(range(6), KINDS))
    print("frame", frame, "without neighbours", accuracy(range(3, 7), ["frame"]))
    assert kinds >= 0.97 and frame >= 0.9
    assert accuracy(range(3, 10), KINDS) < kinds and accuracy(range(6), KINDS) < kinds


def test_the_frame_of_a_page_is_left_out():
    text = "[首页](/a) [帮助](/b)\n[打印](/c) [分享](/d)\n保险公司在收到全部单据之后的三十日内完成审核，并以书面形式通知[投保人](/e)。"
    assert clean(text)[0] == "保险公司在收到全部单据之后的三十日内完成审核，并以书面形式通知投保人。"
    assert clean("见下图。\n![流程图](x.png)\n如上。")[0] == "见下图。\n流程图\n如上。"


def test_trees_fit_their_table_and_carry_over():
    assert set(trees()) == {*KINDS, "role", "frame"}
    rows = [[k % 7, k % 3] for k in range(60)]
    labels = ["a" if r[0] > 3 else "b" for r in rows]
    tree = grow(rows[:40], labels[:40])
    assert [decide(tree, r) for r in rows[40:]] == labels[40:]
    with pytest.raises(ValueError):
        grow([[0]] * 10_001, ["x"] * 10_001)


def test_rows(spark):
    df = spark.createDataFrame([("a", "<b>x</b>", "t"), ("b", None, "t"), ("c", "", "t"), ("a", "<b>x</b>", "t"), (None, "**y**", "t"), ("d", "字<br>" * 20_000, "t")], "chunk_id string, text string, clean_text string")
    rows = strip_markup(df).collect()
    by = {r["chunk_id"]: r for r in rows}
    assert len(rows) == 6 and by["a"]["clean_text"] == "x" and by["b"]["clean_text"] is None and by["c"]["clean_text"] == "" and by[None]["markup_kinds"] == ["markdown"]
    assert by["d"]["clean_text"].count("字") == 20_000
    assert strip_markup(df.limit(0)).count() == 0
