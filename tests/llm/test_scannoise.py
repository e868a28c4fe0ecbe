"""Noise of scanned pages on a small corpus."""

import pytest

from docloom.llm.scannoise import MISREAD, ScanRepair, _joins, packed, rebuild, split_page

BODY = ["被保险人应当在三十日内向保险公司提交单据。", "保险公司收到单据后用十日完成审核，结果以书面为准。", "保单持有人可以在线变更保险金额，变更自次日零时起生效。", "受益人凭单据可领取500元以内的费用。"]
HEAD = "东海保险 家财险条款"


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(f"c{k}", f"s{k % 3}", BODY[k % 4] + BODY[(k + 1) % 4]) for k in range(60)]
    rows += [(f"e{k}", "s9", "The clerk reads the file before the house is sold.") for k in range(20)]
    rows += [(f"h{k}", "scan", f"{BODY[k % 4]}\n{HEAD}{'' if k % 2 else f'　　第{k}页'}\n{BODY[(k + 1) % 4]}") for k in range(8)]
    rows += [
        ("broken", "scan", "被保险人应当在三十日内向保险公\n司提交单据。保险公司收到单\n据后用十日完成审核，结果以书面为准。"),
        ("dash", "scan", "The clerk reads the fi-\nle before the house is sold."),
        ("page", "scan", "保单持有人可以在线变更\n— 12 —\n保险金额，变更自次日零时起生效。"),
        ("char", "scan", "受益入凭单据可领取5OO元以内的费用。"),
        ("word", "scan", "The clcrk reads thc file before the housc is sold."),
        ("title", "scan", f"{HEAD}\n{BODY[0]}"),
        ("clean", "scan", f"常见问答\n{BODY[0]}见第5页。\n\n{BODY[1]}"),
        ("null", "scan", None),
        ("empty", "scan", ""),
        ("nosource", None, f"{BODY[0]}\n77\n{BODY[1]}"),
        ("page", "scan", "保单持有人可以在线变更\n— 12 —\n保险金额，变更自次日零时起生效。"),
        (None, "scan", "3"),
    ]
    return spark.createDataFrame(rows, "chunk_id string, source string, text string").selectExpr("chunk_id", "text", "struct(source as source_file) as metadata", "'x' as id", "1 as tri")


def test_kinds(corpus):
    got = {}
    for r in ScanRepair(corpus, corpus).kinds().collect():
        got.setdefault(r["chunk_id"], set()).add(r["noise_kind"])
    assert {k: v for k, v in got.items() if not k.startswith("h")} == {"broken": {"break"}, "page": {"page", "break"}, "char": {"char"}, "word": {"char"}, "nosource": {"page"}, "dash": {"break"}}
    assert all(got[f"h{k}"] == ({"header"} if k % 2 else {"header", "page"}) for k in range(8))
    assert not {"title", "clean", "null", "empty"} & set(got)


def test_repaired_texts(corpus):
    rows = {r["chunk_id"]: r for r in ScanRepair(corpus, corpus).repaired().collect()}
    assert rows["broken"]["text"] == "".join(BODY[:2]) and rows["page"]["text"] == BODY[2] and rows["char"]["text"] == BODY[3]
    assert rows["dash"]["text"] == rows["word"]["text"] == "The clerk reads the file before the house is sold."
    assert HEAD not in rows["h1"]["text"] and rows["clean"]["noise_kinds"] == []


def test_headers_of_any_length(spark):
    spaced = " ".join("Larkhurst Re — Ridgeway Gold Policy Booklet of the Year".replace(" ", ""))
    long = "Larkhurst Re Mutual — " + "General Conditions of the Ridgeway Gold Policy " * 3 + "Booklet"
    assert len(spaced) > 80 and len(long) > 80
    rows = [(f"{name}{k}", name, f"{BODY[k % 4]}\n{head}\n{BODY[(k + 1) % 4]}") for name, head in (("spaced", spaced), ("long", long)) for k in range(6)]
    df = spark.createDataFrame(rows, "chunk_id string, source string, text string").selectExpr("chunk_id", "text", "struct(source as source_file) as metadata")
    rows = ScanRepair(df, df).repaired().collect()
    assert len(rows) == 12 and all(r["noise_kinds"] == ["header"] and "\n".join(r["text"].split("\n")[1:]) in BODY for r in rows)


def test_breaks_over_headers(spark, corpus):
    other = "溯溯远航农机险条款《甲》"
    rows = [(f"t{k}", "cut", f"{BODY[k % 4]}\n{HEAD}\n{other}\n{BODY[(k + 1) % 4]}") for k in range(8)]
    rows += [
        ("one", "cut", f"被保险人应当在三十日内向保险公\n{HEAD}\n司提交单据。"),
        ("two", "cut", f"被保险人应当在三十日内向保险公\n— 3 —\n{HEAD}\n\n{other}\n4\n司提交单据。"),
        ("hyphen", "cut", f"The clerk reads the fi-\n{HEAD}\nle before the house is sold."),
        ("whole", "cut", f"{BODY[0]}\n{HEAD}\n{BODY[1]}"),
    ]
    df = corpus.select("chunk_id", "text", "metadata").unionByName(spark.createDataFrame(rows, "chunk_id string, source string, text string").selectExpr("chunk_id", "text", "struct(source as source_file) as metadata"))
    got = {r["chunk_id"]: r for r in ScanRepair(df, df).repaired().collect()}
    assert got["one"]["text"] == got["two"]["text"] == BODY[0] and got["hyphen"]["text"] == "The clerk reads the file before the house is sold."
    assert got["one"]["noise_kinds"] == got["hyphen"]["noise_kinds"] == ["break", "header"] and got["two"]["noise_kinds"] == ["break", "header", "page"]
    assert got["whole"]["noise_kinds"] == ["header"] and got["whole"]["text"] == f"{BODY[0]}\n{BODY[1]}"


def frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, source string, text string").selectExpr("chunk_id", "text", "struct(source as source_file) as metadata")


def test_hyphens_by_what_the_corpus_writes(spark):
    known = ["a well-known house", "the insurance pays", "die Kranken- und Pflegeversicherung zahlt", "insurance for all", "und so weiter"]
    rows = [(f"k{k}", "s", known[k % 5]) for k in range(20)]
    rows += [("inner", "s", "it is a well-\nknown rule"), ("cut", "s", "this insur-\nance ends"), ("hanging", "s", "neue Kranken-\nund Pflegeversicherung"), ("unknown", "s", "some quix-\notic rule")]
    got = {r["chunk_id"]: r["text"] for r in ScanRepair(frame(spark, rows), frame(spark, rows)).repaired().collect()}
    assert got["inner"] == "it is a well-known rule" and got["cut"] == "this insurance ends"
    assert got["hanging"] == "neue Kranken- und Pflegeversicherung" and got["unknown"] == "some quixotic rule"


@pytest.mark.parametrize("most", [None, 0])
def test_misreadings_outside_the_list_are_learned(spark, monkeypatch, most):
    import docloom.llm.scannoise as module

    if most is not None:
        monkeypatch.setattr(module, "MAX_SENT", most)
    assert "檢" not in MISREAD
    rows = [(f"k{k}", "s", "请提交检验报告。检查结果以检定书为准，检修另计。") for k in range(12)]
    rows.append(("bad", "s", "请提交檢验报告。檢查结果以檢定书为准，检修另计。"))
    repair = ScanRepair(frame(spark, rows), frame(spark, rows))
    assert repair.pairs["檢"] == "检"
    got = {r["chunk_id"]: (r["text"], r["noise_kinds"]) for r in repair.repaired().collect()}
    assert got["bad"] == (rows[0][2], ["char"]) and got["k1"] == (rows[1][2], [])


def test_headers_with_differences_count_together(spark):
    # each with another character misread, so that none comes back as it is
    head = "东海人寿保险股份有限公司终身寿险利益条款节选本"
    rows = [(f"h{k}", "s", f"{BODY[k % 4]}\n{head[: 3 * k + 1]}{'甲乙丙丁戊己庚'[k]}{head[3 * k + 2 :]}\n{BODY[(k + 1) % 4]}") for k in range(7)]
    got = {(r["chunk_id"], r["noise_kind"]) for r in ScanRepair(frame(spark, rows), frame(spark, rows)).kinds().collect()}
    assert {(f"h{k}", "header") for k in range(7)} <= got


def test_empty_table(spark, corpus):
    assert ScanRepair(corpus.limit(0), corpus.limit(0)).kinds().count() == 0


@pytest.mark.parametrize("line,want", [("— 3 —", ("", "— 3 —")), ("第 4 页", ("", "第 4 页")), ("页码：7", ("", "页码：7")), ("3/9", ("", "3/9")), ("[31]", ("", "[31]")), ("12", ("", "12")), ("第三页", ("", "第三页")), ("总则　　第3页 共9页", ("总则", "第3页 共9页")), ("Booklet  Page 2 of 4", ("Booklet", "Page 2 of 4")), ("见第3页。", ("见第3页。", "")), ("共有 12", ("共有 12", ""))])
def test_page_marks(line, want):
    assert split_page(line) == want


def test_how_lines_join():
    assert _joins("the insur-", "ance pays")[0] == "sure" and _joins("费用约68", "%折算")[0] == "sure" and _joins("完成。", "下一句")[0] == "no"
    assert _joins("| a | b |", "| c | d |")[0] == "no" and _joins("按九", "日")[0] == "no"
    assert _joins("变更保险", "金额自次日") == ("open", packed("保险金"), packed("险金额"))


def test_rebuilding_keeps_positions():
    marks = [{"kind": "char", "line_no": 0, "pos": 1, "size": 2, "repl": "x"}, {"kind": "char", "line_no": 0, "pos": 5, "size": 1, "repl": "yy"}, {"kind": "break", "line_no": 0, "pos": 1, "size": 0, "repl": None}]
    assert rebuild("a12b\nc3", marks) == "axb yy3"
