"""Sentence boundaries in many scripts, with statistics of a small corpus."""

import pytest

import docloom.llm.sentences as module
from docloom.llm.sentences import SentenceModel, learn, split_sentences, text_sentences

EN = ["The office opens at nine. The clerk reads the file.", "The board met on Monday. Bring the form before 5 p.m. on weekdays.", "Costs rose, i.e. by about 4 percent. The file of Dr. Quill is closed.", "See Sec. 4 of the plan. The desk is open until 6 p.m. on Fridays.", "Dr. Quill signed the form. The office agreed. Bring the copy."]
DE = ["Der Schaden vom 3. März betrifft z. B. Sturz und Brand. Der Antrag bleibt offen.", "Nach Abs. 5 Nr. 4 zahlt die Stelle ca. 20 Taler. Danach gilt Satz 3.", "Der Beitrag steigt bis zum 34. Danach gilt Satz 38. Der Rest bleibt.", "Danach prüft die Stelle den Antrag. Der Fall vom 9. März ist offen."]
ZH = ["员工反问：“这里也算吗？”客户提交了单据。", "客户提交了单据。员工念道：“先看单据。再看合同。”随后转给了财务。", "员工念道：“请稍等。”随后转给了客服。客户提交了合同。", "员工反问：“那里也算吗？”员工没有回答。", "员工念道：“请看。”随后转给了柜台。", "客户离开了。"]
TH = ["ลูกค้าส่งเอกสาร บริษัทจ่ายเงิน 500 บาท", "บริษัทจ่ายเงิน 300 บาท ลูกค้าส่งเอกสาร", "ลูกค้าส่งเอกสาร", "บริษัทจ่ายเงิน 20 บาท", "ลูกค้าส่งเอกสาร"]


@pytest.fixture(scope="module")
def model(spark):
    rows = [t for part in (EN, DE, ZH, TH) for t in part] * 12
    return learn(spark.createDataFrame([(t,) for t in rows], "text string"))


def cut(text, model):
    return [text[s:e] for s, e in text_sentences(text, model)]


def test_abbreviations_are_learned(model):
    assert {("en", "p.m"), ("en", "i.e"), ("en", "Dr"), ("de", "Abs"), ("de", "Nr"), ("de", "ca")} <= model.abbreviations
    assert not {("en", "file"), ("en", "closed"), ("de", "offen")} & model.abbreviations


def test_periods(model):
    assert cut("The file of Dr. Quill is open until 5 p.m. on weekdays. The board met.", model) == ["The file of Dr. Quill is open until 5 p.m. on weekdays.", "The board met."]
    assert cut("Bring the form before 5 p.m. The office opens at nine.", model) == ["Bring the form before 5 p.m.", "The office opens at nine."]
    assert cut("Der Schaden vom 3. März ist offen. Der Beitrag steigt bis zum 34. Danach gilt Satz 3.", model) == ["Der Schaden vom 3. März ist offen.", "Der Beitrag steigt bis zum 34.", "Danach gilt Satz 3."]
    assert cut("The price is 3.50 and ver. 1.2.3 is at www.example.invalid today.", model) == ["The price is 3.50 and ver. 1.2.3 is at www.example.invalid today."]


def test_quotations(model):
    assert cut("员工反问：“这里也算吗？”客户提交了单据。", model) == ["员工反问：“这里也算吗？”", "客户提交了单据。"]
    assert cut("员工念道：“先看单据。再看合同。”随后转给了财务。", model) == ["员工念道：“先看单据。再看合同。”随后转给了财务。"]
    assert cut("“先付！”——这是口号。（见第2页。）完。", model)[0] == "“先付！”——这是口号。"
    assert cut('"Is it open?" asked the clerk. „Ist das so?“, fragte er.', model) == ['"Is it open?" asked the clerk.', "„Ist das so?“, fragte er."]
    assert cut("这……恐怕不行。真的吗？！好；的。", model) == ["这……恐怕不行。", "真的吗？！", "好；的。"]


def test_other_scripts(model):
    assert cut("क्या रसीद जरूरी है? फाइल बंद है। दर 5.8 है।", model) == ["क्या रसीद जरूरी है?", "फाइल बंद है।", "दर 5.8 है।"]
    assert cut("ลูกค้าส่งเอกสาร บริษัทจ่ายเงิน 700 บาท", model) == ["ลูกค้าส่งเอกสาร", "บริษัทจ่ายเงิน 700 บาท"]
    assert cut("お金を払いますか？はい。", model) == ["お金を払いますか？", "はい。"]


def test_lines_and_padding(model):
    text = "　标题没有标点 \r\n\n 第二行。  \n\t\n"
    assert [(s, e) for s, e in text_sentences(text, model)] == [(1, 7), (12, 16)]
    assert text_sentences("", model) == [] and text_sentences(" \n　", model) == []


def test_ellipses_end_before_what_begins_sentences(spark):
    rows = ["这……恐怕要等。客服没有解释。", "合同的金额……客服没有解释。", "客服提交了单据。客服离开了。", "合同的期限……\n客服没有解释。"] * 6
    model = learn(spark.createDataFrame([(t,) for t in rows], "text string"))
    assert cut("合同的保费……客服没有解释。", model) == ["合同的保费……", "客服没有解释。"]
    assert cut("这……恐怕要等。", model) == ["这……恐怕要等。"]


def test_collocations_are_learned(model):
    assert ("de", "# März") in model.collocations and not {("de", "# Danach"), ("de", "# Der")} & model.collocations


def test_scripts_without_word_lists(spark):
    ru = ["Договор подписан в г. Москве. Страховщик платит.", "Офис в г. Казани открыт. Клиент ждёт.", "Страховщик платит. Клиент ждёт ответа в г. Туле."] * 8
    model = learn(spark.createDataFrame([(t,) for t in ru], "text string"))
    assert ("cyrillic", "г") in model.abbreviations
    assert cut("Клиент ждёт в г. Твери. Страховщик платит.", model) == ["Клиент ждёт в г. Твери.", "Страховщик платит."]


def test_a_model_too_large_to_send_decides_alike(spark, monkeypatch):
    rows = [(str(k), t) for k, t in enumerate(t for part in (EN, DE, ZH, TH) for t in part * 6)] + [("n", None), ("e", ""), (None, EN[0])]
    df = spark.createDataFrame(rows, "chunk_id string, text string")
    sent = learn(df)
    assert isinstance(sent, SentenceModel)
    want = sorted(map(str, split_sentences(df, sent).collect()))
    monkeypatch.setattr(module, "MAX_ENTRIES", 0)
    joined = learn(df)
    assert not isinstance(joined, SentenceModel)
    assert sorted(map(str, split_sentences(df, joined).collect())) == want


def test_old_texts_are_cut_alike_in_a_larger_corpus(spark):
    texts = [t for part in (EN, DE, ZH, TH) for t in part]
    small, large = (learn(spark.createDataFrame([(t,) for t in texts * n], "text string")) for n in (12, 24))
    assert [cut(t, small) for t in texts] == [cut(t, large) for t in texts]


def test_units_cover_the_text(model):
    for text in EN + DE + ZH + TH:
        got = text_sentences(text, model)
        assert "".join(text[s:e] for s, e in got).replace(" ", "") == text.replace(" ", "")


def test_rows(spark, model):
    df = spark.createDataFrame([("a", "一。二。", "q"), ("b", None, "q"), ("c", "", "q"), ("a", "一。二。", "q"), ("d", "字" * 50_000 + "。", "q")], "chunk_id string, text string, id string")
    out = split_sentences(df, model).collect()
    assert sorted((r["chunk_id"], r["end_pos"]) for r in out) == [("a", 2), ("a", 2), ("a", 4), ("a", 4), ("d", 50_001)]
    assert split_sentences(df.limit(0), model).count() == 0
    empty = learn(df.limit(0))
    assert not empty.abbreviations and cut("一。二", empty) == ["一。", "二"]
