"""Readers, sinks, the pipeline, streaming, and the entry point."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docloom import session
from docloom.operators import embedding
from docloom.plans.pipeline import Config, Pipeline, create_pipeline
from docloom.sources import readers, sinks
from docloom.streaming import ingest

ROOT = Path(__file__).resolve().parents[1]
DOC = "# 保险责任\r\n\r\n被保险人因意外伤害导致身故的，保险人按照合同约定给付保险金。\r\n"


def test_files_and_failing_extraction(spark, tmp_path):
    for name in ("a.PDF", "b.csv", "c.txt", "d.png"):
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.pdf").write_bytes(b"x")
    df = readers.files(spark, str(tmp_path))
    assert {(Path(r["path"]).name, r["route"]) for r in df.select("path", "route").collect()} == {("a.PDF", "pdf"), ("b.csv", "csv"), ("d.png", "image")}

    def extractor(path, content):
        if path.endswith(".csv"):
            raise ValueError("bad")
        return content.decode()

    rows = {Path(r["path"]).name: (r["markdown"], r["error"]) for r in readers.extract(df, extractor).collect()}
    assert rows["a.PDF"] == ("a.PDF", None) and rows["b.csv"] == (None, "ValueError: bad")
    with pytest.raises(Exception, match="unsupported file"):
        spark.createDataFrame([("x.doc",)], "p string").select(readers.checked_route(F.col("p"))).collect()


def test_csv_in_two_encodings(spark, tmp_path):
    (tmp_path / "g.csv").write_bytes("名称,数\n保险,1\n".encode("gbk"))
    (tmp_path / "u.csv").write_bytes("名称,数\n保险,1\n".encode())
    for name in ("g.csv", "u.csv"):
        df = readers.csv(spark, str(tmp_path / name))
        assert df.columns == ["名称", "数"] and df.first()["名称"] == "保险"


def test_chunk_json_round_trip(spark, tmp_path):
    meta = {"chunk_id": "1", "chunk_type": "paragraph", "section_path": ["s"], "heading_level": 1, "has_table": False}
    (tmp_path / "x_chunks.json").write_text(json.dumps([{"chunk_id": "1", "text": "t", "embedding_text": "t", "metadata": meta, "sentence_infos": [{"text": "t"}]}]), encoding="utf-8")
    row = readers.chunk_json(spark, str(tmp_path)).first()
    assert row["metadata"]["section_path"] == ["s"] and row["sentence_infos"][0].asDict() == {"text": "t", "skip_embedding": False, "reason": ""}
    assert "sentence_infos" not in readers.chunk_json(spark, str(tmp_path), sentences=False).columns
    sinks.chunk_json(readers.chunk_json(spark, str(tmp_path)), str(tmp_path / "out"))
    back = json.loads(spark.read.text(str(tmp_path / "out")).first()[0])
    assert back["metadata"]["clause_number"] is None and back["sentence_infos"]
    (tmp_path / "y_chunks.json").write_text(json.dumps([{"chunk_id": "2", "text": "t", "metadata": meta | {"novel": 1}}]))
    with pytest.raises(Exception, match="unknown metadata"):
        readers.chunk_json(spark, str(tmp_path)).collect()


def test_lexicons_and_content_lists(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"b": ["y", "x"], "a": ["z"]}), encoding="utf-8")
    lex = readers.lexicon_json(spark, str(tmp_path / "l.json"))
    assert json.loads(sinks.lexicon_json(lex).first()[0]) == {"b": ["y", "x"], "a": ["z"]}
    (tmp_path / "d_content_list.json").write_text(json.dumps([{"type": "text", "text": "p", "page_idx": 3}, {"type": "list", "list_items": ["q"]}]))
    rows = readers.extracted_pages(spark, str(tmp_path)).orderBy("item_no").collect()
    assert [(r["type"], r["page_idx"], r["list_items"]) for r in rows] == [("text", 3, None), ("list", None, ["q"])]


def test_from_documents_to_answers(spark, tmp_path):
    docs = tmp_path / "in" / "deep"
    docs.mkdir(parents=True)
    (docs / "a.md").write_bytes(DOC.encode())
    p = Pipeline(spark, Config(base=str(tmp_path / "work"), rank_top_k=5, rerank_top_k=2))
    with pytest.raises(RuntimeError):
        p.vectors  # noqa: B018
    assert p.process_documents(str(tmp_path / "in")).count() == 1
    (docs / "b.md").write_text("# 其他\n\n投保人应当缴纳保险费。", encoding="utf-8")
    again = p.process_documents(str(tmp_path / "in"))
    assert sorted(Path(r["path"]).name for r in again.select("path").collect()) == ["a.md", "b.md"]
    asked = spark.createDataFrame([(1, "意外伤害身故 怎么给付")], "query_id long, query string")
    row = p.query(asked, return_chunks=True).first()
    assert row["answer"] and row["num_chunks_used"] == 2 and len(row["chunks"]) == 2
    assert p.query(asked, use_rerank=False).first()["answer"] and p.get_status()["index_built"]
    assert Pipeline(spark, p.config).load_chunks_from_files().count() == 2


def test_files_of_all_kinds_become_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# a", encoding="utf-8")
    (tmp_path / "in" / "a_content_list.json").write_text(json.dumps([{"type": "text", "text": "not taken"}]))
    (tmp_path / "in" / "b_content_list.json").write_text(json.dumps([{"type": "text", "text": "p"}, {"type": "list", "list_items": ["q"]}]))
    (tmp_path / "in" / "c.csv").write_bytes("名,数\n甲,1\n".encode("gbk"))
    (tmp_path / "in" / "d.pdf").write_bytes(b"pages")
    (tmp_path / "in" / "e.png").write_bytes(b"broken")
    (tmp_path / "in" / "f.csv").write_bytes(b"\xff\xff")

    def extractor(path: str, content: bytes) -> str:
        if content == b"broken":
            raise OSError("cannot be read")
        return "# " + content.decode()

    got = {Path(r["path"]).name: (r["text"], r["error"]) for r in readers.documents(spark, str(tmp_path / "in"), extractor).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a.md": "# a", "b.md": "p\n\nq", "c.csv": "# c\n\n| 名 | 数 |\n|---|---|\n| 甲 | 1 |", "d.pdf": "# pages", "e.png": None, "f.csv": None}
    assert "cannot be read" in got["e.png"][1] and "reads the file" in got["f.csv"][1]
    p = Pipeline(spark, Config(base=str(tmp_path / "work")))
    made = p.process_documents(str(tmp_path / "in"), extractor=extractor)
    assert {Path(r["path"]).name for r in made.select("path").distinct().collect()} <= {"a.md", "b.md", "c.csv", "d.pdf"}
    assert spark.read.parquet(p.config.cleaned_dir).count() == 4
    sinks.text_files(spark.createDataFrame([("x/y.md", "one"), ("z.md", None)], "path string, text string"), str(tmp_path / "texts"))
    assert [(r["document"], r["value"]) for r in spark.read.text(str(tmp_path / "texts")).collect()] == [("y", "one")]


@pytest.mark.parametrize("kind", ["flat", "ivf"])
def test_chunks_are_encoded_once(spark, tmp_path, kind):
    log = tmp_path / "log"
    log.touch()

    def counting():
        inner = embedding.hashing_encoder()

        def encode(texts):
            with log.open("a") as f:
                f.writelines(f"{len(t)}\n" for t in texts)
            return inner(texts)

        return encode

    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.md").write_text(f"# {k}\n\n第{k}份文件的内容说明保险责任。", encoding="utf-8")
    config = Config(base=str(tmp_path / "work"), index_type=kind)
    asked = spark.createDataFrame([(1, "保险责任")], "query_id long, query string")
    for _ in range(2):
        # a new session of work finds what the first one kept
        p = Pipeline(spark, config, counting, f"counting-{kind}")
        p.process_documents(str(tmp_path / "in"))
        assert p.query(asked).first()["answer"]
        assert p.query(asked).first()["answer"]
    lines = log.read_text().split()
    question = max(map(int, lines))
    assert sum(int(n) != question for n in lines) == 3
    (tmp_path / "in" / "new.md").write_text("# n\n\n另一份文件。", encoding="utf-8")
    p = Pipeline(spark, config, counting, f"counting-{kind}")
    p.process_documents(str(tmp_path / "in"))
    assert p.vectors.count() == 4
    assert sum(int(n) != question for n in log.read_text().split()) == 4


def test_settings():
    assert Config(base="x").chunks_dir == str(Path("x") / "chunks") and Config(chunks_dir="y").chunks_dir == "y"
    with pytest.raises(ValueError, match="unknown"):
        create_pipeline(None, nonsense=1)


def test_new_files_are_ingested_once(spark, tmp_path):
    src, seen = tmp_path / "in", []
    src.mkdir()
    (src / "a.md").write_bytes(DOC.encode())
    for k in range(2):
        stream = ingest.markdown_stream(spark, str(src))
        ingest.ingest(stream, str(tmp_path / "cp"), lambda df, _: seen.append(df.count())).awaitTermination()
        (src / f"n{k}.md").write_text("第二份文件。", encoding="utf-8")
    assert sum(seen) == 2


def test_lineage_is_cut_in_a_shared_folder(spark):
    df = session.cut_lineage(spark.range(5))
    assert df.count() == 5 and spark.sparkContext.getCheckpointDir()


def test_the_rest_works_without_the_text_operators():
    code = "import sys; sys.modules['docloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'split_sentences' in q and 'p5_found' not in q and set(e.oracle_sql()) <= set(q); import docloom.__main__"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
