"""Terms, extraction, vectors, search, prompts."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import embedding, extraction, generation, retrieval, structure, terminology
from docloom.profiles import PROMPT_HEAD, ZH_TERMS


def test_last_term_wins(spark):
    index = {r["variant"]: r["standard"] for r in terminology.variant_index(terminology.default_lexicon(spark)).collect()}
    assert index["保险金额"] == "保险金额" and len(index) == 108


def test_both_ways_to_find_terms_agree(spark):
    texts = [(1, "投保人应缴纳保费，保单持有人可退保。"), (2, ""), (3, None), (4, "保"), (5, "意外身故")]
    df = spark.createDataFrame(texts, "id int, text string")
    joined = {}
    for r in terminology.terms_by_join(df, "id", "text", terminology.default_lexicon(spark)).collect():
        joined.setdefault(r["id"], set()).add(r["standard"])
    assert {(r["id"], r["standard"]) for r in terminology.terms_of(df, "id", "text", terminology.default_lexicon(spark)).collect()} == {(k, t) for k, v in joined.items() for t in v}
    for r in df.select("id", terminology.extract_terms(F.col("text"), ZH_TERMS).alias("t")).collect():
        assert set(r["t"] or []) == joined.get(r["id"], set())
    assert joined[5] == {"意外伤害", "身故"}


def test_terms_added_and_removed(spark):
    lex = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "standard string, variant string, ord int")
    more = spark.createDataFrame([("a", "z", 1)], "standard string, variant string, ord int")
    assert {(r["standard"], r["variant"]) for r in terminology.add_terms(lex, more).collect()} == {("b", "x"), ("a", "z")}
    gone = spark.createDataFrame([("a",)], "standard string")
    assert terminology.remove_terms(lex, gone).collect() == []


def test_recognition_results_of_five_shapes(spark):
    schema = "a array<string>, b array<string>, c array<string>, d array<string>, e array<struct<text:string,score:double>>"
    rows = [(["x", " ", "y "], ["no"], None, None, None), ([], [" z"], None, None, None), (None, None, ["t"], None, None), (None, None, None, ["u", None], None), (None, None, None, None, [("v", 0.9)]), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    got = [r[0] for r in df.select(extraction.recognised_lines(*(F.col(c) for c in "abcde"))).collect()]
    assert got == [["x", "y"], ["z"], ["t"], ["u"], ["v"], []]


def test_pages_and_statistics(spark):
    schema = "file_id long, item_no int, type string, text string, list_items array<string>, page_idx int"
    rows = [(1, 2, "text", "b", None, 1), (1, 1, "text", "a", None, 1), (1, 3, "list", None, ["p", "", "q"], 2), (1, 4, "image", None, None, 3), (1, 5, "text", None, None, None), (None, 1, "text", "z", None, 1), (1, 2, "text", "b", None, 1)]
    items = extraction.distinct_items(spark.createDataFrame(rows, schema))
    pages = {r["page_idx"]: r["page_text"] for r in extraction.text_by_page(items).collect()}
    assert pages == {0: "", 1: "a\n\nb", 2: "p\n\nq", 3: ""}
    s = extraction.item_statistics(items).first()
    assert (s["total_items"], s["text_items"], s["list_items"], s["image_items"], s["text_length"], s["page_count"], s["pages"]) == (5, 3, 1, 1, 2, 3, "1,2,3")
    assert extraction.file_text(items).first()["file_text"] == "a\n\nb\n\np\n\nq"


def test_routes(spark):
    df = spark.createDataFrame([("/a/B.PDF",), ("x.jpeg",), ("t.csv",), ("t.docx",), ("noend",), (None,)], "p string")
    assert [r[0] for r in df.select(extraction.route(F.col("p"))).collect()] == ["pdf", "image", "csv", "unsupported", "unsupported", None]


def test_pipe_table(spark):
    df = spark.createDataFrame([(2, None), (1, "x")], "k int, v string")
    assert extraction.pipe_table(df, "k", "t").first()[0] == "# t\n\n| k | v |\n|---|---|\n| 1 | x |\n| 2 |  |"


@pytest.fixture
def vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8))
    v[5] = v[6]
    return spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(900, None)], "vec_id int, v array<double>"), np.round(v, 12)


def test_exact_search(spark, vectors):
    df, v = vectors
    got = retrieval.batch_top_k(df.where("vec_id < 7"), df, "vec_id", "vec_id", "v", "v", 5).collect()
    for q in range(7):
        scores = np.round(v @ v[q], 4)
        best = sorted(range(300), key=lambda k: (-scores[k], k))[:5]
        assert [r["row_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == best
    one = retrieval.top_k(df, "vec_id", "v", v[3].tolist(), 1000).collect()
    assert len(one) == 300


def test_cells_keep_the_neighbours(spark, vectors):
    df, v = vectors
    index = retrieval.IvfIndex(df, "vec_id", "v", n_cells=10)
    got = {(r["query_id"], r["row_id"]) for r in index.search(df.where("vec_id < 40"), "vec_id", "v", 10, probes=6).collect()}
    want = {(r["query_id"], r["row_id"]) for r in retrieval.batch_top_k(df.where("vec_id < 40"), df, "vec_id", "vec_id", "v", "v", 10).collect()}
    assert len(got & want) >= 0.9 * len(want)
    assert retrieval.IvfIndex(df.limit(4), "vec_id", "v").search(df.limit(1), "vec_id", "v", 2).count() >= 1


def test_vectors_have_length_one(spark):
    df = spark.createDataFrame([(1, "短文"), (2, None), (3, "")], "id int, t string")
    rows = {r["id"]: r["v"] for r in df.select("id", embedding.encode(F.col("t")).alias("v")).collect()}
    assert rows[2] is None and abs(np.linalg.norm(rows[1]) - 1) < 1e-5
    assert embedding.encoder_info()["loaded"] >= 0
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(embedding.l2_normalise(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]


HIT = "query_id int, query string, chunk_id string, rank_score double, text string, metadata struct<section_path:array<string>,has_table:boolean,has_list:boolean,heading_level:int>"


def test_boost_and_stable_order(spark):
    meta = (["Claims", "Fees"], True, None, 2)
    rows = [(1, "claims fees claims", "a", 0.5, "none", meta), (1, "claims fees claims", "b", 0.9, "none", (None, None, None, None)), (1, "claims fees claims", "c", 0.7, "none", (None, None, None, None))]
    df = spark.createDataFrame(rows, HIT)
    got = {r["chunk_id"]: r["b"] for r in df.select("chunk_id", F.round(retrieval.metadata_boost(F.col("query"), *(F.col(f"metadata.{c}") for c in ("section_path", "has_table", "has_list", "heading_level"))), 6).alias("b")).collect()}
    assert got == {"a": 0.27, "b": 0.0, "c": 0.0}
    order = [r["chunk_id"] for r in retrieval.search(df).orderBy("final_rank").collect()]
    assert order == ["a", "b", "c"]
    plain = retrieval.search(df, rerank_top_k=2, use_rerank=False).orderBy("final_rank").collect()
    assert [(r["chunk_id"], r["rerank_score"]) for r in plain] == [("b", None), ("c", None)]
    assert retrieval.search(df.limit(0)).count() == 0


def test_prompt_stops_at_the_first_overflow(spark):
    hits = spark.createDataFrame([(1, 1, ["a", "b"], "x" * 50), (1, 2, None, "y" * 500), (1, 3, [], "z")], "query_id int, number int, section_path array<string>, text string")
    queries = spark.createDataFrame([(1, "q"), (2, "r")], "query_id int, query string")
    rows = {r["query_id"]: r for r in generation.answers(queries, hits, longest=200).collect()}
    assert rows[1]["num_chunks_used"] == 3 and rows[1]["num_chunks_in_context"] == 1 and rows[2]["num_chunks_in_context"] == 0
    text = generation.contexts(queries, hits, 200).where("query_id = 1").first()["context"]
    assert text == "文档片段1：\n【a > b】\n" + "x" * 50 + "\n"
    assert queries.select(generation.prompt(F.col("query"), F.lit("C"))).first()[0].startswith(PROMPT_HEAD + "C")


def test_chunks_have_stable_ids_and_terms(spark):
    df = spark.createDataFrame([(1, "# t\n\n投保人缴纳保险费。\n\n普通文字。"), (2, None), (3, "")], "doc_id int, text string")
    a, b = (sorted(r["chunk_id"] for r in structure.chunks(df, "doc_id").collect()) for _ in range(2))
    assert a == b and len(a) >= 1
    row = structure.chunks(df, "doc_id").where("doc_id = 1").first()
    assert "投保人" in row["key_terms"] and row["section_path"] == ["t"]
    assert structure.chunk_statistics(structure.chunks(df.limit(0), "doc_id")).count() == 0
    assert json.dumps(row["trigger_words"]) is not None


def test_large_ids_beside_null_ones(spark):
    big = 2**60 + 1
    df = spark.createDataFrame([(big, "- 列表"), (None, "文字")], "doc_id long, text string")
    assert {r["doc_id"] for r in structure.blocks(df, "doc_id").collect()} == {big, None}
    assert {r["doc_id"] for r in structure.chunks(df, "doc_id").collect()} == {big, None}
