"""Queries of the document and retrieval operators, each over whole tables, with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import cleaning, embedding, extraction, generation, retrieval, structure, terminology
from docloom.plans import chunk_sql as sql
from docloom.profiles import HEADING, LIST_ITEM, RE2_SPACE, SPECIAL_LINE, ZH, re2
from docloom.session import shared_folder, table
from docloom.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(text: str | None = None):
    """Register a query under its function's name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if text is not None:
            ORACLE[f.__name__] = text
        return f

    return add


_quote, _strip, _rstrip, _sentences, _class_case, _triggers = sql.quote, sql.strip, sql.rstrip, sql.sentences, sql.class_case, sql.triggers
_LINES = "string_split(text, chr(10))"
_PAGE, _BOILER, _STOPS = sql.PAGE, sql.BOILER, sql.STOPS


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "test_semantic_chunks")


# ---- lines and cleaning ----


@query("SELECT doc_id, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS ls FROM documents WHERE text IS NOT NULL)")
def line_explode(spark, d):
    return cleaning.line_rows(table(spark, d, "documents"), "doc_id")


@query(
    f"""WITH l AS (SELECT doc_id, array_to_string(list_transform({_LINES}, lambda x: {_rstrip('x')}), chr(10)) AS t FROM documents),
    a AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), '\\A\\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM l)
    SELECT doc_id, regexp_replace(regexp_replace(t, '\\n{{3,}}\\z', chr(10) || chr(10), 'g'), '\\A\\n{{2,}}\\z', chr(10), 'g') AS text FROM a"""
)
def normalize_blank_runs(spark, d):
    return table(spark, d, "documents").select("doc_id", X.squeeze_blank(F.col("text")).alias("text"))


@query(f"SELECT chunk_id, array_to_string(list_filter({_LINES}, lambda x: NOT (regexp_matches(x, {_PAGE}, 'i') AND length({_strip('x')}) <= 10)), chr(10)) AS text FROM test_semantic_chunks")
def drop_page_lines(spark, d):
    return _chunks(spark, d).select("chunk_id", X.drop_page_lines(F.col("text")).alias("text"))


_EDGE = f"""WITH one AS (SELECT DISTINCT chunk_id, text FROM test_semantic_chunks WHERE text IS NOT NULL),
    l AS (SELECT chunk_id, len({_LINES}) AS n, generate_subscripts({_LINES}, 1) - 1 AS pos, unnest({_LINES}) AS line FROM one),
    c AS (SELECT chunk_id, line, n, pos, count(*) OVER (PARTITION BY chunk_id, line) AS times, length({_strip('line')}) AS size FROM l),
    gone AS (SELECT DISTINCT chunk_id, line FROM c WHERE n >= 10 AND (pos < least(5, n // 10) OR pos >= n - least(5, n // 10)) AND times >= 2 AND size > 0 AND size >= CASE WHEN times >= 3 THEN 10 ELSE 20 END)"""


@query(_EDGE + " SELECT chunk_id, line FROM gone")
def header_footer_lines(spark, d):
    return _chunks(spark, d).where("text is not null").select("chunk_id", "text").distinct().select("chunk_id", F.explode(X.edge_lines(F.split("text", "\n"))).alias("line"))


@query(_EDGE + " SELECT chunk_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.chunk_id = l.chunk_id AND g.line = l.line)), '') AS text FROM l GROUP BY chunk_id")
def header_footer_removed(spark, d):
    return _chunks(spark, d).where("text is not null").select("chunk_id", "text").distinct().select("chunk_id", X.drop_edge_lines(F.col("text")).alias("text"))


@query(
    f"""WITH l AS (SELECT doc_id, generate_subscripts({_LINES}, 1) - 1 AS pos, unnest({_LINES}) AS line FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, pos, line, {_strip('line')} AS st FROM l),
    n AS (SELECT *, lead(st) OVER w AS nx FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    m AS (SELECT *, st <> '' AND st[1] <> '#' AND NOT regexp_matches(st, '[{_STOPS}]\\z') AND coalesce(nx, '') <> '' AND NOT regexp_matches(nx, {_quote(re2(SPECIAL_LINE))}) AS can FROM n),
    i AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, can ORDER BY pos) AS island FROM m),
    f AS (SELECT *, can AND (pos - min(pos) OVER (PARTITION BY doc_id, can, island)) % 2 = 0 AS first_of_two FROM i),
    g AS (SELECT *, coalesce(lag(first_of_two) OVER (PARTITION BY doc_id ORDER BY pos), false) AS taken FROM f)
    SELECT doc_id, string_agg(CASE WHEN first_of_two THEN st || ' ' || nx ELSE line END, chr(10) ORDER BY pos) FILTER (WHERE NOT taken) AS text FROM g GROUP BY doc_id"""
)
def merge_broken_lines(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", cleaning.join_broken_lines(F.col("text")).alias("text"))


_CHUNK_TEXTS = "WITH one AS (SELECT DISTINCT chunk_id AS id, text FROM test_semantic_chunks WHERE text IS NOT NULL),"
_DOC_TEXTS = "(SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL)"


@query(_CHUNK_TEXTS + sql.cleaned("one") + " SELECT id AS chunk_id, text FROM cleaned")
def basic_clean(spark, d):
    return _chunks(spark, d).where("text is not null").select("chunk_id", "text").distinct().select("chunk_id", cleaning.basic_clean(F.col("text")).alias("text"))


@query(f"SELECT chunk_id, generate_subscripts(ss, 1) - 1 AS pos, unnest(ss) AS sentence FROM (SELECT chunk_id, {_sentences('text')} AS ss FROM test_semantic_chunks WHERE text IS NOT NULL)")
def split_sentences(spark, d):
    return cleaning.sentence_rows(_chunks(spark, d), "chunk_id")


@query(f"SELECT doc_id, len(list_filter(ss, lambda s: regexp_matches(s, {_BOILER}))) AS boilerplate, len(ss) AS sentences FROM (SELECT doc_id, {_sentences('text')} AS ss FROM documents WHERE text IS NOT NULL)")
def boilerplate_flags(spark, d):
    ss = X.sentences(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(F.filter(ss, lambda s: X.is_boilerplate(s))).alias("boilerplate"), F.size(ss).alias("sentences"))


_DENOISED = f"""WITH s AS (SELECT metadata.source_file AS source_file, unnest({_sentences('text')}) AS sentence FROM test_semantic_chunks WHERE text IS NOT NULL AND metadata.source_file IS NOT NULL),
    k AS (SELECT source_file, {_strip('sentence')} AS key FROM s),
    c AS (SELECT source_file, key, count(*) OVER (PARTITION BY source_file, key) AS times FROM k),
    r AS (SELECT source_file, key, times, CASE WHEN key = '' THEN '' WHEN regexp_matches(key, {_BOILER}) THEN 'boilerplate' WHEN times >= 3 THEN 'repetitive' ELSE '' END AS reason FROM c)"""


def _denoised(spark, d):
    rows = cleaning.sentence_rows(_chunks(spark, d).where("metadata.source_file is not null").select(F.col("metadata.source_file").alias("source_file"), "text"), "source_file")
    return cleaning.denoise(rows, "source_file")


@query(_DENOISED + " SELECT source_file, reason, count(*) AS sentences FROM r GROUP BY ALL")
def denoise_reason_counts(spark, d):
    return _denoised(spark, d).groupBy("source_file", "reason").agg(F.count("*").alias("sentences"))


@query(_DENOISED + " SELECT DISTINCT source_file, key AS sentence, times FROM r WHERE times >= 3 AND key <> ''")
def repetitive_sentences(spark, d):
    return _denoised(spark, d).where("repeats >= 3").select("source_file", X.strip(F.col("sentence")).alias("sentence"), F.col("repeats").alias("times")).distinct()


@query(
    "WITH one AS " + _DOC_TEXTS + "," + sql.cleaned("one") + f""",
    s AS (SELECT id, generate_subscripts(ss, 1) - 1 AS pos, unnest(ss) AS sentence FROM (SELECT id, {_sentences('text')} AS ss FROM cleaned)),
    c AS (SELECT *, {_strip('sentence')} AS key, count(*) OVER (PARTITION BY id, {_strip('sentence')}) AS n FROM s),
    r AS (SELECT *, CASE WHEN key = '' THEN '' WHEN regexp_matches(key, {_BOILER}) THEN 'boilerplate' WHEN n >= 3 THEN 'repetitive' ELSE '' END AS reason FROM c)
    SELECT id AS doc_id, pos::INT AS pos, sentence, CASE WHEN key <> '' AND n >= 3 THEN n ELSE 0 END AS repeats, reason, reason <> '' AS skip_embedding FROM r"""
)
def clean_and_split(spark, d):
    return cleaning.clean_and_split(table(spark, d, "documents"), "doc_id")


# ---- structure ----


@query(
    f"""SELECT chunk_id, pos, length(regexp_extract(st, {_quote(re2(HEADING))}, 1)) AS level, regexp_extract(st, {_quote(re2(HEADING))}, 2) AS title
    FROM (SELECT chunk_id, pos, {_strip('line')} AS st FROM (SELECT chunk_id, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS line FROM (SELECT chunk_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS ls FROM test_semantic_chunks WHERE text IS NOT NULL)))
    WHERE regexp_matches(st, {_quote(re2(HEADING))})"""
)
def headings(spark, d):
    rows = cleaning.line_rows(_chunks(spark, d), "chunk_id")
    return rows.where(X.heading_level(F.col("line")) > 0).select("chunk_id", "pos", X.heading_level(F.col("line")).alias("level"), X.heading_title(F.col("line")).alias("title"))


@query(
    f"""WITH h AS (SELECT chunk_id, list_filter(list_transform({_LINES}, lambda x: {{'l': length(regexp_extract({_strip('x')}, {_quote(re2(HEADING))}, 1)), 't': regexp_extract({_strip('x')}, {_quote(re2(HEADING))}, 2)}}), lambda h: h.l > 0) AS hs FROM test_semantic_chunks WHERE text IS NOT NULL),
    p AS (SELECT chunk_id, list_reduce(hs, lambda a, x: {{'path': a.path[1 : x.l - 1] || [x.t], 'o': a.o || [a.path[1 : x.l - 1] || [x.t]]}}, {{'path': []::VARCHAR[], 'o': []::VARCHAR[][]}}).o AS paths FROM h)
    SELECT chunk_id, (generate_subscripts(paths, 1) - 1)::INT AS heading_no, array_to_string(unnest(paths), ' > ') AS section_path FROM p WHERE len(paths) > 0"""
)
def heading_stack(spark, d):
    """Section paths after each heading of each text."""
    ls = F.filter(F.transform(F.split("text", "\n"), lambda x: F.struct(X.heading_level(x).alias("level"), X.heading_title(x).alias("title"))), lambda h: h["level"] > 0)
    rows = _chunks(spark, d).where("text is not null").select("chunk_id", X.heading_paths(ls).alias("paths")).where(F.size("paths") > 0)
    return rows.select("chunk_id", F.posexplode("paths").alias("heading_no", "path")).select("chunk_id", "heading_no", F.array_join("path", " > ").alias("section_path"))


@query(
    f"""SELECT chunk_id, len(list_filter(ls, lambda x: regexp_matches({_strip('x')}, {_quote(re2(LIST_ITEM))}))) AS list_lines,
    len(list_filter(ls, lambda x: starts_with({_strip('x')}, '<table'))) AS table_starts, len(list_filter(ls, lambda x: contains(x, '</table>'))) AS table_ends,
    array_to_string(regexp_extract_all(text, '!\\[.*?\\]\\((.*?)\\)', 1), '|') AS images FROM (SELECT chunk_id, text, {_LINES} AS ls FROM test_semantic_chunks WHERE text IS NOT NULL)"""
)
def markdown_marks(spark, d):
    ls = F.split("text", "\n")
    n = lambda f: F.size(F.filter(ls, f))
    return _chunks(spark, d).where("text is not null").select("chunk_id", n(X.is_list_item).alias("list_lines"), n(X.starts_table).alias("table_starts"), n(X.ends_table).alias("table_ends"), F.array_join(X.image_refs(F.col("text")), "|").alias("images"))


@query(_CHUNK_TEXTS + sql.blocks("one") + """
    SELECT id AS chunk_id, block_no::INT AS block_no, kind AS type, content, CASE WHEN kind = 'heading' THEN level END::INT AS level, title, array_to_string(path, ' > ') AS section_path, CASE WHEN kind <> 'heading' THEN level END::INT AS heading_level, line::INT AS line_num FROM blocks""")
def markdown_blocks(spark, d):
    return structure.blocks(_chunks(spark, d).dropDuplicates(["chunk_id"]), "chunk_id").withColumn("section_path", F.array_join("section_path", " > "))


@query(f"SELECT chunk_id, {_class_case('text')} AS semantic_type, array_to_string({_triggers('text')}, '|') AS trigger_words FROM test_semantic_chunks WHERE text IS NOT NULL")
def semantic_type(spark, d):
    rows = _chunks(spark, d).where("text is not null").select("chunk_id", "text", X.first_pattern(F.col("text")).alias("first"))
    return rows.select("chunk_id", X.semantic_type(F.col("first")).alias("semantic_type"), F.array_join(X.trigger_words(F.col("text"), F.col("first")), "|").alias("trigger_words"))


@query(
    f"""WITH one AS (SELECT DISTINCT chunk_id, text FROM test_semantic_chunks WHERE text IS NOT NULL),
    p AS (SELECT chunk_id, string_split_regex(text, '[。；\\n]') AS fs, list_append(regexp_extract_all(text, '[。；\\n]'), '') AS ds FROM one),
    f AS (SELECT chunk_id, generate_subscripts(fs, 1) AS pos, unnest(fs) AS f, unnest(ds) AS d FROM p),
    k AS (SELECT *, {_class_case('f')} AS kind, {_triggers('f')} AS hits FROM f),
    g AS (SELECT *, lag(kind) OVER (PARTITION BY chunk_id ORDER BY pos) AS prev FROM k),
    b AS (SELECT *, sum(CASE WHEN prev IS NOT NULL AND prev <> '其他' AND prev <> kind THEN 1 ELSE 0 END) OVER (PARTITION BY chunk_id ORDER BY pos) AS grp,
      CASE WHEN kind = '其他' THEN []::VARCHAR[] WHEN prev IS NULL OR prev = '其他' THEN list_concat(hits, hits) ELSE hits END AS words FROM g),
    a AS (SELECT chunk_id, grp, string_agg(f || d, '' ORDER BY pos) AS t, arg_max(kind, pos) AS semantic_type, array_to_string(flatten(list(words ORDER BY pos)), '|') AS trigger_words FROM b GROUP BY chunk_id, grp),
    c AS (SELECT chunk_id, grp, {_strip('t')} AS text, semantic_type, trigger_words FROM a)
    SELECT chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY grp) - 1 AS atom_no, text, semantic_type, trigger_words FROM c WHERE text <> ''
    UNION ALL SELECT chunk_id, 0, text, '其他', '' FROM one WHERE {_strip('text')} = ''"""
)
def semantic_atoms(spark, d):
    rows = structure.atoms(_chunks(spark, d).select("chunk_id", "text").distinct(), "chunk_id")
    return rows.withColumn("trigger_words", F.array_join("trigger_words", "|"))


@query("SELECT doc_id, generate_subscripts(s, 1) - 1 AS piece_no, unnest(s) AS piece FROM (SELECT doc_id, list_transform(range(0, length(text), 500), lambda i: substring(text, i + 1, 500)) AS s FROM documents WHERE text IS NOT NULL)")
def fixed_width_split(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(X.fixed_slices(F.col("text"), 500)).alias("piece_no", "piece"))


@query("WITH one AS " + _DOC_TEXTS + "," + sql.pieces("one", 500) + " SELECT id AS doc_id, piece_no::INT AS piece_no, text AS piece FROM pieces")
def long_atom_split(spark, d):
    return structure.long_pieces(table(spark, d, "documents"), "doc_id", longest=500)


@query(f"SELECT chunk_id, nullif(regexp_extract(text, {_quote(re2(ZH.clause))}), '') AS clause_number FROM test_semantic_chunks")
def clause_number(spark, d):
    return _chunks(spark, d).select("chunk_id", X.clause_number(F.col("text")).alias("clause_number"))


@query(f"SELECT chunk_id, {' OR '.join(f'contains(p, {_quote(w)})' for w in ZH.core_sections)} AS is_core FROM (SELECT chunk_id, coalesce(array_to_string(metadata.section_path, ' '), '') AS p FROM test_semantic_chunks)")
def core_section_flag(spark, d):
    return _chunks(spark, d).select("chunk_id", X.is_core_section(F.col("metadata.section_path")).alias("is_core"))


@query(
    """SELECT chunk_id, CASE WHEN coalesce(metadata.skip_embedding, false) THEN '' WHEN coalesce(len(sentence_infos), 0) = 0 THEN text
    ELSE array_to_string(list_transform(list_filter(sentence_infos, lambda s: NOT coalesce(s.skip_embedding, false)), lambda s: s.text), chr(10)) END AS embedding_text FROM test_semantic_chunks"""
)
def embedding_text(spark, d):
    return _chunks(spark, d).select("chunk_id", X.embedding_text(F.col("sentence_infos"), F.col("text"), F.col("metadata.skip_embedding")).alias("embedding_text"))


@query(sql.chunks(_DOC_TEXTS))
def chunk_documents(spark, d):
    """All of a chunk's fields, arrays joined."""
    made = structure.chunks(table(spark, d, "documents"), "doc_id")
    infos = F.array_join(F.transform("sentence_infos", lambda s: F.concat(s["text"], F.lit("\1"), s["reason"])), "\2")
    joined = {c: F.coalesce(F.array_join(c, "|"), F.lit("")) for c in ("image_refs", "trigger_words", "key_terms")}
    return made.withColumns({**joined, "section_path": F.array_join("section_path", " > "), "sentence_infos": infos, "clause_number": F.coalesce("clause_number", F.lit(""))})


@query(
    """SELECT count(*) AS total_chunks, round(avg(metadata.char_count), 6) AS avg_chunk_size, min(metadata.char_count) AS min_chunk_size, max(metadata.char_count) AS max_chunk_size,
    count(*) FILTER (WHERE len(metadata.image_refs) > 0) AS chunks_with_images, count(*) FILTER (WHERE metadata.has_table) AS chunks_with_tables, count(*) FILTER (WHERE metadata.has_list) AS chunks_with_lists
    FROM (SELECT DISTINCT chunk_id, metadata FROM test_semantic_chunks)"""
)
def chunk_stats(spark, d):
    return structure.chunk_statistics(_chunks(spark, d).dropDuplicates(["chunk_id"]).select("metadata.*"))


@query("SELECT coalesce(metadata.chunk_type, '') AS chunk_type, coalesce(metadata.semantic_type, '') AS semantic_type, count(DISTINCT chunk_id) AS chunks FROM test_semantic_chunks GROUP BY ALL")
def chunk_type_histogram(spark, d):
    return _chunks(spark, d).groupBy(F.coalesce("metadata.chunk_type", F.lit("")).alias("chunk_type"), F.coalesce("metadata.semantic_type", F.lit("")).alias("semantic_type")).agg(F.count_distinct("chunk_id").alias("chunks"))


@query(
    """SELECT DISTINCT chunk_id, text, embedding_text, metadata.chunk_type AS chunk_type, array_to_string(metadata.section_path, ' > ') AS section_path, metadata.heading_level AS heading_level, metadata.char_count AS char_count, metadata.source_file AS source_file,
    metadata.has_table AS has_table, metadata.semantic_type AS semantic_type, len(metadata.key_terms) AS key_terms, coalesce(len(sentence_infos), 0) AS sentences, coalesce(len(list_filter(sentence_infos, lambda s: coalesce(s.skip_embedding, false))), 0) AS skipped FROM test_semantic_chunks"""
)
def chunk_json_round_trip(spark, d):
    """Chunks written as JSON arrays and read again."""
    folder = f"{shared_folder(spark)}/chunks-{uuid4().hex}"
    chunks = _chunks(spark, d)
    sinks.chunk_arrays(chunks, folder, "metadata.source_file")
    read = readers.chunk_json(spark, folder, pattern="*", per_line=True)
    meta = [F.col(f"metadata.{c}").alias(c) for c in ("chunk_type", "heading_level", "char_count", "source_file", "has_table", "semantic_type")]
    n = lambda c: F.greatest(F.size(c), F.lit(0))
    terms = F.when(F.col("metadata.key_terms").isNotNull(), F.size("metadata.key_terms"))
    infos = F.coalesce("sentence_infos", F.array().cast(read.schema["sentence_infos"].dataType))
    rows = read.select("chunk_id", "text", "embedding_text", *meta, F.array_join("metadata.section_path", " > ").alias("section_path"), terms.alias("key_terms"), n(infos).alias("sentences"), F.size(F.filter(infos, lambda s: s["skip_embedding"])).alias("skipped"))
    return rows.distinct()


# ---- terms ----

_INDEX = "(SELECT variant, max_by(standard, (coalesce(ord, 0), standard)) AS standard FROM lexicon WHERE variant <> '' AND standard IS NOT NULL GROUP BY variant)"


@query(f"SELECT * FROM {_INDEX}")
def variant_index(spark, d):
    return terminology.variant_index(table(spark, d, "lexicon"))


@query("SELECT DISTINCT standard FROM lexicon WHERE standard IS NOT NULL")
def standard_terms(spark, d):
    return terminology.standard_terms(table(spark, d, "lexicon"))


_MORE = "(VALUES ('被保险人', '承保对象', 1), ('新术语', '新词', 2)) m(standard, variant, ord)"


@query(f"SELECT standard, variant, ord FROM lexicon WHERE standard NOT IN (SELECT standard FROM {_MORE}) UNION ALL SELECT standard, variant, (ord + (SELECT coalesce(max(ord), 0) FROM lexicon))::INT FROM {_MORE}")
def lexicon_add(spark, d):
    more = spark.createDataFrame([("被保险人", "承保对象", 1), ("新术语", "新词", 2)], "standard string, variant string, ord int")
    return terminology.add_terms(table(spark, d, "lexicon"), more)


@query("SELECT standard, variant, ord FROM lexicon WHERE standard <> '被保险人' AND variant NOT IN (SELECT variant FROM lexicon WHERE standard = '被保险人')")
def lexicon_remove(spark, d):
    return terminology.remove_terms(table(spark, d, "lexicon"), spark.createDataFrame([("被保险人",)], "standard string"))


@query(f"SELECT DISTINCT doc_id, standard FROM documents d JOIN {_INDEX} i ON contains(d.text, i.variant)")
def term_extraction(spark, d):
    return terminology.terms_of(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "lexicon"))


@query(f"SELECT DISTINCT query_id, standard FROM (SELECT DISTINCT query_id, query FROM answer) a JOIN {_INDEX} i ON contains(a.query, i.variant)")
def query_terms(spark, d):
    return terminology.terms_of(table(spark, d, "answer").select("query_id", "query").distinct(), "query_id", "query", table(spark, d, "lexicon"))


_DEFAULT = {v: s for s, vs in ZH.terms.items() for v in vs}


@query(f"SELECT chunk_id, coalesce((SELECT string_agg(s, '|' ORDER BY s) FROM (SELECT DISTINCT s FROM (VALUES {', '.join(f'({_quote(s)}, {_quote(v)})' for v, s in _DEFAULT.items())}) t(s, v) WHERE contains(c.text, t.v))), '') AS terms FROM test_semantic_chunks c WHERE text IS NOT NULL")
def default_terms(spark, d):
    return _chunks(spark, d).where("text is not null").select("chunk_id", F.array_join(terminology.extract_terms(F.col("text"), ZH.terms), "|").alias("terms"))


# ---- extraction results ----

_ITEMS = "(SELECT DISTINCT ON (file_id, item_no) * FROM content_item WHERE file_id IS NOT NULL)"
_PARTS = "list_filter(CASE WHEN type = 'list' THEN coalesce(list_items, []) ELSE [text] END, lambda x: x IS NOT NULL AND x <> '')"


@query(f"SELECT file_id, coalesce(page_idx, 0) AS page_idx, array_to_string(flatten(list({_PARTS} ORDER BY item_no)), chr(10) || chr(10)) AS page_text FROM {_ITEMS} GROUP BY ALL")
def text_by_page(spark, d):
    return extraction.text_by_page(extraction.distinct_items(table(spark, d, "content_item")))


@query(f"SELECT file_id, array_to_string(flatten(list({_PARTS} ORDER BY item_no)), chr(10) || chr(10)) AS file_text FROM {_ITEMS} GROUP BY ALL")
def file_text(spark, d):
    return extraction.file_text(extraction.distinct_items(table(spark, d, "content_item")))


@query(
    f"""SELECT file_id, item_no, array_to_string(CASE WHEN len(a) > 0 THEN a ELSE b END, '|') AS lines FROM (SELECT file_id, item_no, list_filter(list_transform(coalesce(list_items, []), lambda x: {_strip('x')}), lambda x: x <> '') AS a,
    list_filter([{_strip('text')}], lambda x: x <> '') AS b FROM {_ITEMS})"""
)
def recognised_lines(spark, d):
    """Lines of recognition results, in the first of their shapes that holds any."""
    none = F.lit(None).cast("array<string>")
    pairs = F.lit(None).cast("array<struct<text:string>>")
    items = extraction.distinct_items(table(spark, d, "content_item")).where("file_id is not null")
    return items.select("file_id", "item_no", F.array_join(extraction.recognised_lines(F.col("list_items"), none, F.array("text"), none, pairs), "|").alias("lines"))


@query(
    f"""SELECT file_id, count(*) AS total_items, {', '.join(f"count(*) FILTER (WHERE type = '{k}') AS {k}_items" for k in ('text', 'list', 'image', 'table'))},
    coalesce(sum(length(text)) FILTER (WHERE type = 'text'), 0)::BIGINT AS text_length, count(DISTINCT page_idx) AS page_count, array_to_string(list_sort(list_filter(list(DISTINCT page_idx), lambda x: x IS NOT NULL)), ',') AS pages FROM {_ITEMS} GROUP BY file_id"""
)
def content_stats(spark, d):
    return extraction.item_statistics(extraction.distinct_items(table(spark, d, "content_item")))


@query(
    """SELECT file_id, lower(regexp_extract(p, '(\\.[^./\\\\]+)$', 1)) AS suffix, CASE WHEN p IS NULL THEN NULL WHEN lower(p) LIKE '%.pdf' THEN 'pdf' WHEN regexp_matches(lower(p), '\\.(png|jpg|jpeg|bmp|tiff|tif)$') THEN 'image' WHEN lower(p) LIKE '%.csv' THEN 'csv' ELSE 'unsupported' END AS route
    FROM (SELECT file_id, regexp_replace(source_file, '\\.md$', '.' || file_type) AS p FROM raw_file)"""
)
def file_routing(spark, d):
    path = F.concat(F.regexp_replace("source_file", r"\.md$", "."), F.col("file_type"))
    return table(spark, d, "raw_file").select("file_id", extraction.suffix(path).alias("suffix"), extraction.route(path).alias("route"))


@query("SELECT DISTINCT file_id, source_file FROM raw_file r WHERE NOT EXISTS (SELECT 1 FROM content_item c WHERE c.file_id = r.file_id)")
def skip_processed(spark, d):
    return extraction.not_yet_processed(table(spark, d, "raw_file"), table(spark, d, "content_item"), "file_id").select("file_id", "source_file").distinct()


@query("SELECT count(*) AS row_count, 6 AS column_count, 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS columns FROM orders")
def csv_profile(spark, d):
    return extraction.table_profile(table(spark, d, "orders"))


@query("SELECT c_custkey, '| ' || coalesce(c_custkey::VARCHAR, '') || ' | ' || coalesce(c_name, '') || ' | ' || coalesce(c_mktsegment, '') || ' |' AS line FROM customer")
def csv_rows(spark, d):
    return extraction.pipe_rows(table(spark, d, "customer"), "c_custkey", ["c_custkey", "c_name", "c_mktsegment"])


@query("SELECT '# nation' || chr(10) || chr(10) || '| n_nationkey | n_name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation")
def csv_markdown(spark, d):
    return extraction.pipe_table(table(spark, d, "nation"), "n_nationkey", "nation", ["n_nationkey", "n_name"])


@query("SELECT c_mktsegment, round(avg(o_totalprice), 4) AS avg_total, count(*) AS orders FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def structured_avg(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_mktsegment").agg(F.round(F.avg("o_totalprice"), 4).alias("avg_total"), F.count("*").alias("orders"))


@query("SELECT chunk_id AS id, text, 'chunk' AS kind FROM test_semantic_chunks UNION ALL SELECT doc_id::VARCHAR, text, 'document' FROM documents")
def union_chunks(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.lit("document").alias("kind"))
    return _chunks(spark, d).select(F.col("chunk_id").alias("id"), "text", F.lit("chunk").alias("kind")).unionByName(docs)


@query("SELECT chunk_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS preview FROM test_semantic_chunks")
def text_preview(spark, d):
    return _chunks(spark, d).select("chunk_id", X.preview(F.col("text")).alias("preview"))


# ---- vectors and search ----


@query("SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) + 0.0) AS unit FROM embeddings WHERE embedding IS NOT NULL")
def l2_normalize(spark, d):
    return table(spark, d, "embeddings").where("embedding is not null").select("vec_id", F.transform(embedding.l2_normalise(F.col("embedding")), lambda x: F.round(x, 4)).alias("unit"))


_SCORES = "SELECT q.vec_id AS query_id, e.vec_id AS row_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 4) AS score FROM embeddings q JOIN embeddings e ON true WHERE q.vec_id % 50 = 0"


@query(_SCORES)
def similarity_matrix(spark, d):
    e = table(spark, d, "embeddings")
    return embedding.similarity(e.where("vec_id % 50 = 0"), e, "vec_id", "vec_id", "embedding", "embedding").withColumn("score", F.round("score", 4))


@query("SELECT e.vec_id AS row_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 4) AS score FROM embeddings e JOIN embeddings q ON q.vec_id = 0 ORDER BY score DESC, row_id LIMIT 20")
def vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    first = e.where("vec_id = 0").first()
    return retrieval.top_k(e, "vec_id", "embedding", list(first["embedding"]), 20)


@query(f"SELECT query_id, row_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM ({_SCORES})) WHERE rank <= 20")
def batch_topk(spark, d):
    e = table(spark, d, "embeddings")
    return retrieval.batch_top_k(e.where("vec_id % 50 = 0"), e, "vec_id", "vec_id", "embedding", "embedding", 20)


@query()
def ivf_topk(spark, d):
    e = table(spark, d, "embeddings")
    return retrieval.IvfIndex(e, "vec_id", "embedding").search(e.where("vec_id % 50 = 0"), "vec_id", "embedding", 20, probes=24)


_GRAMS = """WITH t AS (SELECT doc_id, rpad(text, greatest(length(text), 3)::INT, chr(0)) AS t FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, substring(t, i, 3) AS g, count(*) AS k FROM (SELECT doc_id, t, unnest(range(1, length(t) - 1)) AS i FROM t) GROUP BY ALL),
    h AS (SELECT g, list_reduce(list_transform(string_split(g, ''), lambda c: unicode(c)::UHUGEINT), lambda a, c: xor((xor(a, c) * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT, ((xor(a, c) * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT) // 536870912::UHUGEINT), 0::UHUGEINT) AS h FROM (SELECT DISTINCT g FROM p)),
    n AS (SELECT doc_id, (h % 64)::INT AS cell, sum(CASE WHEN h >= 9223372036854775808::UHUGEINT THEN k ELSE -k END)::INT AS v FROM p JOIN h USING (g) GROUP BY ALL)"""


@query(_GRAMS + " SELECT doc_id, cell, v AS grams FROM n WHERE v <> 0")
def document_grams(spark, d):
    """What the default encoder counts before the vectors get length 1."""
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", embedding.encode(F.col("text"), normalise=False).alias("vec"))
    return rows.select("doc_id", F.posexplode("vec").alias("cell", "grams")).where("grams <> 0").withColumn("grams", F.col("grams").cast("int"))


@query()
def document_vectors(spark, d):
    return table(spark, d, "documents").select("doc_id", embedding.encode(F.col("text")).alias("vec"))


_HITS = """hits AS (SELECT DISTINCT query_id, chunk_id, rank_score, rnk FROM hit WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL),
    asked AS (SELECT query_id, max(query) AS query FROM answer WHERE query_id IS NOT NULL GROUP BY query_id),
    one AS (SELECT DISTINCT ON (chunk_id) chunk_id, text, metadata FROM test_semantic_chunks),
    j AS (SELECT h.query_id, a.query, h.chunk_id, h.rank_score, c.text, c.metadata FROM hits h JOIN asked a USING (query_id) JOIN one c USING (chunk_id))"""
_WORDS = f"list_distinct(list_filter(string_split_regex(lower(query), '[{RE2_SPACE}]+'), lambda w: w <> ''))"
_BOOST = f"""coalesce(len(list_filter({_WORDS}, lambda w: contains(lower(coalesce(array_to_string(metadata.section_path, ' '), '')), w))), 0) * 0.1::DOUBLE
    + CASE WHEN metadata.has_table THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN metadata.has_list THEN 0.03::DOUBLE ELSE 0 END + CASE WHEN metadata.heading_level <= 2 THEN 0.02::DOUBLE ELSE 0 END"""
_PAIRS = "CASE WHEN length(query) >= 2 THEN list_distinct(list_transform(range(1, length(query)), lambda i: substring(query, i, 2))) ELSE [query] END"


def _hits(spark, d):
    hits = table(spark, d, "hit").where("query_id is not null and chunk_id is not null").select("query_id", "chunk_id", "rank_score", "rnk").distinct().drop("rnk")
    asked = table(spark, d, "answer").where("query_id is not null").groupBy("query_id").agg(F.max("query").alias("query"))
    # texts are made distinct only where a hit asks for them
    one = _chunks(spark, d).select("chunk_id", "text", "metadata").join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi").dropDuplicates(["chunk_id"])
    return hits.join(asked, "query_id").join(one, "chunk_id")


@query(f"WITH {_HITS} SELECT query_id, chunk_id, round({_BOOST}, 6) AS boost FROM j")
def metadata_boost(spark, d):
    m = "metadata."
    boost = retrieval.metadata_boost(F.col("query"), F.col(m + "section_path"), F.col(m + "has_table"), F.col(m + "has_list"), F.col(m + "heading_level"))
    return _hits(spark, d).select("query_id", "chunk_id", F.round(boost, 6).alias("boost"))


_STAGES = f"""WITH {_HITS}, first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC NULLS LAST, chunk_id) AS rank FROM j) WHERE rank <= 20),
    scored AS (SELECT *, round(len(list_filter({_PAIRS}, lambda p: contains(text, p)))::DOUBLE / greatest(len({_PAIRS}), 1) + {_BOOST}, 6) AS rerank_score FROM first),
    second AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, rank, chunk_id) AS final_rank FROM scored)"""


@query(_STAGES + " SELECT query_id, chunk_id, rank_score, rank, rerank_score, final_rank FROM second WHERE final_rank <= 5")
def two_stage_search(spark, d):
    return retrieval.search(_hits(spark, d)).select("query_id", "chunk_id", "rank_score", "rank", "rerank_score", "final_rank")


@query(_STAGES + " SELECT query_id, chunk_id, rank_score, rank FROM first WHERE rank <= 5")
def search_without_rerank(spark, d):
    return retrieval.search(_hits(spark, d), use_rerank=False).select("query_id", "chunk_id", "rank_score", "rank")


_PIECES = f"""{_STAGES}, piece AS (SELECT query_id, query, final_rank AS number, '文档片段' || final_rank || '：' || chr(10) || CASE WHEN coalesce(len(metadata.section_path), 0) > 0 THEN '【' || array_to_string(metadata.section_path, ' > ') || '】' || chr(10) ELSE '' END || text || chr(10) AS piece FROM second WHERE final_rank <= 5),
    run AS (SELECT *, sum(length(piece)) OVER (PARTITION BY query_id ORDER BY number) AS used FROM piece)"""


def _given(spark, d):
    return retrieval.search(_hits(spark, d)).select("query_id", F.col("final_rank").alias("number"), F.col("metadata.section_path").alias("section_path"), "text")


@query(_PIECES + " SELECT query_id, number, used::BIGINT AS used FROM run WHERE used <= 3000")
def prompt_budget(spark, d):
    return generation.budgeted(_given(spark, d)).select("query_id", "number", "used")


@query(
    _PIECES
    + """, ctx AS (SELECT query_id, string_agg(piece, chr(10) ORDER BY number) AS context, count(*) AS n_used FROM run WHERE used <= 3000 GROUP BY query_id),
    given AS (SELECT query_id, count(*) AS n FROM piece GROUP BY query_id)
    SELECT a.query_id, a.query, coalesce(list_filter(string_split(c.context, chr(10)), lambda l: l <> '' AND NOT starts_with(l, '文档片段') AND NOT starts_with(l, '【'))[1], '') AS answer, coalesce(g.n, 0)::INT AS num_chunks_used, coalesce(c.n_used, 0)::INT AS num_chunks_in_context, (length(a.query) + length(coalesce(c.context, '')) + """
    + str(len(generation.PROMPT_HEAD) + len(generation.PROMPT_TAIL.replace("{query}", "")))
    + ")::INT AS prompt_length FROM asked a LEFT JOIN ctx c USING (query_id) LEFT JOIN given g USING (query_id)"
)
def rag_answers(spark, d):
    asked = table(spark, d, "answer").where("query_id is not null").groupBy("query_id").agg(F.max("query").alias("query"))
    return generation.answers(asked, _given(spark, d))


# ---- streaming (an extension) ----


@query("SELECT time_bucket(INTERVAL 10 MINUTES, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_window_counts(spark, d):
    from docloom.streaming.ingest import windowed_counts

    path = f"{d}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")
    counts = windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
    out = f"{shared_folder(spark)}/window-counts-{uuid4().hex}"
    # each micro-batch replaces the table of counts; none of it passes through the driver
    keep = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{out}-progress").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
    keep.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(out).withColumn("start", F.col("start").cast("timestamp_ntz"))
