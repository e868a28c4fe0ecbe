"""Document structure: blocks of Markdown texts, semantic atoms, and chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.functions import textlogic
from docloom.functions.ids import carried, carried_type
from docloom.operators.terminology import extract_terms
from docloom.profiles import ZH, Profile

_BLOCK = "block_no int, type string, content string, level int, title string, section_path array<string>, heading_level int, line_num int"
_ATOM = "atom_no int, text string, semantic_type string, trigger_words array<string>"
_CHUNK = (
    "chunk_no int, text string, chunk_type string, section_path array<string>, heading_level int, image_refs array<string>, start_line int, end_line int, has_table boolean, has_list boolean, "
    "skip_embedding boolean, semantic_type string, trigger_words array<string>, sentence_infos array<struct<text:string,skip_embedding:boolean,reason:string>>"
)


def _per_text(df: DataFrame, id_col: str, text_col: str, schema: str, rows_of) -> DataFrame:
    """Rows made of each text, one Arrow batch at a time, no shuffle; a null text makes none."""
    names = ["_id", *(c.strip().split(" ")[0] for c in _split_schema(schema))]
    kind = df.select(F.col(id_col)).schema[0].dataType.simpleString()
    source = df.select(carried(F.col(id_col), kind).alias("_id"), F.col(text_col).alias("_text")).where("_text is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for ident, text in zip(pdf["_id"], pdf["_text"]):
                out += [(ident, *row) for row in rows_of(text)]
                if len(out) > 5_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    return source.mapInPandas(run, f"_id {carried_type(kind)}, {schema}").withColumn("_id", F.col("_id").cast(kind)).withColumnRenamed("_id", id_col.split(".")[-1])


def _split_schema(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:i])
            start = i + 1
    return [*out, schema[start:]]


def blocks(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Headings, tables, lists and paragraphs of Markdown texts, in order, with their section paths."""

    def rows(text: str):
        for k, b in enumerate(textlogic.parse_blocks(text)):
            heading = b.kind == "heading"
            yield k, b.kind, b.content, b.level if heading else None, b.title, b.path, None if heading else b.level, b.line

    return _per_text(df, id_col, text_col, _BLOCK, rows)


def atoms(df: DataFrame, id_col: str, text_col: str = "text", profile: Profile = ZH, double: bool = True) -> DataFrame:
    """Stretches of one semantic class, in order, with their trigger words."""
    return _per_text(df, id_col, text_col, _ATOM, lambda t: ((k, *a) for k, a in enumerate(textlogic.semantic_atoms(t, profile, double))))


def long_pieces(df: DataFrame, id_col: str, text_col: str = "text", longest: int = 500) -> DataFrame:
    """Texts over ``longest`` characters cut at list points, punctuation or length; others as they are."""
    return _per_text(df, id_col, text_col, "piece_no int, piece string", lambda t: enumerate(textlogic.split_long(t, longest)))


def chunks(df: DataFrame, id_col: str, text_col: str = "text", sizes: textlogic.Sizes = textlogic.Sizes(), profile: Profile = ZH, repeat: int = 3, cleaning: bool = True, semantic: bool = True, next_path: bool = False) -> DataFrame:
    """The chunks of Markdown documents with all their metadata, terms and a deterministic chunk_id.

    A chunk has the path of its own section; with ``next_path`` the last one of a section has the next one's.
    A null text has no chunks, and neither has a blank one.
    """

    def rows(text: str):
        for k, c in enumerate(textlogic.chunk_document(text, sizes, profile, repeat, cleaning, semantic, next_path)):
            infos = [{"text": a, "skip_embedding": b, "reason": r} for a, b, r in c.sentence_infos]
            yield k, c.text, c.chunk_type, c.section_path, c.heading_level, c.image_refs, c.start_line, c.end_line, c.has_table, c.has_list, c.skip_embedding, c.semantic_type, c.trigger_words, infos

    out = _per_text(df, id_col, text_col, _CHUNK, rows)
    name = id_col.split(".")[-1]
    out = out.withColumns(
        {
            "chunk_id": F.sha2(F.concat_ws("\u0001", F.col(name).cast("string"), F.col("chunk_no").cast("string"), "text"), 256),
            "char_count": F.length("text"),
            "clause_number": X.clause_number(F.col("text"), profile),
            "is_core_section": X.is_core_section(F.col("section_path"), profile),
            "embedding_text": X.embedding_text(F.col("sentence_infos"), F.col("text"), F.col("skip_embedding")),
        }
    )
    terms = extract_terms(F.col("text"), profile.terms)
    # no terms are null, as opposed to no trigger words
    return out.withColumn("key_terms", F.when(F.size(terms) > 0, terms))


def chunk_statistics(df: DataFrame, size: str = "char_count", kind: str = "chunk_type", images: str = "image_refs", table: str = "has_table", listed: str = "has_list") -> DataFrame:
    """One row: number of chunks, mean, least and largest size, counts with images, tables and lists; none for no chunks."""
    n = F.count("*").alias("total_chunks")
    return df.agg(
        n,
        F.round(F.avg(size), 6).alias("avg_chunk_size"),
        F.min(size).alias("min_chunk_size"),
        F.max(size).alias("max_chunk_size"),
        F.count_if(F.size(images) > 0).alias("chunks_with_images"),
        F.count_if(F.col(table)).alias("chunks_with_tables"),
        F.count_if(F.col(listed)).alias("chunks_with_lists"),
    ).where("total_chunks > 0")
