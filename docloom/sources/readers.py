"""Sources: binary files with routing, Markdown, extracted pages, CSV, chunk JSON, lexicons."""

from __future__ import annotations

import csv as csvlib
import io
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.extraction import file_text, route, suffix

CHUNK_METADATA = (
    "chunk_id STRING, chunk_type STRING, section_path ARRAY<STRING>, heading_level INT, char_count INT, image_refs ARRAY<STRING>, source_file STRING, start_line INT, end_line INT, "
    "has_table BOOLEAN, has_list BOOLEAN, skip_embedding BOOLEAN, skip_sentences ARRAY<INT>, semantic_type STRING, clause_number STRING, is_core_section BOOLEAN, trigger_words ARRAY<STRING>, key_terms ARRAY<STRING>"
)
CHUNK = f"chunk_id STRING, text STRING, embedding_text STRING, metadata STRUCT<{', '.join(p.replace(' ', ': ', 1) for p in CHUNK_METADATA.split(', '))}>, sentence_infos ARRAY<STRUCT<text: STRING, skip_embedding: BOOLEAN, reason: STRING>>"
ITEM = "type STRING, text STRING, list_items ARRAY<STRING>, page_idx INT, text_level INT, bbox ARRAY<DOUBLE>"
SUFFIXES = (".pdf", ".png", ".jpg", ".jpeg", ".bmp", ".tiff", ".tif", ".csv")


def files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False, supported_only: bool = True) -> DataFrame:
    """(path, suffix, route, modificationTime, length, content) of a folder's files; content is read only if selected."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    out = raw.select("path", suffix(F.col("path")).alias("suffix"), route(F.col("path")).alias("route"), "modificationTime", "length", "content")
    return out.where(F.col("route") != "unsupported") if supported_only else out


def checked_route(path: F.Column) -> F.Column:
    """The route of a path; an unsupported one is an error."""
    kind = route(path)
    return F.when(kind == "unsupported", F.raise_error(F.concat(F.lit("unsupported file: "), path))).otherwise(kind)


def extract(files_df: DataFrame, extractor: Callable[[str, bytes], str]) -> DataFrame:
    """(path, markdown, error) of binary files by a function of path and content; a file that fails has its error instead."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows.append((path, extractor(path, bytes(content)), None))
                except Exception as e:  # noqa: BLE001 - one bad file must not end the others
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "markdown", "error"])

    return files_df.select("path", "content").mapInPandas(run, "path string, markdown string, error string")


def markdown(spark: SparkSession, folder: str, pattern: str = "*.md", recursive: bool = True) -> DataFrame:
    """(path, text): each file one row, line ends as \\n."""
    raw = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).text(folder, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def extracted_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(path, item_no, item fields) of the content lists (JSON arrays) that an extractor left under a folder."""
    raw = spark.read.option("pathGlobFilter", "*_content_list.json").option("recursiveFileLookup", "true").text(folder, wholetext=True)
    items = F.posexplode(F.from_json("value", f"ARRAY<STRUCT<{', '.join(p.replace(' ', ': ', 1) for p in ITEM.split(', '))}>>"))
    return raw.select(F.col("_metadata.file_path").alias("path"), items.alias("item_no", "item")).select("path", "item_no", "item.*")


def csv(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("utf-8", "gbk"), infer: bool = True) -> DataFrame:
    """A CSV file with a header, in the first of the encodings in which it holds no replacement character.

    Encodings beyond Unicode's need a session that allows Java's charsets (``spark.sql.legacy.javaCharsets``), as local
    ones of this package do; without it Spark rejects them.
    """
    for k, encoding in enumerate(encodings):
        df = spark.read.option("header", True).option("encoding", encoding).option("inferSchema", infer).csv(path)
        if k + 1 == len(encodings):
            return df
        lines = spark.read.option("encoding", encoding).csv(path, sep="\u0001", schema="line string")
        if not any("�" in c for c in df.columns) and lines.where(F.contains("line", F.lit("�"))).limit(1).count() == 0:
            return df
    raise ValueError("no encoding given")


def csv_tables(files_df: DataFrame, encodings: tuple[str, ...] = ("utf-8", "gbk")) -> DataFrame:
    """(path, markdown, error) of CSV files, each as one pipe table under its name, in the first encoding that can read it."""

    def table(path: str, content: bytes) -> str:
        for encoding in encodings:
            try:
                text = content.decode(encoding)
                break
            except UnicodeDecodeError:
                continue
        else:
            raise ValueError(f"none of {encodings} reads the file")
        rows = [["" if x is None else x for x in r] for r in csvlib.reader(io.StringIO(text.removeprefix("\ufeff")))]
        if not rows:
            raise ValueError("no columns")
        lines = [f"| {' | '.join(rows[0])} |", "|" + "---|" * len(rows[0]), *(f"| {' | '.join(r)} |" for r in rows[1:])]
        name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        return f"# {name}\n\n" + "\n".join(lines)

    return extract(files_df, table)


def documents(spark: SparkSession, folder: str, extractor: Callable[[str, bytes], str] | None = None) -> DataFrame:
    """(path, text, error) of all files under a folder by their routes; a file that cannot be read has its error.

    Markdown is taken as it is; an extractor's content list only where no Markdown of the same name lies beside it;
    CSV files become pipe tables; PDF and image files go to ``extractor``, and without one are left out.
    """
    none = F.lit(None).cast("string")
    md = markdown(spark, folder)
    out = md.select("path", "text", none.alias("error"))
    # both come from one extraction: the Markdown goes first
    items = extracted_pages(spark, folder).withColumn("file_id", F.regexp_replace("path", r"_content_list\.json$", ".md"))
    listed = file_text(items).select(F.col("file_id").alias("path"), F.col("file_text").alias("text"))
    out = out.unionByName(listed.join(md.select("path"), "path", "left_anti").select("path", "text", none.alias("error")))
    found = files(spark, folder, recursive=True)
    made = csv_tables(found.where("route = 'csv'"))
    if extractor is not None:
        made = made.unionByName(extract(found.where("route in ('pdf', 'image')"), extractor))
    return out.unionByName(made.withColumnRenamed("markdown", "text"))


def chunk_json(spark: SparkSession, folder: str, sentences: bool = True, strict: bool = True, pattern: str = "*_chunks.json", per_line: bool = False) -> DataFrame:
    """Chunks of all JSON arrays in a folder's files, one array a file or ``per_line``; an unknown metadata key is an error if ``strict``."""
    raw = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=not per_line)
    chunk = F.from_json("value", f"ARRAY<STRUCT<{_colons(CHUNK)}>>", {"mode": "FAILFAST"})
    keys = F.from_json("value", "ARRAY<STRUCT<metadata: MAP<STRING, STRING>>>")
    both = raw.select(F.explode(F.arrays_zip(chunk.alias("c"), keys.alias("m"))).alias("z")).select("z.*")
    both = both.toDF("c", "m")
    if strict:
        known = F.array(*(F.lit(p.split(" ")[0]) for p in CHUNK_METADATA.split(", ")))
        unknown = F.array_except(F.map_keys("m.metadata"), known)
        both = both.where(F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("unknown metadata: "), F.array_join(unknown, ", ")))).otherwise(True))
    out = both.select("c.*")
    filled = F.transform("sentence_infos", lambda s: F.struct(s["text"].alias("text"), F.coalesce(s["skip_embedding"], F.lit(False)).alias("skip_embedding"), F.coalesce(s["reason"], F.lit("")).alias("reason")))
    return out.withColumn("sentence_infos", filled) if sentences else out.drop("sentence_infos")


def _colons(ddl: str) -> str:
    """A top-level DDL list in the form that stands inside STRUCT<>."""
    out, depth = [], 0
    start = 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[start:i].strip().replace(" ", ": ", 1))
            start = i + 1
    return ", ".join(out)


def lexicon_json(spark: SparkSession, path: str) -> DataFrame:
    """(standard, variant, ord) of a JSON object {standard: [variants]}."""
    raw = spark.read.text(path, wholetext=True)
    pairs = raw.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.map_entries(F.from_json("value", "MAP<STRING, ARRAY<STRING>>"))).alias("i", "e"))
    # numbered through, whatever the number of a term's variants
    before = F.expr("coalesce(sum(size(e.value)) over (partition by path order by i rows between unbounded preceding and 1 preceding), 0)")
    numbered = pairs.select("e", "i", before.alias("before"))
    return numbered.select(F.col("e.key").alias("standard"), "before", F.posexplode("e.value").alias("j", "variant")).withColumn("ord", F.col("before") + F.col("j") + 1).select("standard", "variant", F.col("ord").cast("int").alias("ord"))
