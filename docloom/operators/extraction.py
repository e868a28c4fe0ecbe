"""Results of text recognition: items of pages, text of files and pages, statistics, tables as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import strip

IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".bmp", ".tiff", ".tif")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def route(path: Column) -> Column:
    """pdf, image, csv or unsupported, by the path's suffix; null for null."""
    s = suffix(path)
    return F.when(path.isNull(), None).when(s == ".pdf", "pdf").when(s.isin(*IMAGE_SUFFIXES), "image").when(s == ".csv", "csv").otherwise("unsupported")


def recognised_lines(rec_texts: Column, rec_results: Column, textline_results: Column, attribute_texts: Column, pairs: Column) -> Column:
    """The lines of a recognition result in any of five shapes: of the first that holds a line, stripped and not blank."""
    shapes = [rec_texts, rec_results, textline_results, attribute_texts, F.transform(pairs, lambda p: p["text"])]
    out = F.array().cast("array<string>")
    for shape in reversed(shapes):
        held = F.filter(F.transform(F.coalesce(shape, F.array().cast("array<string>")), strip), lambda x: x.isNotNull() & (x != ""))
        out = F.when(F.size(held) > 0, held).otherwise(out)
    return out


def _item_text() -> Column:
    """What an item adds to a text: its text, then its list items, blanks left out."""
    return F.filter(F.concat(F.array(F.when(F.col("type") != "list", F.col("text"))), F.when(F.col("type") == "list", F.coalesce("list_items", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != ""))


def distinct_items(items: DataFrame, keys: tuple[str, str] = ("file_id", "item_no")) -> DataFrame:
    """Items stored twice once."""
    return items.dropDuplicates(list(keys))


def text_by_page(items: DataFrame) -> DataFrame:
    """(file_id, page_idx, page_text): texts and list items of each page in order, parted by blank lines.

    An item without a page is on page 0; a page without text has an empty one.
    """
    rows = items.where("file_id is not null").select("file_id", F.coalesce("page_idx", F.lit(0)).alias("page_idx"), "item_no", _item_text().alias("parts"))
    ordered = F.array_sort(F.collect_list(F.struct("item_no", "parts")))
    return rows.groupBy("file_id", "page_idx").agg(F.array_join(F.flatten(F.transform(ordered, lambda s: s["parts"])), "\n\n").alias("page_text"))


def file_text(items: DataFrame) -> DataFrame:
    """(file_id, file_text): texts and list items of each file in order, parted by blank lines."""
    rows = items.where("file_id is not null").select("file_id", "item_no", _item_text().alias("parts"))
    ordered = F.array_sort(F.collect_list(F.struct("item_no", "parts")))
    return rows.groupBy("file_id").agg(F.array_join(F.flatten(F.transform(ordered, lambda s: s["parts"])), "\n\n").alias("file_text"))


def item_statistics(items: DataFrame) -> DataFrame:
    """Per file: items, items of each type, characters of text items, and the sorted pages."""
    count = lambda kind: F.count_if(F.col("type") == kind)
    return (
        items.where("file_id is not null")
        .groupBy("file_id")
        .agg(
            F.count("*").alias("total_items"),
            count("text").alias("text_items"),
            count("list").alias("list_items"),
            count("image").alias("image_items"),
            count("table").alias("table_items"),
            F.coalesce(F.sum(F.when(F.col("type") == "text", F.length("text"))), F.lit(0)).alias("text_length"),
            F.count_distinct("page_idx").alias("page_count"),
            F.array_join(F.transform(F.array_sort(F.collect_set("page_idx")), lambda p: p.cast("string")), ",").alias("pages"),
        )
    )


def best_text(markdown: Column, csv_markdown: Column, item_text: Column) -> Column:
    """A file's text: its Markdown, else its table, else that of its items."""
    return F.coalesce(markdown, csv_markdown, item_text)


def pipe_rows(df: DataFrame, order: str, columns: list[str] | None = None) -> DataFrame:
    """(order, line): each row of a table as a line of a pipe table, nulls empty."""
    names = columns or df.columns
    return df.select(order, F.concat(F.lit("| "), F.array_join(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names)), " | "), F.lit(" |")).alias("line"))


def pipe_table(df: DataFrame, order: str, title: str, columns: list[str] | None = None) -> DataFrame:
    """One row with a small table as Markdown: a title, the head, and all rows in order."""
    names = columns or df.columns
    head = f"# {title}\n\n| {' | '.join(names)} |\n|{'---|' * len(names)}\n"
    rows = pipe_rows(df, order, names)
    return rows.agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda s: s["line"]), "\n")).alias("markdown"))


def table_profile(df: DataFrame) -> DataFrame:
    """Rows, columns and column names of a table."""
    return df.agg(F.count("*").alias("row_count")).select("row_count", F.lit(len(df.columns)).alias("column_count"), F.lit(",".join(df.columns)).alias("columns"))


def not_yet_processed(files: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Files without a result; with ``overwrite`` semantics simply don't call this."""
    return files.join(done.select(key).distinct(), key, "left_anti")
