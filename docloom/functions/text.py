"""Text operations as column expressions; all of them run inside the JVM and need no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.profiles import HEADING, IMAGE, JAVA_SPACE, LIST_ITEM, ZH, Profile, any_of, java, occurs


def strip(c: Column) -> Column:
    """Without white space of any script at both ends (``trim`` leaves U+3000 and line ends)."""
    return F.regexp_replace(c, rf"(?U)\A[{JAVA_SPACE}]+|[{JAVA_SPACE}]+\z", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)[{JAVA_SPACE}]+\z", "")


def lines(text: Column) -> Column:
    """The lines of a text with any kind of line end; an empty text has one empty line, a null text none."""
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")


def is_page_line(line: Column, profile: Profile = ZH, longest: int = 10) -> Column:
    """Whether a line reads as a page number and is short enough to be nothing else."""
    return line.rlike(java(any_of([p.replace("$", r"\z") for p in profile.page_patterns]), "i")) & (F.length(strip(line)) <= longest)


def drop_page_lines(text: Column, profile: Profile = ZH) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~is_page_line(x, profile)), "\n")


def edge_lines(ls: Column, least_repeat: int = 20) -> Column:
    """The running headers and footers among the lines of a text of ten lines or more.

    A line of the outer tenth (five lines at most) on either side, found twice or more in the text, and long
    enough: ``least_repeat`` characters, half of it (five at least) when found three times.
    """
    n = F.size(ls)
    k = F.least(F.lit(5), F.floor(n / 10).cast("int"))
    outer = F.array_distinct(F.concat(F.slice(ls, 1, k), F.slice(ls, n - k + 1, k)))

    def runs(x: Column) -> Column:
        times = F.size(F.filter(ls, lambda y: y == x))
        long = F.length(strip(x))
        return (times >= 2) & (long > 0) & (long >= F.when(times >= 3, max(5, least_repeat // 2)).otherwise(least_repeat))

    return F.when(n >= 10, F.filter(outer, runs)).otherwise(F.array().cast("array<string>"))


def drop_edge_lines(text: Column, least_repeat: int = 20) -> Column:
    ls = F.split(text, "\n")
    gone = edge_lines(ls, least_repeat)
    return F.when(F.size(gone) == 0, text).otherwise(F.array_join(F.filter(ls, lambda x: ~F.array_contains(gone, x)), "\n"))


def sentences(text: Column, profile: Profile = ZH) -> Column:
    """Sentences of each line, cut behind every terminator and stripped; blank lines stay as they are."""
    t = profile.terminators

    def cut(line: Column) -> Column:
        parts = F.filter(F.transform(F.regexp_extract_all(line, F.lit(f"[^{t}]*[{t}]|[^{t}]+"), F.lit(0)), strip), lambda x: x != "")
        return F.when(strip(line) == "", F.array(line)).otherwise(parts)

    return F.flatten(F.transform(F.split(text, "\n"), cut))


def is_boilerplate(sentence: Column, profile: Profile = ZH) -> Column:
    return sentence.rlike(any_of(profile.boilerplate))


def is_core_section(path: Column, profile: Profile = ZH) -> Column:
    """Whether a section path, joined by blanks, holds one of the profile's core words; false for null."""
    joined = F.array_join(F.coalesce(path, F.array().cast("array<string>")), " ")
    return reduce(lambda a, b: a | b, (joined.contains(w) for w in profile.core_sections))


def first_pattern(text: Column, profile: Profile = ZH) -> Column:
    """The number of the first pattern that occurs, through all classes in order; -1 if none does, null for null.

    Looks for a class as a whole first, so a text of no class costs one search for each class. Make it a column of
    its own where both the class and the trigger words are wanted.
    """
    out = F.lit(-1)
    number = sum(len(patterns) for _, patterns in profile.classes)
    for _, patterns in reversed(profile.classes):
        number -= len(patterns)
        inner = F.lit(None).cast("int")
        for k, p in reversed(list(enumerate(patterns))):
            inner = F.when(text.rlike(java(occurs(p))), F.lit(number + k)).otherwise(inner)
        out = F.when(text.rlike(java(any_of([occurs(p) for p in patterns]))), inner).otherwise(out)
    return F.when(text.isNotNull(), out)


def semantic_type(first: Column, profile: Profile = ZH) -> Column:
    """The class of a text by its first pattern, the profile's other if there is none; null for null."""
    out, number = F.lit(profile.other), 0
    bounds = []
    for name, patterns in profile.classes:
        bounds.append((name, number, number + len(patterns) - 1))
        number += len(patterns)
    for name, low, high in reversed(bounds):
        out = F.when(first.between(low, high), name).otherwise(out)
    return F.when(first.isNotNull(), out)


def trigger_words(text: Column, first: Column, profile: Profile = ZH) -> Column:
    """All occurrences of the first pattern that occurs; none gives an empty array, null null."""
    out = F.array().cast("array<string>")
    for k, p in enumerate(p for _, patterns in profile.classes for p in patterns):
        # a lazy beginning always reaches back to its clause's start or the last occurrence; without being told
        # so, the search starts anew at every character of a clause without an occurrence
        told = java(p) if occurs(p) == p else java(rf"(?:\G|(?<=[，。；])){p}")
        out = F.when(first == k, F.regexp_extract_all(text, F.lit(told), F.lit(0))).otherwise(out)
    return F.when(text.isNotNull(), out)


def clause_number(text: Column, profile: Profile = ZH) -> Column:
    return F.nullif(F.regexp_extract(text, java(profile.clause), 0), F.lit(""))


def heading_level(line: Column) -> Column:
    """1 to 6 for a heading line, else 0."""
    return F.length(F.regexp_extract(strip(line), java(HEADING), 1))


def heading_title(line: Column) -> Column:
    return F.nullif(F.regexp_extract(strip(line), java(HEADING), 2), F.lit(""))


def is_list_item(line: Column) -> Column:
    return strip(line).rlike(java(LIST_ITEM))


def starts_table(line: Column) -> Column:
    return strip(line).startswith("<table")


def ends_table(line: Column) -> Column:
    return line.contains("</table>")


def image_refs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(IMAGE), F.lit(1))


def squeeze_blank(text: Column) -> Column:
    """Lines without trailing white space, at most two blank ones in a row."""
    out = F.array_join(F.transform(F.split(text, "\n"), rstrip), "\n")
    # a run of line ends holds one blank line less than itself, but as many at the start and at the end
    for run, kept in ((r"\n{4,}", "\n\n\n"), (r"\A\n{3,}", "\n\n"), (r"\n{3,}\z", "\n\n"), (r"\A\n{2,}\z", "\n")):
        out = F.regexp_replace(out, run, kept)
    return out


def fixed_slices(text: Column, size: int) -> Column:
    """Consecutive pieces of ``size`` characters; an empty text has none."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))


def push_heading(path: Column, level: Column, title: Column) -> Column:
    """The section path after a heading: what stands above its level, by position, and its title."""
    return F.concat(F.slice(path, F.lit(1), level - 1), F.array(title))


def heading_paths(headings: Column) -> Column:
    """For an ordered array of (level, title) the section path after each."""
    start = F.struct(F.array().cast("array<string>").alias("path"), F.array().cast("array<array<string>>").alias("out"))

    def step(acc: Column, h: Column) -> Column:
        path = push_heading(acc["path"], h["level"], h["title"])
        return F.struct(path.alias("path"), F.concat(acc["out"], F.array(path)).alias("out"))

    return F.aggregate(headings, start, step, lambda acc: acc["out"])


def embedding_text(infos: Column, text: Column, skipped: Column) -> Column:
    """What of a chunk is embedded: nothing if it is skipped, its text if it has no sentences, else those kept."""
    kept = F.transform(F.filter(infos, lambda s: ~F.coalesce(s["skip_embedding"], F.lit(False))), lambda s: s["text"])
    return F.when(F.coalesce(skipped, F.lit(False)), "").when(F.coalesce(F.size(infos), F.lit(0)) <= 0, text).otherwise(F.array_join(kept, "\n"))


def preview(text: Column, longest: int = 200) -> Column:
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest), F.lit("..."))).otherwise(text)
