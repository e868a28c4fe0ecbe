"""Lines repeated across the documents of one source.

Lines are compared without white space and with numbers masked. For finding near-duplicates the spaces stay, and
dates and names are masked too. Lines of a source that are equal once masked are one form; forms are clustered by
locality-sensitive hashing of five-token shingles, links being verified by the exact similarity, and clusters
found in many documents are removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import regex as re
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.graph import components
from docloom.session import cut_lineage

SHINGLE = 5
BANDS, ROWS = 8, 4
#: Leads of a bucket in the first round, and how many times more there are in each further one.
LEADS, MORE_LEADS = 16, 8
#: Buckets (8 bytes each) that may be sent to all executors; more of them are joined by an exchange.
MAX_SENT = 500_000

_TOKEN = re.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[\p{L}\p{M}]+|\p{N}+|[^\s]")
# Names of months, which make a date beside a number, and words before a writer's name.
_MONTHS = (
    "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec|Januar|Februar|März|Mai|Juni|Juli|Oktober|Dezember"
    "|janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre"
)
_BY = "by|By|von|Von|par|Par|durch|Autor:|Author:|Auteur :"
#: Dates, their numbers masked: of numbers, without a year, and with the names of months.
_DATE = re.compile(rf"0 ?[-/.年] ?0(?: ?[-/.月] ?0(?: ?日)?)?|0 ?月 ?0 ?日|0(?:st|nd|rd|th|er|\.)? (?:{_MONTHS})\b\.?(?:,? 0)?|\b(?:{_MONTHS})\b\.? 0(?:st|nd|rd|th)?\b(?:, 0)?")
#: What stands in quotation marks or title marks; runs of capitalised words; a name after a word like "by"; a short value behind a label in Chinese.
_NAME = re.compile(rf"[“\"「『《][^”\"」』》]{{1,40}}[”\"」』》]|\p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)+|(?<=\b(?:{_BY}) )\p{{Lu}}[\p{{L}}.]+|(?<=\p{{Han}}{{2,6}} ?[:：] ?)\p{{Han}}{{2,4}}(?=$|[\s|｜/，、])")

_MASKS = re.compile("〔[ND]〕")
_LETTER = re.compile(r"\p{L}")


def mask(shown: str) -> str:
    """A line, its numbers masked, with dates and names masked; names stay where nothing else is in words, as in titles."""
    dated = _DATE.sub("〔D〕", shown)
    masked = _NAME.sub("〔N〕", dated)
    return masked if _LETTER.search(_MASKS.sub("", masked)) else dated


@cache
def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_501)
    return rng.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def shingle_hashes(forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the five-token shingles of all masked lines, and where each line's begin; a shorter line is one shingle."""
    known: dict[str, int] = {}
    tokens: list[int] = []
    sizes = []
    for line in forms:
        found = _TOKEN.findall(line) or [""]
        found += [""] * (SHINGLE - len(found))
        sizes.append(len(found))
        for t in found:
            h = known.get(t)
            if h is None:
                h = known[t] = xxhash.xxh64_intdigest(t)
            tokens.append(h)
    points = np.array(tokens, dtype=np.uint64)
    n = len(points) - SHINGLE + 1
    hashes = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + points[k : k + n]
    hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    ends = np.cumsum(sizes)
    inside = np.arange(n) + SHINGLE <= np.repeat(ends, sizes)[:n]
    counts = np.array(sizes) - SHINGLE + 1
    return hashes[inside], np.cumsum(counts) - counts


def band_hashes(forms: list[str]) -> np.ndarray:
    """For each masked line one hash for each band of its MinHash signature."""
    hashes, starts = shingle_hashes(forms)
    mult, add = _constants(BANDS * ROWS)
    out = np.zeros((len(forms), BANDS), np.uint64)
    for band in range(BANDS):
        h = np.full(len(forms), np.uint64(band + 1))
        for row in range(ROWS):
            k = band * ROWS + row
            x = hashes * mult[k] + add[k]
            x ^= x >> np.uint64(32)
            h = (h ^ np.minimum.reduceat(x, starts)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        out[:, band] = h
    return out


def similarity(a: str, b: str) -> float:
    """Share of common five-token shingles of two masked lines."""
    x, y = (set(shingle_hashes([s])[0].tolist()) for s in (a, b))
    return len(x & y) / len(x | y)


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each line masked, with the hash of its masked form and its buckets."""
    for pdf in batches:
        for first in range(0, len(pdf), 4_000):
            part = pdf.iloc[first : first + 4_000]
            sites = part["site"].to_numpy().view(np.uint64)
            masked = [mask(s) for s in part["shown"]]
            forms = np.array([xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) for s in masked], np.uint64) ^ sites
            bands = (band_hashes(masked) ^ sites[:, None]).view(np.int64)
            yield pd.DataFrame({"node": part["node"], "twin": part["twin"], "docs": part["docs"], "form": forms.view(np.int64), "masked": masked, "bands": list(bands)})


def _verify(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known = list({*pdf["masked"], *pdf["masked_b"]})
            if known:
                hashes, starts = shingle_hashes(known)
                sets = {s: set(h.tolist()) for s, h in zip(known, np.split(hashes, starts[1:]))}
                keep = [least * max(len(x), len(y)) <= min(len(x), len(y)) and len(x & y) >= least * len(x | y) for x, y in zip(map(sets.get, pdf["masked"]), map(sets.get, pdf["masked_b"]))]
                yield pdf.loc[keep, ["form", "lead"]]

    return run


def link(members: DataFrame, forms: DataFrame, similar: float) -> DataFrame:
    """(form, label) of the forms linked to others, the label being the least form that one is joined to by links.

    ``members`` has (bucket, form), ``forms`` (form, masked). Each round takes leads out of each bucket that is not of one
    component yet, from outside its largest component, and compares each with all forms of other components in
    the bucket. A bucket is done when all forms outside the largest component have led: by then any two forms in it
    were compared, unless links had joined them before. So no link between components is lost, and
    a bucket of copies of one text, however large, costs one round.
    """
    found, links, led, many = True, None, None, LEADS
    labels = members.select("form", F.col("form").alias("label")).limit(0)
    while True:
        if found:
            here = members.join(labels, "form", "left").select("bucket", "form", F.coalesce("label", "form").alias("label"))
            parts = here.groupBy("bucket", "label").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max_by("label", "n").alias("main"), F.count("*").alias("parts"))
            # buckets of one component need no more
            opened = cut_lineage(here.join(parts.where("parts > 1").drop("parts"), "bucket"))
        free = opened.where("label <> main")
        if led is not None:
            free = free.join(led, ["bucket", "form"], "left_anti")
        # the first of each bucket are taken before the exchange too, so a large bucket doesn't come into one task
        leads = free.withColumn("at", F.expr("row_number() over (partition by bucket order by form)")).where(F.col("at") <= many)
        leads = cut_lineage(leads.select("bucket", F.col("form").alias("lead"), F.col("label").alias("lead_label")))
        if leads.isEmpty():
            return labels
        pairs = opened.join(leads, "bucket").where("label <> lead_label").select("form", "lead").distinct()
        named = pairs.join(forms, "form").join(forms.select(F.col("form").alias("lead"), F.col("masked").alias("masked_b")), "lead")
        new = cut_lineage(named.mapInPandas(_verify(similar), "form long, lead long"))
        found = not new.isEmpty()
        if found:
            links = new if links is None else links.unionByName(new)
            labels = components(links, "form", "lead").withColumnRenamed("node", "form")
        done = leads.select("bucket", F.col("lead").alias("form"))
        led = done if led is None else led.unionByName(done)
        many *= MORE_LEADS


class SiteLines:
    """Lines of the documents of each source, and those that come back in at least ``min_docs`` of them.

    Rows without a source or an id, and null texts, take no part; rows stored twice count once. A line without
    letters and digits never counts. White space within a line is disregarded, and so are the digits of
    numbers. Lines of any length take part, and sources of any size: counts are pre-aggregated by source
    and line, so neither a large source nor a frequent line comes into one task.
    """

    def __init__(self, df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", source_col: str = "metadata.source_file", min_docs: int = 5, similar: float = 0.8) -> None:
        self.min_docs, self.id_col = min_docs, id_col.split(".")[-1]
        rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")).where("id is not null and source is not null and text is not null")
        lines = rows.select("id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        space = r"[\p{IsWhite_Space}\x1c-\x1f]+"
        key = F.regexp_replace(F.regexp_replace("line", space, ""), "[0-9]+", "0")
        keyed = lines.select("id", "source", "line_no", "line", key.alias("key")).where(F.col("key").rlike(r"[\p{L}\p{N}]"))
        #: two hashes together stand for source and key
        self.lines = keyed.select("id", "line_no", "line", F.xxhash64("source").alias("site"), F.xxhash64("source", "key").alias("node"), F.xxhash64("key", "source", F.lit(1)).alias("twin"))
        # names and words need the spaces, which the key is without: one of its lines stands for all
        shown = F.regexp_replace(F.trim(F.regexp_replace("line", space, " ")), "[0-9]+", "0")
        nodes = self.lines.withColumn("line", shown).groupBy("site", "node", "twin").agg(F.count_distinct("id").alias("docs"), F.min("line").alias("shown"))
        # masked and signed once; read by every step below
        signed = cut_lineage(nodes.mapInPandas(_sign, "node long, twin long, docs long, form long, masked string, bands array<long>"))
        buckets = signed.select(F.explode("bands").alias("bucket"), "form")
        shared = buckets.groupBy("bucket").agg(F.min("form").alias("first"), F.max("form").alias("other"), F.count("*").alias("rows")).where("first <> other")
        shared = cut_lineage(shared)
        # a bucket of two is known by now; the others are looked up, without an exchange where they are few
        more = shared.where("rows > 2").select("bucket")
        more = F.broadcast(more) if more.count() <= MAX_SENT else more
        two = shared.where("rows = 2").select("bucket", F.explode(F.array("first", "other")).alias("form"))
        members = cut_lineage(two.unionByName(buckets.join(more, "bucket").distinct()))
        forms = cut_lineage(signed.select("form", "masked").join(members.select("form").distinct(), "form", "left_semi").dropDuplicates(["form"]))
        labels = link(members, forms, similar)
        #: every line in the cluster of its form; a form linked to no other is a cluster of its own
        self.nodes = signed.select("node", "twin", "form", "docs").join(labels, "form", "left").select("node", "twin", F.coalesce("label", "form").alias("cluster"), F.col("docs").alias("line_docs"))

    def repeated(self) -> DataFrame:
        """(id, line_no, cluster, cluster_docs, line_docs) of the lines of clusters found in ``min_docs`` documents or more.

        ``cluster_docs`` counts the documents of the cluster, ``line_docs`` those that hold this very line, in
        the sense of equal keys. A line similar to no other is a cluster of its own.
        """
        # no cluster is in more documents than its lines together
        enough = self.nodes.groupBy("cluster").agg(F.sum("line_docs").alias("at_most")).where(F.col("at_most") >= self.min_docs).select("cluster")
        chosen = self.nodes.join(enough, "cluster")
        held = cut_lineage(self.lines.select("id", "line_no", "node", "twin").join(chosen, ["node", "twin"]).select("id", "line_no", "cluster", "line_docs"))
        sizes = held.groupBy("cluster").agg(F.count_distinct("id").alias("cluster_docs")).where(F.col("cluster_docs") >= self.min_docs)
        return held.join(sizes, "cluster").select(F.col("id").alias(self.id_col), "line_no", "cluster", "cluster_docs", "line_docs").distinct()

    def cleaned(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """(id, text, n_removed) of every row of ``df``, its text without the repeated lines; a null text stays null."""
        gone = self.repeated().groupBy(self.id_col).agg(F.collect_set("line_no").alias("gone"))
        rows = df.select(F.col(self.id_col), F.col(text_col).alias("text")).join(gone, self.id_col, "left")
        parts = F.filter(F.split("text", "\n"), lambda _, k: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), k))
        return rows.select(self.id_col, F.array_join(parts, "\n").alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))
