"""Repeated lines, leaks, shared spans and mixtures, against brute force."""

import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm.codepoints import code_points, rolling_hashes, sliding_min
from docloom.llm.graph import components
from docloom.llm.leakage import find_leaks, normalised
from docloom.llm.mixing import Mixture, find_exponent
from docloom.llm.sharedspans import SharedSpans
from docloom.llm.siteboiler import SiteLines, band_hashes, link, mask, similarity


@settings(max_examples=100, deadline=None)
@given(st.text(min_size=1, max_size=60), st.integers(1, 9))
def test_rolling_hashes_and_minima(text, size):
    p = code_points(text)
    hashes = rolling_hashes(p, size)
    windows = [tuple(p[i : i + size]) for i in range(len(p) - size + 1)]
    assert len(hashes) == len(windows) and len(set(hashes.tolist())) == len(set(windows))
    assert sliding_min(hashes, 3).tolist() == [min(hashes[i : i + 3].tolist()) for i in range(max(0, len(hashes) - 2))]


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 200), (200, 300), (7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {k: 1 for k in range(1, 41)} | {100: 100, 200: 100, 300: 100}


NOTICE = "本页内容由客户服务部门整理并定期更新，仅供各位参考，具体请以签发的文本内容为准。"


def lines_table(spark):
    rng = random.Random(3)
    rows = []
    for k in range(40):
        own = "".join(rng.choice("天地玄黄宇宙洪荒日月盈昃") for _ in range(30))
        rows.append((f"c{k}", "hot" if k % 2 else "cold", f"{own}\n阅读 {k * 17} 次 点赞\n{NOTICE if k % 2 else ''}\n----"))
    rows += [(f"n{k}", "near", f"{NOTICE[:-1]}{'，' + str(k) if k else ''}{'甲乙丙丁'[k % 4]}。") for k in range(8)]
    rows += [("x", "hot", None), ("y", None, NOTICE), (None, "hot", NOTICE), ("c1", "hot", rows[1][2]), ("z", "hot", "")]
    return spark.createDataFrame(rows, "chunk_id string, source string, text string").selectExpr("chunk_id", "text", "struct(source as source_file, array(1) as skip_sentences) as metadata", "'k' as key", "1 as node"), rows


def test_lines_of_a_source(spark):
    df, rows = lines_table(spark)
    site = SiteLines(df)
    found = site.repeated().collect()
    holding, places = {}, {}
    for ident, source, text in rows:
        if ident and source and text:
            for k, line in enumerate(text.split("\n")):
                key = re.sub("[0-9]+", "0", "".join(line.split()))
                if any(c.isalnum() for c in key):
                    holding.setdefault((source, key), set()).add(ident)
                    places.setdefault((source, key), set()).add((ident, k))
    want = {p for k, v in holding.items() if len(v) >= 5 for p in places[k]}
    assert {(r["chunk_id"], r["line_no"]) for r in found if r["line_docs"] >= 5} == want
    # lines that differ in a few characters count together
    assert {r["chunk_id"] for r in found if r["chunk_id"].startswith("n")} == {f"n{k}" for k in range(8)}
    cleaned = {r["chunk_id"]: r["text"] for r in site.cleaned(df).collect()}
    assert NOTICE not in cleaned["c1"] and "阅读" not in cleaned["c0"] and cleaned["x"] is None and cleaned["z"] == ""
    assert SiteLines(df.limit(0)).repeated().count() == 0


def test_bylines_of_spaced_scripts_count_together(spark):
    people = ["Anna Keller", "Jonas Weber", "Marie Dubois", "Tom Baker", "Eva Lindt", "Karl Brandt"]
    firms = ["Bright Insurance", "North Mutual", "Blue Harbour Group", "Alpine Life", "Gold Cover", "Stone Re"]
    forms = {"en": "Reviewed by {} for {} on 12.05.2024 and kept in the archive.", "de": "geprüft durch {} im Auftrag von {} am 12.05.2024 und im Archiv abgelegt."}
    rows = [(f"{lang}{k}", lang, form.format(people[k], firms[k]) + f"\nown text {chr(97 + k) * 5} here") for lang, form in forms.items() for k in range(6)]
    rows += [(f"t{k}", "titles", firms[k]) for k in range(6)]
    df = spark.createDataFrame(rows, "chunk_id string, source string, text string").selectExpr("chunk_id", "text", "struct(source as source_file) as metadata")
    found = SiteLines(df).repeated().collect()
    assert {(r["chunk_id"], r["line_no"]) for r in found} == {(f"{lang}{k}", 0) for lang in forms for k in range(6)}
    assert {(r["cluster_docs"], r["line_docs"]) for r in found} == {(6, 1)}


def test_lines_unlike_the_first_of_a_bucket_are_linked(spark):
    rng = random.Random(11)
    groups = [["".join(rng.choice("天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往") for _ in range(120))] * 6 for _ in range(40)]
    groups = [[g[:k * 20] + "秋" + g[k * 20 + 1 :] for k, g in enumerate(group)] for group in groups]
    lines = {i: line for i, line in enumerate(line for group in groups for line in group)}
    # one bucket for all: whatever the lead is, most of the bucket is unlike it
    members = spark.createDataFrame([(1, i) for i in lines], "bucket long, form long")
    got = link(members, spark.createDataFrame(list(lines.items()), "form long, masked string"), 0.8).collect()
    assert all(similarity(a, b) >= 0.8 for group in groups for a, b in zip(group, group[1:]))
    assert {(r["form"], r["label"]) for r in got} == {(i, i // 6 * 6) for i in lines}


def test_no_link_inside_a_bucket_is_lost(spark):
    """Components of a bucket's lines equal those of all pairs that are similar enough, chains included."""
    rng = random.Random(23)
    lines = {}
    for k in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(60)]
        for _ in range(rng.randrange(1, 9)):
            lines[len(lines)] = " ".join(words)
            words = list(words)
            words[rng.randrange(60)] = f"v{rng.randrange(400)}"
    label = {i: i for i in lines}
    for a in lines:
        for b in lines:
            if a < b and similarity(lines[a], lines[b]) >= 0.8:
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    members = spark.createDataFrame([(k % 2, i) for i in lines for k in (0, 1)], "bucket long, form long")
    got = {r["form"]: r["label"] for r in link(members, spark.createDataFrame(list(lines.items()), "form long, masked string"), 0.8).collect()}
    assert {i: got.get(i, i) for i in lines} == label and len(set(label.values())) > 5


def test_near_lines_of_a_source_are_found(spark):
    """Planted groups of lines at 0.8 to 0.85 of one another: the share of their links that survive, end to end."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    groups = {}
    for g in range(60):
        words = [word() for _ in range(106)]
        groups[g] = [" ".join([*words[: 15 * k + 5], word(), *words[15 * k + 6 :]]) for k in range(6)]
    rows = [(f"g{g}-{k}", "one", line + "\n" + " ".join(word() for _ in range(12))) for g, lines in groups.items() for k, line in enumerate(lines)]
    assert all(0.8 <= similarity(a, b) < 0.85 for lines in groups.values() for a, b in zip(lines, lines[1:]))
    df = spark.createDataFrame(rows, "chunk_id string, source string, text string").selectExpr("chunk_id", "text", "struct(source as source_file) as metadata")
    found = SiteLines(df).repeated().collect()
    assert {r["line_no"] for r in found} == {0} and {r["line_docs"] for r in found} == {1}
    linked = {r["chunk_id"] for r in found if r["cluster_docs"] == 6}
    assert len(linked) >= 0.95 * len(rows)


def test_masks():
    same = [
        ("Reviewed by our editorial board and last updated by Anna Schmidt", "Reviewed by our editorial board and last updated by Peter Wagner"),
        ("Reviewed by our editorial board and last updated by Schmidt", "Reviewed by our editorial board and last updated by Wagner"),
        ("作者：张伟", "作者：李娜"),
        ("更新于0月0日", "更新于0年0月0日"),
        ("posted on 0 May 0 in the archive", "posted on 0.0.0 in the archive"),
    ]
    for a, b in same:
        assert mask(a) == mask(b)
    assert mask("it may be so") == "it may be so" and mask("Gold Cover") == "Gold Cover"


def test_bands_find_what_is_similar():
    rng = random.Random(5)
    hits = total = 0
    for _ in range(300):
        a = "".join(rng.choice("天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往") for _ in range(80))
        at = rng.randrange(80)
        b = a[:at] + "秋" + a[at + 1 :]
        if similarity(a, b) >= 0.8:
            total += 1
            x, y = band_hashes([a, b])
            hits += bool((x == y).any())
    assert total > 100 and hits >= 0.9 * total


def test_leaks(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop 天地玄黄") for _ in range(n))
    items = [(k, word(120)) for k in range(30)] + [(90, None), (91, "short"), (92, "")]
    docs = [(k, word(rng.randrange(0, 400)) + (items[k % 30][1][10 : 10 + 30 + k % 25].upper() if k % 3 else "") + word(50)) for k in range(200)] + [(500, None), (501, ""), (502, items[3][1].replace("a", "ａ")), (1, "again " + items[0][1])]
    ddf, idf = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["shared_windows"]) for r in find_leaks(ddf, idf).collect()}
    want = set()
    for d, t in docs:
        n = normalised(t or "")
        for i, u in items:
            m = normalised(u or "")
            shared = sum(m[s : s + 40] in n for s in range(len(m) - 39))
            if shared:
                want.add((d, i, shared))
    assert got == want and (502, 3) in {(d, i) for d, i, _ in got}
    assert find_leaks(ddf, idf.limit(0)).count() == 0 and find_leaks(ddf.limit(0), idf).count() == 0


def test_leaks_in_blocks(spark, monkeypatch):
    import docloom.llm.leakage as module

    items = spark.createDataFrame([(k, chr(0x4E00 + k) * 3 + "".join(chr(0x5000 + k * 60 + j) for j in range(50))) for k in range(20)], "item_id long, text string")
    docs = items.selectExpr("item_id + 100 as doc_id", "concat('前', text) as text")
    whole = {tuple(r) for r in find_leaks(docs, items).collect()}
    monkeypatch.setattr(module, "MAX_ITEM_CHARS", 300)
    assert {tuple(r) for r in find_leaks(docs, items).collect()} == whole and len(whole) == 20


def test_leaks_of_many_items(spark, monkeypatch):
    import docloom.llm.leakage as module

    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop 天地玄黄") for _ in range(n))
    items = [(k, word(120)) for k in range(20)] + [(20, None), (21, "short")]
    items += [(22, items[0][1]), (None, items[1][1])]
    docs = [(k, word(100) + items[k % 20][1][10 : 60 + k % 25] + word(50)) for k in range(60)] + [(100, None), (101, ""), (None, items[2][1]), (5, items[3][1]), (5, items[3][1])]
    ddf, idf = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    sent = sorted(map(str, find_leaks(ddf, idf).collect()))
    monkeypatch.setattr(module, "MAX_PASSES", 0)
    assert sorted(map(str, find_leaks(ddf, idf).collect())) == sent and len(sent) > 60


def test_shared_spans(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefgh 天地玄黄") for _ in range(n))
    spans = [word(n) for n in (19, 20, 21, 60, 90)]
    docs = [(k, word(rng.randrange(0, 60)) + rng.choice(spans) + word(rng.randrange(0, 60)) + (rng.choice(spans) if k % 4 == 0 else "")) for k in range(80)]
    docs += [(200 + k, docs[5][1]) for k in range(6)] + [(300, None), (301, ""), (302, "x" * 19), (303, "y" * 500), (None, docs[5][1])]
    df = spark.createDataFrame(docs + [docs[7]], "doc_id long, text string").selectExpr("*", "1 as id", "2 as edge")
    shared = SharedSpans(df, span=20)
    windows = {d: {t[i : i + 20] for i in range(len(t) - 19)} for d, t in docs if d is not None and t}
    want = {(a, b) for a in windows for b in windows if a < b and windows[a] & windows[b]}
    assert {tuple(r) for r in shared.pairs().collect()} == want
    shares = {r["doc_id"]: r["shared_chars"] for r in shared.shares().collect()}
    for d, t in docs:
        if d is not None and t:
            marked = set()
            for i in range(len(t) - 19):
                if any(t[i : i + 20] in windows[o] for o in windows if o != d):
                    marked |= set(range(i, i + 20))
            assert shares.get(d, 0) == len(marked)
    islands = set()
    for d, t in docs:
        if d is not None and t:
            at = [i for i in range(len(t) - 19) if any(t[i : i + 20] in windows[o] for o in windows if o != d)]
            begins = [i for i in at if i - 1 not in at]
            islands |= {(d, i, next(j for j in range(i, len(t)) if j not in at) - 1 + 20) for i in begins}
    assert {tuple(r) for r in shared.spans().collect()} == islands
    # the groups hold every pair, and no other
    held = {}
    for r in shared.groups().collect():
        held.setdefault(r["span"], set()).add(r["id"])
    assert {(a, b) for ids in held.values() for a in ids for b in ids if a < b} == want and all(len(ids) > 1 for ids in held.values())
    assert SharedSpans(df.limit(0), span=20).pairs().count() == 0


TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def weights_of(tokens, target, exponent):
    q = [n / sum(tokens) for n in tokens]
    raw = [a * (t / a) ** exponent if a and t else 0.0 for a, t in zip(q, target)]
    return [x / sum(raw) for x in raw]


def entropy(weights):
    return -sum(w * math.log(w) for w in weights if w > 0)


def test_exponents(spark):
    def find(tokens, target, repeats, total=None, min_entropy=None):
        rows = [(n, float(max(sum(tokens), 1)), t, float(n * r)) for n, t, r in zip(tokens, target, repeats)]
        return find_exponent(spark.createDataFrame(rows, "tokens long, whole double, share double, cap double"), total, min_entropy)

    assert find([100, 300], [0.5, 0.5], [1, 1]) == (200, 1.0)
    total, t = find([100, 300], [0.5, 0.5], [1, 1], total=360)
    w = weights_of([100, 300], [0.5, 0.5], t)
    assert total == 360 and 0 < t < 1 and abs(w[0] * 360 - 100) < 0.01
    assert find([0, 0], [0.5, 0.5], [1, 1]) == (0, 0.0) and find([5, 5], [0.0, 0.0], [1, 1]) == (0, 0.0)
    _, t = find([100, 100], [0.99, 0.01], [99, 99], total=100, min_entropy=0.5)
    assert 0 < t < 1 and abs(entropy(weights_of([100, 100], [0.99, 0.01], t)) - 0.5) < 1e-6
    assert find([100, 300], [0.5, 0.5], [1, 1], total=4000)[1] == 0.0


@pytest.mark.parametrize("total", [None, 1100, 3000])
def test_mixture(spark, total):
    rng = random.Random(4)
    docs = [(k, "big" if k % 3 else "small", "word " * rng.randrange(1, 9)) for k in range(300)] + [(900, "big", None), (901, "other", "x"), (902, None, "x"), (903, "small", ""), (904, "small", "word " * 300)]
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3), ("missing", 0.0, 2), ("none", None, None)], "source string, target_share double, max_repeat int")
    mix = Mixture(spark.createDataFrame(docs, "doc_id long, source string, text string").selectExpr("*", "1 as tokens"), targets, TOKENIZER, total)
    used = mix.used().collect()
    report = {r["source"]: r for r in mix.report().collect()}
    assert len({r["doc_id"] for r in used}) == len(used) and all(r["times"] <= (1 if r["source"] == "big" else 3) for r in used)
    assert report["missing"]["taken"] == 0 and report["none"]["taken"] == 0
    if total is None:
        assert mix.exponent == 1.0 and report["big"]["off_target"] < 0.01 and report["small"]["off_target"] < 0.01
    # no document that isn't used any further would have fitted
    for name in ("big", "small"):
        short = report[name]["budget"] - report[name]["taken"]
        assert 0 <= short <= 10
    assert {r["doc_id"]: r["times"] for r in mix.used().collect()} == {r["doc_id"]: r["times"] for r in used}
    assert sum(r["taken"] for r in report.values()) == sum(r["tokens"] * r["times"] for r in used) <= mix.total


def test_mixture_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a", "word")], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeat int")
    assert Mixture(docs.limit(0), targets, TOKENIZER).report().first()["taken"] == 0
    assert Mixture(docs, targets.limit(0), TOKENIZER).used().count() == 0
    assert [(r["doc_id"], r["times"]) for r in Mixture(docs, targets, TOKENIZER).used().collect()] == [(1, 2)]


def test_large_ids_beside_null_ones(spark):
    big = 2**60 + 1
    text = "".join(chr(0x4E00 + k) for k in range(60))
    df = spark.createDataFrame([(big, text), (None, text)], "doc_id long, text string")
    items = df.withColumnRenamed("doc_id", "item_id")
    assert {(r["doc_id"], r["item_id"]) for r in find_leaks(df, items).collect()} == {(a, b) for a in (big, None) for b in (big, None)}
