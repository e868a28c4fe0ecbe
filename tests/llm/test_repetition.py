"""Repetition inside single texts, against brute force."""

from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm.repetition import repeated_share, repetition


def brute(text, window):
    s = "".join(c for c in text if c.isalpha())
    seen, covered = set(), set()
    for i in range(len(s) - window + 1):
        w = s[i : i + window]
        if w in seen:
            covered |= set(range(i, i + window))
        seen.add(w)
    longest = 0
    if covered:
        longest = max(k for k in range(window, len(s)) if len({s[i : i + k] for i in range(len(s) - k + 1)}) < len(s) - k + 1)
    return len(s), len(covered), longest


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab 1\n字", max_size=60), min_size=1, max_size=5), st.integers(1, 6))
def test_against_brute_force(texts, window):
    got = repetition(texts, window)
    assert [g[:3] for g in got] == [brute(t, window) for t in texts]
    assert all((g[3] > 0) == (g[1] > 0) for g in got)


def test_blocks_change_nothing(monkeypatch):
    import docloom.llm.repetition as module

    texts = ["abcabc" * 7, "", "xyz" * 20, "q"] * 3
    whole = repetition(texts, 5)
    monkeypatch.setattr(module, "_BLOCK", 10)
    assert repetition(texts, 5) == whole


def test_shares(spark):
    rows = [("a", "甲乙丙丁戊己庚辛壬癸" * 6, "x"), ("b", None, "x"), ("c", "", "x"), ("d", "12345 !!", "x"), ("a", "甲乙丙丁戊己庚辛壬癸" * 6, "x"), (None, "abc", "x"), ("e", "".join(chr(0x4E00 + k) for k in range(5000)), "x")]
    df = spark.createDataFrame(rows, "chunk_id string, text string, id string")
    out = repeated_share(df, "chunk_id", "text").collect()
    by = {r["chunk_id"]: r for r in out}
    assert len(out) == 7 and by["a"]["excessive"] and by["a"]["repeated_letters"] == 50 and by["a"]["longest_repeat"] == 50
    assert not any(by[k]["excessive"] for k in ("b", "c", "d", "e", None)) and by["d"]["n_letters"] == 0
    assert repeated_share(df.limit(0), "chunk_id", "text").count() == 0


def test_the_limit_itself_counts(spark):
    # 100 letters of which 30 are repeated
    text = "".join(chr(0x4E00 + k) for k in range(70))
    text += text[:30]
    df = spark.createDataFrame([("a", text), ("b", text + "x")], "chunk_id string, text string")
    assert {r["chunk_id"] for r in repeated_share(df, "chunk_id", "text").where("excessive").collect()} == {"a"}
