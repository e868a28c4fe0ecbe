"""Queries against their SQL, on the driver's smallest tables where these exist."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


CORE = sorted(n for n in entry.oracle_sql() if not (n.startswith("p") and n[1].isdigit() and n.split("_")[0] not in ("p4", "p7")))


@pytest.mark.parametrize("name", CORE)
def test_query_and_sql_agree(spark, db, name):
    df = entry.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = Counter(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    res = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == columns
    want = Counter(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in res.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
