"""Every registered query with an oracle statement gives the statement's rows at the smallest scale."""

from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from phaseloom.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def flat(v):
    """A value as text, and the numbers in it that are compared within a tolerance."""
    if v is None or v != v:
        return "null", []
    if isinstance(v, (list, tuple)):
        parts = [flat(x) for x in v]
        return "[" + ",".join(t for t, _ in parts) + "]", [n for _, ns in parts for n in ns]
    return ("#", [float(v)]) if isinstance(v, (float, Decimal)) else (str(v), [])


def rows_of(rows, names, at):
    out = []
    for r in rows:
        cells = [flat(r[at(c)]) for c in names]
        out.append((tuple(t for t, _ in cells), [n for _, ns in cells for n in ns]))
    return sorted(out, key=lambda x: (x[0], [round(n, 2) + 0.0 for n in x[1]], x[1]))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_oracle(spark, db, name):
    df = catalog.queries()[name](spark, DIR)
    rel = db.sql(catalog.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    got, want = rows_of(df.collect(), names, lambda c: c), rows_of(rel.fetchall(), names, rel.columns.index)
    assert [t for t, _ in got] == [t for t, _ in want]
    for (_, a), (_, b) in zip(got, want, strict=True):
        assert a == pytest.approx(b, rel=1e-5, abs=2e-4)


def test_entry(spark):
    assert entry.entry(spark).columns == ["recording_id", "w", "r_mean", "metastability"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
