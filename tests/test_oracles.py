"""Every registered query against its SQL oracle on the smallest test tables."""

import os

import duckdb
import pytest

import __spark_entry__ as E  # noqa: E402
from colloquy.plans.checks import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        return round(v, 9)
    return v


def _rows(records):
    return sorted((tuple(_norm(x) for x in r) for r in records), key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = _rows(tuple(r[c] for c in cols) for r in df.collect())
    rel = duck.sql(E.oracle_sql()[name])
    duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    spark_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    assert spark_types == duck_types  # same names and the same integer widths
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    want = _rows(tuple(r[i] for i in idx) for r in cur.fetchall())
    assert got == want


def test_every_query_is_registered_with_callable():
    q = E.queries()
    assert set(E.oracle_sql()) <= set(q)
    assert set(QUERIES) <= set(q)
    assert set(QUERIES) <= set(E.oracle_sql())  # the optional operators test theirs themselves


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 3
    assert "periodos" in df.columns
