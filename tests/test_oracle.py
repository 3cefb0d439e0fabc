"""Every registered query against its DuckDB oracle (sf0.001)."""

import datetime as dt
import decimal
import math

import duckdb
import pytest

from conftest import SF001
from sigfolio.plans.registry import ORACLE, QUERIES, load_all

load_all()
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, dt.datetime) and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    return v


def _rows(rows, cols):
    out = [tuple(_norm(r[c]) for c in sorted(cols)) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, repr(x)) for x in t))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF001)
    cols = df.columns
    got = _rows([r.asDict() for r in df.collect()], cols)
    cur = duck.execute(ORACLE[name])
    dcols = [d[0] for d in cur.description]
    want = _rows([dict(zip(dcols, r)) for r in cur.fetchall()], dcols)
    assert sorted(cols) == sorted(dcols)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_oracle_runs(spark, name):
    df = QUERIES[name](spark, SF001)
    assert df.count() >= 0
