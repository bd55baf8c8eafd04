"""Every registered query against its DuckDB oracle on the smallest tables
(the same comparison the driver makes at sf0.01), plus the rows-only ones."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from biasframe.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
SQL = E.oracle_sql()
NAMES = sorted(E.queries())


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in recs), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["subgroup", "subgroup_size", "subgroup_auc", "bpsn_auc", "bnsp_auc"]
    rows = df.collect()
    assert len(rows) == 13
    # two one-class AUCs at sf0.001
    assert sum(v is None for r in rows for v in (r["subgroup_auc"], r["bpsn_auc"], r["bnsp_auc"])) == 2


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = E.queries()[name](spark, SF)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in SQL:
        assert len(got) > 0
        return
    cur = con.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    want = _rows(cols, cur.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert got == want
