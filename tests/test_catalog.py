"""Every catalogue query against its oracle on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from tidemill.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else f"{x:.9g}"
        if isinstance(x, list | tuple):
            return [cell(y) for y in x]
        return str(x)

    return sorted(str([cell(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    assert len(set(df.columns)) == len(df.columns)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got or name in ("incremental_ingest",)
        return
    cur = duck.execute(sql)
    names = [c[0] for c in cur.description]
    assert not [c for c in cur.description if "DECIMAL" in str(c[1]) or "HUGEINT" in str(c[1])]
    assert not [c for c, kind in df.dtypes if kind.startswith("decimal")]
    want = cur.fetchall()
    assert sorted(names) == sorted(df.columns)
    assert canonical(got, df.columns) == canonical(want, names)
