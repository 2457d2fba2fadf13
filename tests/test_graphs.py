"""Queries over the key graph: no bound on the number of ways, null keys as in SQL."""

from __future__ import annotations

import duckdb
import pytest

from tidemill.plans import catalog

NATIONS = "(0, 0), (1, 0), (2, 1), (3, NULL), (4, 9)"
SUPPLIERS = "(0, 0), (1, 0), (1, 2), (2, 4), (3, 7), (NULL, 1)"
CUSTOMERS = "(0, 0), (1, 2), (1, 2), (2, 3), (3, 8), (NULL, 1)"
#: Without a null source, with one (for NOT IN nothing is a sink then), and without any row.
CASES = {"plain": (NATIONS.replace("(3, NULL), ", ""), SUPPLIERS, CUSTOMERS), "null source": (NATIONS, SUPPLIERS + ", (4, NULL)", CUSTOMERS + ", (4, NULL)"), "empty": ("(0, 0)", "", "")}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("name", ["reverse_reachability", "longest_layers"])
def test_key_graph_beyond_the_row_limit_of_recursion(spark, tmp_path, name, case):
    con = duckdb.connect()
    for t, columns, rows in zip(("nation", "supplier", "customer"), (("n_nationkey", "n_regionkey"), ("s_suppkey", "s_nationkey"), ("c_custkey", "c_nationkey")), CASES[case], strict=True):
        some = f"(VALUES {rows})" if rows else "(SELECT 0, 0 WHERE false)"
        con.execute(f"CREATE TABLE {t} AS SELECT CAST(a AS BIGINT) AS {columns[0]}, CAST(b AS INTEGER) AS {columns[1]} FROM {some} x(a, b)")
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "3")
    try:
        df = catalog.queries()[name](spark, str(tmp_path))
        got = df.collect()
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", limit)
    cur = con.execute(catalog.oracle_sql()[name])
    assert df.columns == [c[0] for c in cur.description]
    assert sorted(map(tuple, got), key=str) == sorted(cur.fetchall(), key=str)
