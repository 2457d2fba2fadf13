"""Waterfall joins and linear laws on small rows."""

from __future__ import annotations

import numpy as np

from tidemill.operators import dynamics, waterfall


def test_rows_take_their_first_key_that_meets(spark):
    rows = spark.createDataFrame([(1, "a", "b"), (2, "x", "b"), (3, "x", "y"), (4, None, "a"), (4, None, "a")], "id int, k1 string, k2 string")
    names = spark.createDataFrame([("a", 10), ("b", 21), ("b", 20), (None, 5)], "name string, value int")
    got = sorted((r["id"], r["matched_by"], r["value"]) for r in waterfall.waterfall_join(rows, ["k1", "k2"], names, "name").collect() if r["matched_by"])
    assert got == [(1, "k1", 10), (2, "k2", 20), (4, "k2", 10), (4, "k2", 10)]
    assert waterfall.waterfall_join(rows, ["k1", "k2"], names, "name").where("matched_by IS NULL").select("id", "value").collect() == [(3, None)]
    assert waterfall.waterfall_join(rows.limit(0), ["k1"], names, "name").count() == 0


def test_linear_laws_against_their_solutions(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [1.0, None])], "id int, v array<double>")
    turn, none = np.array([[0.0, -1.0], [1.0, 0.0]]), np.zeros(2)
    got = {r["id"]: r["v"] for r in dynamics.linear_rollout(rows, ["id"], "v", turn, none + 1, 2).collect()}
    assert got[2] is None and got[3] is None and got[4] is None
    assert np.allclose(got[1], turn @ (turn @ [1.0, 2.0] + 1) + 1)
    flow = {r["id"]: r["v"] for r in dynamics.linear_flow(rows, ["id"], "v", turn, none, np.pi / 2, 64).collect()}
    assert np.allclose(flow[1], [-2.0, 1.0], atol=1e-6) and flow[2] is None
