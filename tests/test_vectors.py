"""Vector arithmetic on a frame of other names, against plain Python."""

from __future__ import annotations

import math

from tidemill.operators.vectors import cosine, pairs_ahead, squared_distance

ROWS = [(1, [1.0, 2.0, -1.0]), (2, [0.0, 0.0, 0.0]), (3, [2.0, 4.0, -2.5]), (5, [1.0, 0.0, 3.0]), (6, None)]


def test_pairs_ahead(spark):
    frame = spark.createDataFrame(ROWS, "k long, v array<float>")
    got = pairs_ahead(frame, "k", "v", 2).select("k", "ahead", cosine("x", "y").alias("c"), squared_distance("x", "y").alias("d")).collect()
    vectors = dict(ROWS)
    assert {(r["k"], r["ahead"]) for r in got} == {(k, a) for k in vectors for a in (1, 2) if k + a in vectors}
    for r in got:
        a, b = vectors[r["k"]], vectors[r["k"] + r["ahead"]]
        if a is None or b is None:
            assert r["c"] is None and r["d"] is None
            continue
        norms = [max(math.sqrt(sum(x * x for x in v)), 1e-12) for v in (a, b)]
        assert math.isclose(r["c"], sum(x * y for x, y in zip(a, b, strict=True)) / (norms[0] * norms[1]), abs_tol=1e-12)
        assert math.isclose(r["d"], sum((x - y) ** 2 for x, y in zip(a, b, strict=True)))


def test_empty(spark):
    assert not pairs_ahead(spark.createDataFrame([], "k long, v array<float>"), "k", "v", 3).collect()
