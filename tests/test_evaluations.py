"""JSON harvests, early stopping, stability gates and rejection by kind against plain Python, on frames with other names."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemill.operators import histories, json_trees


def test_json_harvests(spark):
    texts = ['{"b": ["x", {"Secret ": 1, "a": "y"}], "A": "z"}', '{"canonical_id": " u ", "aliases": ["v", " ", 3], "in": {"aliases": "w", "canonical_id": 4, "o": [{"canonical_id": "q"}]}}', "[]", '"s"', "{bad", None, "[" * 300 + '"deep"' + "]" * 300, "[" * 200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "n long, t string")
    got = df.select("n", json_trees.strings(F.col("t")), json_trees.entity_ids(F.col("t")), json_trees.keys_among(F.col("t"), ["secret", "in"])).orderBy("n").collect()
    assert [r[1] for r in got] == [["z", "x", "y"], ["v", " ", " u ", "w", "q"], [], ["s"], None, None, ["deep"], None]
    assert [r[2] for r in got] == [[], ["u", "v", "q"], [], [], None, None, [], None]
    assert [r[3] for r in got] == [["secret"], ["in"], [], [], None, None, [], None]


def test_text_of_object_or_scalar(spark):
    texts = ['{"text": " a "}', '{"text": null}', "{}", '" b "', "7", "null", '"  "', "{bad", None]
    got = spark.createDataFrame(list(enumerate(texts)), "n long, t string").select(json_trees.text_of(F.col("t"))).collect()
    assert [r[0] for r in got] == ["a", None, None, "b", "7", None, None, None, None]


def test_early_stopping_moves_the_best_only_by_more_than_the_margin(spark):
    runs = {1: [1.0, 0.95, 0.91, 0.85, math.nan, 0.8, None], 2: [3.0], 3: [math.nan, 2.0, 1.95, 1.0]}
    rows = [(r, e, x) for r, line in runs.items() for e, x in enumerate(line)]
    got = histories.early_stopping(spark.createDataFrame(rows[::-1], "r long, e long, x double"), "r", "e", "x", patience=2, min_delta=0.1).collect()
    want = {}
    for r, line in runs.items():
        best, waited = math.inf, 0
        for e, x in enumerate(line):
            better = x is not None and x < best - 0.1
            best, waited = (x, 0) if better else (best, waited + 1)
            want[r, e] = (better, best, waited, waited >= 2)
    assert {(s["r"], s["epoch"]): (s["improved"], s["best"], s["waited"], s["stop"]) for s in got} == want
    assert not histories.early_stopping(spark.createDataFrame(rows, "r long, e long, x double"), "r", "e", "x", patience=0).where("stop").count()


def test_stability_gates(spark):
    lines = {
        "minimum_epochs_not_reached": [(1.0, 1.0)],
        "non_finite_validation_metric": [(1.0, 1.0), (math.nan, 1.0), (0.5, 1.0)],
        "insufficient_trajectory_coverage": [(1.0, 1.0), (0.5, 1.0), (0.4, 0.2)],
        "insufficient_validation_improvement": [(1.0, 1.0), (0.99, 1.0), (0.98, 1.0)],
        "validation_regressed_from_best": [(1.0, 1.0), (0.5, 1.0), (0.7, 1.0)],
        "finite_covered_improved_and_non_regressing": [(1.0, 0.1), (0.5, 1.0), (0.51, 1.0)],
    }
    rows = [(name, e, x, c) for name, line in lines.items() for e, (x, c) in enumerate(line)] + [("null", e, None, 1.0) for e in range(3)]
    df = spark.createDataFrame(rows, "r string, e long, x double, c double")
    got = {r["r"]: (r["stable"], r["reason"]) for r in histories.stability(df, "r", "e", "x", "c", 2, 0.5, 0.1, 0.05).collect()}
    assert got.pop("null") == (False, "non_finite_validation_metric")
    assert got == {name: (name.startswith("finite_"), name) for name in lines}


def test_rank_of_positive_by_kind(spark):
    cases = {1: [(0.5, True, None), (0.5, False, "u"), (0.9, False, "u"), (0.1, False, "w")], 2: [(0.5, False, "u"), (0.5, True, None)], 3: [(1.0, False, "u")]}
    rows = [(c, i, s, p, k) for c, line in cases.items() for i, (s, p, k) in enumerate(line)]
    got = {r["c"]: r for r in histories.rank_of_positive(spark.createDataFrame(rows, "c long, i long, s double, p boolean, k string"), "c", "i", "s", "p", "k", ["u", "w"]).collect()}
    assert set(got) == {1, 2}
    for c, r in got.items():
        line = cases[c]
        ranked = sorted(line, key=lambda x: -x[0])
        place, own = next(i for i, x in enumerate(ranked, 1) if x[1]), next(x[0] for x in line if x[1])
        share = lambda kind: (lambda v: sum(v) / len(v) if v else None)([own > x[0] for x in line if not x[1] and kind in (None, x[2])])  # noqa: B023,E731
        assert (r["place"], r["top1"]) == (place, place == 1) and abs(r["reciprocal"] - 1 / place) < 1e-12
        assert [r["rejection"], r["rejection_u"], r["rejection_w"]] == [share(None), share("u"), share("w")]
