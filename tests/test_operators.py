"""Operators without an oracle: invariants and small brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import assignment, budget, graph, sentences, sequences
from tidemill.plans import catalog
from tidemill.sources import files

SF = "/root/testdata/sf0.001"


def test_components_of_a_long_chain_and_a_cycle():
    chain = [(i, i + 1) for i in range(5000)]
    label = graph.strong_components(list(range(5001)), chain)
    assert len(set(label.values())) == 5001
    label = graph.strong_components([1, 2, 3], [(1, 2), (2, 1), (2, 3)])
    assert label == {1: 1, 2: 1, 3: 3}
    assert graph.layers_to_sink([(1, 2), (2, 1), (2, 3)], label) == {3: 0, 1: 1}


@pytest.mark.parametrize("seed", range(5))
def test_components_against_reachability(seed):
    rng = random.Random(seed)
    nodes = list(range(12))
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(20)]
    reach = {(a, a) for a in nodes} | set(edges)
    for k, i, j in itertools.product(nodes, repeat=3):
        if (i, k) in reach and (k, j) in reach:
            reach.add((i, j))
    assert graph.strong_components(nodes, edges) == {a: min(b for b in nodes if (a, b) in reach and (b, a) in reach) for a in nodes}


def test_structured_records_layers(spark):
    rows = spark.createDataFrame([("g", 1, 2), ("g", 1, 2), ("g", 2, 3), ("h", 1, 2), ("h", 2, 1), ("h", 2, 3)], "g string, a long, b long")
    got = {(r["g"], r["node"]): (r["component"], r["layer"], r["is_sink"]) for r in graph.structured_records(rows, "g", "a", "b").collect()}
    assert got == {("g", 1): (1, 0, False), ("g", 2): (2, 1, False), ("g", 3): (3, 2, True), ("h", 1): (1, 0, False), ("h", 2): (1, 0, False), ("h", 3): (3, 1, True)}


def test_greedy_skips_and_goes_on(spark):
    rows = spark.createDataFrame([("a", 1, 6), ("a", 2, 5), ("a", 3, 4), ("a", 4, 1), ("b", 1, 11), ("b", 2, None), ("b", 3, 10)], "g string, i long, cost long")
    got = {(r["g"], r["i"]): r["accepted"] for r in budget.greedy_fill(rows, "g", ["i"], "cost", 10).collect()}
    assert [k for k, v in sorted(got.items()) if v] == [("a", 1), ("a", 3), ("b", 3)]


def test_indivisible_split_is_close_and_leaves_no_part_empty():
    rng = random.Random(3)
    weights = {f"f{i:02d}": rng.randint(1, 100) for i in range(40)}
    where = assignment.indivisible_split(weights)
    total = sum(weights.values())
    for part, share in assignment.PARTS:
        assert abs(sum(w for g, w in weights.items() if where[g] == part) / total - share) < 0.02
    assert set(assignment.indivisible_split({"a": 100, "b": 1, "c": 1}).values()) == {"train", "validation", "test"}
    assert assignment.indivisible_split({}) == {}


@pytest.mark.parametrize("seed", range(6))
def test_quotas_are_as_even_as_any_assignment(seed):
    rng = random.Random(seed)
    labels = ("a", "b", "c")
    options = [tuple(c) for n in (1, 2, 3) for c in itertools.combinations(labels, n)]
    records = [rng.choice(options) for _ in range(7)]
    groups = {}
    for r in records:
        groups[r] = groups.get(r, 0) + 1
    quota = assignment.balanced_quotas(groups, labels)
    assert all(sum(q.values()) == groups[g] and all(label in g for label, n in q.items() if n) for g, q in quota.items())
    totals = [sum(q[label] for q in quota.values()) for label in labels]
    best = min((max(t), -min(t)) for c in itertools.product(*records) for t in [[c.count(label) for label in labels]])
    assert (max(totals), -min(totals)) == best


def test_horizon_balance_of_equal_records():
    quota = assignment.balanced_quotas({("long", "middle", "short"): 101}, ("long", "middle", "short"))
    assert sorted(quota["long", "middle", "short"].values()) == [33, 34, 34]


def test_horizon_balance_query_assigns_each_record_once(spark):
    rows = catalog.queries()["horizon_balance"](spark, SF).collect()
    n = spark.read.parquet(f"{SF}/conversations.parquet").groupBy("conv_id").count().where("count >= 2").count()
    assert len(rows) == len({r["conv_id"] for r in rows}) == n


def test_too_many_groups_are_refused(spark, monkeypatch):
    monkeypatch.setattr(assignment, "MAX_GROUPS", 3)
    with pytest.raises(ValueError, match="too many"):
        assignment.split_families(spark.range(10).select(F.col("id").cast("string").alias("f"), F.lit(1).alias("w")), "f", "w")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("One ends. Two ends! Three?", ["One ends.", "Two ends!", "Three?"]),
        ("A value of 3.14 is kept. E. coli grows, e.g. here.", ["A value of 3.14 is kept.", "E. coli grows, e.g. here."]),
        ('He said "stop." Then left', ['He said "stop."', "Then left"]),
        ("", []), (None, []), ("  \n ", []), ("no stop", ["no stop"]), ("Wait... what", ["Wait...", "what"]),
    ],
)
def test_sentences(text, want):
    assert sentences.sentences_of(text) == want


def test_warp_and_subsequence():
    assert sequences.warp(np.array([1.0, 2, 3]), np.array([1.0, 2, 2, 3])) == (0.0, 4)
    assert sequences.warp(np.array([0.0]), np.array([2.0, 4.0]))[0] == 3.0
    rng = random.Random(1)
    for _ in range(30):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 7))] for _ in range(2))
        best = max(n for n in range(len(a) + 1) for pick in itertools.combinations(a, n) if all(any(x == y for y in it) for it in [iter(b)] for x in pick))
        assert sequences.common_length(a, b) == best


def test_shuffled_negatives_are_distinct_and_wrong(spark):
    rows = catalog.queries()["shuffled_negatives"](spark, SF).collect()
    seen = set()
    for r in rows:
        assert list(r["permutation"]) != sorted(r["permutation"])
        assert (r["conv_id"], tuple(r["permutation"])) not in seen
        seen.add((r["conv_id"], tuple(r["permutation"])))


def test_text_files_are_exact(spark, tmp_path):
    rows = spark.createDataFrame([("00051", "", 'a "q", b\nc'), ("007", "x", "ü")], "k string, e string, t string")
    files.write_text(rows, f"file://{tmp_path}/csv")
    back = files.read_text_exact(spark, f"file://{tmp_path}/csv", ["k", "e", "t"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_text(rows, f"file://{tmp_path}/csv")


def test_bad_json_is_a_status(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{broken\n{"a": 2}\n')
    got = files.read_json_records(spark, f"file://{tmp_path}/x.jsonl", "a int").groupBy("status").count().collect()
    assert {r[0]: r[1] for r in got} == {"ok": 2, "invalid": 1}
