"""Orders over any frame against plain Python, with a group that holds most rows, nulls and an empty frame."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from tidemill.operators.ranking import firsts, interleave, marked_firsts, place_in_order, running_totals, tiered_order
from tidemill.streaming import ingest

SCHEMA = "num long, town string, size string, kind string, cost long"


def made(seed, n=120):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["big", "big", "big", "small", None]), rng.choice("abc"), rng.choice(["x", "y", "z"]), rng.choice([0, 0, 5, 17, None])) for i in range(n)]
    rng.shuffle(rows)
    return rows


def grouped(rows, key):
    out = defaultdict(list)
    for r in sorted(rows):
        out[key(r)].append(r)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_running_totals_and_places(spark, seed):
    rows = made(seed)
    frame = spark.createDataFrame(rows, SCHEMA)
    totals = {r["num"]: r["ahead"] for r in running_totals(frame, ["num"], "cost", ["town"], name="ahead").collect()}
    places = {r["num"]: r["place"] for r in place_in_order(frame, ["num"], ["town"], partitions=7).collect()}
    for group in grouped(rows, lambda r: r[1]).values():
        ahead = 0
        for i, r in enumerate(group):
            assert (totals[r[0]], places[r[0]]) == (ahead, i)
            ahead += r[4] or 0
    assert len(totals) == len(places) == len(rows)


@pytest.mark.parametrize("seed", range(2))
def test_interleave_takes_turns(spark, seed):
    rows = made(seed)
    got = {r["num"]: r["place"] for r in interleave(spark.createDataFrame(rows, SCHEMA), ["town"], "size", ["num"], ("kind",)).collect()}
    want = {}
    for town in grouped(rows, lambda r: r[1]).values():
        place = 0
        for _, block in sorted(grouped(town, lambda r: r[3]).items()):
            lanes = [list(lane) for _, lane in sorted(grouped(block, lambda r: r[2]).items())]
            while any(lanes):
                for lane in lanes:
                    if lane:
                        want[lane.pop(0)[0]] = place
                        place += 1
    assert got == want


def test_firsts_and_tiers(spark):
    rows = made(3)
    frame = spark.createDataFrame(rows, SCHEMA)
    best = {k: v[0][0] for k, v in grouped(rows, lambda r: r[1]).items()}
    assert {r["town"]: r["num"] for r in firsts(frame, ["town"], ["num"]).collect()} == best
    assert {r["num"] for r in marked_firsts(frame, ["town"], ["num"], "first").where("first").collect()} == set(best.values())
    by_kind = {v[0][0] for v in grouped(rows, lambda r: r[3]).values()}
    by_size = {v[0][0] for v in grouped(rows, lambda r: (r[1], r[2])).values()}
    tier = lambda r: 0 if r[0] in by_kind else 1 if r[3] == "y" else 2 if r[0] in by_size else 3
    want = {}
    for town in grouped(rows, lambda r: r[1]).values():
        want |= {num: (t, i) for i, (t, num) in enumerate(sorted((tier(r), r[0]) for r in town), 1)}
    got = {r["num"]: (r["tier"], r["pos"]) for r in tiered_order(frame, ["town"], ["num"], "kind", ["town", "size"], "y").collect()}
    assert got == want


def test_empty_frame(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert not interleave(none, ["town"], "size", ["num"]).collect()
    assert not tiered_order(none, ["town"], ["num"], "kind", ["town", "size"], "y").collect()


def test_ingest_resumes_and_keeps_each_key_once(spark, tmp_path):
    source, where = f"file://{tmp_path}/in", f"file://{tmp_path}/log"
    put = lambda rows: spark.createDataFrame(rows, "id long, say string").coalesce(1).write.mode("append").parquet(source)
    run = lambda: sorted(((r["id"], r["say"]) for r in ingest.ingest_once(spark, source, "id long, say string", "*.parquet", "id", where).collect()), key=str)
    put([(1, "a"), (1, "a"), (2, "b"), (None, "n")])
    assert run() == [(1, "a"), (2, "b"), (None, "n")]
    put([(2, "late"), (3, "c"), (None, "again")])
    assert run() == [(1, "a"), (2, "b"), (3, "c"), (None, "n")]
    assert run() == [(1, "a"), (2, "b"), (3, "c"), (None, "n")]
