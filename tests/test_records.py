"""Fixpoints over edges and layered records, against plain Python."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemill.operators import fixpoint, record_graphs, records


def edges_of(spark, rows):
    return fixpoint.clean_edges(spark.createDataFrame(rows, "g string, a long, b long"), "g", "a", "b")


def closure(pairs):
    out = defaultdict(set)
    for g, a, b in pairs:
        if a is not None and b is not None:
            out[g, a].add(b)
    reach = {}
    for start in list(out):
        seen, todo = set(), [start[1]]
        while todo:
            for b in out.get((start[0], todo.pop()), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[start] = seen
    return reach


def test_components_and_distances_against_closures(spark):
    rng = random.Random(3)
    rows = [(f"g{i % 12}", rng.randrange(9), rng.randrange(9)) for i in range(130)] + [("g0", None, 1), ("lone", 4, 4), ("pair", 1, 2), ("pair", 2, 1)]
    edges = edges_of(spark, rows)
    parts = fixpoint.strong_components(edges)
    got = {(r["g"], r["n"]): r["component"] for r in parts.collect()}
    reach = closure(rows)
    nodes = {(g, n) for g, a, b in rows if a is not None for n in (a, b)}
    both = lambda g, a, b: b in reach.get((g, a), ()) and a in reach.get((g, b), ())
    want = {(g, n): min([n, *(m for h, m in nodes if h == g and both(g, n, m))]) for g, n in nodes}
    assert got == want
    dag = fixpoint.condensed(edges, parts)
    far = {(r["g"], r["sink"], r["n"]): r["v"] for r in fixpoint.distances_to_sinks(dag, fixpoint.sinks(parts, dag)).collect()}
    onward = defaultdict(set)
    for g, a, b in rows:
        if a is not None and want[g, a] != want[g, b]:
            onward[g, want[g, a]].add(want[g, b])

    def ways(g, c, sink):
        if c == sink:
            return 0
        lengths = [x for d in onward[g, c] if (x := ways(g, d, sink)) is not None]
        return 1 + max(lengths) if lengths else None

    tops = {(g, c) for (g, _), c in want.items()}
    assert far == {(g, s, c): d for g, c in tops for h, s in tops if h == g and not onward[g, s] and (d := ways(g, c, s)) is not None}


def test_two_hundred_levels_and_more_ways_than_can_be_listed(spark, monkeypatch):
    monkeypatch.setattr(fixpoint, "HOPS", 8)
    rows = [("deep", 2 * level + i, 2 * level + 2 + j) for level in range(199) for i in (0, 1) for j in (0, 1)]
    edges = edges_of(spark, rows)
    ends = spark.createDataFrame([("deep", 398), ("deep", 399)], "g string, sink long")
    far = fixpoint.distances_to_sinks(edges, ends).collect()
    assert len(far) == 2 * (2 * 199 + 1) and all(r["v"] == 199 - r["n"] // 2 for r in far)


def test_empty_tables(spark):
    none = edges_of(spark, [])
    assert fixpoint.strong_components(none).count() == 0
    assert fixpoint.reached(spark.createDataFrame([], "g string, n long"), none, ["g"]).count() == 0
    assert records.structured_records(spark.createDataFrame([], EVENTS)).count() == 0


EVENTS = "graph string, event string, sources array<long>, targets array<long>, role string, semantic string, content string, text string"


def event(name, sources, targets, role="backbone", semantic=None, content=None, text=None, graph="g"):
    return graph, name, sources, targets, role, semantic or f"{sources}{targets}", content or f"{sources}{targets}", text


def test_a_cycle_a_sink_and_what_stays_outside(spark):
    rows = [
        event("e0", [1], [2]), event("e1", [2], [1]), event("e2", [2], [3]), event("e3", [3, 1], [4]),
        event("c0", [1], [2], "context"), event("c1", [1], [4], "context"), event("c2", [1], [9], "context"), event("x0", [1], [2], "excluded"),
        event("s0", [5], [3], text="late"), event("h0", [1], [2], graph="h"),
    ]
    made = {r["graph"]: r for r in records.structured_records(spark.createDataFrame(rows, EVENTS)).collect()}
    g = made["g"]
    assert g["sink_nodes"] == "4" and g["n_layers"] == 3 and [x["distance_to_sink"] for x in g["layers"]] == [2, 1, 0]
    assert [[e["event_id"] for e in x["events"]] for x in g["layers"]] == [["e1", "c0"], ["e2", "s0"], ["c1", "e3"]]
    top = {e["event_id"]: e for e in g["layers"][0]["events"]}
    assert top["c0"]["role"] == "backbone" and top["c0"]["producers"] == ["c0", "e0"] and top["c0"]["n_context"] == 1  # one meaning, the context event comes first
    assert (g["n_excluded"], g["n_unattached"], g["n_beyond"], g["n_graph_events"]) == (1, 1, 0, 9)
    assert made["h"]["n_layers"] == 1 and made["h"]["record_id"] != g["record_id"]


def test_merges_do_not_depend_on_order_and_report_conflicts(spark):
    rows = [
        event("b", [1], [2], semantic="same", text="one"), event("a", [1], [2], semantic="same", text=None), event("c", [0], [2], semantic="same", text="two"), event("c", [0], [2], semantic="same", text="two"),
        event("d", [1], [2], semantic="calm", text="x"), event("f", [1], [2], role="context", semantic="calm", content="[1][2]", text=None),
    ]
    out = []
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        merged = records.merged_events(spark.createDataFrame(rows, EVENTS).repartition(1 + seed), ["graph"])
        out.append(sorted((r["semantic"], r["event_id"], tuple(r["producers"]), r["role"], tuple(map(tuple, r["arcs"])), r["text"], tuple(r["conflicts"]), r["n_context"]) for r in merged.collect()))
    assert out[0] == out[1] == out[2]
    assert out[0] == [("calm", "d", ("d", "f"), "backbone", ((1, 2),), "x", (), 1), ("same", "c", ("c", "c", "a", "b"), "backbone", ((0, 2), (1, 2)), "two", ("content", "text", "producer"), 0)]


def test_prefix_rows_cut_between_layers(spark):
    rows = [event(f"e{i}", [i], [i + 1], content=f"c{i}") for i in range(4)]
    found = {r["prefix_length"]: r for r in records.prefix_rows(records.structured_records(spark.createDataFrame(rows, EVENTS))).collect()}
    assert sorted(found) == [1, 2, 3] and found[1]["observed"] == '[{"layer_index":0,"events":["c0"]}]' and found[3]["n_remaining_layers"] == 1
    assert found[2]["remaining"] == '[{"layer_index":2,"events":["c2"]},{"layer_index":3,"events":["c3"]}]' and len({r["row_sha256"] for r in found.values()}) == 3


def test_dense_index(spark):
    df = spark.createDataFrame([("a", 7), ("a", 3), ("a", 7), ("b", 5)], "g string, v int")
    assert {tuple(r) for r in fixpoint.dense_index(df, ["g"], "v", "i").collect()} == {("a", 3, 0), ("a", 7, 1), ("b", 5, 0)}
    assert df.select(F.max("v")).first()[0] == 7


def odd_events(seed, kind=int):
    """Events with null ends, nodes, ids and texts, empty lists, ids that come twice, roles unknown."""
    rng = random.Random(seed)
    node = lambda: None if rng.random() < 0.04 else kind(rng.randrange(12))
    nodes = lambda: None if rng.random() < 0.03 else [node() for _ in range(rng.choice([0, 1, 1, 1, 1, 2, 3]))]
    some = lambda *values: rng.choice(values)
    rows = []
    for g in range(40):
        size = rng.randrange(1, 40)
        for _ in range(size):
            e = None if rng.random() < 0.03 else f"e{rng.randrange(size * 2)}" + some("", "é", "\U0001f600", "~")
            rows.append((None if g == 7 else f"g{g}", e, nodes(), nodes(), some("backbone", "backbone", "context", "excluded", "other", None), some("m1", "m2", "m3", "é", None), some("c1", "c2", None), some("t1", "t2", None)))
        rows += rng.sample(rows[-size:], min(2, size))
    return rows


@pytest.mark.parametrize("kind", [int, str])
def test_whole_graphs_give_what_joins_give(spark, monkeypatch, kind):
    events = spark.createDataFrame(odd_events(5, kind), EVENTS.replace("array<long>", "array<string>") if kind is str else EVENTS)
    monkeypatch.setattr(record_graphs, "BATCH_ROWS", 30)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    look = lambda df: (df.schema.simpleString(), sorted(map(repr, df.collect())))
    try:
        made, layered = look(records.structured_records(events)), look(records.layered_events(events))
        by_joins = records._joined_layers(events)
        assert layered == look(by_joins) and len(layered[1]) > 200
        assert made == look(records._joined_records(events, by_joins)) and len(made[1]) > 60
        if kind is int:
            monkeypatch.setattr(records, "WHOLE_GRAPH", 20)  # some graphs by joins
            assert made == look(records.structured_records(events))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_records_are_dealt_out_once(spark):
    rows = [event(f"e{i}", [i], [i + 1], graph=f"g{i % 3}") for i in range(9)]
    plan = records.prefix_rows(records.structured_records(spark.createDataFrame(rows, EVENTS)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_prefix_rows_write_each_layer_once(spark):
    rows = [event(f"e{i}", [i], [i + 1], content=f"c{i}") for i in range(4)]
    found = records.prefix_rows(records.structured_records(spark.createDataFrame(rows, EVENTS))).select("observed", "answer_sha256")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("StructsToJsonEvaluator") == 1


def test_layered_events_are_dealt_out_once(spark):
    rows = [event(f"e{i}", [i], [i + 1], graph=f"g{i % 3}") for i in range(9)]
    plan = records.layered_events(spark.createDataFrame(rows, EVENTS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Aggregate" not in plan
