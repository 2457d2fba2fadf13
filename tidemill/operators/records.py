"""Layered records of graphs: one for each sink, with its events, what was merged and what was left out.

Events are rows (graph, event, sources, targets, role, semantic, content, text): sources and
targets are arrays of nodes; role is backbone, context or excluded; semantic names what an event
means, content what a reader sees of it; text may be null. Backbone events define the order:
strong components of their arcs, the sinks among these, and for each sink the components that
lead to it, layered by the longest way. Graphs of up to WHOLE_GRAPH events are dealt out once and
go whole to a task (record_graphs.py); of larger ones every step is a join or an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import discard, kept
from . import record_graphs
from .fixpoint import clean_edges, condensed, dense_index, distances_to_sinks, sinks, strong_components

# The roles.
BACKBONE, CROSS, CONTEXT, EXCLUDED = "backbone", "context_cross_layer", "context", "excluded"
COLUMNS = ("graph", "event", "sources", "targets", "role", "semantic", "content", "text")

#: Events of a graph up to which it goes whole to a task.
WHOLE_GRAPH = 5_000
#: Events that a task of whole graphs has.
TASK_EVENTS = 250_000
#: Types of graphs, events and nodes that are ordered and written in Python as in Spark.
_PLAIN = ("tinyint", "smallint", "int", "bigint", "string")


def stable_id(kind: str, *parts: Column) -> Column:
    """kind and the first 24 hex digits of the digest of kind and parts, joined by line feeds."""
    return F.concat(F.lit(f"{kind}:"), F.substring(F.sha2(F.concat_ws("\n", F.lit(kind), *parts), 256), 1, 24))


def views(events: DataFrame) -> DataFrame:
    """(g, sink, n, v, depth, nodes): the nodes n that lead to a sink, v their longest way to it, depth the
    longest of the view, nodes the sink's own nodes (ascending, joined by commas). A kept table."""
    arcs = events.where(F.col("role") == BACKBONE).select("graph", F.explode("sources").alias("source"), "targets").select("graph", "source", F.explode("targets").alias("target"))
    edges = kept(clean_edges(arcs, "graph", "source", "target"), "arcs")
    parts = strong_components(edges)
    dag = kept(condensed(edges, parts), "dag")
    far = distances_to_sinks(dag, sinks(parts, dag))
    depth = far.groupBy("g", "sink").agg(F.max("v").alias("depth"))
    names = parts.groupBy("g", F.col("component").alias("sink")).agg(F.array_join(F.array_sort(F.collect_set("n")).cast("array<string>"), ",").alias("nodes"))
    of = parts.select("g", F.col("n").alias("node"), F.col("component").alias("n"))
    out = kept(far.join(of, ["g", "n"]).join(depth, ["g", "sink"]).join(names, ["g", "sink"]).select("g", "sink", F.col("node").alias("n"), "v", "depth", "nodes"), "views")
    for table in (edges, parts, dag, far):
        discard(table)
    return out


def placements(events: DataFrame, view: DataFrame) -> DataFrame:
    """(g, sink, event, role, raw): where each event stands in each view that takes it.

    A backbone event stands at the nearest of its targets in the view. A context event needs all
    its ends in the view and stands at the latest; where they differ it crosses layers. raw counts
    from the top, with gaps.
    """
    backbone = events.where(F.col("role") == BACKBONE).select(F.col("graph").alias("g"), "event", F.explode("targets").alias("n"))
    near = backbone.join(view, ["g", "n"]).groupBy("g", "sink", "event").agg(F.min("v").alias("v"), F.first("depth").alias("depth")).select("g", "sink", "event", F.lit(BACKBONE).alias("role"), (F.col("depth") - F.col("v")).alias("raw"))
    ends = F.array_distinct(F.concat("sources", "targets"))
    context = events.where(F.col("role") == CONTEXT).select(F.col("graph").alias("g"), "event", F.size(ends).alias("ends"), F.explode(ends).alias("n"))
    inside = context.join(view, ["g", "n"]).groupBy("g", "sink", "event", "ends").agg(F.count("*").alias("met"), F.min("v").alias("v"), F.max("v").alias("far"), F.first("depth").alias("depth"))
    inside = inside.where("met = ends").select("g", "sink", "event", F.when(F.col("v") < F.col("far"), CROSS).otherwise(CONTEXT).alias("role"), (F.col("depth") - F.col("v")).alias("raw"))
    return near.unionByName(inside)


def merged_events(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (by, semantic, event, sources, targets, role, content, text) merged by (by, semantic), whatever their order.

    The first by (least target, least source, event) gives event_id, sources, targets, content and
    text; producers are all events in that order, role is the strongest, arcs the distinct pairs of
    ends if it is backbone. conflicts names what the members disagree on and a merge would have to
    choose: content, text (nulls aside), producer (an event that comes twice). n_context counts the
    members that are not backbone.
    """
    key = F.struct(F.array_min("targets").alias("t"), F.array_min("sources").alias("s"), F.col("event").alias("e"))
    strength = F.when(F.col("role") == BACKBONE, 0).when(F.col("role") == CROSS, 1).otherwise(2)
    arcs = F.flatten(F.transform("sources", lambda s: F.transform("targets", lambda t: F.struct(s.alias("a"), t.alias("b")))))
    member = F.struct(key.alias("key"), "sources", "targets", "content", "text")
    grouped = rows.withColumn("_arcs", arcs).groupBy(*by, "semantic").agg(
        F.min(member).alias("_first"), F.array_sort(F.collect_list(key)).alias("_order"), F.min(strength).alias("_role"), F.collect_set("_arcs").alias("_arcs"),
        F.min("content").alias("_c0"), F.max("content").alias("_c1"), F.min("text").alias("_t0"), F.max("text").alias("_t1"), F.count_distinct("event").alias("_own"), F.count("*").alias("_all"), F.sum(F.when(F.col("role") == BACKBONE, 0).otherwise(1)).alias("n_context"),
    )
    found = F.array(F.when(F.col("_c0") != F.col("_c1"), "content"), F.when(F.col("_t0") != F.col("_t1"), "text"), F.when(F.col("_own") < F.col("_all"), "producer"))
    return grouped.select(
        *by, "semantic", F.col("_first.key.e").alias("event_id"), F.transform("_order", lambda k: k["e"]).alias("producers"), F.col("_first.sources").alias("sources"), F.col("_first.targets").alias("targets"),
        F.element_at(F.array(F.lit(BACKBONE), F.lit(CROSS), F.lit(CONTEXT)), F.col("_role") + 1).alias("role"),
        F.when(F.col("_role") == 0, F.array_sort(F.array_distinct(F.flatten("_arcs")))).alias("arcs"), F.col("_first.content").alias("content"), F.col("_first.text").alias("text"),
        F.filter(found, lambda x: x.isNotNull()).alias("conflicts"), F.col("_first.key").alias("order"), "n_context",
    )


def _divided(events: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """The records of graphs of up to WHOLE_GRAPH events, and the events of the larger ones; none where there are none."""
    kinds = dict(events.dtypes)
    node = kinds["sources"].removeprefix("array<").removesuffix(">")
    plain = {kinds["graph"], kinds["event"], node} <= set(_PLAIN) and kinds["sources"] == kinds["targets"] and {kinds[c] for c in COLUMNS[4:]} == {"string"}
    events = kept(events.select(*COLUMNS).where("graph IS NOT NULL"), "events")  # read twice at least
    if not plain:
        return None, events
    large = kept(events.groupBy("graph").count().where(F.col("count") > WHOLE_GRAPH).select("graph"), "large")
    rest = None if large.isEmpty() else events.join(large, "graph", "left_semi").select(*COLUMNS)
    small = events if rest is None else events.join(large, "graph", "left_anti").select(*COLUMNS)
    if rest is None:
        discard(large)
    tasks = max(2 * events.sparkSession.sparkContext.defaultParallelism, -(-events.count() // TASK_EVENTS))
    dealt = small.repartition(tasks, "graph").sortWithinPartitions("graph")
    return dealt.mapInArrow(record_graphs.made_records, record_graphs.result_schema(kinds["graph"], kinds["event"], node)), rest


def layered_events(events: DataFrame) -> DataFrame:
    """(graph, view_id, record_id, sink_nodes, layer_index, distance_to_sink, and the columns of merged_events) of every view.

    Events with null ends or of unknown roles take no part; nodes of one graph only meet in it; an
    empty table gives an empty result. Layers are numbered densely from the top.
    """
    whole, rest = _divided(events)
    if whole is None:
        return _joined_layers(rest)
    head = ("graph", "view_id", "record_id", "sink_nodes")
    layer = whole.select(*head, F.explode("layers").alias("x")).select(*head, "x.layer_index", "x.distance_to_sink", F.explode("x.events").alias("e"))
    own = ("semantic", "event_id", "producers", "sources", "targets", "role", "arcs", "content", "text", "conflicts", "order", "n_context")
    out = layer.select(*head, "layer_index", "distance_to_sink", *(f"e.{c}" for c in own))
    return out if rest is None else out.unionByName(_joined_layers(rest))


def _joined_layers(events: DataFrame) -> DataFrame:
    """layered_events by joins over all graphs."""
    view = views(events)
    known = events.select(F.col("graph").alias("g"), "event", "sources", "targets", "semantic", "content", "text")
    placed = placements(events, view)
    layers = dense_index(placed, ["g", "sink"], "raw", "layer_index")
    rows = placed.join(layers, ["g", "sink", "raw"]).join(known, ["g", "event"])
    merged = merged_events(rows, ["g", "sink", "raw", "layer_index"])
    heads = view.select("g", "sink", "depth", "nodes").distinct()
    view_id = stable_id("view", F.col("g").cast("string"), F.col("nodes"))
    out = merged.join(heads, ["g", "sink"]).withColumn("view_id", view_id).withColumn("distance_to_sink", (F.col("depth") - F.col("raw")).cast("bigint"))
    return out.select(
        F.col("g").alias("graph"), "view_id", stable_id("record", F.col("g").cast("string"), F.col("view_id")).alias("record_id"), F.col("nodes").alias("sink_nodes"), "layer_index", "distance_to_sink",
        "semantic", "event_id", "producers", "sources", "targets", "role", "arcs", "content", "text", "conflicts", "order", "n_context",
    )


def structured_records(events: DataFrame, layered: DataFrame | None = None) -> DataFrame:
    """One row for each sink of each graph: its layers with their events, and the counts of what was left out.

    layers: array of (layer_index, distance_to_sink, events), events in the order of (least target,
    least source, event). n_graph_events counts the graph's events, n_excluded those excluded as
    such, n_unattached context events that do not fit the view, n_beyond backbone events of other views.
    """
    if layered is not None:
        return _joined_records(events, layered)
    whole, rest = _divided(events)
    if whole is None:
        return _joined_records(rest, _joined_layers(rest))
    sized = whole.withColumn("n_layers", F.size("layers").cast("bigint")).withColumn("n_events", F.aggregate("layers", F.lit(0).cast("bigint"), lambda n, x: n + F.size(x["events"])))
    out = sized.select("graph", "view_id", "record_id", "sink_nodes", "layers", "n_producers", "n_conflicts", "n_graph_events", "n_excluded", "n_layers", "n_events", "n_unattached", "n_beyond")
    return out if rest is None else out.unionByName(_joined_records(rest, _joined_layers(rest)))


def _joined_records(events: DataFrame, layered: DataFrame) -> DataFrame:
    """structured_records by joins and aggregates over all graphs."""
    own = F.struct("order", "event_id", "producers", "semantic", "sources", "targets", "role", "arcs", "content", "text", "conflicts", "n_context")
    by = ["graph", "view_id", "record_id", "sink_nodes"]
    layer = layered.groupBy(*by, "layer_index", "distance_to_sink").agg(F.array_sort(F.collect_list(own)).alias("events"), F.sum(F.size("producers")).alias("_p"), F.sum("n_context").alias("_c"), F.sum(F.size("conflicts")).alias("_x"))
    record = layer.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("layer_index", "distance_to_sink", "events"))).alias("layers"), F.sum("_p").alias("n_producers"), F.sum("_c").alias("_attached"), F.sum("_x").alias("n_conflicts"))
    is_ = lambda role: F.sum(F.when(F.col("role") == role, 1).otherwise(0))
    counts = events.groupBy("graph").agg(F.count("*").alias("n_graph_events"), is_(EXCLUDED).alias("n_excluded"), is_(CONTEXT).alias("_context"), is_(BACKBONE).alias("_backbone"))
    out = record.join(counts, "graph").withColumn("n_layers", F.size("layers").cast("bigint")).withColumn("n_events", F.aggregate("layers", F.lit(0).cast("bigint"), lambda n, x: n + F.size(x["events"])))
    out = out.withColumn("n_unattached", F.col("_context") - F.col("_attached")).withColumn("n_beyond", F.col("_backbone") - (F.col("n_producers") - F.col("_attached")))
    return out.drop("_attached", "_context", "_backbone")


def prefix_rows(records: DataFrame) -> DataFrame:
    """A row for each record and each number of observed layers that leaves at least one: ids, both sides as JSON, their counts and digests."""
    size = F.size("layers")
    # each layer is written and counted once, before the rows of a record are made
    shown = F.transform("layers", lambda x: F.to_json(F.struct(x["layer_index"].alias("layer_index"), F.transform(x["events"], lambda e: e["content"]).alias("events"))))
    layers = records.where(size > 1).select("record_id", "view_id", "graph", "sink_nodes", "n_layers", shown.alias("shown"), F.transform("layers", lambda x: F.size(x["events"]).cast("bigint")).alias("counts"))
    rows = layers.select("*", F.explode(F.sequence(F.lit(1), F.size("shown") - 1)).alias("prefix_length"))
    seen = lambda column: F.slice(column, F.lit(1), F.col("prefix_length"))
    rest = lambda column: F.slice(column, F.col("prefix_length") + 1, F.size(column))
    whole = lambda part: F.concat(F.lit("["), F.array_join(part, ","), F.lit("]"))
    total = lambda part: F.aggregate(part, F.lit(0).cast("bigint"), lambda n, x: n + x)
    sides = rows.select("*", whole(seen("shown")).alias("observed"), whole(rest("shown")).alias("remaining"), total(seen("counts")).alias("n_observed_events"), total(rest("counts")).alias("n_remaining_events"))
    return sides.select(
        F.concat("record_id", F.lit(":prefix="), F.col("prefix_length").cast("string")).alias("sample_id"), "record_id", "view_id", "graph", "sink_nodes", F.col("prefix_length").cast("bigint").alias("prefix_length"), "n_layers",
        (F.col("n_layers") - F.col("prefix_length")).alias("n_remaining_layers"), "n_observed_events", "n_remaining_events", "observed", "remaining", F.sha2("observed", 256).alias("observed_sha256"), F.sha2("remaining", 256).alias("answer_sha256"),
        F.sha2(F.concat_ws("\n", "record_id", "observed", "remaining"), 256).alias("row_sha256"),
    )
