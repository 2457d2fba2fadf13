"""Fixpoints over edges of any number of graphs at once: relaxation, reachability, strong components, layers.

Edges are rows (graph, source, target) of as many graphs as there are; a round works on all of
them, and rounds are as many as the longest way asks for, not as there are graphs or paths. A
round joins only what the round before has improved (semi-naive), keeps one row per key, and is
written, so that neither plans nor duplicates grow.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import discard, kept

#: Rounds whose improvements are read one by one before they are merged into one table.
MERGE_EVERY = 8
#: Edges that a round goes along before its improvements are written.
HOPS = 4


def clean_edges(edges: DataFrame, graph: str, source: str, target: str) -> DataFrame:
    """Distinct (g, a, b) without null ends."""
    return edges.select(F.col(graph).alias("g"), F.col(source).alias("a"), F.col(target).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct()


def relax(seeds: DataFrame, edges: DataFrame, keys: list[str], best: str = "max", step: int = 0) -> DataFrame:
    """The best value of each (keys, n) that seeds (keys, n, v) reach over edges (g, a, b), each edge adding step.

    best is max or min. keys hold g and what else is told apart (a start, say). Values must
    settle: with step 1 and max the edges must have no cycle. The result is a kept table.
    """
    pick = F.max if best == "max" else F.min
    better = F.col("v") > F.col("_v") if best == "max" else F.col("v") < F.col("_v")
    by = [*keys, "n"]
    known = [kept(seeds.select(*by, "v").groupBy(*by).agg(pick("v").alias("v")), "relax")]
    front = known[0]
    while True:
        state = reduce(DataFrame.unionByName, known).groupBy(*by).agg(pick("v").alias("_v"))
        onward, hops = front, []
        for _ in range(HOPS):
            onward = onward.join(edges.withColumnRenamed("a", "n"), ["g", "n"]).select(*keys, F.col("b").alias("n"), (F.col("v") + step if step else F.col("v")).alias("v"))
            onward = onward.groupBy(*by).agg(pick("v").alias("v"))
            hops.append(onward)
        found = reduce(DataFrame.unionByName, hops).groupBy(*by).agg(pick("v").alias("v")).join(state, by, "left").where(F.col("_v").isNull() | better).drop("_v")
        front = kept(found, "relax")
        if front.isEmpty():
            discard(front)
            break
        known.append(front)
        if len(known) > MERGE_EVERY:  # the newest stays apart: the next round starts from it
            merged = kept(reduce(DataFrame.unionByName, known[:-1]).groupBy(*by).agg(pick("v").alias("v")), "relax")
            for table in known[:-1]:
                discard(table)
            known = [merged, front]
    out = kept(reduce(DataFrame.unionByName, known).groupBy(*by).agg(pick("v").alias("v")), "relaxed")
    for table in known:
        discard(table)
    return out


def reached(seeds: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (keys, n) that seeds (keys, n) reach over edges (g, a, b), themselves included."""
    return relax(seeds.withColumn("v", F.lit(0)), edges, keys, "min").drop("v")


def trimmed(edges: DataFrame) -> DataFrame:
    """The edges that can lie on a cycle or between two: those from nothing or to nothing are taken away, until none is."""
    now = kept(edges, "trim")
    size = now.count()
    while size:
        left = now
        for _ in range(3):  # three peelings a round
            entered, left_from = left.select("g", F.col("b").alias("a")).distinct(), left.select("g", F.col("a").alias("b")).distinct()
            left = left.join(entered, ["g", "a"], "left_semi").join(left_from, ["g", "b"], "left_semi")
        left = kept(left.select("g", "a", "b"), "trim")
        discard(now)
        now, before, size = left, size, left.count()
        if size == before:
            break
    return now


def strong_components(edges: DataFrame) -> DataFrame:
    """(g, n, component) for each node of edges (g, a, b); component: the smallest node that n reaches and is reached by.

    Edges off all cycles are trimmed. On the rest each node takes the smallest node that leads to
    it; a node that is its own smallest is the least of its component, which is what leads back to
    it among the nodes that took it. Those are done, and the rest goes on.
    """
    nodes = kept(edges.select("g", F.col("a").alias("n")).unionByName(edges.select("g", F.col("b").alias("n"))).distinct(), "nodes")
    core, done = trimmed(edges.where("a <> b")), []
    while not core.isEmpty():
        ends = core.select("g", F.col("a").alias("n")).unionByName(core.select("g", F.col("b").alias("n"))).distinct()
        color = relax(ends.withColumn("v", F.col("n")), core, ["g"], "min")
        of = lambda end: color.select("g", F.col("n").alias(end), F.col("v").alias(f"v{end}"))  # noqa: E731, B023
        inside = kept(core.join(of("a"), ["g", "a"]).join(of("b"), ["g", "b"]).where("va = vb").select("g", F.col("b").alias("a"), F.col("a").alias("b")), "inside")
        roots = color.where("n = v").select("g", "n", "v")
        members = relax(roots, inside, ["g"], "min")
        gone = members.select("g", F.col("n").alias("a"))
        rest = trimmed(core.join(gone, ["g", "a"], "left_anti").join(gone.withColumnRenamed("a", "b"), ["g", "b"], "left_anti").select("g", "a", "b"))
        for table in (core, color, inside):
            discard(table)
        done.append(members)
        core = rest
    discard(core)
    if done:
        labels = reduce(DataFrame.unionByName, done)
        out = kept(nodes.join(labels, ["g", "n"], "left").select("g", "n", F.coalesce("v", "n").alias("component")), "components")
        for table in (*done, nodes):
            discard(table)
        return out
    return nodes.withColumn("component", F.col("n"))


def condensed(edges: DataFrame, components: DataFrame) -> DataFrame:
    """The graph of components: distinct (g, a, b) of the edges that join two of them."""
    of = lambda end: components.select("g", F.col("n").alias(end), F.col("component").alias(f"c{end}"))
    return edges.join(of("a"), ["g", "a"]).join(of("b"), ["g", "b"]).where("ca <> cb").select("g", F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()


def sinks(components: DataFrame, dag: DataFrame) -> DataFrame:
    """(g, sink): components without a way out."""
    return components.select("g", F.col("component").alias("sink")).distinct().join(dag.select("g", F.col("a").alias("sink")).distinct(), ["g", "sink"], "left_anti")


def distances_to_sinks(dag: DataFrame, ends: DataFrame) -> DataFrame:
    """(g, sink, n, v): every component n that leads to a sink of ends (g, sink), and the length of the longest way."""
    back = dag.select("g", F.col("b").alias("a"), F.col("a").alias("b"))
    return relax(ends.select("g", "sink", F.col("sink").alias("n"), F.lit(0).alias("v")), back, ["g", "sink"], "max", 1)


def dense_index(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Distinct (by, value) with its rank among the group's values, from 0; a group has few values (layers of a view)."""
    return rows.select(*by, value).distinct().withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(value)) - 1).cast("bigint"))
