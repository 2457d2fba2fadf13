"""Graph operators: strong components of small graphs, layered records of a graph, merged duplicates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import scratch


def strong_components(nodes: list, edges: list[tuple]) -> dict:
    """Smallest member of each node's strong component. Without recursion, so long chains are fine."""
    out: dict = {n: [] for n in nodes}
    for a, b in edges:
        out[a].append(b)
    index: dict = {}
    low: dict = {}
    stack: list = []
    on: set = set()
    label: dict = {}
    for root in sorted(out):
        if root in index:
            continue
        work = [(root, iter(sorted(out[root])))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            step = next(rest, None)
            if step is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    members = []
                    while True:
                        m = stack.pop()
                        on.discard(m)
                        members.append(m)
                        if m == node:
                            break
                    for m in members:
                        label[m] = min(members)
            elif step not in index:
                index[step] = low[step] = len(index)
                stack.append(step)
                on.add(step)
                work.append((step, iter(sorted(out[step]))))
            elif step in on:
                low[node] = min(low[node], index[step])
    return label


def layers_to_sink(edges: list[tuple], label: dict) -> dict:
    """Longest distance of each component to a sink of the condensed graph."""
    forward: dict = {c: set() for c in label.values()}
    for a, b in edges:
        if label[a] != label[b]:
            forward[label[a]].add(label[b])
    backward: dict = {c: set() for c in forward}
    for a, targets in forward.items():
        for b in targets:
            backward[b].add(a)
    left = {c: len(t) for c, t in forward.items()}
    ready, distance = sorted(c for c, n in left.items() if not n), {}
    for c in ready:
        distance[c] = 0
    while ready:
        c = ready.pop()
        for up in backward[c]:
            distance[up] = max(distance.get(up, 0), distance[c] + 1)
            left[up] -= 1
            if not left[up]:
                ready.append(up)
    return distance


def structured_records(edges: DataFrame, graph: str, source: str, target: str) -> DataFrame:
    """One row per node of each graph: component, its distance to a sink, its layer, whether it is a sink.

    Distinct edges of one graph are a group; graphs are documents of bounded size, and there
    are many of them.
    """
    kinds = dict(edges.dtypes)
    pairs = edges.select(graph, F.col(source).alias("src"), F.col(target).alias("dst")).distinct()

    def run(own: pd.DataFrame) -> pd.DataFrame:
        found = [(a, b) for a, b in zip(own["src"], own["dst"], strict=True)]
        label = strong_components(sorted({n for e in found for n in e}), found)
        distance = layers_to_sink(found, label)
        depth = max(distance.values())
        return pd.DataFrame([(own[graph].iloc[0], n, c, distance[c], depth - distance[c], distance[c] == 0) for n, c in sorted(label.items())], columns=[graph, "node", "component", "distance", "layer", "is_sink"])

    schema = f"`{graph}` {kinds[graph]}, node {kinds[source]}, component {kinds[source]}, distance bigint, layer bigint, is_sink boolean"
    return pairs.groupBy(graph).applyInPandas(run, schema)


def transitive_closure(edges: DataFrame, src: str, dst: str, rounds: int = 40) -> DataFrame:
    """Distinct (src, dst) for every pair that a way of one edge or more connects; null ends connect nothing.

    Each round joins the ways with themselves, so their length doubles, and is written, so
    no plan grows; it stops when a round adds no pair.
    """
    spark = edges.sparkSession
    now = edges.select(F.col(src).alias(src), F.col(dst).alias(dst)).where(F.col(src).isNotNull() & F.col(dst).isNotNull()).distinct()
    known = -1
    for _ in range(rounds):
        where = scratch(spark, "closure")
        now.write.parquet(where)
        found = spark.read.schema(now.schema).parquet(where)
        count = found.count()
        if count == known:
            return found
        known = count
        onward = found.select(F.col(src).alias("_via"), F.col(dst).alias("_to"))
        now = found.unionByName(found.join(onward, F.col(dst) == F.col("_via")).select(src, F.col("_to").alias(dst))).distinct()
    raise RuntimeError(f"the closure did not settle in {rounds} rounds")
