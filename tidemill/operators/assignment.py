"""Solvers that run on the driver after an aggregate has shrunk the data to groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PARTS = (("train", 0.7), ("validation", 0.2), ("test", 0.1))
#: Most groups that a solver takes; a group is one row of the aggregate.
MAX_GROUPS = 100_000


def _collected(df: DataFrame) -> list:
    rows = df.limit(MAX_GROUPS + 1).collect()
    if len(rows) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups: too many for a driver-side solver")
    return rows


def indivisible_split(weights: dict, parts: tuple = PARTS, passes: int = 50) -> dict:
    """Groups to parts, none divided, none of the parts empty if there are enough groups.

    Largest groups first to the part that is furthest below its share; then single moves and
    swaps while the squared error of the shares falls.
    """
    total = sum(weights.values()) or 1
    goal = {p: share * total for p, share in parts}
    have, where = dict.fromkeys(goal, 0), {}
    for g in sorted(weights, key=lambda g: (-weights[g], g)):
        part = max(goal, key=lambda p: (goal[p] - have[p], p))
        where[g] = part
        have[part] += weights[g]
    for part in goal:
        if part not in where.values() and len(weights) >= len(goal):
            full = [g for g in where if sum(w == where[g] for w in where.values()) > 1]
            g = min(full, key=lambda g: (weights[g], g))
            have[where[g]] -= weights[g]
            where[g] = part
            have[part] += weights[g]
    error = lambda: sum((have[p] - goal[p]) ** 2 for p in goal)
    for _ in range(passes):
        best = (error(), None, None)
        for g in sorted(where):
            for part in goal:
                old = where[g]
                if part == old or sum(w == old for w in where.values()) == 1:
                    continue
                have[old] -= weights[g]
                have[part] += weights[g]
                if error() < best[0] - 1e-9:
                    best = (error(), g, part)
                have[old] += weights[g]
                have[part] -= weights[g]
        if best[1] is None:
            break
        have[where[best[1]]] -= weights[best[1]]
        have[best[2]] += weights[best[1]]
        where[best[1]] = best[2]
    return where


def split_families(rows: DataFrame, family: str, weight: str) -> DataFrame:
    sums = {r[0]: r[1] for r in _collected(rows.groupBy(family).agg(F.sum(weight).cast("long")))}
    where = indivisible_split(sums)
    return rows.sparkSession.createDataFrame([(k, v, sums[k]) for k, v in sorted(where.items())], f"{family} string, part string, weight bigint")


def balanced_quotas(groups: dict[tuple, int], labels: tuple) -> dict[tuple, dict]:
    """How many records of each eligibility group get each label, so that the labels' totals are as even as can be.

    groups maps the labels a record may have to the number of such records. The smallest
    feasible largest total is found by bisection over a flow; the smallest total likewise.
    """
    total = sum(groups.values())

    def flow(low: int, high: int) -> dict | None:
        # lower bounds: every label first takes low, then up to high
        quota = {g: dict.fromkeys(labels, 0) for g in groups}
        taken, left = dict.fromkeys(labels, 0), dict(groups)

        def augment(label: str, cap: int) -> bool:
            """One more record for label, by moving others along a shortest path."""
            if taken[label] >= cap:
                return False
            before: dict = {label: None}
            queue = [label]
            for at in queue:
                for g in groups:
                    if at not in g:
                        continue
                    if left[g]:
                        left[g] -= 1
                        quota[g][at] += 1
                        while before[at] is not None:
                            up, via = before[at]
                            quota[via][at] -= 1
                            quota[via][up] += 1
                            at = up
                        taken[label] += 1
                        return True
                    for other in g:
                        if other not in before and quota[g][other]:
                            before[other] = (at, g)
                            queue.append(other)
            return False

        for label in labels:
            while taken[label] < low:
                if not augment(label, low):
                    return None
        for label in labels:
            while taken[label] < high and augment(label, high):
                pass
        return quota if not any(left.values()) else None

    bottom, top = -(-total // max(1, len(labels))), total
    while bottom < top:
        mid = (bottom + top) // 2
        bottom, top = (bottom, mid) if flow(0, mid) is not None else (mid + 1, top)
    high, bottom, top = top, 0, total // max(1, len(labels))
    while bottom < top:
        mid = (bottom + top + 1) // 2
        bottom, top = (mid, top) if flow(mid, high) is not None else (bottom, mid - 1)
    return flow(bottom, high) or {g: dict.fromkeys(labels, 0) for g in groups}


def assign_labels(rows: DataFrame, key: str, options: str, labels: tuple) -> DataFrame:
    """One label for each row from its array of options, totals balanced; inside a group by the hash of the key."""
    spark = rows.sparkSession
    name = F.array_join(F.array_sort(options), "|")
    groups = {tuple(r[0].split("|")): r[1] for r in _collected(rows.where(F.size(options) > 0).groupBy(name.alias("g")).agg(F.count("*")))}
    quotas = balanced_quotas(groups, labels)
    bounds = []
    for g, own in quotas.items():
        upto = 0
        for label in labels:
            if own[label]:
                bounds.append(("|".join(g), label, upto + 1, upto + own[label]))
                upto += own[label]
    table = F.broadcast(spark.createDataFrame(bounds, "g string, label string, first bigint, last bigint"))
    order = Window.partitionBy("g").orderBy(F.sha2(F.concat(F.lit("horizon:"), F.col(key).cast("string")), 256), key)
    placed = rows.where(F.size(options) > 0).select(key, name.alias("g")).withColumn("place", F.row_number().over(order))
    return placed.join(table, "g").where("place BETWEEN first AND last").select(key, "label")

