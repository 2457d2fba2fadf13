"""Sequence operators without a relational form: warping distance, common subsequences, rollouts, permutations."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def warp(a: np.ndarray, b: np.ndarray) -> tuple[float, int]:
    """Dynamic time warping cost over the length of its path; of equal predecessors up, left, then diagonal."""
    if not len(a) or not len(b):
        return float("nan"), 0
    cost = np.abs(a[:, None] - b[None, :])
    total = np.full((len(a) + 1, len(b) + 1), np.inf)
    steps = np.zeros((len(a) + 1, len(b) + 1), np.int64)
    total[0, 0] = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            best, count = min(((total[i - 1, j], 0, steps[i - 1, j]), (total[i, j - 1], 1, steps[i, j - 1]), (total[i - 1, j - 1], 2, steps[i - 1, j - 1])), key=lambda t: t[:2])[::2]
            total[i, j] = cost[i - 1, j - 1] + best
            steps[i, j] = count + 1
    n = int(steps[-1, -1])
    return float(total[-1, -1] / n), n


def dtw(rows: DataFrame, left: str, right: str) -> DataFrame:
    """rows with distance and steps of the warping path of two number arrays; arrays are held whole, a row at a time."""

    @F.pandas_udf("distance double, steps bigint")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([warp(np.asarray(x, float), np.asarray(y, float)) for x, y in zip(a, b, strict=True)], columns=["distance", "steps"])

    return rows.withColumn("_d", run(left, right)).select(*rows.columns, "_d.distance", "_d.steps")


def common_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, one row of the table at a time."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def lcs(rows: DataFrame, left: str, right: str) -> DataFrame:
    @F.pandas_udf("bigint")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([common_length(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int64")

    n = F.size(left) + F.size(right)
    out = rows.withColumn("lcs", run(left, right))
    return out.withColumn("f1", F.when(n == 0, 1.0).otherwise(F.round(2 * F.col("lcs") / n, 9)))


def linear_rollout(rows: DataFrame, column: str, steps: int, decay: float) -> DataFrame:
    """Roll a vector forward by a decayed cyclic shift; drift is how far the end is from the start. In higher-order functions only."""
    shift = lambda z: F.transform(F.concat(F.slice(z, 2, F.size(z) - 1), F.slice(z, 1, 1)), lambda x: x * F.lit(decay))
    start = F.col(column).cast("array<double>")
    end = start
    for _ in range(steps):
        end = shift(end)
    square = F.aggregate(F.zip_with(end, start, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return rows.withColumn("drift", F.sqrt(square))


def shuffled_negatives(rows: DataFrame, key: str, position: str, wanted: int, attempts: int = 30) -> DataFrame:
    """Up to wanted distinct orders of a group's positions, none the true one, by the hash of seed, attempt and position.

    Positions of one group are sorted inside the row; groups that have only one order give none.
    """
    groups = rows.groupBy(key).agg(F.sort_array(F.collect_list(position)).alias("true"))

    @F.pandas_udf("array<array<bigint>>")
    def run(keys: pd.Series, true: pd.Series) -> pd.Series:
        out = []
        for k, order in zip(keys, true, strict=True):
            order, found = list(order), []
            for attempt in range(attempts):
                if len(found) == wanted:
                    break
                made = sorted(order, key=lambda p: hashlib.sha256(f"{k}:{attempt}:{p}".encode()).digest())
                if made != order and made not in found:
                    found.append(made)
            out.append(found)
        return pd.Series(out)

    return groups.select(key, F.posexplode(run(F.col(key), F.col("true"))).alias("nr", "permutation"))
