"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written


#: A key with more rows than this, and than a share of all rows, meets its minimum by broadcast and not by a shuffle.
HEAVY_ROWS, HEAVY_SHARE = 256, 10_000


def with_minimum(rows: DataFrame, key: str, value: str, name: str, count: int) -> DataFrame:
    """rows with the smallest value of their key as column name; count is about the number of rows, and no key is null.

    Keys of many rows are at most 2 * HEAVY_SHARE, whatever the number of rows, so their
    minima are broadcast; their rows are dealt by a hash of the whole row, the others by key.
    """
    heavy = max(HEAVY_ROWS, count // HEAVY_SHARE)
    low = rows.groupBy(key).agg(F.min(value).alias("_m"), F.count("*").alias("_n"))
    crowded = F.broadcast(low.where(F.col("_n") > heavy).select(F.col(key).alias("_hot"), F.col("_m").alias("_hot_m")))
    dealt = rows.join(crowded, F.col(key) == F.col("_hot"), "left")
    dealt = dealt.select(*rows.columns, "_hot_m", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.xxhash64(*rows.columns)).alias("_k"), F.col("_hot").isNull().alias("_by_key"))
    light = low.where(F.col("_n") <= heavy).select(F.col(key).alias("_k"), F.lit(True).alias("_by_key"), "_m")
    return dealt.join(light, ["_k", "_by_key"], "left").select(*rows.columns, F.coalesce("_hot_m", "_m").alias(name))


def join_hot(rows: DataFrame, key: str, table: DataFrame, count: int) -> DataFrame:
    """rows left-joined to table, which has one row for a key; keys of many rows go as in with_minimum."""
    heavy = max(HEAVY_ROWS, count // HEAVY_SHARE)
    often = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > heavy).select(key)
    hot = F.broadcast(often.join(table.withColumn("_found", F.lit(True)), key, "left"))
    gained = [c for c in table.columns if c != key]
    dealt = rows.join(hot.select(F.col(key).alias("_hot"), "_found", *(F.col(c).alias(f"_hot_{c}") for c in gained)), F.col(key) == F.col("_hot"), "left")
    dealt = dealt.withColumns({"_k": F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.xxhash64(*rows.columns)), "_by_key": F.col("_hot").isNull()})
    light = table.select(F.col(key).alias("_k"), F.lit(True).alias("_by_key"), *(F.col(c).alias(f"_own_{c}") for c in gained))
    return dealt.join(light, ["_k", "_by_key"], "left").select(*rows.columns, *(F.coalesce(f"_hot_{c}", f"_own_{c}").alias(c) for c in gained))


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return with_minimum(both, "a", "b", "m", 2 * count).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(edges: DataFrame, count: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = with_minimum(down, "a", "b", "m", count)
    return pairs.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()


def connected_components(edges: DataFrame, rounds: int = 60, files: int | None = None) -> DataFrame:
    """Rows (node, component) for every node of the edges (a, b), component the smallest node that links reach.

    Each round rewrites every edge towards the smallest neighbour it can see, which leaves
    stars after a number of rounds that grows with the logarithm of the longest path. The hub
    of a star is no hot key, see with_minimum. A round
    is written to the shared folder, so no plan grows and a lost executor costs one round;
    files is the number of files of a round at most (as many as there are partitions if None).
    Loops and repeated edges are allowed; an empty edge table gives an empty result.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges", files)
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = print_of(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        after = written(_small_star(_large_star(now, seen[0]), seen[0]), "edges", files)
        dropped(edges.sparkSession, now)
        now, before, seen = after, seen, print_of(after)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.withColumn("component", F.col("node")))
