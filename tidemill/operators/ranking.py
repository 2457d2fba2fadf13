"""Row numbers and running totals over all rows, or over groups of any size, without gathering either in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import scratch


def _same(pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(a).eqNullSafe(F.col(b)) for a, b in pairs))


def running_totals(rows: DataFrame, order: list, amount: Column | str, by: list[str] | None = None, name: str = "before", partitions: int | None = None) -> DataFrame:
    """rows with the sum (long) of the amounts of the rows ahead in the given order, within each group of by if given.

    Amounts are whole and not negative; null counts as 0. Rows are range-partitioned by group
    and order and written once, so that the partitions stay as they are; each is summed alone
    and shifted by the totals of those before it (one row per partition), and a group counts
    from its first row. A group that holds a third of all rows is many partitions like any
    other. Ties need a last unique key in order.
    """
    spark = rows.sparkSession
    keys = [*map(F.col, by or []), *(F.col(o) if isinstance(o, str) else o for o in order)]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"_k{i}" for i in range(len(keys))]
    weight = F.coalesce((F.col(amount) if isinstance(amount, str) else amount).cast("bigint"), F.lit(0)).alias("_w")
    ranged = rows.select("*", weight, *(k.alias(a) for k, a in zip(keys, names, strict=True))).repartitionByRange(n, *names).withColumn("_part", F.spark_partition_id())
    where = scratch(spark, "places")
    ranged.write.parquet(where)
    ranged = spark.read.schema(ranged.schema).parquet(where)
    ahead = (Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_part").agg(F.sum("_w").alias("_n"))
    offsets = F.broadcast(sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(*ahead)), F.lit(0)).alias("_offset")))  # at most n rows
    inside = F.coalesce(F.sum("_w").over(Window.partitionBy("_part").orderBy(*names).rowsBetween(*ahead)), F.lit(0))
    out = ranged.withColumn("_in", inside).join(offsets, "_part").withColumn(name, F.col("_in") + F.col("_offset"))
    if by:
        own = [f"_g{i}" for i in range(len(by))]
        firsts = out.groupBy(*(F.col(k).alias(g) for k, g in zip(by, own, strict=True))).agg(F.min(name).alias("_first"))
        out = out.join(firsts, _same(list(zip(by, own, strict=True)))).withColumn(name, F.col(name) - F.col("_first"))
    return out.select(*rows.columns, name)


def place_in_order(rows: DataFrame, order: list, by: list[str] | None = None, partitions: int | None = None, name: str = "place") -> DataFrame:
    """rows with their place (long, from 0) in the given order, within each group of by if given; as running_totals, one a row."""
    return running_totals(rows, order, F.lit(1), by, name, partitions)


def firsts(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(by, order) of the first row of each group: an aggregate, combined before the shuffle, in place of a ranking."""
    return rows.groupBy(*by).agg(F.min(F.struct(*order)).alias("_first")).select(*by, *(F.col(f"_first.{o}").alias(o) for o in order))


def marked_firsts(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """rows with a boolean: is this the first of its group?"""
    own = [f"_g{i}" for i in range(len(by))]
    least = rows.groupBy(*(F.col(k).alias(g) for k, g in zip(by, own, strict=True))).agg(F.min(F.struct(*order)).alias("_first"))
    return rows.join(least, _same(list(zip(by, own, strict=True)))).select(*rows.columns, (F.struct(*order) == F.col("_first")).alias(name))


def interleave(rows: DataFrame, by: list[str], lane: str, order: list[str], blocks: tuple[str, ...] = (), name: str = "place") -> DataFrame:
    """rows with their place (from 0) in each group of by, dealt in turns: the first of every lane, then the second of
    every lane; lanes of one turn stand in the order of their names. Blocks, if given, come one after the other."""
    turns = place_in_order(rows, order, [*by, *blocks, lane], name="_turn")
    return place_in_order(turns, [*blocks, "_turn", lane], by, name=name).drop("_turn")


def tiered_order(rows: DataFrame, by: list[str], order: list[str], organism: str, graph: list[str], priority: str) -> DataFrame:
    """rows with tier and pos (from 1, in each group of by): 0 the first of each organism, 1 the priority organism,
    2 the first of each graph, 3 the rest; each record stands once, at its lowest tier."""
    marked = marked_firsts(marked_firsts(rows, [organism], order, "_of_organism"), graph, order, "_of_graph")
    tier = F.when(F.col("_of_organism"), 0).when(F.col(organism) == priority, 1).when(F.col("_of_graph"), 2).otherwise(3).cast("bigint")
    placed = place_in_order(marked.withColumn("tier", tier).drop("_of_organism", "_of_graph"), ["tier", *order], by, name="pos")
    return placed.withColumn("pos", F.col("pos") + 1)
