"""A join by one key after the other: only rows that one key leaves unmatched go on to the next."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import kept


def waterfall_join(rows: DataFrame, keys: list[str], table: DataFrame, key: str) -> DataFrame:
    """rows with matched_by (the first of keys that meets a row of table, else null) and table's other columns.

    Of several rows of table with one key the least counts. Null keys meet nothing. Every step is
    written, so a row is joined no more often than it has keys; columns of table must not stand in rows.
    """
    gained = [c for c in table.columns if c != key]
    one = table.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*gained)).alias("_row"))
    rest, done = rows, []
    for name in keys:
        met = kept(rest.join(one, F.col(name) == F.col("_key"), "left").select(*rows.columns, "_row"), "waterfall")
        done.append(met.where("_row IS NOT NULL").withColumn("matched_by", F.lit(name)))
        rest = met.where("_row IS NULL").select(*rows.columns)
    done.append(rest.withColumn("_row", F.lit(None).cast(one.schema["_row"].dataType)).withColumn("matched_by", F.lit(None).cast("string")))
    return reduce(DataFrame.unionByName, done).select(*rows.columns, "matched_by", *(F.col(f"_row.{c}").alias(c) for c in gained))
