"""Array arithmetic inside a row: products and distances of vectors without a row per component."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column, floor: float = 1e-12) -> Column:
    """Cosine with a floor under the norms, so that a zero vector gives 0."""
    norm = lambda v: F.greatest(F.sqrt(dot(v, v)), F.lit(floor))
    return dot(a, b) / (norm(a) * norm(b))


def pairs_ahead(rows: DataFrame, key: str, vector: str, steps: int = 1) -> DataFrame:
    """rows with ahead (1 to steps), x and y: each vector (in double precision) beside those 1 to steps keys on; rows without one drop out."""
    doubles = F.col(vector).cast("array<double>")
    left = rows.withColumn("x", doubles).withColumn("ahead", F.explode(F.sequence(F.lit(1), F.lit(steps)))).withColumn("_at", F.col(key) + F.col("ahead"))
    right = rows.select(F.col(key).alias("_at"), doubles.alias("y"))
    return left.join(right, "_at").select(*rows.columns, F.col("ahead").cast("bigint").alias("ahead"), "x", "y")
