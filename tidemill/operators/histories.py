"""Rules over the epochs of training runs, and over scored candidates of cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def early_stopping(df: DataFrame, run: str, epoch: str, loss: str, patience: int, min_delta: float = 0.0) -> DataFrame:
    """(run, epoch, loss, improved, best, waited, stop) for every epoch.

    An epoch improves where its loss is below the best so far by more than min_delta, and only
    then the best moves; so each epoch depends on all before, and a run's epochs are folded in
    order in one array. A null or NaN loss does not improve; patience 0 never stops.
    """
    steps = df.groupBy(run).agg(F.sort_array(F.collect_list(F.struct(F.col(epoch).alias("at"), F.col(loss).cast("double").alias("x")))).alias("line"))
    state = "struct<at: bigint, x: double, improved: boolean, best: double, waited: bigint>"

    def fold(done: Column, step: Column) -> Column:
        best = F.coalesce(F.try_element_at(done, F.lit(-1))["best"], F.lit(float("inf")))
        waited = F.coalesce(F.try_element_at(done, F.lit(-1))["waited"], F.lit(0))
        better = F.coalesce((step["x"] < best - F.lit(min_delta)) & ~F.isnan(step["x"]), F.lit(False))
        new = F.struct(step["at"].cast("bigint").alias("at"), step["x"].alias("x"), better.alias("improved"), F.when(better, step["x"]).otherwise(best).alias("best"), F.when(better, 0).otherwise(waited + 1).cast("bigint").alias("waited"))
        return F.concat(done, F.array(new.cast(state)))

    folded = steps.select(run, F.explode(F.aggregate("line", F.array().cast(f"array<{state}>"), fold)).alias("s"))
    stop = (F.col("s.waited") >= patience) & F.lit(patience > 0)
    return folded.select(run, F.col("s.at").alias("epoch"), F.col("s.x").alias("loss"), F.col("s.improved").alias("improved"), F.col("s.best").alias("best"), F.col("s.waited").alias("waited"), stop.alias("stop"))


def stability(df: DataFrame, run: str, epoch: str, loss: str, coverage: str, epochs: int, least_coverage: float, improvement: float, regression: float) -> DataFrame:
    """(run, stable, reason): the first gate that a run's history fails.

    The gates in order: enough epochs; every loss and coverage finite; the last coverage high
    enough; the best loss below the first by a share of it; the last loss no more than a share
    above the best.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    cols = df.select(run, epoch, F.col(loss).cast("double").alias("_x"), F.col(coverage).cast("double").alias("_c"))
    h = cols.groupBy(run).agg(
        F.count("*").alias("n"),
        F.bool_and(finite("_x") & finite("_c")).alias("finite"),
        F.max_by("_c", epoch).alias("covered"),
        F.min_by("_x", epoch).alias("first"),
        F.max_by("_x", epoch).alias("last"),
        F.min("_x").alias("best"),
    )
    gain = (F.col("first") - F.col("best")) / F.greatest(F.abs("first"), F.lit(1e-12))
    # The reason codes.
    reason = (
        F.when(F.col("n") < epochs, "minimum_epochs_not_reached")
        .when(~F.col("finite"), "non_finite_validation_metric")
        .when(F.col("covered") < least_coverage, "insufficient_trajectory_coverage")
        .when(gain < improvement, "insufficient_validation_improvement")
        .when(F.col("last") > F.col("best") * (1.0 + regression) + 1e-12, "validation_regressed_from_best")
    )
    return h.select(run, reason.isNull().alias("stable"), F.coalesce(reason, F.lit("finite_covered_improved_and_non_regressing")).alias("reason"))


def rank_of_positive(df: DataFrame, case: str, position: str, score: str, positive: str, kind: str, kinds: list[str]) -> DataFrame:
    """(case, place, top1, reciprocal, rejection, and rejection_<kind> for each of kinds) for every case with a positive candidate.

    Candidates are ranked by score, ties by position; the positive one is the first of its
    kind in that order. A rejection is the share of negative candidates, of all or of one
    kind, that score below it; null without any.
    """
    above = F.struct((-F.col(score)).alias("s"), F.col(position).alias("p"))
    best = df.where(F.col(positive)).groupBy(case).agg(F.min(above).alias("_best"))
    rows = df.withColumn("_own", above).join(best, case)
    beaten = F.when(~F.col(positive), (-F.col("_best.s") > F.col(score)).cast("double"))
    of_kinds = [F.avg(F.when(F.col(kind) == k, beaten)).alias(f"rejection_{k}") for k in kinds]
    found = rows.groupBy(case).agg((1 + F.count_if(F.col("_own") < F.col("_best"))).cast("bigint").alias("place"), F.avg(beaten).alias("rejection"), *of_kinds)
    return found.select(case, "place", (F.col("place") == 1).alias("top1"), (1.0 / F.col("place")).alias("reciprocal"), "rejection", *(f"rejection_{k}" for k in kinds))
