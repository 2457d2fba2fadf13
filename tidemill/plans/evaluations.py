"""Operators on data frames applied to the test tables, with oracles written apart from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import histories, json_trees
from ..sources.tables import table


def _nested(spark, sf_dir):
    entity = F.struct(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("canonical_id"), F.array("p_brand", F.lit("  "), "p_type").alias("aliases"), F.col("p_name").alias("name"))
    items = F.array(F.struct(F.lit("x").alias("Organism"), F.col("p_type").alias("kind")))
    return table(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct(F.col("p_size").alias("id"), F.col("p_name").alias("name"), entity.alias("entity"), items.alias("items"))).alias("body"))


def json_harvest(spark, sf_dir):
    """Strings, ids and named keys of nested payloads."""
    body = F.col("body")
    return _nested(spark, sf_dir).select(
        "p_partkey",
        F.array_join(json_trees.strings(body), "|").alias("strings"),
        F.array_join(json_trees.entity_ids(body), "|").alias("ids"),
        F.array_join(json_trees.keys_among(body, ("organism", "kind", "secret")), "|").alias("keys"),
    )


JSON_HARVEST = """SELECT p_partkey, p_brand || '|  |' || p_type || '|part:' || p_partkey || '|' || p_name || '|x|' || p_type || '|' || p_name AS strings,
  'part:' || p_partkey || '|' || p_brand || '|' || p_type AS ids, 'kind|organism' AS keys FROM part"""


def object_or_scalar_text(spark, sf_dir):
    """The text of payloads that are an object, a string, a number, blank or null."""
    k = F.col("doc_id") % 6
    body = F.when(k == 0, F.to_json(F.struct(F.concat(F.lit(" "), F.col("source")).alias("text")))).when(k == 1, F.concat(F.lit('"'), F.col("source"), F.lit(' "'))).when(k == 2, F.col("doc_id").cast("string"))
    body = body.when(k == 3, F.lit('{"text": "  "}')).when(k == 4, F.lit("null"))
    return table(spark, sf_dir, "documents").select("doc_id", json_trees.text_of(body).alias("phenotype"))


OBJECT_OR_SCALAR_TEXT = "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN source WHEN 1 THEN source WHEN 2 THEN doc_id::VARCHAR END AS phenotype FROM documents"


def _history(spark, sf_dir):
    """Runs of epochs: the mean value of a user's events by order, as whole thousandths."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.col("value") * 1000).cast("bigint").alias("milli"), F.col("event_type"))
    return events.groupBy("user_id", (F.col("event_id") % 12).alias("epoch")).agg((F.max("milli") / 1000).alias("loss"), (F.count_if(F.col("event_type") != "error") / F.count("*")).alias("coverage"))


_HISTORY = "SELECT user_id, event_id % 12 AS epoch, max(round(value * 1000)::BIGINT) / 1000 AS loss, count(*) FILTER (event_type <> 'error') / count(*) AS coverage FROM events GROUP BY ALL"


def early_stop_fold(spark, sf_dir):
    """Early stopping where a gain must exceed a margin."""
    found = histories.early_stopping(_history(spark, sf_dir), "user_id", "epoch", "loss", patience=3, min_delta=5.0)
    return found.select("user_id", "epoch", "improved", F.round("best", 3).alias("best"), "waited", "stop")


EARLY_STOP_FOLD = f"""WITH RECURSIVE h AS ({_HISTORY}), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch) AS i FROM h),
  f AS (SELECT user_id, epoch, i, true AS improved, loss AS best, 0::BIGINT AS waited FROM o WHERE i = 1
    UNION ALL SELECT o.user_id, o.epoch, o.i, o.loss < f.best - 5, CASE WHEN o.loss < f.best - 5 THEN o.loss ELSE f.best END, CASE WHEN o.loss < f.best - 5 THEN 0 ELSE f.waited + 1 END FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
  SELECT user_id, epoch, improved, round(best, 3) AS best, waited, waited >= 3 AS stop FROM f"""


def stability_reasons(spark, sf_dir):
    """Each run's first failed gate."""
    return histories.stability(_history(spark, sf_dir), "user_id", "epoch", "loss", "coverage", epochs=6, least_coverage=0.5, improvement=0.2, regression=0.5)


STABILITY_REASONS = f"""WITH h AS ({_HISTORY}), a AS (SELECT user_id, count(*) AS n, arg_max(coverage, epoch) AS covered, arg_min(loss, epoch) AS first_, arg_max(loss, epoch) AS last_, min(loss) AS best FROM h GROUP BY user_id),
  r AS (SELECT user_id, CASE WHEN n < 6 THEN 'minimum_epochs_not_reached' WHEN covered < 0.5 THEN 'insufficient_trajectory_coverage' WHEN (first_ - best) / greatest(abs(first_), 1e-12) < 0.2 THEN 'insufficient_validation_improvement' WHEN last_ > best * 1.5 + 1e-12 THEN 'validation_regressed_from_best' END AS bad FROM a)
  SELECT user_id, bad IS NULL AS stable, coalesce(bad, 'finite_covered_improved_and_non_regressing') AS reason FROM r"""


def rejection_by_kind(spark, sf_dir):
    """Lines of an order as candidates, the first of each order the positive one, the others negative by return flag."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("double").alias("score"), F.min("l_returnflag").alias("kind"))
    first = lines.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("first"))
    cases = lines.join(first, "l_orderkey").withColumn("positive", F.col("l_linenumber") == F.col("first"))
    found = histories.rank_of_positive(cases, "l_orderkey", "l_linenumber", "score", "positive", "kind", ["A", "N", "R"])
    rounded = [F.round(c, 9).alias(c) for c in ("reciprocal", "rejection", "rejection_A", "rejection_N", "rejection_R")]
    return found.select("l_orderkey", "place", "top1", *rounded)


REJECTION_BY_KIND = """WITH l AS (SELECT l_orderkey, l_linenumber, max(l_quantity)::DOUBLE AS score, min(l_returnflag) AS kind FROM lineitem GROUP BY ALL),
  p AS (SELECT l_orderkey, arg_min(score, l_linenumber) AS score, min(l_linenumber) AS at FROM l GROUP BY l_orderkey),
  c AS (SELECT l.l_orderkey, l.kind, l.score > p.score AS above, CASE WHEN l.l_linenumber = p.at THEN NULL WHEN p.score > l.score THEN 1.0 ELSE 0.0 END AS beaten FROM l JOIN p USING (l_orderkey))
  SELECT l_orderkey, 1 + count(*) FILTER (above) AS place, count(*) FILTER (above) = 0 AS top1, round(1.0 / (1 + count(*) FILTER (above)), 9) AS reciprocal, round(avg(beaten), 9) AS rejection,
    round(avg(beaten) FILTER (kind = 'A'), 9) AS "rejection_A", round(avg(beaten) FILTER (kind = 'N'), 9) AS "rejection_N", round(avg(beaten) FILTER (kind = 'R'), 9) AS "rejection_R" FROM c GROUP BY l_orderkey"""


QUERIES = {
    "json_harvest": (json_harvest, JSON_HARVEST),
    "object_or_scalar_text": (object_or_scalar_text, OBJECT_OR_SCALAR_TEXT),
    "early_stop_fold": (early_stop_fold, EARLY_STOP_FOLD),
    "stability_reasons": (stability_reasons, STABILITY_REASONS),
    "rejection_by_kind": (rejection_by_kind, REJECTION_BY_KIND),
}
