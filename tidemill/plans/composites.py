"""Evaluation families put together from the other plans, and rules that need an ordered stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dialect import relational
from ..operators.budget import least_loaded
from ..sources.tables import table


def cki_summary(d):
    """Knock-out influence by status: survival ratio, gate accuracy, share of cases where the double beats the single."""
    return """WITH c AS (SELECT o.o_orderstatus AS status, l.l_orderkey, avg(CASE WHEN l_returnflag = 'R' THEN l_discount END) AS ko, avg(CASE WHEN l_returnflag = 'N' THEN l_discount END) AS wt,
        min(CASE WHEN l_linenumber = 1 THEN l_tax END) AS single_low, min(CASE WHEN l_linenumber >= 2 THEN l_tax END) AS double_low FROM @lineitem l JOIN @orders o ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderstatus, l.l_orderkey)
      SELECT status, count(*) AS cases, round(avg(ko / greatest(wt, 0.000001)) / 1000, 3) AS survival_k, round(avg(CASE WHEN ko IS NULL OR wt IS NULL THEN NULL WHEN round(ko, 9) < round(wt, 9) THEN 1.0 ELSE 0.0 END), 7) AS gate,
             round(avg(CASE WHEN double_low < single_low THEN 1.0 WHEN single_low IS NULL OR double_low IS NULL THEN NULL ELSE 0.0 END), 7) AS lower_double FROM c GROUP BY status"""


def event_set_score(d):
    """Next-layer score of neighbouring orders of a customer: exact match and multiset F1 of (part brand, flag), averaged over eligible rows; coverage over all."""
    return f"""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM @orders),
      ev AS (SELECT l.l_orderkey, concat(p.p_brand, '>', l.l_returnflag) AS e, count(*) AS n FROM @lineitem l JOIN @part p ON l.l_partkey = p.p_partkey GROUP BY l.l_orderkey, concat(p.p_brand, '>', l.l_returnflag)),
      tot AS (SELECT l_orderkey, sum(n) AS n FROM ev GROUP BY l_orderkey), pair AS (SELECT a.o_custkey, a.o_orderkey AS t, b.o_orderkey AS p FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.r = a.r + 1),
      hit AS (SELECT pair.t, sum(least(x.n, y.n)) AS h FROM pair JOIN ev x ON x.l_orderkey = pair.t JOIN ev y ON y.l_orderkey = pair.p AND x.e = y.e GROUP BY pair.t),
      s AS (SELECT pair.o_custkey, coalesce(h, 0) AS h, a.n AS nt, b.n AS np FROM pair LEFT JOIN tot a ON a.l_orderkey = pair.t LEFT JOIN tot b ON b.l_orderkey = pair.p LEFT JOIN hit ON hit.t = pair.t)
      SELECT c.c_mktsegment AS segment, count(*) AS n_pairs, CAST(sum(CASE WHEN h = nt AND h = np THEN 1 ELSE 0 END) AS BIGINT) AS exact_matches, round(avg(CASE WHEN nt IS NOT NULL AND np IS NOT NULL THEN 2.0 * h / (nt + np) END), 7) AS f1,
             round(avg(CASE WHEN nt IS NOT NULL AND np IS NOT NULL THEN 1.0 ELSE 0.0 END), 7) AS coverage FROM s JOIN @customer c ON c.c_custkey = s.o_custkey GROUP BY c.c_mktsegment"""


def perturbed_summary(d):
    """Correlation of deltas from a control mean per vector, averaged by label, with the paired win rate over the plain copy."""
    return f"""WITH dims AS (SELECT vec_id, label, i, CAST({d.at('embedding', 'CAST(i AS INT)')} AS DOUBLE) AS x FROM (SELECT vec_id, label, embedding, {d.explode(d.places('embedding'))} AS i FROM @embeddings)), c AS (SELECT i, avg(x) AS m FROM dims WHERE label = 0 GROUP BY i),
      p AS (SELECT a.vec_id, a.label, round(corr(a.x - c.m, b.x - c.m), 9) AS delta_r, round(corr(a.x, b.x), 9) AS plain_r FROM dims a JOIN dims b ON b.vec_id = a.vec_id + 1 AND a.i = b.i JOIN c ON a.i = c.i GROUP BY a.vec_id, a.label)
      SELECT label, count(*) AS n, round(avg(delta_r), 6) AS delta_r, round(avg(CASE WHEN delta_r > plain_r THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM p GROUP BY label"""


def complete_layer_retention(d):
    """Turns kept whole while their running length fits the budget; a conversation over it is marked."""
    return f"""WITH t AS (SELECT conv_id, turn, {d.chars('text')} AS n, CAST(sum({d.chars('text')}) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM @conversations)
      SELECT conv_id, CAST(sum(CASE WHEN upto <= 1500 THEN 1 ELSE 0 END) AS BIGINT) AS kept, count(*) AS turns, CAST(coalesce(max(CASE WHEN upto <= 1500 THEN upto END), 0) AS BIGINT) AS tokens, max(upto) > 1500 AS over_budget FROM t GROUP BY conv_id"""


def reconstruction_self_consistency(d):
    """Error of each vector against the mean of its label, by label, and the share within a bound."""
    return f"""WITH dims AS (SELECT vec_id, label, i, CAST({d.at('embedding', 'CAST(i AS INT)')} AS DOUBLE) AS x FROM (SELECT vec_id, label, embedding, {d.explode(d.places('embedding'))} AS i FROM @embeddings)), c AS (SELECT label, i, avg(x) AS m FROM dims GROUP BY label, i),
      e AS (SELECT dims.vec_id, dims.label, round(avg((x - m) * (x - m)), 9) AS mse FROM dims JOIN c ON dims.label = c.label AND dims.i = c.i GROUP BY dims.vec_id, dims.label) SELECT label, round(avg(mse), 7) AS mse, round(avg(CASE WHEN mse < 0.0156 THEN 1.0 ELSE 0.0 END), 6) AS within FROM e GROUP BY label"""


def direction_margin(d):
    """Share of customers whose later order is dearer, and the margin."""
    return """WITH o AS (SELECT o_custkey, o_totalprice, lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS later FROM @orders)
      SELECT c.c_mktsegment AS segment, count(later) AS n, round(avg(CASE WHEN later IS NULL THEN NULL WHEN later > o_totalprice THEN 1.0 ELSE 0.0 END), 7) AS accuracy, round(avg(later - o_totalprice), 3) AS margin FROM o JOIN @customer c ON c.c_custkey = o.o_custkey GROUP BY c.c_mktsegment"""


def _least_loaded(spark, sf_dir):
    layers = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("shard", F.col("conv_id") % 4)
    options = F.expr("filter(array(IF(n >= 3, 'long', NULL), IF(n >= 4, 'middle', NULL), IF(n >= 2, 'short', NULL)), x -> x IS NOT NULL)")
    return least_loaded(layers.select("shard", "conv_id", options.alias("options")), "shard", ["conv_id"], "options", ("long", "middle", "short")).select("conv_id", "label")


_LEAST_ORACLE = """WITH RECURSIVE l AS (SELECT conv_id, count(*) AS n, conv_id % 4 AS shard FROM conversations GROUP BY conv_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY conv_id) AS i FROM l),
  g AS (
    SELECT shard, 0::BIGINT AS i, 0::BIGINT AS conv_id, NULL::VARCHAR AS label, 0 AS a, 0 AS b, 0 AS c FROM (SELECT DISTINCT shard FROM l)
    UNION ALL
    SELECT shard, i, conv_id, label, a + (label IS NOT DISTINCT FROM 'long')::INT, b + (label IS NOT DISTINCT FROM 'middle')::INT, c + (label IS NOT DISTINCT FROM 'short')::INT FROM (
      SELECT g.shard, r.i, r.conv_id, g.a, g.b, g.c, CASE WHEN n >= 4 THEN CASE WHEN a <= b AND a <= c THEN 'long' WHEN b <= c THEN 'middle' ELSE 'short' END WHEN n = 3 THEN CASE WHEN a <= c THEN 'long' ELSE 'short' END WHEN n = 2 THEN 'short' END AS label
      FROM g JOIN r ON r.shard = g.shard AND r.i = g.i + 1))
  SELECT conv_id, label FROM g WHERE i > 0"""


QUERIES = relational(cki_summary, event_set_score, perturbed_summary, complete_layer_retention, reconstruction_self_consistency, direction_margin) | {"horizon_least_loaded": (_least_loaded, _LEAST_ORACLE)}
