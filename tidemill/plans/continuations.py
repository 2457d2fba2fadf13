"""Each order of a customer as the continuation that the order before is scored against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import continuations
from ..sources.tables import table

_SHOWN = ("next_layer_exact", "next_layer_f1", "next_source_f1", "next_relation_f1", "event_precision", "event_recall", "event_f1", "source_f1", "target_f1", "layer_f1", "ordered_event_f1", "event_sequence_exact")


def _pairs(spark, sf_dir):
    """Two orders in a row: an event is a line, its step the line number, source the size of the part, relation the flag, target status and tax."""
    tables = {t: table(spark, sf_dir, t) for t in ("lineitem", "orders", "part")}
    return spark.sql(
        """WITH o AS (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_ FROM {orders}),
      e AS (SELECT l_orderkey, transform(array_sort(collect_list(struct(l_linenumber, p_size % 3 AS s, l_returnflag, l_linestatus, round(l_tax, 2) AS tax))), x -> named_struct('step', CAST(x.l_linenumber AS BIGINT), 'source', array(CAST(x.s AS STRING)), 'relation', x.l_returnflag, 'target', array(x.l_linestatus, CAST(x.tax > 0.04 AS STRING)), 'mediators', CAST(NULL AS ARRAY<STRING>))) AS events
        FROM {lineitem} JOIN {part} ON p_partkey = l_partkey GROUP BY l_orderkey)
      SELECT o.o_orderkey, a.events AS guess, b.events AS truth FROM o LEFT JOIN e a ON a.l_orderkey = o.o_orderkey LEFT JOIN e b ON b.l_orderkey = o.next_ WHERE next_ IS NOT NULL""",
        **tables,
    )


def _scores(spark, sf_dir):
    scored = continuations.score_continuations(_pairs(spark, sf_dir), "guess", "truth")
    return scored.select("o_orderkey", *(F.round(c, 9).alias(c) for c in _SHOWN))


def _f1(h, p, t):
    return f"CASE WHEN {p} = 0 AND {t} = 0 THEN 1.0 WHEN {p} = 0 OR {t} = 0 OR {h} = 0 THEN 0.0 ELSE 2.0 * {h} / ({p} + {t}) END"


#: By joins of counted events; the longest common subsequences by growing chains of equal pairs.
_SCORES_ORACLE = f"""WITH RECURSIVE o AS (SELECT o_orderkey AS k, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_ FROM orders), pair AS (SELECT * FROM o WHERE next_ IS NOT NULL),
  ev AS (SELECT l_orderkey, l_linenumber AS step, CAST(p_size % 3 AS VARCHAR) AS s, l_returnflag AS r, l_linestatus AS a, CAST(round(l_tax, 2) > 0.04 AS VARCHAR) AS b, s || '/' || r || '/' || a || '/' || b AS e, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, p_size % 3, l_returnflag, l_linestatus, round(l_tax, 2)) AS i FROM lineitem JOIN part ON p_partkey = l_partkey),
  side AS (SELECT k, 'p' AS w, ev.* FROM pair JOIN ev ON l_orderkey = k UNION ALL SELECT k, 't', ev.* FROM pair JOIN ev ON l_orderkey = next_),
  one AS (SELECT * FROM (SELECT *, min(step) OVER (PARTITION BY k, w) AS low FROM side) WHERE step = low),
  bag AS (SELECT k, what, v, count(*) FILTER (w = 'p') AS np, count(*) FILTER (w = 't') AS nt FROM (SELECT k, w, 'event' AS what, e AS v FROM side UNION ALL SELECT DISTINCT k, w, 'source', s FROM side UNION ALL SELECT DISTINCT k, w, 'target', x FROM (SELECT k, w, a AS x FROM side UNION ALL SELECT k, w, b FROM side)
    UNION ALL SELECT k, w, 'first', e FROM one UNION ALL SELECT k, w, 'first_relation', r FROM one UNION ALL SELECT DISTINCT k, w, 'first_source', s FROM one) GROUP BY k, what, v),
  hits AS (SELECT pair.k, what, coalesce(sum(least(np, nt)), 0) AS h, coalesce(sum(np), 0) AS p, coalesce(sum(nt), 0) AS t FROM pair CROSS JOIN (VALUES ('event'), ('source'), ('target'), ('first'), ('first_relation'), ('first_source')) n(what) LEFT JOIN bag USING (k, what) GROUP BY pair.k, what),
  layer AS (SELECT k, w, row_number() OVER (PARTITION BY k, w ORDER BY step) AS i, v FROM (SELECT k, w, step, string_agg(e, ',' ORDER BY e) AS v FROM side GROUP BY k, w, step)),
  seq AS (SELECT k, 'event' AS what, w, i, e AS v FROM side UNION ALL SELECT k, 'layer', w, i, v FROM layer),
  eq AS (SELECT x.k, x.what, x.i, y.i AS j FROM seq x JOIN seq y ON x.k = y.k AND x.what = y.what AND x.v = y.v AND x.w = 'p' AND y.w = 't'),
  chain(k, what, i, j, n) AS (SELECT k, what, i, j, 1 FROM eq UNION SELECT c.k, c.what, eq.i, eq.j, c.n + 1 FROM chain c JOIN eq ON eq.k = c.k AND eq.what = c.what AND eq.i > c.i AND eq.j > c.j),
  lcs AS (SELECT k, what, max(n) AS h FROM chain GROUP BY k, what), sizes AS (SELECT k, what, count(*) FILTER (w = 'p') AS p, count(*) FILTER (w = 't') AS t, string_agg(v, ';' ORDER BY i) FILTER (w = 'p') AS vp, string_agg(v, ';' ORDER BY i) FILTER (w = 't') AS vt FROM seq GROUP BY k, what),
  ord AS (SELECT pair.k, n.what, coalesce(h, 0) AS h, coalesce(p, 0) AS p, coalesce(t, 0) AS t, coalesce(vp, '') = coalesce(vt, '') AS same FROM pair CROSS JOIN (VALUES ('event'), ('layer')) n(what) LEFT JOIN sizes USING (k, what) LEFT JOIN lcs USING (k, what)),
  f AS (SELECT k, what, CAST({_f1("h", "p", "t")} AS DOUBLE) AS f1, CASE WHEN p > 0 THEN CAST(h AS DOUBLE) / p WHEN t = 0 THEN 1.0 ELSE 0.0 END AS precision_, CASE WHEN t > 0 THEN CAST(h AS DOUBLE) / t WHEN p = 0 THEN 1.0 ELSE 0.0 END AS recall_, CASE WHEN p > 0 AND t > 0 THEN 1.0 ELSE 0.0 END AS both_, CASE WHEN h = p AND h = t AND p > 0 THEN 1.0 ELSE 0.0 END AS same FROM hits),
  g AS (SELECT k, what, CAST({_f1("h", "p", "t")} AS DOUBLE) AS f1, same FROM ord)
  SELECT k AS o_orderkey, CAST(max(same) FILTER (f.what = 'first') AS DOUBLE) AS next_layer_exact, round(CAST(max(f1 * both_) FILTER (f.what = 'first') AS DOUBLE), 9) AS next_layer_f1, round(CAST(max(f1 * both_) FILTER (f.what = 'first_source') AS DOUBLE), 9) AS next_source_f1, round(CAST(max(f1 * both_) FILTER (f.what = 'first_relation') AS DOUBLE), 9) AS next_relation_f1,
    round(CAST(max(precision_) FILTER (f.what = 'event') AS DOUBLE), 9) AS event_precision, round(CAST(max(recall_) FILTER (f.what = 'event') AS DOUBLE), 9) AS event_recall, round(CAST(max(f1) FILTER (f.what = 'event') AS DOUBLE), 9) AS event_f1, round(CAST(max(f1) FILTER (f.what = 'source') AS DOUBLE), 9) AS source_f1, round(CAST(max(f1) FILTER (f.what = 'target') AS DOUBLE), 9) AS target_f1,
    round(CAST((SELECT max(g.f1) FROM g WHERE g.k = f.k AND g.what = 'layer') AS DOUBLE), 9) AS layer_f1, round(CAST((SELECT max(g.f1) FROM g WHERE g.k = f.k AND g.what = 'event') AS DOUBLE), 9) AS ordered_event_f1, CAST(CASE WHEN (SELECT bool_and(g.same) FROM g WHERE g.k = f.k AND g.what = 'event') THEN 1.0 ELSE 0.0 END AS DOUBLE) AS event_sequence_exact FROM f GROUP BY k"""

QUERIES = {"continuation_scores": (_scores, _SCORES_ORACLE)}
