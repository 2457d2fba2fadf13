"""Scores: set and sequence metrics, enrichment, ranking, correlation, trajectories, batches of vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dialect import ORACLE, on_oracle, relational
from ..operators import sequences
from ..operators.vectors import cosine, pairs_ahead, squared_distance
from ..sources.tables import table

_TURNS = "pairs AS (SELECT a.conv_id, a.turn, a.text AS target, b.text AS predicted FROM @conversations a JOIN @conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


def entity_prf(d):
    """Precision, recall and F1 of word sets of neighbouring turns; both empty is a full match."""
    words = lambda t: d.array_distinct(d.mapped(d.words(t), "x", "lower(x)"))
    return f"""WITH {_TURNS}, s AS (SELECT conv_id, turn, {words('target')} AS t, {words('predicted')} AS p FROM pairs),
      c AS (SELECT conv_id, turn, {d.size('t')} AS nt, {d.size('p')} AS np, {d.size(d.both('t', 'p'))} AS hit FROM s)
      SELECT conv_id, turn, round(CASE WHEN np = 0 THEN CASE WHEN nt = 0 THEN 1.0 ELSE 0.0 END ELSE CAST(hit AS DOUBLE) / np END, 9) AS prec, round(CASE WHEN nt = 0 THEN 1.0 ELSE CAST(hit AS DOUBLE) / nt END, 9) AS rec,
             round(CASE WHEN nt + np = 0 THEN 1.0 ELSE 2.0 * hit / (nt + np) END, 9) AS f1, nt = hit AND np = hit AS exact_match FROM c"""


def multiset_f1(d):
    """Multiset intersection by counts."""
    return f"""WITH {_TURNS}, t AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, {d.explode(d.words('target'))} AS w FROM pairs) GROUP BY conv_id, turn, w),
      p AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, {d.explode(d.words('predicted'))} AS w FROM pairs) GROUP BY conv_id, turn, w),
      hit AS (SELECT t.conv_id, t.turn, sum(least(t.n, p.n)) AS h FROM t JOIN p ON t.conv_id = p.conv_id AND t.turn = p.turn AND t.w = p.w GROUP BY t.conv_id, t.turn),
      size_ AS (SELECT conv_id, turn, {d.size(d.words('target'))} AS nt, {d.size(d.words('predicted'))} AS np FROM pairs)
      SELECT s.conv_id, s.turn, CAST(coalesce(h, 0) AS BIGINT) AS hits, round(CASE WHEN nt + np = 0 THEN 1.0 ELSE 2.0 * coalesce(h, 0) / (nt + np) END, 9) AS f1 FROM size_ s LEFT JOIN hit ON s.conv_id = hit.conv_id AND s.turn = hit.turn"""


def stepwise_score(d):
    """Positional pairing of steps; the denominator is the longer side."""
    return f"""WITH {_TURNS}, w AS (SELECT conv_id, turn, {d.words('target')} AS t, {d.words('predicted')} AS p FROM pairs),
      e AS (SELECT conv_id, turn, t, p, {d.explode(d.series(1, 'greatest(' + d.size('t') + ', ' + d.size('p') + ', 1)'))} AS i FROM w)
      SELECT conv_id, turn, CAST(sum(CASE WHEN i <= {d.size('t')} AND i <= {d.size('p')} AND substr({d.at('t', 'CAST(least(i, ' + d.size('t') + ') AS INT)')}, 1, 1) = substr({d.at('p', 'CAST(least(i, ' + d.size('p') + ') AS INT)')}, 1, 1) THEN 1 ELSE 0 END) AS BIGINT) AS hits,
             CAST(max(greatest({d.size('t')}, {d.size('p')}, 1)) AS BIGINT) AS steps FROM e WHERE {d.size('t')} > 0 AND {d.size('p')} > 0 GROUP BY conv_id, turn"""


def reference_sets(d):
    return f"SELECT p_brand, count(DISTINCT p_type) AS n_types, {d.joined('p_type', 'p_type', '|')} AS types FROM (SELECT DISTINCT p_brand, p_type FROM @part) GROUP BY p_brand"


_ENRICH = """part_of AS (SELECT DISTINCT p_brand AS q, p_type AS e FROM @part WHERE p_size <= 25), ref AS (SELECT DISTINCT concat('S', CAST(p_size AS STRING)) AS s, p_type AS e FROM @part),
      universe AS (SELECT count(DISTINCT e) AS big_n FROM ref), qn AS (SELECT q, count(*) AS n FROM part_of GROUP BY q), sk AS (SELECT s, count(*) AS k FROM ref GROUP BY s),
      ov AS (SELECT q, s, count(*) AS x FROM part_of p JOIN ref r ON p.e = r.e GROUP BY q, s),
      cell AS (SELECT qn.q, sk.s, big_n, n, k, x FROM ov JOIN qn ON ov.q = qn.q JOIN sk ON ov.s = sk.s CROSS JOIN universe)"""


def _log_comb(d):
    """log n! for n up to the size of the universe, by a running sum of logarithms."""
    return f"""lf AS (SELECT CAST(i AS BIGINT) AS i, CASE WHEN i = 0 THEN 0.0 ELSE sum(CASE WHEN i = 0 THEN 0.0 ELSE ln(CAST(i AS DOUBLE)) END) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) END AS f FROM (SELECT {d.explode(d.series(0, 'big_n'))} AS i FROM universe) z)"""


def _enriched(d):
    """Every query against every reference set, one that shares nothing with it at p = 1; the correction counts all sets.

    Tails are computed for the pairs that overlap only; all pairs are rows of the result.
    """
    return f"""{_ENRICH}, {_log_comb(d)},
      tail AS (SELECT q, s, big_n, n, k, x, {d.explode(d.series('x', 'least(n, k)'))} AS j FROM cell),
      term AS (SELECT t.q, t.s, t.x, a.f - b.f - c.f + e.f - g.f - h.f - (o.f - p.f - r.f) AS lp FROM tail t JOIN lf a ON a.i = t.k JOIN lf b ON b.i = t.j JOIN lf c ON c.i = t.k - t.j
               JOIN lf e ON e.i = t.big_n - t.k JOIN lf g ON g.i = t.n - t.j JOIN lf h ON h.i = t.big_n - t.k - t.n + t.j JOIN lf o ON o.i = t.big_n JOIN lf p ON p.i = t.n JOIN lf r ON r.i = t.big_n - t.n),
      hit AS (SELECT q, s, x, round(least(1.0, sum(exp(lp))), 9) AS p FROM term GROUP BY q, s, x),
      pv AS (SELECT qn.q, sk.s, coalesce(hit.x, 0) AS x, coalesce(hit.p, 1.0) AS p FROM qn CROSS JOIN sk LEFT JOIN hit ON hit.q = qn.q AND hit.s = sk.s),
      ranked AS (SELECT q, s, x, p, row_number() OVER (PARTITION BY q ORDER BY p, s) AS r, count(*) OVER (PARTITION BY q) AS m FROM pv),
      bh AS (SELECT q, s, x, p, round(least(1.0, min(p * m / r) OVER (PARTITION BY q ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 8) AS fdr FROM ranked)"""


def enrichment_bh(d):
    """Hypergeometric upper tail by log-factorials, corrected over all reference sets by a running reverse minimum."""
    return f"WITH {_enriched(d)} SELECT q, s, CAST(x AS BIGINT) AS x, round(p, 7) AS p, round(fdr, 7) AS fdr FROM bh"


def retrieval_rank(d):
    """Place of each query's true set among all sets by corrected p, p and name: hits and reciprocal rank."""
    return f"""WITH {_enriched(d)}, rk AS (SELECT q, s, row_number() OVER (PARTITION BY q ORDER BY fdr, p, s) AS r FROM bh), truth AS (SELECT q, min(s) AS s FROM bh WHERE x > 0 GROUP BY q)
      SELECT t.q, CAST(rk.r AS BIGINT) AS place, rk.r <= 1 AS hit1, rk.r <= 3 AS hit3, rk.r <= 5 AS hit5, round(1.0 / rk.r, 9) AS reciprocal FROM truth t JOIN rk ON t.q = rk.q AND t.s = rk.s"""


#: Written apart from the queries: gamma functions in place of a table, each set's correction by a search over the sets no better than it.
_ENRICH_ORACLE = """WITH mine AS (SELECT p_brand AS q, list(DISTINCT p_type) AS own FROM part WHERE p_size <= 25 GROUP BY p_brand),
  sets AS (SELECT 'S' || p_size AS s, list(DISTINCT p_type) AS own FROM part GROUP BY p_size),
  total AS (SELECT count(DISTINCT p_type)::DOUBLE AS t FROM part),
  every AS (SELECT q, s, len(list_intersect(mine.own, sets.own)) AS x, len(mine.own) AS n, len(sets.own) AS k, t FROM mine, sets, total),
  p AS (SELECT q, s, x, CASE WHEN x = 0 THEN 1.0 ELSE round(least(1.0, list_sum(list_transform(range(greatest(x, n - (t - k)::BIGINT, 0), least(n, k) + 1), lambda j:
      exp(lgamma(k + 1) - lgamma(j + 1) - lgamma(k - j + 1) + lgamma(t - k + 1) - lgamma(n - j + 1) - lgamma(t - k - n + j + 1) - lgamma(t + 1) + lgamma(n + 1) + lgamma(t - n + 1))))), 9) END AS p FROM every),
  above AS (SELECT a.q, a.s, a.x, a.p, count(b.s) AS upto FROM p a JOIN p b ON a.q = b.q AND b.p <= a.p GROUP BY a.q, a.s, a.x, a.p),
  fdr AS (SELECT a.q, a.s, a.x, a.p, round(least(1.0, min(b.p * (SELECT count(*) FROM sets) / b.upto)), 8) AS fdr FROM above a JOIN above b ON a.q = b.q AND b.p >= a.p GROUP BY a.q, a.s, a.x, a.p)"""


def candidate_rerank(d):
    """Candidates of a case by score, ties by input place: top, reciprocal rank, share of negatives below the gold one."""
    return """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / l_quantity AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS place FROM @lineitem),
      g AS (SELECT l_orderkey, score AS gold, place AS gold_place FROM c WHERE place = 1), n AS (SELECT l_orderkey, count(*) AS size_ FROM c GROUP BY l_orderkey)
      SELECT c.l_orderkey, CAST(1 + sum(CASE WHEN c.score > g.gold THEN 1 ELSE 0 END) AS BIGINT) AS gold_rank, round(avg(CASE WHEN c.place > 1 THEN CASE WHEN g.gold > c.score THEN 1.0 ELSE 0.0 END END), 9) AS rejection, max(n.size_) AS size_
      FROM c JOIN g ON c.l_orderkey = g.l_orderkey JOIN n ON c.l_orderkey = n.l_orderkey GROUP BY c.l_orderkey"""


def calibrated_rerank(d):
    """Linear score of standardised features with fixed weights, means by kind of negative."""
    return """WITH s AS (SELECT l_orderkey, l_returnflag AS kind, 0.7 * (l_quantity - 25) / 14 - 0.2 * (l_discount - 0.05) / 0.03 + 0.1 * (l_tax - 0.04) / 0.02 AS z FROM @lineitem), g AS (SELECT l_orderkey, max(z) AS top FROM s GROUP BY l_orderkey)
      SELECT kind, count(*) AS n, round(avg(z), 8) AS mean_z, round(avg(CASE WHEN z = top THEN 1.0 ELSE 0.0 END), 9) AS top1 FROM s JOIN g ON s.l_orderkey = g.l_orderkey GROUP BY kind"""


def best_of_candidates(d):
    """Argmin of a loss over candidate columns turned to rows."""
    return """WITH u AS (SELECT o_orderkey, 'half' AS candidate, abs(o_totalprice / 2 - 50000) AS loss FROM @orders UNION ALL SELECT o_orderkey, 'same', abs(o_totalprice - 50000) FROM @orders UNION ALL SELECT o_orderkey, 'twice', abs(o_totalprice * 2 - 50000) FROM @orders)
      SELECT o_orderkey, candidate, round(loss, 4) AS loss FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY loss, candidate) AS r FROM u) WHERE r = 1"""


_ROLES = """st AS (SELECT l_orderkey AS case_id, CASE l_returnflag WHEN 'N' THEN 'wt' WHEN 'R' THEN 'ko' ELSE 'rescue' END AS role, round(avg(l_discount * 10), 9) AS prob, max(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS gold FROM @lineitem GROUP BY l_orderkey, CASE l_returnflag WHEN 'N' THEN 'wt' WHEN 'R' THEN 'ko' ELSE 'rescue' END)"""


def ko_rescue(d):
    """Wild type, knock-out and rescue of a case: recovery, effect sign, Brier score, survival ratio."""
    return f"""WITH {_ROLES} SELECT k.case_id, round(CASE WHEN w.prob - k.prob = 0 THEN NULL ELSE (r.prob - k.prob) / (w.prob - k.prob) END + 0.0, 7) AS recovery, CAST(sign(round(k.prob - w.prob, 9)) AS BIGINT) AS effect,
      round(power(k.prob - k.gold, 2), 9) AS brier, (k.prob >= 0.5) = (k.gold = 1) AS endpoint_ok, round(k.prob / greatest(w.prob, 0.000001), 6) AS survival
      FROM st k JOIN st w ON k.case_id = w.case_id AND w.role = 'wt' LEFT JOIN st r ON k.case_id = r.case_id AND r.role = 'rescue' WHERE k.role = 'ko'"""


def rescue_rank(d):
    """Best rank of a positive line in its order."""
    return """WITH r AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_partkey, l_suppkey, l_linenumber, l_quantity) AS r FROM @lineitem)
      SELECT l_orderkey, CAST(min(CASE WHEN l_quantity > 25 THEN r END) AS BIGINT) AS best, round(1.0 / min(CASE WHEN l_quantity > 25 THEN r END), 9) AS reciprocal FROM r GROUP BY l_orderkey"""


def conditional_minima(d):
    """Whether the smallest value of the large rows lies below that of the single ones."""
    return """SELECT l_suppkey, min(CASE WHEN l_linenumber = 1 THEN l_extendedprice END) AS single_low, min(CASE WHEN l_linenumber >= 2 THEN l_extendedprice END) AS double_low,
      min(CASE WHEN l_linenumber >= 2 THEN l_extendedprice END) < min(CASE WHEN l_linenumber = 1 THEN l_extendedprice END) AS beats FROM @lineitem GROUP BY l_suppkey"""


def js_divergence(d):
    """Base-2 divergence of normalised histograms of each supplier and of all."""
    return """WITH h AS (SELECT l_suppkey, l_linenumber AS b, count(*) AS n FROM @lineitem GROUP BY l_suppkey, l_linenumber), t AS (SELECT b, sum(n) AS n FROM h GROUP BY b), keys AS (SELECT s.l_suppkey, t.b, t.n AS tn FROM (SELECT DISTINCT l_suppkey FROM h) s JOIN t ON true),
      p AS (SELECT k.l_suppkey, k.b, CAST(coalesce(h.n, 0) AS DOUBLE) / sum(coalesce(h.n, 0)) OVER (PARTITION BY k.l_suppkey) AS p, CAST(k.tn AS DOUBLE) / sum(k.tn) OVER (PARTITION BY k.l_suppkey) AS q FROM keys k LEFT JOIN h ON k.l_suppkey = h.l_suppkey AND k.b = h.b)
      SELECT l_suppkey, round(0.5 * sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) / ln(2.0) ELSE 0.0 END) + 0.5 * sum(CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) / ln(2.0) ELSE 0.0 END), 8) AS jsd FROM p GROUP BY l_suppkey"""


def _dims(d, limit=""):
    return f"dims AS (SELECT vec_id, label, i, CAST({d.at('embedding', 'CAST(i AS INT)')} AS DOUBLE) AS x FROM (SELECT vec_id, label, embedding, {d.explode(d.places('embedding'))} AS i FROM @embeddings){limit})"


def cosine_pairs(d):
    """Cosine of consecutive vectors with a floor under the norms, and their distance."""
    return f"""WITH {_dims(d)}, c AS (SELECT a.vec_id, sum(a.x * b.x) AS dot, sqrt(sum(a.x * a.x)) AS na, sqrt(sum(b.x * b.x)) AS nb, sum((a.x - b.x) * (a.x - b.x)) AS d2 FROM dims a JOIN dims b ON b.vec_id = a.vec_id + 1 AND a.i = b.i GROUP BY a.vec_id)
      SELECT vec_id, round(dot / (greatest(na, 1e-12) * greatest(nb, 1e-12)), 7) AS cosine, round(sqrt(d2), 7) AS distance FROM c"""


def mse_points(d):
    """Mean squared error of each point against its successor, and by label."""
    return f"""WITH {_dims(d)} SELECT a.label, round(avg((a.x - b.x) * (a.x - b.x)), 8) AS mse, count(DISTINCT a.vec_id) AS n FROM dims a JOIN dims b ON b.vec_id = a.vec_id + 1 AND a.i = b.i GROUP BY a.label"""


def horizon_metrics(d):
    """Error by horizon: vectors one to three ahead."""
    return f"""WITH {_dims(d)}, k AS (SELECT vec_id, i, x, {d.explode(d.series(1, 3))} AS ahead FROM dims), h AS (SELECT CAST(k.ahead AS BIGINT) AS ahead, k.vec_id, avg((k.x - b.x) * (k.x - b.x)) AS mse FROM k JOIN dims b ON b.vec_id = k.vec_id + k.ahead AND k.i = b.i GROUP BY CAST(k.ahead AS BIGINT), k.vec_id)
      SELECT ahead, count(*) AS n, round(avg(mse), 8) AS mse FROM h GROUP BY ahead"""


def pearson_spearman(d):
    """Correlations of price and quantity per supplier; ranks of ties averaged; 0 where undefined."""
    return """WITH r AS (SELECT l_suppkey, l_quantity AS x, l_extendedprice AS y, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0 AS rx,
        rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_suppkey, l_extendedprice) - 1) / 2.0 AS ry FROM @lineitem)
      SELECT l_suppkey, round(coalesce(corr(x, y), 0), 7) AS pearson, round(coalesce(corr(CAST(rx AS DOUBLE), CAST(ry AS DOUBLE)), 0), 7) AS spearman FROM r GROUP BY l_suppkey"""


def topk_delta_corr(d):
    """Correlation over the 20 dimensions that differ most from the next vector."""
    return f"""WITH {_dims(d)}, m AS (SELECT a.vec_id, a.i, a.x, b.x AS y, row_number() OVER (PARTITION BY a.vec_id ORDER BY abs(a.x - b.x) DESC, a.i) AS r FROM dims a JOIN dims b ON b.vec_id = a.vec_id + 1 AND a.i = b.i)
      SELECT vec_id, round(coalesce(corr(x, y), 0), 6) AS r20 FROM m WHERE r <= 20 GROUP BY vec_id"""


def paired_win_rate(d):
    """Share of customers whose first order beats their second, by position."""
    return """WITH o AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM @orders)
      SELECT count(*) AS n, CAST(sum(CASE WHEN a.o_totalprice > b.o_totalprice THEN 1 ELSE 0 END) AS BIGINT) AS wins, round(avg(a.o_totalprice - b.o_totalprice), 4) AS gain FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.r = 1 AND b.r = 2"""


def latent_geometry(d):
    """Mean square, variance around one and off-diagonal covariance of dimensions."""
    return f"""WITH {_dims(d)}, few AS (SELECT vec_id, i, x FROM dims), one AS (SELECT avg(m * m) AS mean_sq, avg((v - 1) * (v - 1)) AS var_gap FROM (SELECT i, avg(x) AS m, var_pop(x) AS v FROM few GROUP BY i)),
      off AS (SELECT avg(c * c) AS off_sq FROM (SELECT a.i, b.i AS j, covar_samp(a.x, b.x) AS c FROM few a JOIN few b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY a.i, b.i)) SELECT round(mean_sq, 8) AS mean_sq, round(var_gap, 8) AS var_gap, round(off_sq, 9) AS off_sq FROM one, off"""


def layer_mean_pool(d):
    return f"WITH {_dims(d)} SELECT label, CAST(i AS BIGINT) AS i, round(avg(x), 8) AS pooled FROM dims GROUP BY label, i"


def linspace_downsample(d):
    """At most five points of a trajectory, evenly spaced, half rounded to even."""
    return f"""WITH n AS (SELECT user_id, count(*) AS n FROM @events GROUP BY user_id), w AS (SELECT user_id, n, {d.explode(d.series(0, 4))} AS j FROM n), place AS (SELECT DISTINCT user_id, CAST(CASE WHEN n <= 5 THEN j ELSE {d.half_even('j * (n - 1) / 4.0')} END AS BIGINT) AS pos FROM w WHERE n > 5 OR j < n),
      e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM @events) SELECT e.user_id, e.event_id, place.pos FROM place JOIN e ON place.user_id = e.user_id AND place.pos = e.pos"""


def trajectory_slice(d):
    """Points from the last prompt point on, short ones dropped, and the mean of the prompt."""
    return """WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM @events)
      SELECT user_id, round(avg(CASE WHEN pos <= 3 THEN value END), 8) AS control, count(CASE WHEN pos BETWEEN 3 AND 7 THEN 1 END) AS points, round(max(CASE WHEN pos = 3 THEN value END), 8) AS start_value FROM e WHERE n >= 4 GROUP BY user_id"""


def pad_trajectory(d):
    """Lengths before and after zero padding, and the last nonzero place."""
    return """WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM @events), m AS (SELECT max(pos) AS longest FROM e)
      SELECT user_id, count(*) AS length_, CAST(max(longest) - count(*) AS BIGINT) AS padding, CAST(max(CASE WHEN value <> 0 THEN pos END) AS BIGINT) AS stripped FROM e, m GROUP BY user_id"""


def velocity(d):
    return """SELECT event_id, round(lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) - value, 8) AS step FROM @events"""


def gaps_islands_layers(d):
    """A new layer where the type changes: flag, running sum, runs."""
    return """WITH f AS (SELECT user_id, ts, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS new_ FROM @events),
      g AS (SELECT *, sum(new_) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS layer FROM f) SELECT user_id, CAST(layer AS BIGINT) AS layer, min(event_type) AS kind, count(*) AS n FROM g GROUP BY user_id, layer"""


def multiscale_time(d):
    """Cumulative time: a long step where the layer changes, a short one inside."""
    return """SELECT event_id, round(sum(CASE WHEN event_type = p THEN CAST(0.1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS t FROM (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM @events)"""


def capped_flatten(d):
    """At most five events a user, the true number kept."""
    return "SELECT user_id, event_id, n FROM (SELECT user_id, event_id, CAST(count(*) OVER (PARTITION BY user_id) AS BIGINT) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM @events) WHERE r <= 5"


def early_stop_trace(d):
    """Best so far, steps without improvement, and where patience would end."""
    return f"""WITH e AS (SELECT {d.days('ts')} AS day_, round(avg(value), 9) AS loss FROM @events GROUP BY {d.days('ts')}), b AS (SELECT day_, loss, row_number() OVER (ORDER BY day_) AS i, min(loss) OVER (ORDER BY day_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM e),
      m AS (SELECT *, max(CASE WHEN best IS NULL OR loss < best THEN i END) OVER (ORDER BY day_ ROWS UNBOUNDED PRECEDING) AS last_better FROM b) SELECT CAST(i AS BIGINT) AS epoch, round(loss, 7) AS loss, CAST(i - last_better AS BIGINT) AS waited, i - last_better >= 3 AS stop FROM m"""


def stability_gate(d):
    """First, best and last of a history, relative gain and regression, and the decision."""
    return f"""WITH e AS (SELECT {d.days('ts')} AS day_, avg(value) AS loss FROM @events GROUP BY {d.days('ts')}), r AS (SELECT loss, row_number() OVER (ORDER BY day_) AS i, row_number() OVER (ORDER BY day_ DESC) AS j FROM e)
      SELECT round(max(CASE WHEN i = 1 THEN loss END), 7) AS first_loss, round(min(loss), 7) AS best, round(max(CASE WHEN j = 1 THEN loss END), 7) AS last_loss, round((max(CASE WHEN i = 1 THEN loss END) - min(loss)) / max(CASE WHEN i = 1 THEN loss END), 6) AS gain,
             max(CASE WHEN j = 1 THEN loss END) <= min(loss) * 1.05 AS stable FROM r"""


def qa_by_tag(d):
    """Accuracy by tag, a row counted under each of its tags."""
    return f"""WITH t AS (SELECT x.doc_id, {d.explode(d.array('x.lang', 'x.source'))} AS tag, l.quality FROM @documents x JOIN @labels l ON x.doc_id = l.doc_id) SELECT tag, count(*) AS n, round(avg(CAST(quality AS DOUBLE)), 9) AS accuracy FROM t GROUP BY tag"""


def cell_sentence_eval(d):
    """Rank agreement of shared tokens of neighbouring turns."""
    return f"""WITH {_TURNS}, t AS (SELECT conv_id, turn, w, min(i) AS i FROM (SELECT conv_id, turn, {d.at('ws', 'CAST(i AS INT)')} AS w, i FROM (SELECT conv_id, turn, ws, {d.explode(d.series(1, d.size('ws')))} AS i FROM (SELECT conv_id, turn, {d.words('target')} AS ws FROM pairs) WHERE {d.size('ws')} > 0)) GROUP BY conv_id, turn, w),
      p AS (SELECT conv_id, turn, w, min(i) AS i FROM (SELECT conv_id, turn, {d.at('ws', 'CAST(i AS INT)')} AS w, i FROM (SELECT conv_id, turn, ws, {d.explode(d.series(1, d.size('ws')))} AS i FROM (SELECT conv_id, turn, {d.words('predicted')} AS ws FROM pairs) WHERE {d.size('ws')} > 0)) GROUP BY conv_id, turn, w)
      SELECT t.conv_id, t.turn, count(*) AS shared, round(coalesce(CASE WHEN count(*) > 2 THEN corr(CAST(t.i AS DOUBLE), CAST(p.i AS DOUBLE)) END, 0), 6) AS r FROM t JOIN p ON t.conv_id = p.conv_id AND t.turn = p.turn AND t.w = p.w GROUP BY t.conv_id, t.turn"""


def counterfactual_metrics(d):
    """Control deltas of vectors, endpoint distance and effect norm by label."""
    return f"""WITH {_dims(d)}, c AS (SELECT i, avg(x) AS m FROM dims WHERE label = 0 GROUP BY i), n AS (SELECT dims.vec_id, dims.label, sqrt(sum((dims.x - c.m) * (dims.x - c.m))) AS effect FROM dims JOIN c ON dims.i = c.i GROUP BY dims.vec_id, dims.label)
      SELECT label, round(avg(effect), 7) AS mean_effect, round(max(effect), 7) AS top_effect FROM n GROUP BY label"""


def runtime_estimate(d):
    """Hours for a token budget at a rate, with the share of validation time."""
    return f"SELECT source, CAST(sum(n_chars) AS BIGINT) AS tokens, round(sum(n_chars) / 2418.9274 / 3600 * (1 + 0.2170807), 9) AS hours, sum(n_chars) / 2418.9274 / 3600 * 1.2170807 <= 48 AS fits FROM @documents GROUP BY source"


def squared_error_objective(d):
    """Weighted squared error of the splits' shares against 70/20/10."""
    return "WITH s AS (SELECT CAST(sum(CASE WHEN doc_id % 10 < 7 THEN n_chars ELSE 0 END) AS DOUBLE) / sum(n_chars) AS a, CAST(sum(CASE WHEN doc_id % 10 IN (7, 8) THEN n_chars ELSE 0 END) AS DOUBLE) / sum(n_chars) AS b, CAST(sum(CASE WHEN doc_id % 10 = 9 THEN n_chars ELSE 0 END) AS DOUBLE) / sum(n_chars) AS c FROM @documents) SELECT round((a - 0.7) * (a - 0.7) + (b - 0.2) * (b - 0.2) + (c - 0.1) * (c - 0.1), 10) AS objective FROM s"


def warmup_scale(d):
    return f"SELECT CAST(i AS BIGINT) AS step, round(CASE WHEN ceil(50 * 0.1) = 0 THEN 1.0 ELSE greatest(0.0, least(1.0, i / ceil(50 * 0.1))) END, 9) AS scale FROM (SELECT {d.explode(d.series(0, 50))} AS i) z"


def _paths(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value", "event_type"))).alias("e"))
    return rows.select("user_id", F.col("e.value").alias("value"), F.col("e.event_type").alias("kind"))


def _dtw(spark, sf_dir):
    rows = _paths(spark, sf_dir)
    other = rows.select((F.col("user_id") - 1).alias("user_id"), F.col("value").alias("other"))
    return sequences.dtw(rows.join(other, "user_id"), "value", "other").select("user_id", F.round("distance", 8).alias("distance"), "steps")


def _lcs(spark, sf_dir):
    rows = _paths(spark, sf_dir)
    other = rows.select((F.col("user_id") - 1).alias("user_id"), F.col("kind").alias("other"))
    return sequences.lcs(rows.join(other, "user_id"), "kind", "other").select("user_id", "lcs", "f1")


def _rollout(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return sequences.linear_rollout(vectors, "embedding", steps=3, decay=0.9).select("vec_id", F.round("drift", 6).alias("drift"))


_ROLLOUT_ORACLE = """SELECT vec_id, round(sqrt(list_sum(list_transform(generate_series(1, 64), lambda i: power(CAST(embedding[CAST((i + 2) % 64 + 1 AS INT)] AS DOUBLE) * CAST(0.9 AS DOUBLE) * CAST(0.9 AS DOUBLE) * CAST(0.9 AS DOUBLE) - CAST(embedding[CAST(i AS INT)] AS DOUBLE), 2)))), 6) AS drift
  FROM embeddings"""


def _shuffled(spark, sf_dir):
    return sequences.shuffled_negatives(table(spark, sf_dir, "conversations"), "conv_id", "turn", wanted=3)


def _vector_pairs(spark, sf_dir, steps=1):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return pairs_ahead(rows, "vec_id", "embedding", steps).withColumn("d2", squared_distance("x", "y"))


def _cosine_pairs(spark, sf_dir):
    pairs = _vector_pairs(spark, sf_dir)
    return pairs.select("vec_id", F.round(cosine("x", "y"), 7).alias("cosine"), F.round(F.sqrt("d2"), 7).alias("distance"))


def _mse_points(spark, sf_dir):
    return _vector_pairs(spark, sf_dir).groupBy("label").agg(F.round(F.sum("d2") / F.sum(F.size("x")), 8).alias("mse"), F.countDistinct("vec_id").alias("n"))


def _horizon_metrics(spark, sf_dir):
    return _vector_pairs(spark, sf_dir, 3).groupBy("ahead").agg(F.count("*").alias("n"), F.round(F.avg(F.col("d2") / F.size("x")), 8).alias("mse"))


QUERIES = relational(
    entity_prf, multiset_f1, stepwise_score, reference_sets, enrichment_bh, retrieval_rank, candidate_rerank, calibrated_rerank, best_of_candidates, ko_rescue, rescue_rank, conditional_minima, js_divergence,
    pearson_spearman, topk_delta_corr, paired_win_rate, latent_geometry, layer_mean_pool, linspace_downsample, trajectory_slice, pad_trajectory, velocity, gaps_islands_layers,
    multiscale_time, capped_flatten, early_stop_trace, stability_gate, qa_by_tag, cell_sentence_eval, counterfactual_metrics, runtime_estimate, squared_error_objective, warmup_scale,
) | {
    "cosine_pairs": (_cosine_pairs, on_oracle(cosine_pairs(ORACLE))), "mse_points": (_mse_points, on_oracle(mse_points(ORACLE))), "horizon_metrics": (_horizon_metrics, on_oracle(horizon_metrics(ORACLE))),
} | {"dtw_distance": (_dtw, None), "lcs_length": (_lcs, None), "linear_rollout": (_rollout, _ROLLOUT_ORACLE), "shuffled_negatives": (_shuffled, None)}

QUERIES["enrichment_bh"] = (QUERIES["enrichment_bh"][0], _ENRICH_ORACLE + " SELECT q, s, x::BIGINT AS x, round(p, 7) AS p, round(fdr, 7) AS fdr FROM fdr")
QUERIES["retrieval_rank"] = (
    QUERIES["retrieval_rank"][0],
    _ENRICH_ORACLE
    + """, truth AS (SELECT q, min(s) AS s FROM fdr WHERE x > 0 GROUP BY q),
  found AS (SELECT t.q, (1 + count(o.s))::BIGINT AS place FROM truth t JOIN fdr f ON f.q = t.q AND f.s = t.s LEFT JOIN fdr o ON o.q = t.q AND (o.fdr, o.p, o.s) < (f.fdr, f.p, f.s) GROUP BY t.q)
  SELECT q, place, place <= 1 AS hit1, place <= 3 AS hit3, place <= 5 AS hit5, round(1.0 / place, 9) AS reciprocal FROM found""",
)
