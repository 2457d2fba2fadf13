"""Orders, caps, prefixes and budgets: windows in place of hand-written scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dialect import ORACLE, on_oracle, relational
from ..operators.budget import greedy_fill
from ..operators.ranking import firsts, interleave, marked_firsts, place_in_order, running_totals, tiered_order
from ..sources.tables import table

_BINS = "CASE WHEN n_chars < 200 THEN '02-04' WHEN n_chars < 600 THEN '05-08' WHEN n_chars < 1500 THEN '09-16' WHEN n_chars < 4000 THEN '17-32' ELSE '33+' END"


def _ranked(d):
    return f"ranked AS (SELECT doc_id, source, lang, source || '/' || lang AS graph, n_chars, {_BINS} AS bin, {d.sha("'order:17:' || CAST(doc_id AS STRING)")} AS rk FROM @documents)"


def candidate_order(d):
    """Tiers: first of each organism, the priority organism, first of each graph, the rest; each record once."""
    return f"""WITH {_ranked(d)}, t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY rk, doc_id) AS ro, row_number() OVER (PARTITION BY graph ORDER BY rk, doc_id) AS rg FROM ranked),
      tiers AS (SELECT doc_id, source, rk, CASE WHEN ro = 1 THEN 0 WHEN lang = 'de' THEN 1 WHEN rg = 1 THEN 2 ELSE 3 END AS tier FROM t)
      SELECT doc_id, CAST(tier AS BIGINT) AS tier, CAST(row_number() OVER (PARTITION BY source ORDER BY tier, rk, doc_id) AS BIGINT) AS pos FROM tiers"""


def first_per_key(d):
    return f"WITH {_ranked(d)} SELECT lang, doc_id, rk FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY rk, doc_id) AS r FROM ranked) WHERE r = 1"


def length_bins(d):
    return f"SELECT {_BINS} AS bin, count(*) AS n, min(n_chars) AS low, max(n_chars) AS high FROM @documents GROUP BY {_BINS}"


def length_round_robin(d):
    """Interleave the length bins of a source: position first, then bin."""
    return f"""WITH {_ranked(d)}, p AS (SELECT *, row_number() OVER (PARTITION BY source, bin ORDER BY rk, doc_id) AS pos FROM ranked)
      SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY pos, bin) AS BIGINT) AS place FROM p"""


def diversity_order(d):
    """First the best record of each organism, then the others; each block interleaved by length."""
    return f"""WITH {_ranked(d)}, b AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY source, lang ORDER BY rk, doc_id) = 1 THEN 0 ELSE 1 END AS block FROM ranked),
      p AS (SELECT *, row_number() OVER (PARTITION BY source, block, bin ORDER BY rk, doc_id) AS pos FROM b)
      SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY block, pos, bin) AS BIGINT) AS place FROM p"""


def graph_round_robin(d):
    """All first views of the graphs before any second view."""
    return f"""WITH {_ranked(d)}, v AS (SELECT *, row_number() OVER (PARTITION BY graph ORDER BY rk, doc_id) AS view_idx FROM ranked),
      p AS (SELECT *, row_number() OVER (PARTITION BY source, view_idx, bin ORDER BY rk, doc_id) AS pos FROM v)
      SELECT doc_id, source, CAST(view_idx AS BIGINT) AS view_idx, CAST(row_number() OVER (PARTITION BY source ORDER BY view_idx, pos, bin) AS BIGINT) AS place FROM p"""


def organism_round_robin(d):
    """Queue position across organisms, then length bins."""
    return f"""WITH {_ranked(d)}, q AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY rk, doc_id) AS qpos FROM ranked),
      p AS (SELECT *, row_number() OVER (PARTITION BY source, qpos, bin ORDER BY rk, doc_id) AS pos FROM q)
      SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY qpos, pos, bin) AS BIGINT) AS place FROM p"""


def family_cap_topk(d):
    """At most eight records a family, and whether they are in the nested cap of four."""
    return f"""WITH {_ranked(d)} SELECT doc_id, source, pos, pos <= 4 AS in_smaller_cap FROM (
      SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY rk, doc_id) AS BIGINT) AS pos FROM ranked) WHERE pos <= 8"""


def coverage_summary(d):
    """An aggregate of aggregates over the capped families."""
    return f"""WITH {_ranked(d)}, k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rk, doc_id) AS pos FROM ranked), c AS (SELECT source, count(*) AS n, count(DISTINCT lang) AS langs, count(DISTINCT bin) AS bins FROM k WHERE pos <= 8 GROUP BY source)
      SELECT count(*) AS families, CAST(sum(n) AS BIGINT) AS records, min(n) AS low, max(n) AS high, min(langs) AS min_langs, max(bins) AS max_bins FROM c"""


_LAYERS = "layers AS (SELECT conv_id, count(*) AS n FROM @conversations GROUP BY conv_id)"


def prefix_choices(d):
    """One to three prefixes per record: short only for two layers, else long and short, from four on long, middle, short."""
    return f"""WITH {_LAYERS} SELECT conv_id, horizon, prefix FROM (
      SELECT conv_id, n, 'long_target' AS horizon, CAST(1 AS BIGINT) AS prefix FROM layers WHERE n >= 3 UNION ALL
      SELECT conv_id, n, 'middle_target', CAST(floor((n + 1) / 2) AS BIGINT) FROM layers WHERE n >= 4 UNION ALL
      SELECT conv_id, n, 'short_target', n - 1 FROM layers WHERE n >= 2)"""


def even_prefixes(d):
    """Of the prefix lengths 1 to n - 1 all, or three evenly spaced ones, rounded half to even."""
    return f"""WITH {_LAYERS}, few AS (SELECT conv_id, {d.explode(d.series(1, 'n - 1'))} AS prefix FROM layers WHERE n BETWEEN 2 AND 4),
      e AS (SELECT conv_id, n, {d.explode(d.series(0, 2))} AS pos FROM layers WHERE n > 4)
      SELECT conv_id, CAST(prefix AS BIGINT) AS prefix FROM few UNION ALL SELECT conv_id, CAST(1 + {d.half_even('pos * (n - 2) / 2.0')} AS BIGINT) FROM e"""


#: Written apart from the query: first, last and the middle, whose half goes to the even neighbour; all three differ from five layers on.
_EVEN_ORACLE = """WITH layers AS (SELECT conv_id, count(*)::BIGINT AS n FROM conversations GROUP BY conv_id),
  k AS (SELECT conv_id, n, n - 2 AS top FROM layers)
SELECT conv_id, p AS prefix FROM k, range(1, 4) r(p) WHERE n <= 4 AND p < n
UNION ALL SELECT conv_id, 1::BIGINT FROM k WHERE n > 4
UNION ALL SELECT conv_id, 1 + CASE WHEN top % 2 = 0 THEN top // 2 WHEN (top // 2) % 2 = 0 THEN top // 2 ELSE top // 2 + 1 END FROM k WHERE n > 4
UNION ALL SELECT conv_id, n - 1 FROM k WHERE n > 4"""


def all_prefixes(d):
    return f"""WITH {_LAYERS}, e AS (SELECT conv_id, n, {d.explode(d.series(1, 'n - 1'))} AS prefix FROM layers WHERE n > 1)
      SELECT conv_id, CAST(prefix AS BIGINT) AS prefix, n - prefix AS target FROM e"""


def horizon_label(d):
    """Label of a prefix by its place in the record, as an audit derives it."""
    return f"""WITH {_LAYERS}, e AS (SELECT conv_id, n, {d.explode(d.series(1, 'n - 1'))} AS prefix FROM layers WHERE n > 1)
      SELECT conv_id, CAST(prefix AS BIGINT) AS prefix, CASE WHEN n = 2 THEN 'degenerate_target' WHEN prefix = 1 THEN 'long_target' WHEN prefix = n - 1 THEN 'short_target'
        WHEN prefix = floor((n + 1) / 2) THEN 'middle_target' ELSE 'other' END AS horizon FROM e"""


def epoch_prefix_view(d):
    """One prefix a record and epoch: the schedule entry (epoch - 1 + offset of the record) mod its length, else by position."""
    return f"""WITH rows_ AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
        CAST({d.hex_number(f"substr({d.sha('CAST(conv_id AS STRING)')}, 1, 16)")} % 3 AS BIGINT) AS off FROM @conversations),
      wish AS (SELECT *, CASE (2 + off) % 3 WHEN 0 THEN 1 WHEN 1 THEN floor((n - 1) / 2) + 1 ELSE n END AS want FROM rows_)
      SELECT conv_id, turn, CASE (2 + off) % 3 WHEN 0 THEN 'long' WHEN 1 THEN 'middle' ELSE 'short' END AS horizon FROM wish WHERE pos = want"""


def budget_prefix_sum(d):
    """The plain cut: records in order while the running sum stays within the budget of their source."""
    return f"""WITH {_ranked(d)}, s AS (SELECT doc_id, source, n_chars, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY rk, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM ranked)
      SELECT doc_id, source, upto FROM s WHERE upto <= 20000"""


def _greedy(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.sha2(F.concat(F.lit("order:17:"), F.col("doc_id").cast("string")), 256).alias("rk"))
    return greedy_fill(rows, "source", ["rk", "doc_id"], "n_chars", 20000).where("accepted").select("doc_id", "source", F.col("running").alias("upto"))


_GREEDY_ORACLE = """WITH RECURSIVE r AS (
    SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY sha256('order:17:' || doc_id::VARCHAR), doc_id) AS i FROM documents),
  g AS (
    SELECT source, i, doc_id, CASE WHEN n_chars <= 20000 THEN n_chars ELSE 0 END AS upto, n_chars <= 20000 AS ok FROM r WHERE i = 1
    UNION ALL
    SELECT r.source, r.i, r.doc_id, CASE WHEN g.upto + r.n_chars <= 20000 THEN g.upto + r.n_chars ELSE g.upto END, g.upto + r.n_chars <= 20000 FROM g JOIN r ON r.source = g.source AND r.i = g.i + 1)
  SELECT doc_id, source, upto::BIGINT AS upto FROM g WHERE ok"""


def head_sample(d):
    return "SELECT o_orderkey, o_totalprice FROM @orders ORDER BY o_orderkey LIMIT 50"


def event_sort_key(d):
    """Deterministic event order: smallest part, smallest supplier, line."""
    return """SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS BIGINT) AS place FROM @lineitem"""


def length_grouped_batches(d):
    """By length in chunks of 32 per language, padded by the first rows; the chunks in seeded hash order."""
    return f"""WITH r AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM @documents),
      padded AS (SELECT doc_id, lang, n_chars, i FROM r UNION ALL SELECT doc_id, lang, n_chars, i + n FROM r WHERE n % 32 <> 0 AND i < 32 - n % 32),
      c AS (SELECT lang, CAST(floor(i / 32) AS BIGINT) AS chunk, count(*) AS rows_, CAST(sum(n_chars) AS BIGINT) AS chars, max(n_chars) AS longest, {d.sha("'chunk:3:' || lang || ':' || CAST(CAST(floor(i / 32) AS BIGINT) AS STRING)")} AS h FROM padded
            GROUP BY lang, CAST(floor(i / 32) AS BIGINT), {d.sha("'chunk:3:' || lang || ':' || CAST(CAST(floor(i / 32) AS BIGINT) AS STRING)")})
      SELECT lang, chunk, rows_, chars, longest, CAST(row_number() OVER (PARTITION BY lang ORDER BY h) AS BIGINT) AS place FROM c"""


def matched_global_batches(d):
    """A hash permutation, padded to whole global batches of 16 and dealt to four ranks by stride."""
    return f"""WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {d.sha("'epoch:1:' || CAST(o_orderkey AS STRING)")}) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM @orders),
      padded AS (SELECT o_orderkey, o_orderpriority, i FROM r UNION ALL SELECT o_orderkey, o_orderpriority, i + n FROM r WHERE n % 16 <> 0 AND i < 16 - n % 16)
      SELECT o_orderpriority, CAST(floor(i / 16) AS BIGINT) AS batch, CAST(i % 4 AS BIGINT) AS rank_, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM padded GROUP BY o_orderpriority, CAST(floor(i / 16) AS BIGINT), CAST(i % 4 AS BIGINT)"""


def range_selection(d):
    """Rows from a start key through a stop key, with an include list and a substring."""
    return """WITH r AS (SELECT n_nationkey, n_name, max(CASE WHEN n_nationkey = 4 THEN 1 ELSE 0 END) OVER (ORDER BY n_nationkey ROWS UNBOUNDED PRECEDING) AS started,
        max(CASE WHEN n_nationkey = 18 THEN 1 ELSE 0 END) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stopped FROM @nation)
      SELECT n_nationkey, n_name FROM r WHERE started = 1 AND coalesce(stopped, 0) = 0 AND n_nationkey NOT IN (7) AND n_name LIKE '%A%'"""


def balanced_oversample(d):
    """A record is kept by its own draw, or by a second draw if it is labelled toxic."""
    draw = lambda ns: f"(CAST({d.hex_number(f'''substr({d.sha(chr(39) + ns + ':' + chr(39) + ' || CAST(x.doc_id AS STRING)')}, 1, 16)''')} AS DOUBLE) / 18446744073709551616.0)"
    return f"""SELECT x.doc_id, {draw('base')} < 0.3 AS by_base, coalesce(l.toxic, 0) = 1 AS has_label FROM @documents x LEFT JOIN @labels l ON x.doc_id = l.doc_id
      WHERE {draw('base')} < 0.3 OR (coalesce(l.toxic, 0) = 1 AND {draw('more')} < 0.5)"""


def _wrapped(placed, group, size):
    """placed with n rows a group, the first rows again behind the last until the size divides the number."""
    counts = placed.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("n"))
    every = placed.join(counts, F.col(group).eqNullSafe(F.col("_g"))).drop("_g").withColumnRenamed("place", "i")
    again = every.where((F.col("n") % size != 0) & (F.col("i") < size - F.col("n") % size)).withColumn("i", F.col("i") + F.col("n"))
    return every.unionByName(again)


def _length_grouped(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    padded = _wrapped(place_in_order(rows, [(-F.col("n_chars")), "doc_id"], ["lang"]), "lang", 32)
    chunks = padded.groupBy("lang", F.floor(F.col("i") / 32).alias("chunk")).agg(F.count("*").alias("rows_"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))
    chunks = chunks.withColumn("h", F.sha2(F.concat(F.lit("chunk:3:"), F.col("lang"), F.lit(":"), F.col("chunk").cast("string")), 256))
    return place_in_order(chunks, ["h"], ["lang"]).select("lang", "chunk", "rows_", "chars", "longest", (F.col("place") + 1).alias("place"))


def _matched_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.sha2(F.concat(F.lit("epoch:1:"), F.col("o_orderkey").cast("string")), 256).alias("h"))
    padded = _wrapped(place_in_order(rows, ["h"], ["o_orderpriority"]), "o_orderpriority", 16)
    return padded.groupBy("o_orderpriority", F.floor(F.col("i") / 16).alias("batch"), (F.col("i") % 4).alias("rank_")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))


#: The order that the catalogue ranks documents by.
_RANK = ["rk", "doc_id"]


def _rank_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", F.concat("source", F.lit("/"), "lang").alias("graph"))
    return rows.select("*", F.expr(_BINS).alias("bin"), F.sha2(F.concat(F.lit("order:17:"), F.col("doc_id").cast("string")), 256).alias("rk"))


def _from_one(rows, *columns):
    return rows.select(*columns, (F.col("place") + 1).alias("place"))


def _candidate_order(spark, sf_dir):
    return tiered_order(_rank_columns(spark, sf_dir), ["source"], _RANK, "lang", ["graph"], "de").select("doc_id", "tier", "pos")


def _first_per_key(spark, sf_dir):
    return firsts(_rank_columns(spark, sf_dir), ["lang"], _RANK).select("lang", "doc_id", "rk")


def _length_round_robin(spark, sf_dir):
    return _from_one(interleave(_rank_columns(spark, sf_dir), ["source"], "bin", _RANK), "doc_id", "source")


def _diversity_order(spark, sf_dir):
    rows = marked_firsts(_rank_columns(spark, sf_dir), ["source", "lang"], _RANK, "best").withColumn("block", F.when(F.col("best"), 0).otherwise(1))
    return _from_one(interleave(rows, ["source"], "bin", _RANK, ("block",)), "doc_id", "source")


def _graph_round_robin(spark, sf_dir):
    rows = place_in_order(_rank_columns(spark, sf_dir), _RANK, ["graph"], name="view").withColumn("view_idx", F.col("view") + 1)
    return _from_one(interleave(rows, ["source"], "bin", _RANK, ("view_idx",)), "doc_id", "source", "view_idx")


def _organism_round_robin(spark, sf_dir):
    rows = place_in_order(_rank_columns(spark, sf_dir), _RANK, ["source", "lang"], name="qpos")
    return _from_one(interleave(rows, ["source"], "bin", _RANK, ("qpos",)), "doc_id", "source")


def _budget_prefix_sum(spark, sf_dir):
    summed = running_totals(_rank_columns(spark, sf_dir), _RANK, "n_chars", ["source"]).withColumn("upto", F.col("before") + F.col("n_chars"))
    return summed.where("upto <= 20000").select("doc_id", "source", "upto")


QUERIES = relational(
    length_bins, family_cap_topk, coverage_summary, prefix_choices, even_prefixes, all_prefixes,
    horizon_label, epoch_prefix_view, head_sample, event_sort_key, range_selection, balanced_oversample,
) | {
    "budget_greedy_skip": (_greedy, _GREEDY_ORACLE),
    "candidate_order": (_candidate_order, on_oracle(candidate_order(ORACLE))),
    "first_per_key": (_first_per_key, on_oracle(first_per_key(ORACLE))),
    "length_round_robin": (_length_round_robin, on_oracle(length_round_robin(ORACLE))),
    "diversity_order": (_diversity_order, on_oracle(diversity_order(ORACLE))),
    "graph_round_robin": (_graph_round_robin, on_oracle(graph_round_robin(ORACLE))),
    "organism_round_robin": (_organism_round_robin, on_oracle(organism_round_robin(ORACLE))),
    "budget_prefix_sum": (_budget_prefix_sum, on_oracle(budget_prefix_sum(ORACLE))),
    "length_grouped_batches": (_length_grouped, on_oracle(length_grouped_batches(ORACLE))),
    "matched_global_batches": (_matched_batches, on_oracle(matched_global_batches(ORACLE))),
}

QUERIES["even_prefixes"] = (QUERIES["even_prefixes"][0], _EVEN_ORACLE)
