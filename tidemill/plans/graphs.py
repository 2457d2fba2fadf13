"""Graphs: adjacency, components, reachability, layers, merged duplicates, solvers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.dialect import ORACLE, on_oracle, on_spark, relational
from ..operators import assignment, fixpoint, graph
from ..sources.files import discard, kept
from ..sources.tables import table

#: Transitions of event types in the order of a user's events: a small graph with cycles.
_EDGES = """steps AS (SELECT user_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM @events),
      edges AS (SELECT src, dst, count(*) AS n FROM steps WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst)"""

#: The key graph: region to nation to supplier and customer, with a short cut from region to supplier.
_DAG = """dag AS (SELECT 'r' || CAST(n_regionkey AS STRING) AS src, 'n' || CAST(n_nationkey AS STRING) AS dst FROM @nation UNION ALL SELECT 'n' || CAST(s_nationkey AS STRING), 's' || CAST(s_suppkey AS STRING) FROM @supplier
      UNION ALL SELECT 'n' || CAST(c_nationkey AS STRING), 'c' || CAST(c_custkey AS STRING) FROM @customer UNION ALL SELECT 'r' || CAST(n_regionkey AS STRING), 's' || CAST(s_suppkey AS STRING) FROM @supplier JOIN @nation ON s_nationkey = n_nationkey)"""


def edges_adjacency(d):
    return f"WITH {_EDGES} SELECT src, count(*) AS out_degree, CAST(sum(n) AS BIGINT) AS weight, {d.joined('dst', 'dst', '|')} AS targets FROM edges GROUP BY src"


def condense_sinks(d):
    """Nodes without a way out."""
    return f"WITH {_DAG} SELECT DISTINCT dst AS sink FROM dag a WHERE NOT EXISTS (SELECT 1 FROM dag b WHERE b.src = a.dst)"


def reverse_reachability(d):
    """Ancestors of the sinks, and how many each has."""
    return f"""WITH RECURSIVE {_DAG}, up(sink, node) AS (SELECT DISTINCT dst, src FROM dag WHERE substr(dst, 1, 1) IN ('s', 'c') UNION ALL SELECT up.sink, dag.src FROM up JOIN dag ON dag.dst = up.node)
      SELECT sink, count(DISTINCT node) AS ancestors FROM up GROUP BY sink"""


def _dag(spark, sf_dir):
    return on_spark(spark, sf_dir, f"WITH {_DAG} SELECT src, dst FROM dag")


def _inner(dag):
    """The edges that do not end a way: few, whatever the number of leaves."""
    return dag.join(dag.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")


def _ancestors(spark, sf_dir):
    """The closure of the inner edges, and one step from each leaf: a recursive query would list all ways from all leaves."""
    dag = _dag(spark, sf_dir)
    leaves = dag.where("substr(dst, 1, 1) IN ('s', 'c')").select(F.col("dst").alias("sink"), F.col("src").alias("node")).distinct()
    above = graph.transitive_closure(_inner(dag), "src", "dst").select(F.col("dst").alias("node"), F.col("src").alias("up"))
    ways = leaves.unionByName(leaves.join(above, "node").select("sink", F.col("up").alias("node")))
    return ways.groupBy("sink").agg(F.count_distinct("node").alias("ancestors"))


def longest_layers(d):
    """Longest distance to a sink and the layer from the top."""
    return f"""WITH RECURSIVE {_DAG}, walk(node, depth) AS (SELECT DISTINCT dst, 0 FROM dag WHERE dst NOT IN (SELECT src FROM dag) UNION ALL SELECT dag.src, walk.depth + 1 FROM walk JOIN dag ON dag.dst = walk.node),
      far AS (SELECT node, max(depth) AS distance FROM walk GROUP BY node) SELECT node, CAST(distance AS BIGINT) AS distance, CAST((SELECT max(distance) FROM far) - distance AS BIGINT) AS layer FROM far"""


def _layers(spark, sf_dir):
    """Longest ways by rounds over the inner edges, from the nodes above the sinks; the sinks themselves are at 0."""
    dag = _dag(spark, sf_dir)
    dag.createOrReplaceTempView(view := f"dag_{uuid.uuid4().hex}")
    # as the oracle's NOT IN: a null source leaves no sinks
    sinks = spark.sql(f"SELECT DISTINCT dst AS node FROM {view} WHERE dst NOT IN (SELECT DISTINCT src FROM {view})")
    spark.catalog.dropTempView(view)
    first = dag.join(sinks.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.lit(0).alias("g"), F.col("src").alias("n")).distinct()
    up = kept(_inner(dag).select(F.lit(0).alias("g"), F.col("dst").alias("a"), F.col("src").alias("b")).distinct(), "inner")
    higher = fixpoint.relax(first.withColumn("v", F.lit(1)), up, ["g"], "max", 1)
    discard(up)
    far = sinks.select("node", F.lit(0).alias("distance")).unionByName(higher.select(F.col("n").alias("node"), F.col("v").alias("distance")))
    top = far.agg(F.max("distance").alias("top"))
    return far.crossJoin(F.broadcast(top)).select("node", F.col("distance").cast("bigint").alias("distance"), (F.col("top") - F.col("distance")).cast("bigint").alias("layer"))


def _scc_pairs(spark, sf_dir):
    """Mutually reachable event types, by the closure of all transitions."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, sf_dir, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(order).alias("dst"))
    reach = graph.transitive_closure(steps.where("dst IS NOT NULL AND src <> dst"), "src", "dst")
    back = reach.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    return reach.intersect(back.select("src", "dst")).groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("component")).select("node", F.least("node", "component").alias("component"))


_SCC_PAIRS_ORACLE = """WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL AND src <> dst),
  reach AS (SELECT src AS a, dst AS b FROM e UNION SELECT reach.a, e.dst FROM reach JOIN e ON reach.b = e.src)
SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a"""


def context_attachment(d):
    """Extra edges whose endpoints all lie inside a view: their layer, and whether they cross layers."""
    return """WITH layer AS (SELECT n_nationkey AS node, n_regionkey AS l FROM @nation WHERE n_regionkey < 4), extra AS (SELECT DISTINCT s.s_nationkey AS a, c.c_nationkey AS b FROM @supplier s JOIN @customer c ON s.s_suppkey = c.c_custkey)
      SELECT e.a, e.b, CASE WHEN x.l IS NULL OR y.l IS NULL THEN 'excluded' WHEN x.l <> y.l THEN 'cross' ELSE 'inside' END AS role, CAST(CASE WHEN x.l IS NOT NULL AND y.l IS NOT NULL THEN greatest(x.l, y.l) END AS BIGINT) AS layer
      FROM extra e LEFT JOIN layer x ON e.a = x.node LEFT JOIN layer y ON e.b = y.node"""


def semantic_dedup(d):
    """Equal content per layer is one event; the ids of all producers stay, the strongest role wins."""
    key = "concat('event', chr(10), CAST(l_partkey AS STRING), chr(10), l_returnflag)"
    return f"""SELECT CAST(l_linenumber AS BIGINT) AS layer, 'event:' || substr({d.sha(key)}, 1, 24) AS event_id, count(*) AS producers, min(l_orderkey) AS first_order,
      min(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) = 0 AS backbone, {d.joined('CAST(l_orderkey AS STRING)', 'l_orderkey', ',')} AS ids FROM @lineitem GROUP BY l_linenumber, {d.sha(key)}"""


def exact_text_groups(d):
    return f"SELECT {d.sha('text')} AS text_id, min(doc_id) AS keeper, count(*) AS copies FROM @documents GROUP BY {d.sha('text')}"


def dependency_closure(d):
    """All a job waits for, through others."""
    return f"""WITH RECURSIVE dep AS (SELECT n_nationkey AS job, n_nationkey - 3 AS needs FROM @nation WHERE n_nationkey >= 3 UNION ALL SELECT n_nationkey, n_nationkey - 5 FROM @nation WHERE n_nationkey >= 5 AND n_nationkey % 2 = 0),
      all_(job, needs, depth) AS (SELECT job, needs, 1 FROM dep UNION ALL SELECT a.job, dep.needs, a.depth + 1 FROM all_ a JOIN dep ON dep.job = a.needs) SELECT job, count(DISTINCT needs) AS n_needs, CAST(max(depth) AS BIGINT) AS longest FROM all_ GROUP BY job"""


def _records(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    from pyspark.sql import Window

    steps = events.select("user_id", F.col("event_type").alias("src"), F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("dst"))
    return graph.structured_records(steps.where("dst IS NOT NULL"), "user_id", "src", "dst")


def _scc_oracle():
    return """WITH RECURSIVE e AS (SELECT DISTINCT user_id, src, dst FROM (SELECT user_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL),
  reach AS (SELECT user_id, src AS a, dst AS b FROM e UNION SELECT r.user_id, r.a, e.dst FROM reach r JOIN e ON r.user_id = e.user_id AND r.b = e.src),
  nodes AS (SELECT user_id, src AS node FROM e UNION SELECT user_id, dst FROM e)
SELECT n.user_id, n.node, least(n.node, coalesce(min(x.b), n.node)) AS component FROM nodes n
LEFT JOIN (SELECT x.user_id, x.a, x.b FROM reach x JOIN reach y ON x.user_id = y.user_id AND x.a = y.b AND x.b = y.a) x ON n.user_id = x.user_id AND n.node = x.a GROUP BY n.user_id, n.node"""


def _scc(spark, sf_dir):
    return _records(spark, sf_dir).select("user_id", "node", "component")


def _balance(spark, sf_dir):
    layers = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    options = F.expr("filter(array(IF(n >= 3, 'long', NULL), IF(n >= 4, 'middle', NULL), IF(n >= 2, 'short', NULL)), x -> x IS NOT NULL)")
    return assignment.assign_labels(layers.withColumn("options", options), "conv_id", "options", ("long", "middle", "short"))


def _indivisible(spark, sf_dir):
    return assignment.split_families(table(spark, sf_dir, "documents"), "source", "n_chars")


QUERIES = relational(
    edges_adjacency, condense_sinks, context_attachment, semantic_dedup, exact_text_groups, dependency_closure,
) | {"reverse_reachability": (_ancestors, on_oracle(reverse_reachability(ORACLE))), "longest_layers": (_layers, on_oracle(longest_layers(ORACLE))), "scc_pairs": (_scc_pairs, _SCC_PAIRS_ORACLE), "structured_records": (_records, None), "scc_components": (_scc, _scc_oracle()), "horizon_balance": (_balance, None), "indivisible_split": (_indivisible, None)}
