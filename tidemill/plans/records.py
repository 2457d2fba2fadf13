"""Layered records of the graphs that customers' orders make: nations are nodes, neighbouring lines of an order are events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records
from ..sources.tables import table

#: An event leads from the nation of a line's supplier to that of the next line of the order.
_EVENTS = """SELECT o_custkey AS graph, concat(CAST(l_orderkey AS {string}), ':', CAST(rn AS {string})) AS event, s, t, CASE WHEN l_returnflag = 'N' THEN 'context' WHEN l_linestatus = 'O' AND l_quantity > 45 THEN 'excluded' ELSE 'backbone' END AS role,
    concat(CAST(s AS {string}), '>', CAST(t AS {string}), ':', l_returnflag) AS semantic, concat(CAST(s AS {string}), '>', CAST(t AS {string})) AS content, CASE WHEN l_quantity >= 5 THEN l_linestatus END AS text
  FROM (SELECT *, lead(s) OVER w AS t, row_number() OVER w AS rn FROM (SELECT l.*, o_custkey, s_nationkey AS s FROM lineitem l JOIN orders o ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey)
    WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax)) WHERE t IS NOT NULL"""


def order_events(spark, sf_dir):
    tables = {t: table(spark, sf_dir, t) for t in ("lineitem", "orders", "supplier")}
    text = _EVENTS.format(string="STRING")
    for name in tables:
        text = text.replace(f"FROM {name} ", f"FROM {{{name}}} ").replace(f"JOIN {name} ", f"JOIN {{{name}}} ")
    found = spark.sql(text, **tables)
    return found.select("graph", "event", F.array("s").alias("sources"), F.array("t").alias("targets"), "role", "semantic", "content", "text")


def _layered(spark, sf_dir):
    rows = records.layered_events(order_events(spark, sf_dir))
    return rows.select("graph", "record_id", "sink_nodes", "layer_index", "distance_to_sink", "event_id", F.array_join("producers", ",").alias("producers"), "role", F.coalesce(F.size("arcs"), F.lit(0)).cast("bigint").alias("n_arcs"), "text", F.array_join("conflicts", ",").alias("conflicts"))


def _records(spark, sf_dir):
    made = records.structured_records(order_events(spark, sf_dir))
    body = F.array_join(F.transform("layers", lambda x: F.concat(x["layer_index"].cast("string"), F.lit("/"), x["distance_to_sink"].cast("string"), F.lit("="), F.array_join(F.transform(x["events"], lambda e: e["event_id"]), ","))), ";")
    return made.select("graph", "view_id", "record_id", "sink_nodes", "n_layers", "n_events", "n_producers", "n_conflicts", "n_graph_events", "n_excluded", "n_unattached", "n_beyond", body.alias("body"))


def _prefixes(spark, sf_dir):
    rows = records.prefix_rows(records.structured_records(order_events(spark, sf_dir)))
    return rows.select("sample_id", "record_id", "graph", "prefix_length", "n_layers", "n_remaining_layers", "n_observed_events", "n_remaining_events", "observed", "answer_sha256")


#: The same by closures of pairs, told apart from the operators: all pairs, mutual pairs, all ways to each sink.
_VIEWS = f"""WITH RECURSIVE ev AS ({_EVENTS.format(string="VARCHAR")}), e AS (SELECT DISTINCT graph AS g, s AS a, t AS b FROM ev WHERE role = 'backbone'),
  reach(g, a, b) AS (SELECT g, a, b FROM e UNION SELECT r.g, r.a, e.b FROM reach r JOIN e ON r.g = e.g AND r.b = e.a), nodes AS (SELECT g, a AS n FROM e UNION SELECT g, b FROM e),
  comp AS (SELECT n.g, n.n, least(n.n, coalesce(min(x.b), n.n)) AS c FROM nodes n LEFT JOIN (SELECT x.g, x.a, x.b FROM reach x JOIN reach y ON x.g = y.g AND x.a = y.b AND x.b = y.a) x ON n.g = x.g AND n.n = x.a GROUP BY n.g, n.n),
  dag AS (SELECT DISTINCT e.g, x.c AS a, y.c AS b FROM e JOIN comp x ON x.g = e.g AND x.n = e.a JOIN comp y ON y.g = e.g AND y.n = e.b WHERE x.c <> y.c),
  sink AS (SELECT DISTINCT g, c FROM comp WHERE NOT EXISTS (SELECT 1 FROM dag WHERE dag.g = comp.g AND dag.a = comp.c)),
  far(g, sink, c, d) AS (SELECT g, c, c, 0 FROM sink UNION SELECT f.g, f.sink, dag.a, f.d + 1 FROM far f JOIN dag ON dag.g = f.g AND dag.b = f.c),
  longest AS (SELECT g, sink, c, max(d) AS d FROM far GROUP BY g, sink, c), depth AS (SELECT g, sink, max(d) AS depth FROM longest GROUP BY g, sink), v AS (SELECT l.g, l.sink, comp.n, l.d, depth FROM longest l JOIN comp ON comp.g = l.g AND comp.c = l.c JOIN depth ON depth.g = l.g AND depth.sink = l.sink),
  ids AS (SELECT g, c AS sink, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS nodes FROM comp WHERE EXISTS (SELECT 1 FROM sink WHERE sink.g = comp.g AND sink.c = comp.c) GROUP BY g, c),
  named AS (SELECT *, 'view:' || substr(sha256('view' || chr(10) || CAST(g AS VARCHAR) || chr(10) || nodes), 1, 24) AS view_id FROM ids),
  heads AS (SELECT *, 'record:' || substr(sha256('record' || chr(10) || CAST(g AS VARCHAR) || chr(10) || view_id), 1, 24) AS record_id FROM named),
  placed AS (SELECT ev.*, y.sink, y.depth - y.d AS raw, y.d AS dist, 'backbone' AS place FROM ev JOIN v y ON y.g = ev.graph AND y.n = ev.t WHERE role = 'backbone'
    UNION ALL SELECT ev.*, x.sink, x.depth - least(x.d, y.d), least(x.d, y.d), CASE WHEN x.d = y.d THEN 'context' ELSE 'context_cross_layer' END FROM ev JOIN v x ON x.g = ev.graph AND x.n = ev.s JOIN v y ON y.g = ev.graph AND y.n = ev.t AND y.sink = x.sink WHERE role = 'context'),
  ranked AS (SELECT *, dense_rank() OVER (PARTITION BY graph, sink ORDER BY raw) - 1 AS layer FROM placed),
  merged AS (SELECT graph, sink, layer, dist, semantic, min(event) AS event_id, string_agg(event, ',' ORDER BY event) AS producers, count(*) AS n, count(*) FILTER (place <> 'backbone') AS n_context, max(t) AS t, max(content) AS content,
    CASE WHEN bool_or(place = 'backbone') THEN 'backbone' WHEN bool_or(place = 'context_cross_layer') THEN 'context_cross_layer' ELSE 'context' END AS role, arg_min(struct_pack(x := text), event).x AS text, count(DISTINCT text) > 1 AS clash, max(s) AS s FROM ranked GROUP BY graph, sink, layer, dist, semantic)"""

_LAYERED_ORACLE = f"""{_VIEWS} SELECT graph, record_id, nodes AS sink_nodes, CAST(layer AS BIGINT) AS layer_index, CAST(dist AS BIGINT) AS distance_to_sink, event_id, producers, role, CAST(CASE WHEN role = 'backbone' THEN 1 ELSE 0 END AS BIGINT) AS n_arcs, text, CASE WHEN clash THEN 'text' ELSE '' END AS conflicts
  FROM merged m JOIN heads h ON h.g = m.graph AND h.sink = m.sink"""

_RECORDS_ORACLE = f"""{_VIEWS}, layers AS (SELECT graph, sink, layer, dist, string_agg(event_id, ',' ORDER BY t, s, event_id) AS ids, count(*) AS n, sum(n) AS producers, sum(n_context) AS attached, sum(CASE WHEN clash THEN 1 ELSE 0 END) AS clashes FROM merged GROUP BY graph, sink, layer, dist),
  counts AS (SELECT graph, count(*) AS n, count(*) FILTER (role = 'excluded') AS excluded, count(*) FILTER (role = 'context') AS context, count(*) FILTER (role = 'backbone') AS backbone FROM ev GROUP BY graph)
  SELECT l.graph, view_id, record_id, nodes AS sink_nodes, count(*) AS n_layers, CAST(sum(l.n) AS BIGINT) AS n_events, CAST(sum(producers) AS BIGINT) AS n_producers, CAST(sum(clashes) AS BIGINT) AS n_conflicts, max(c.n) AS n_graph_events, max(excluded) AS n_excluded, CAST(max(context) - sum(attached) AS BIGINT) AS n_unattached,
    CAST(max(backbone) - sum(producers - attached) AS BIGINT) AS n_beyond, string_agg(CAST(layer AS VARCHAR) || '/' || CAST(dist AS VARCHAR) || '=' || ids, ';' ORDER BY layer) AS body
  FROM layers l JOIN heads h ON h.g = l.graph AND h.sink = l.sink JOIN counts c ON c.graph = l.graph GROUP BY l.graph, view_id, record_id, nodes"""

_PREFIXES_ORACLE = f"""{_VIEWS}, layers AS (SELECT graph, sink, layer, count(*) AS n, '{{"layer_index":' || CAST(layer AS VARCHAR) || ',"events":[' || string_agg('"' || content || '"', ',' ORDER BY t, s, event_id) || ']}}' AS body FROM merged GROUP BY graph, sink, layer),
  whole AS (SELECT graph, sink, count(*) AS n_layers, sum(n) AS n FROM layers GROUP BY graph, sink)
  SELECT record_id || ':prefix=' || CAST(p AS VARCHAR) AS sample_id, record_id, w.graph, p AS prefix_length, n_layers, n_layers - p AS n_remaining_layers, CAST(sum(l.n) FILTER (layer < p) AS BIGINT) AS n_observed_events, CAST(sum(l.n) FILTER (layer >= p) AS BIGINT) AS n_remaining_events,
    '[' || string_agg(body, ',' ORDER BY layer) FILTER (layer < p) || ']' AS observed, sha256('[' || string_agg(body, ',' ORDER BY layer) FILTER (layer >= p) || ']') AS answer_sha256
  FROM (SELECT *, unnest(range(1, n_layers)) AS p FROM whole) w JOIN layers l ON l.graph = w.graph AND l.sink = w.sink JOIN heads h ON h.g = w.graph AND h.sink = w.sink GROUP BY record_id, p, w.graph, n_layers"""

QUERIES = {"layered_event_records": (_layered, _LAYERED_ORACLE), "sink_records": (_records, _RECORDS_ORACLE), "record_prefix_rows": (_prefixes, _PREFIXES_ORACLE)}
