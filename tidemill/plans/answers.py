"""Model answers built from orders: parsed by version with every reason, canonical JSON, nested rewriting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import payloads
from ..sources.tables import spread, table

#: Lines of an order in a fixed order, from 0, with what the answer says of each.
_LINES = """SELECT *, concat('sup:', CAST(l_suppkey AS {string})) AS sid, concat('part:', CAST(l_partkey AS {string})) AS pid, concat('S', CAST(l_suppkey AS {string}), ' sends P', CAST(l_partkey AS {string})) AS said,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS BIGINT) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem"""

#: A fault for each remainder of the order's key by 9: none, version, gap, blank text, cut JSON, action, alias, older form, fenced v3.
_ANSWERS = f"""WITH lines AS ({_LINES.format(string="STRING").replace("FROM lineitem", "FROM {lineitem}")}),
  layers AS (SELECT l_orderkey, array_sort(collect_list(struct(i, CASE WHEN l_orderkey % 9 = 2 AND i > 0 AND i = n - 1 THEN i + 5 ELSE i END AS layer_index, CASE WHEN l_orderkey % 9 = 3 AND i = 0 THEN ' ' ELSE said END AS said, sid, pid,
      l_orderkey % 9 = 5 AND l_returnflag = 'R' AS odd_action, l_orderkey % 9 = 6 AND l_linestatus = 'O' AS odd_alias))) AS ls FROM lines GROUP BY l_orderkey),
  told AS (SELECT l_orderkey, to_json(named_struct('schema_version', CASE WHEN l_orderkey % 9 = 1 THEN 'v9' ELSE 'pathway_continuation_v4' END, 'remaining_layers', transform(ls, x -> named_struct('layer_index', x.layer_index, 'events', array(named_struct('event_type', 'relation',
      'source', array(named_struct('canonical_id', x.sid, 'aliases', CASE WHEN x.odd_alias THEN array(x.sid) ELSE array('s') END, 'name', x.sid)), 'action', named_struct('kind', CASE WHEN x.odd_action THEN 'none' ELSE 'relation' END, 'relation_class', 'trade', 'subtypes', array('sale'), 'reversibility', CAST(NULL AS STRING)),
      'mediators', CAST(array() AS ARRAY<STRING>), 'target', array(named_struct('canonical_id', x.pid, 'aliases', CAST(array() AS ARRAY<STRING>), 'name', x.pid)), 'text', x.said))))), map('ignoreNullFields', 'false')) AS v4,
    to_json(named_struct('steps', transform(ls, x -> x.said))) AS older,
    to_json(named_struct('schema_version', 'pathway_continuation_v3', 'remaining_layers', transform(ls, x -> named_struct('layer_index', x.i, 'events', array(named_struct('source', array(named_struct('canonical_id', x.sid, 'name', x.sid)), 'relation', 'sends', 'target', array(named_struct('canonical_id', x.pid, 'name', x.pid)), 'text', x.said)))))) AS v3 FROM layers)
  SELECT l_orderkey, CASE l_orderkey % 9 WHEN 4 THEN left(v4, length(v4) - 1) WHEN 7 THEN older WHEN 8 THEN concat('```json', chr(10), v3, chr(10), '```') ELSE v4 END AS payload FROM told"""


def _validation(spark, sf_dir):
    answers = spark.sql(_ANSWERS, lineitem=table(spark, sf_dir, "lineitem"))
    read = payloads.parse_payloads(answers, "payload")
    found = read.select("l_orderkey", "form", "json_valid", "schema_valid", F.size("steps").cast("bigint").alias("n_steps"), F.sha2(F.array_join(F.transform("steps", lambda s: F.concat_ws("|", F.coalesce(s["step"].cast("string"), F.lit("-")), s["text"])), ";"), 256).alias("steps_sha256"), F.array_join("reasons", ";").alias("reasons"))
    return found.withColumn("steps_sha256", F.when(F.col("form") != "text", F.col("steps_sha256")))


#: What each fault must give, told from the rows and not from any JSON; the cut JSON counts as one line of text.
_VALIDATION_ORACLE = f"""WITH lines AS ({_LINES.format(string="VARCHAR")}), f AS (SELECT *, l_orderkey % 9 AS fault, 'layer ' || CAST(i AS VARCHAR) || ' event 0: ' AS place FROM lines),
  told AS (SELECT l_orderkey, fault, n, i, CASE WHEN fault = 3 AND i = 0 THEN NULL WHEN fault = 7 THEN '-|' || said WHEN fault = 2 AND i > 0 AND i = n - 1 THEN CAST(i + 5 AS VARCHAR) || '|' || said ELSE CAST(i AS VARCHAR) || '|' || said END AS step,
    CASE WHEN fault = 1 THEN place || 'keys;' || place || 'source;' || place || 'target;' || place || 'relation' WHEN fault = 3 AND i = 0 THEN 'layer 0: no_text;' || place || 'text' WHEN fault = 5 AND l_returnflag = 'R' THEN place || 'action' WHEN fault = 6 AND l_linestatus = 'O' THEN place || 'source' WHEN fault = 7 THEN 'step ' || CAST(i AS VARCHAR) || ': not_object' END AS inner_,
    CASE WHEN fault = 2 AND i > 0 AND i = n - 1 THEN 'layer ' || CAST(i AS VARCHAR) || ': gap' END AS gap FROM f),
  whole AS (SELECT l_orderkey, fault, count(step) AS n_steps, coalesce(string_agg(step, ';' ORDER BY i), '') AS steps, concat_ws(';', CASE fault WHEN 1 THEN 'unknown_version' WHEN 7 THEN 'older_form' END, string_agg(inner_, ';' ORDER BY i), string_agg(gap, ';' ORDER BY i)) AS reasons FROM told GROUP BY l_orderkey, fault)
  SELECT l_orderkey, CASE fault WHEN 1 THEN 'layers' WHEN 4 THEN 'text' WHEN 7 THEN 'older' WHEN 8 THEN 'v3' ELSE 'v4' END AS form, fault <> 4 AS json_valid, fault <> 4 AND reasons = '' AS schema_valid, CASE WHEN fault = 4 THEN 1 ELSE n_steps END AS n_steps,
    CASE WHEN fault = 4 THEN NULL ELSE sha256(steps) END AS steps_sha256, CASE WHEN fault = 4 THEN 'invalid_json' ELSE reasons END AS reasons FROM whole"""


_TREE = r"""concat('{ "z" : {"name":"', p_name, '", "list": [ "', p_brand, '", "', p_name, '", ', CAST(p_size AS STRING), ', null ]},', chr(10), ' "brand":"', p_brand, '", "quote": "say \\"', p_brand, '\\"\\u0041", "a": {"', p_brand, '": true, "empty": {}} }') AS body"""


def _rewritten(spark, sf_dir):
    rows = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")).selectExpr("p_partkey", "p_brand", _TREE)
    named = F.create_map(F.col("p_brand"), F.concat(F.lit('ent:"'), F.substring(F.sha2("p_brand", 256), 1, 8), F.lit('"')))
    return rows.select("p_partkey", payloads.canonical_json(F.col("body")).alias("canonical"), payloads.rewrite_leaves(F.col("body"), named).alias("everywhere"), payloads.rewrite_leaves(F.col("body"), named, ("brand",)).alias("under_brand"))


_REWRITTEN_ORACLE = r"""WITH t AS (SELECT *, 'ent:\"' || substr(sha256(p_brand), 1, 8) || '\"' AS e FROM part),
  made AS (SELECT p_partkey, kind, '{"a":{"' || p_brand || '":true,"empty":{}},"brand":"' || CASE WHEN kind = 'canonical' THEN p_brand ELSE e END || '","quote":"say \"' || p_brand || '\"A","z":{"list":["' || CASE WHEN kind = 'everywhere' THEN e ELSE p_brand END || '","' || p_name || '",' || CAST(p_size AS VARCHAR) || ',null],"name":"' || p_name || '"}}' AS body
    FROM t, (VALUES ('canonical'), ('everywhere'), ('under_brand')) k(kind))
  SELECT p_partkey, max(CASE WHEN kind = 'canonical' THEN body END) AS canonical, max(CASE WHEN kind = 'everywhere' THEN body END) AS everywhere, max(CASE WHEN kind = 'under_brand' THEN body END) AS under_brand FROM made GROUP BY p_partkey"""

QUERIES = {"payload_validation": (_validation, _VALIDATION_ORACLE), "json_rewrite": (_rewritten, _REWRITTEN_ORACLE)}
