"""Sources, sinks and streams as queries: what is written is read again and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dialect import relational
from ..sources import files, records
from ..sources.tables import table
from ..streaming import ingest


def _csv_roundtrip(spark, sf_dir):
    where = files.scratch(spark, "csv")
    rows = table(spark, sf_dir, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("key"), F.when(F.col("n_regionkey") == 0, "").otherwise(F.col("n_name")).alias("name"))
    files.write_text(rows, where)
    return files.read_text_exact(spark, where, ["key", "name"])


def _json_roundtrip(spark, sf_dir):
    where = files.scratch(spark, "json")
    table(spark, sf_dir, "region").select(F.to_json(F.struct("r_regionkey", "r_name")).alias("value")).write.text(where)
    read = files.read_json_records(spark, where, "r_regionkey int, r_name string")
    return read.select("record.r_regionkey", "record.r_name", "status")


def _release(spark, sf_dir):
    where = files.scratch(spark, "release")
    files.write_release(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars"), where, ["lang"])
    return spark.read.parquet(where).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.countDistinct("source").alias("sources"))


def _release_pruned(spark, sf_dir):
    where = files.scratch(spark, "release")
    files.write_release(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars"), where, ["lang", "source"])
    return spark.read.parquet(where).where("lang = 'de' AND source = 'src1'").select("doc_id", "n_chars")


def _inventory(spark, sf_dir):
    return files.inventory(spark, sf_dir, "[nr]*ion.parquet").select("name", (F.col("bytes") > 0).alias("filled"), (F.length("digest") == 64).alias("hashed"))


def _record_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.struct("o_orderkey", "o_orderstatus", "o_totalprice").alias("r"))
    back = rows.withColumn("again", F.from_json(F.to_json("r", {"ignoreNullFields": "false"}), "o_orderkey bigint, o_orderstatus string, o_totalprice double"))
    return back.groupBy("r.o_orderstatus").agg(F.count("*").alias("n"), F.sum(F.col("r").eqNullSafe(F.col("again")).cast("bigint")).alias("same"))


def _ingest(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return ingest.ingest_once(spark, sf_dir, schema, "events.parquet", "event_id").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


def _windows(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return ingest.windowed_counts(spark, sf_dir, schema, "events.parquet", "ts", "event_type", "1 day", "1 hour")


def _record_files(spark, sf_dir):
    """Turns as lines of JSON, every seventh conversation cut; pages as csv; nations as a JSON file of records for each region."""
    lines, cells, whole = (files.scratch(spark, kind) for kind in ("lines", "cells", "whole"))
    told = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    table(spark, sf_dir, "conversations").select(F.when(F.col("conv_id") % 7 == 0, F.substr(told, F.lit(1), F.length(told) - 1)).otherwise(told).alias("value")).write.text(lines)
    files.write_text(table(spark, sf_dir, "pages").select("page_id", "html"), cells)
    nations = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("records"))
    nations.select("n_regionkey", F.to_json(F.struct("records")).alias("value")).write.partitionBy("n_regionkey").text(whole)
    size = lambda path: F.length(F.try_variant_get("record", path, "string"))
    read = lambda path, kind, name, text: records.load_records(spark, path, kind).select(F.lit(name).alias("kind"), "status", F.coalesce(size(text), F.lit(0)).alias("chars"), F.coalesce("position", F.lit(0)).alias("position"))
    every = read(lines, "lines", "lines", "$.text").unionByName(read(cells, "csv", "csv", "$.html")).unionByName(read(whole, "json", "json", "$.n_name"))
    return every.groupBy("kind", "status").agg(F.count("*").alias("n"), F.sum("chars").cast("bigint").alias("chars"), F.max("position").cast("bigint").alias("last"))


def tumbling_windows(d):
    return f"SELECT {d.days('ts')} AS day_, event_type, count(*) AS n FROM @events GROUP BY {d.days('ts')}, event_type"


def manifest_lines(d):
    """Non-empty lines of a text source."""
    return f"SELECT doc_id, count(*) AS n_lines FROM (SELECT doc_id, {d.explode(d.split('text', '[\\n]'))} AS line FROM @documents) WHERE trim(line) <> '' GROUP BY doc_id"


QUERIES = relational(tumbling_windows, manifest_lines) | {
    "csv_text_roundtrip": (_csv_roundtrip, "SELECT lpad(n_nationkey::VARCHAR, 5, '0') AS key, CASE WHEN n_regionkey = 0 THEN '' ELSE n_name END AS name FROM nation"),
    "json_lines_roundtrip": (_json_roundtrip, "SELECT r_regionkey, r_name, 'ok' AS status FROM region"),
    "partitioned_release": (_release, "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars, count(DISTINCT source) AS sources FROM documents GROUP BY lang"),
    "release_pruned_read": (_release_pruned, "SELECT doc_id, n_chars FROM documents WHERE lang = 'de' AND source = 'src1'"),
    "file_identity_scan": (_inventory, "SELECT * FROM (VALUES ('nation.parquet', true, true), ('region.parquet', true, true)) t(name, filled, hashed)"),
    "record_roundtrip": (_record_roundtrip, "SELECT o_orderstatus, count(*) AS n, count(*) AS same FROM orders GROUP BY o_orderstatus"),
    "incremental_ingest": (_ingest, "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY event_type"),
    "record_files": (
        _record_files,
        """SELECT 'lines' AS kind, CASE WHEN conv_id % 7 = 0 THEN 'invalid_json' ELSE 'ok' END AS status, count(*) AS n, CAST(coalesce(sum(CASE WHEN conv_id % 7 <> 0 THEN length(text) END), 0) AS BIGINT) AS chars, CAST(0 AS BIGINT) AS last FROM conversations GROUP BY 2
        UNION ALL SELECT 'csv', 'ok', count(*), CAST(sum(length(html)) AS BIGINT), 0 FROM pages UNION ALL SELECT 'json', 'ok', count(*), CAST(sum(length(n_name)) AS BIGINT), (SELECT max(c) - 1 FROM (SELECT count(*) AS c FROM nation GROUP BY n_regionkey)) FROM nation""",
    ),
    "stream_windows": (_windows, "SELECT date_trunc('day', ts)::TIMESTAMP AS begin, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
}
