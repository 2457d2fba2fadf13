"""Record files of any of three kinds: csv, lines of JSON, and JSON of a list or of {"records": [...]}."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {".csv": "csv", ".jsonl": "lines", ".ndjson": "lines", ".json": "json"}


def kind_of(path: str) -> str:
    """csv, lines or json by the ending of the path; another ending is refused."""
    for ending, kind in KINDS.items():
        if path.rstrip("/").lower().endswith(ending):
            return kind
    raise ValueError(f"no kind of record file ends as {path}")


def _status(value: Column) -> Column:
    return F.when(value.isNull(), "invalid_json").when(~F.schema_of_variant(value).startswith("OBJECT"), "not_object").otherwise("ok")


def load_records(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(file, position, status, record) of every record under path, a file or a folder of files of one kind.

    record is a VARIANT. status: ok; invalid_json (a line or file that is no JSON); not_object (a
    record that is a scalar or list, kept as it is); no_records (JSON of neither form). Cells of csv are strings as they
    stand, none null. position counts the records of a JSON file from 0 and is null in the others,
    whose files are split between tasks; a JSON file is one value and is read whole. Blank lines are no records.
    """
    kind = kind or kind_of(path)
    file = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file")
    none = F.lit(None).cast("bigint").alias("position")
    if kind == "csv":
        rows = spark.read.options(header=True, nullValue="\u0000", emptyValue="", multiLine=True, escape='"').csv(path)
        cells = F.to_variant_object(F.struct(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in rows.columns)))
        return rows.select(file, none, F.lit("ok").alias("status"), cells.alias("record"))
    if kind == "lines":
        lines = spark.read.text(path).select(file, "value").where(F.trim("value") != "")
        lines = lines.withColumn("record", F.try_parse_json("value"))
        return lines.select("file", none, _status(F.col("record")).alias("status"), "record")
    files = spark.read.text(path, wholetext=True).select(file, F.try_parse_json("value").alias("_v"))
    shape = F.schema_of_variant("_v")
    inner = F.try_variant_get("_v", "$.records", "array<variant>")
    items = F.when(shape.startswith("ARRAY"), F.try_variant_get("_v", "$", "array<variant>")).when(shape.startswith("OBJECT"), inner)
    whole = F.when(F.col("_v").isNull(), "invalid_json").when(F.col("_items").isNull(), "no_records")
    files = files.withColumn("_items", items).withColumn("_whole", whole)
    good = files.where("_whole IS NULL").select("file", F.posexplode("_items").alias("position", "record"))
    good = good.select("file", F.col("position").cast("bigint").alias("position"), _status(F.col("record")).alias("status"), "record")
    return good.unionByName(files.where("_whole IS NOT NULL").select("file", none, F.col("_whole").alias("status"), F.col("_v").alias("record")))
