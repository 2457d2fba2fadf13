"""File sources and sinks: exact text, JSON with a status, inventories, partitioned releases, incremental ingest."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A folder under the checkpoint folder of the session, else under the local temporary one (tests on one machine)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + os.path.join(tempfile.gettempdir(), "tidemill-scratch")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_text_exact(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with every cell a string: leading zeros and empty strings stay, a row that is too long fails."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).options(header=True, mode="FAILFAST", nullValue="\u0000", emptyValue="", multiLine=True, escape='"').csv(path)


def write_text(df: DataFrame, path: str) -> None:
    """CSV of strings; the commit protocol makes the folder appear whole."""
    df.select(*(F.col(c).cast("string").alias(c) for c in df.columns)).write.mode("errorifexists").options(header=True, nullValue="\u0000", escape='"').csv(path)


def read_json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Line-delimited JSON with a status per row instead of a failed scan."""
    rows = spark.read.text(path).where("trim(value) <> ''")
    parsed = rows.withColumn("record", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    first = schema.split()[0]
    return parsed.withColumn("status", F.when(F.col(f"record.{first}").isNull(), "invalid").otherwise("ok"))


def inventory(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Path tail, size and digest of every file under path; contents are read in the tasks."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=pattern).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"))


def write_release(df: DataFrame, path: str, by: list[str]) -> None:
    df.write.mode("errorifexists").partitionBy(*by).parquet(path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the scratch folder: computed once, its plan ends there, it outlives lost executors.

    What was shuffled for it is deleted once it is written, not when the driver next collects its garbage.
    """
    spark, clean = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    where, before = scratch(spark, name), spark.conf.get(clean, None)
    spark.conf.set(clean, "true")
    try:
        df.write.parquet(where)
    finally:
        spark.conf.unset(clean) if before is None else spark.conf.set(clean, before)
    return spark.read.schema(df.schema).parquet(where)


def discard(df: DataFrame) -> None:
    """Delete a table of kept() that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
