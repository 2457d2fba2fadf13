"""Streams that run to the end of what is there: each source once, ids once, a log appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.files import scratch


def ingest_once(spark: SparkSession, folder: str, schema, pattern: str, key: str, where: str | None = None) -> DataFrame:
    """Rows of the files of a folder, each file once and each key once, resumable from its checkpoint.

    The folder is the source of a file stream; a second run with the same where (the folder of
    log and checkpoint) adds only files that are new and keys that the log lacks. The keys seen
    so far are the log itself, joined against each batch, so that no state grows in the
    executors; a batch that is tried again replaces its own part. Returns the log as a table.
    """
    where = where or scratch(spark, "ingest")
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    layout = StructType([*rows.schema.fields, StructField("_batch", LongType())])
    spark.createDataFrame([], rows.schema).write.mode("overwrite").parquet(f"{where}/rows/_batch=-1")

    def append(batch: DataFrame, number: int) -> None:
        log = batch.sparkSession.read.schema(layout).parquet(f"{where}/rows").where(F.col("_batch") < number)
        fresh = batch.dropDuplicates([key]).join(log.select(F.col(key).alias("_seen")), F.col(key).eqNullSafe(F.col("_seen")), "left_anti")
        fresh.select(*rows.columns).write.mode("overwrite").parquet(f"{where}/rows/_batch={number}")

    query = rows.writeStream.foreachBatch(append).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(layout).parquet(f"{where}/rows").drop("_batch")


def windowed_counts(
    spark: SparkSession, folder: str, schema, pattern: str, time: str, kind: str, length: str, late: str, files_per_trigger: int | None = None, watch: Callable[[StreamingQuery], None] | None = None
) -> DataFrame:
    """Event counts by window and kind of a file stream, up to the end of what is there.

    The state holds the windows that the watermark (late behind the newest event) still leaves
    open, and no others; later events of closed windows are dropped. A trigger appends the counts of
    the windows that it changed, and the newest count of a window is the one that holds; a trigger that
    is tried again replaces its own part. watch, if given, is called with the query at its end.
    """
    where = scratch(spark, "windows")
    source = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        source = source.option("maxFilesPerTrigger", files_per_trigger)
    rows = source.parquet(folder).withColumn("_t", F.col(time).cast("timestamp"))
    counts = rows.withWatermark("_t", late).groupBy(F.window("_t", length).alias("w"), F.col(kind)).agg(F.count("*").alias("n"))
    layout = StructType([*counts.schema.fields, StructField("_batch", LongType())])
    spark.createDataFrame([], counts.schema).write.mode("overwrite").parquet(f"{where}/counts/_batch=-1")

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/counts/_batch={number}")

    query = counts.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if watch:
        watch(query)
    counted = spark.read.schema(layout).parquet(f"{where}/counts").groupBy("w", kind).agg(F.max_by("n", "_batch").alias("n"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("begin"), kind, "n")
