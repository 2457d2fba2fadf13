"""Helpers of the text operators: shared folder, Arrow text buffers, words, hashes."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the vectorised code works on at a time; a longer text is one piece.
CHUNK_BYTES = 2 << 20
#: Rows of ids and fingerprints in a file, where there are more files than two a core.
FILE_ROWS = 1_000_000

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def let_workers_import(spark: SparkSession) -> None:
    """Python workers find this package by the path the driver has it at (local mode; a cluster ships it with --py-files)."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, env.get("PYTHONPATH")]))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset (tests, one machine) an own one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = "file://" + os.path.join(tempfile.gettempdir(), "tidemill-checkpoints")
    return where.rstrip("/")


def files_for(spark: SparkSession, rows: int) -> int:
    """Files for a table of so many rows of ids: two a core, and more where they would have over FILE_ROWS rows."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS))


def written(df: DataFrame, what: str, files: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors.

    files: so many at most. Each task that writes starts three processes (chmod) where Hadoop
    has no native library, and each shows all the executor's memory until it runs.
    """
    spark = df.sparkSession
    if files:
        df = df.coalesce(files)
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table of written() that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def keep_first_of_groups(docs: DataFrame, grouped: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row of docs for each group that grouped gives: it maps (row, doc_id, text) to (row, doc_id, root).

    The row with the smallest doc_id stays; among rows with it, or where no row has one, the
    first as written. Columns of any name pass through.
    """
    own = written(docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).withColumn("row", F.monotonically_increasing_id()), "rows")
    at = {name: F.col(f"c{i}") for i, name in enumerate(docs.columns)}
    groups = grouped(own.select("row", at["doc_id"].cast("long").alias("doc_id"), at["text"].cast("string").alias("text")))
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best"))
    return own.join(best.select("best.row"), "row", "left_semi").drop("row").toDF(*docs.columns)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets, without a copy; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32, count=len(column) + 1, offset=column.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about limit bytes; texts stay whole."""
    raw, offsets = text_buffers(column)
    n, lo = len(column), 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, 9, 10, 11, 12, 13]] = False


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words [^\\x20\\x09-\\x0D]+ of all texts, and the first word of each text (n + 1)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = _WORD[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    first[cuts] |= inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets, side="left")


_BASE = 0x9E3779B97F4A7C15
#: Longer words are hashed one by one.
LONG_WORD = 512


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes, the same wherever the word stands: eight bytes at a time are mixed in."""
    lengths = ends - starts
    out = mix64(lengths.astype(np.uint64) + np.uint64(_BASE))
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eights = np.ndarray((len(raw) + 1,), "<u8", padded.data, strides=(1,))
    live, lane = np.flatnonzero(lengths <= LONG_WORD), 0
    while len(live):
        rest = lengths[live] - lane
        part = eights[starts[live] + lane]
        short = np.flatnonzero(rest < 8)
        part[short] &= (np.uint64(1) << (rest[short] * 8).astype(np.uint64)) - np.uint64(1)
        out[live] = mix64(out[live] ^ part)
        live, lane = live[rest > 8], lane + 8
    for i in np.flatnonzero(lengths > LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]].tobytes())
    return out


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words[i : i + k] for each i (len(words) - k + 1 of them)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = 1
    for j in range(k):
        out += words[j : j + n] * np.uint64(factor)
        factor = factor * _BASE % (1 << 64)
    return mix64(out)


def range_hashes(words: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of words[begin : end] for each pair of bounds, a word at a time; for ranges of some hundred words at most."""
    lengths = ends - begins
    out = mix64(lengths.astype(np.uint64) + np.uint64(_BASE))
    live = np.argsort(-lengths, kind="stable")
    sizes, at = lengths[live], 0
    while len(live := live[: np.searchsorted(-sizes[: len(live)], -at, side="left")]):
        out[live] = mix64(out[live] * np.uint64(_BASE) ^ words[begins[live] + at])
        at += 1
    return out
