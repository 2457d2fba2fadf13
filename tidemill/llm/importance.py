"""Importance resampling towards a target distribution over hashed word runs.

A document is read once, word by word, with a ring of running CRC-32 states: one for each of the
last n starts. A new word opens a state of its own and extends every open one by a space and
itself, and each state it touches is the checksum of a run that ends there, so no run of words is
ever joined or hashed from its beginning. The ring is kept level by level (states of one word, of
two, ...), which lets zlib go over a block of words at a time; a text of any length is a sequence
of blocks that hand the ring on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import dropped, let_workers_import, text_buffers, written

RUN_WORDS = 3
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 5
SEED = 42
#: Bytes of a text that are split into words at a time.
BLOCK_BYTES = 1 << 20

#: A-Z to a-z; digits, a-z and all bytes of other characters than ASCII stay; the rest parts words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def ring_states(text: bytes, n: int = RUN_WORDS) -> Iterator[tuple[int, list[list[int]]]]:
    """(words, checksums of the runs of 1, 2, ... n words that end in them) for each block of a text."""
    plain, at = text.translate(_WORDS), 0
    ring: list[int | None] = [None] * n
    while at < len(plain):
        end = plain.find(b" ", at + BLOCK_BYTES)
        end = len(plain) if end < 0 else end
        words = plain[at:end].split()
        at = end
        if not words:
            continue
        spaced = [b" " + w for w in words]
        level, levels = list(map(crc32, words)), []
        for k in range(n):
            levels.append(level)
            open_states = level[:-1] if ring[k] is None else [ring[k], *level[:-1]]
            ring[k] = level[-1] if level else None
            level = list(map(crc32, spaced[len(spaced) - len(open_states) :], open_states)) if open_states else []
        yield len(words), levels


def _buckets(levels: list[list[int]], buckets: int) -> np.ndarray:
    return np.fromiter(chain.from_iterable(levels), np.int64, sum(map(len, levels))) % buckets


def _texts(column: pa.Array) -> Iterator[bytes]:
    raw, offsets = text_buffers(column)
    view = memoryview(np.ascontiguousarray(raw))
    for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield bytes(view[begin:end])


def bucket_counts(docs: DataFrame, n: int = RUN_WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """How many runs of 1 to n words of all texts fall in each bucket: added up in each task, then by bucket.

    buckets numbers come to the driver, whatever the size of docs. Null texts hold no words.
    """
    let_workers_import(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in _texts(batch.column(0)):
                for _, levels in ring_states(text, n):
                    total += np.bincount(_buckets(levels, buckets), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    counts = np.zeros(buckets, np.int64)
    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in found.collect():
        counts[r["bucket"]] = r["n"]
    return counts


def bucket_gains(target: np.ndarray, raw: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln of the smoothed share of a bucket in target over that in raw), one count added to each bucket."""
    size, all_target, all_raw = len(raw), float(target.sum()), float(raw.sum())
    return np.array([math.floor(scale * math.log((float(t) + 1) * (all_raw + size) / ((float(s) + 1) * (all_target + size)))) for t, s in zip(target, raw, strict=True)], np.int64)


def importance_weights(docs: DataFrame, gains: np.ndarray, n: int = RUN_WORDS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) for every row of docs; weight: the gains of all runs of 1 to n words.

    A null or empty text has no words and a weight of 0. Repeated rows keep a row each; other
    columns are left out; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    let_workers_import(spark)
    shared = spark.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for row, text in enumerate(_texts(batch.column(1))):
                for words, levels in ring_states(text, n):
                    at = _buckets(levels, len(gain))
                    out[:, row] += (words, len(at), int(gain[at].sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel_noise(seed: int = SEED, scale: int = 1000) -> Column:
    """floor(-scale * ln(-ln(u))), u from the first 32 bits of sha256(seed:doc_id); a null doc_id as the empty string."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-float(scale)) * F.log(-F.log(u))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, n: int = RUN_WORDS, buckets: int = BUCKETS, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of docs: the draw of percent of the texts of min_words or more.

    score: weight and Gumbel noise, so that the highest scores are a draw without replacement by
    importance. rank: 1, 2, 3 ... over the rows drawn, by score, then doc_id (null last), then
    n_features and weight; null for the rest. A null text has no words, weight 0 and no rank;
    repeated rows are rows like any other; extra columns are left out; an empty table, or an
    empty target, gives the same columns (without target texts each bucket counts 0 there).

    The order is a range exchange of the figures alone, numbered in its partitions and shifted by
    their sizes (a row each); equal rows are parted by their place, so none of it is one task.
    """
    spark = docs.sparkSession
    gains = bucket_gains(bucket_counts(target, n, buckets), bucket_counts(docs, n, buckets))
    scored = importance_weights(docs, gains, n).withColumn("score", F.col("weight") + gumbel_noise(seed)).withColumn("short", F.col("n_words") < min_words)
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "importance")
    drawn = scored.where("NOT short").count() * percent // 100
    order = [F.asc("short"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("row")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = scored.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = written(placed.drop("row"), "importance-order")
    dropped(spark, scored)
    part = F.shiftright("place", 33)
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts = [(p, upto - n) for (p, n), upto in zip(sizes, accumulate(n for _, n in sizes), strict=True)]
    ahead = F.broadcast(spark.createDataFrame(starts, "part long, ahead long"))  # a row for each shuffle partition
    place = F.col("ahead") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    rank = F.when(~F.col("short") & (place <= drawn), place)
    return placed.withColumn("part", part).join(ahead, "part").select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


#: The checksums are folded byte by byte, each run from the state of the one that is a word shorter.
ORACLE = r"""WITH tab AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
  texts AS (SELECT true AS raw, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT false, -row_number() OVER (), item_id, text FROM benchmark),
  lists AS (SELECT raw, r, doc_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
  places AS (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM lists), runs AS (SELECT r, ws[i] AS c, CASE WHEN i > 1 THEN ws[i - 1] END AS b, CASE WHEN i > 2 THEN ws[i - 2] END AS a FROM places),
  vocab AS (SELECT c, list_transform(range(0, strlen(c)), lambda k: CAST('0x' || substr(hex(encode(c)), 2 * k + 1, 2) AS BIGINT)) AS bytes FROM (SELECT DISTINCT c FROM runs)),
  one AS (SELECT c, bytes, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1])) AS s FROM vocab, tab),
  two AS (SELECT p.b, p.c, list_reduce(list_prepend(x.s, list_prepend(32::BIGINT, y.bytes)), lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1])) AS s FROM (SELECT DISTINCT b, c FROM runs WHERE b IS NOT NULL) p JOIN one x ON x.c = p.b JOIN one y ON y.c = p.c, tab),
  three AS (SELECT p.a, p.b, p.c, list_reduce(list_prepend(x.s, list_prepend(32::BIGINT, y.bytes)), lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1])) AS s FROM (SELECT DISTINCT a, b, c FROM runs WHERE a IS NOT NULL) p JOIN two x ON x.b = p.a AND x.c = p.b JOIN one y ON y.c = p.c, tab),
  features AS (SELECT r, xor(s, 4294967295) % 10000 AS bucket FROM runs JOIN one USING (c) UNION ALL SELECT r, xor(s, 4294967295) % 10000 FROM runs JOIN two USING (b, c) UNION ALL SELECT r, xor(s, 4294967295) % 10000 FROM runs JOIN three USING (a, b, c)),
  sums AS (SELECT bucket, count(*) FILTER (r > 0) AS s, count(*) FILTER (r < 0) AS t FROM features GROUP BY bucket), totals AS (SELECT CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM sums),
  gains AS (SELECT bucket, CAST(floor(1000 * ln((sums.t + 1) * (totals.s + 10000) / ((sums.s + 1) * (totals.t + 10000)))) AS BIGINT) AS gain FROM sums, totals),
  weights AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM features JOIN gains USING (bucket) WHERE r > 0 GROUP BY r),
  scored AS (SELECT doc_id, len(ws) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM lists LEFT JOIN weights USING (r) WHERE raw),
  placed AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place, count(*) OVER (PARTITION BY words >= 20) AS able FROM scored)
  SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= able * 5 // 100 THEN place END AS rank FROM placed"""
