"""Quality by compression: zstandard dictionaries of good and of bad text.

A text compresses better with the dictionary of the class it resembles. The difference of
its two compressed sizes over the larger one is the raw signal; a logistic calibration on
that difference, the compressed share and the length (with their products) makes a score.
The calibration is cross-fitted: the labelled sample is dealt into two halves, and each half
is measured with the dictionaries of the other, as an unlabelled text will be.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, let_workers_import, text_chunks, written

#: The bounded sample that training takes: so many labelled rows of each class, whatever their
#: length; for a dictionary so many bytes of a class, and of each text every piece in turn
#: until TEXT_BYTES are met, spread over its whole length.
MAX_LABELLED = 4000
MAX_DICTIONARY_INPUT = 6 << 20
TEXT_BYTES = 1 << 16
DICTIONARY_BYTES = 112_640
LEVEL = 3
ACCEPT = 0.3


class Model(NamedTuple):
    """dictionaries: good, bad; centre, scale, weights: of the calibration; prior: the score without dictionaries."""

    dictionaries: tuple[bytes, bytes] | None
    centre: np.ndarray | None
    scale: np.ndarray | None
    weights: np.ndarray | None
    prior: float


def spread_pieces(text: bytes, limit: int = TEXT_BYTES, size: int = 2048) -> list[bytes]:
    """Pieces of size bytes of a text: all of them, or evenly spaced ones of a text above limit."""
    pieces, most = -(-len(text) // size), max(1, limit // size)
    return [text[at * size : (at + 1) * size] for at in (range(pieces) if pieces <= most else (i * pieces // most for i in range(most)))]


def _dictionary(pieces: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, k=256, d=8).as_bytes()
    except zstandard.ZstdError:  # too little text to train: the text itself is the dictionary
        return b"".join(pieces)[-DICTIONARY_BYTES:]


def compressors(dictionaries: tuple[bytes, bytes]) -> list[zstandard.ZstdCompressor]:
    out = []
    for content in dictionaries:
        own = zstandard.ZstdCompressionDict(content)
        own.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def compressed_sizes(texts: list[bytes], dictionaries: tuple[bytes, bytes]) -> np.ndarray:
    """Rows (size with the good dictionary, with the bad one, plain bytes)."""
    good, bad = compressors(dictionaries)
    return np.array([(len(good.compress(t)), len(bad.compress(t)), len(t)) for t in texts], dtype=float).reshape(-1, 3)


def features(sizes: np.ndarray) -> np.ndarray:
    good, bad, plain = sizes.T
    diff = (bad - good) / np.maximum(np.maximum(good, bad), 1)
    share = np.minimum(good, bad) / np.maximum(plain, 1)
    length = np.log1p(plain)
    return np.stack([np.ones(len(diff)), diff, diff**2, share, share**2, diff * share, length, length * share, length * diff, 1 / (share + 0.05)], axis=1)


def calibrated(sizes: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton's method."""
    x = features(sizes)
    centre, scale = x.mean(0), x.std(0)
    centre[0], scale[0] = 0, 1
    scale[scale == 0] = 1
    z, w = (x - centre) / scale, np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(len(w)), z.T @ (y - p) - 0.01 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, w


def score_sizes(sizes: np.ndarray, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip((features(sizes) - model.centre) / model.scale @ model.weights, -30, 30)))


def _sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int) -> tuple[DataFrame | None, float]:
    """(labelled rows _h, _y, _t, at most about MAX_LABELLED of each class; the share of label 1)."""
    key = F.col("doc_id").cast("long")
    known = (
        labels.select(key.alias("_id"), F.col(label).cast("int").alias("_y"))
        .where(f"_id IS NOT NULL AND _y IN (0, 1) AND crc32(CAST(_id AS STRING)) % {folds} <> {held_out}")
        .groupBy("_id").agg(F.max("_y").alias("_y"))
    )
    totals = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return None, float(next(iter(totals), 0.5))
    share = {y: int(min(1.0, MAX_LABELLED / n) * 1_000_000) for y, n in totals.items()}
    limit = F.expr(f"CASE _y WHEN 1 THEN {share[1]} ELSE {share[0]} END")
    picked = known.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < limit)
    # a doc_id on many rows: of its rows as many as would keep the class within its bound
    rows = docs.select(key.alias("_id"), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("_t"))
    rows = rows.join(F.broadcast(picked), "_id").withColumn("_h", F.xxhash64("_id", "_t", F.monotonically_increasing_id()))
    sample = written(rows, "quality")
    counts = {r["_y"]: r["n"] for r in sample.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if any(n > 2 * MAX_LABELLED for n in counts.values()):
        share = {y: int(min(1.0, MAX_LABELLED / counts.get(y, 1)) * 1_000_000) for y in (0, 1)}
        fewer = written(sample.where(F.pmod("_h", F.lit(1_000_000)) < F.expr(f"CASE _y WHEN 1 THEN {share[1]} ELSE {share[0]} END")), "quality")
        dropped(docs.sparkSession, sample)
        sample = fewer
    return sample, totals[1] / (totals[0] + totals[1])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held_out: int = 0) -> Model:
    """Fit on labelled rows whose crc32(doc_id as text) mod folds is not held_out.

    The sample is bounded by MAX_LABELLED rows of each class (their ids, at most 2 *
    MAX_LABELLED expected, may be broadcast) and MAX_DICTIONARY_INPUT bytes of each class and
    half; only those bytes, and three sizes a row, come to the driver.
    """
    sample, prior = _sample(docs, labels, label, folds, held_out)
    if sample is None:
        return Model(None, None, None, None, prior)
    let_workers_import(docs.sparkSession)
    half = F.pmod(F.shiftright("_h", 32), F.lit(2)).cast("int")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, *rest in zip(*(batch.column(i).to_pylist() for i in (3, 0, 1, 2)), strict=True):
                pieces = spread_pieces(text)
                yield pa.RecordBatch.from_arrays([*(pa.array([x] * len(pieces), k) for x, k in zip(rest, (pa.int64(), pa.int32(), pa.int32()), strict=True)), pa.array(pieces, pa.binary())], names=["_h", "_y", "_half", "_p"])

    pieces = sample.select("_h", "_y", half.alias("_half"), "_t").mapInArrow(cut, "_h long, _y int, _half int, _p binary")
    totals = {(r["_y"], r["_half"]): r["n"] for r in pieces.groupBy("_y", "_half").agg(F.sum(F.octet_length("_p")).alias("n")).collect()}
    most = {k: int(min(1.0, MAX_DICTIONARY_INPUT / 2 / max(1, n)) * 1_000_000) for k, n in totals.items()}
    limit = F.expr("CASE " + " ".join(f"WHEN _y = {y} AND _half = {h} THEN {n}" for (y, h), n in most.items()) + " ELSE 0 END") if most else F.lit(0)
    got = sorted(pieces.where(F.pmod(F.xxhash64("_h", "_p"), F.lit(1_000_000)) < limit).collect(), key=lambda r: (r["_h"], r["_p"]))
    of = lambda y, halves: [bytes(r["_p"]) for r in got if r["_y"] == y and r["_half"] in halves]
    if not of(0, (0, 1)) or not of(1, (0, 1)):
        dropped(docs.sparkSession, sample)
        return Model(None, None, None, None, prior)
    whole = tuple(_dictionary(of(y, (0, 1))) for y in (1, 0))
    crossed = all(of(y, (h,)) for y in (0, 1) for h in (0, 1))
    others = [tuple(_dictionary(of(y, (1 - h,))) for y in (1, 0)) for h in (0, 1)] if crossed else [whole, whole]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [compressors(d) for d in others]
        for batch in batches:
            sizes = [(len(pairs[h][0].compress(t)), len(pairs[h][1].compress(t)), len(t)) for h, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in np.array(sizes, float).reshape(-1, 3).T)], names=["_y", "g", "b", "n"])

    rows = sorted(sample.select("_y", half.alias("_half"), "_t").mapInArrow(measured, "_y int, g double, b double, n double").collect())
    dropped(docs.sparkSession, sample)
    # each class weighs as in all labelled rows, though the sample bounds both alike
    y, s = np.array([r["_y"] for r in rows], float), np.array([r[1:4] for r in rows], float)
    centre, scale, weights = calibrated(s, y)
    seen = y.mean()
    if 0 < seen < 1:
        weights[0] += np.log(prior / (1 - prior)) - np.log(seen / (1 - seen))
    return Model(whole, centre, scale, weights, prior)


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score) for every row of docs, from the text alone.

    A null text counts as empty and is scored like any other. Repeated rows keep one result
    row each and score alike; other columns of docs are ignored; an empty table gives an
    empty result. Without labels of both classes every score is the share of label 1 (0.5
    without any label).
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scorer(docs, model), "doc_id long, score double")


def _scorer(docs: DataFrame, model: Model):
    spark = docs.sparkSession
    let_workers_import(spark)
    shared = spark.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        pair = compressors(model.dictionaries) if model.dictionaries else None
        for batch in batches:
            parts = [np.zeros(0)]
            for lo, hi, raw, offsets in text_chunks(batch.column(1)):
                if pair is None:
                    parts.append(np.full(hi - lo, model.prior))
                    continue
                view = memoryview(np.ascontiguousarray(raw))
                sizes = [(len(pair[0].compress(t)), len(pair[1].compress(t)), len(t)) for t in (view[offsets[i] : offsets[i + 1]] for i in range(hi - lo))]
                parts.append(score_sizes(np.array(sizes, float).reshape(-1, 3), model))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts))], names=["doc_id", "score"])

    return run


def keep_good(docs: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """The rows of docs with a score of accept or more, with their columns as they are, without a shuffle.

    Null and empty texts are scored like any other; repeated rows stay or go alike; columns of
    any name pass through; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    let_workers_import(spark)
    shared = spark.sparkContext.broadcast(tuple(model))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        pair = compressors(model.dictionaries) if model.dictionaries else None
        for batch in batches:
            texts = [t.encode() for t in batch.column(at).fill_null("").to_pylist()]
            if pair is None:
                keep = np.full(len(texts), model.prior >= accept)
            else:
                sizes = np.array([(len(pair[0].compress(t)), len(pair[1].compress(t)), len(t)) for t in texts], float).reshape(-1, 3)
                keep = score_sizes(sizes, model) >= accept
            yield batch.filter(pa.array(keep, pa.bool_()))

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
