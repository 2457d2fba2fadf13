"""Language identification by mixture inference.

Each language has a character trigram distribution learnt from labelled documents. A
document is a mixture: every word is drawn from one of its languages. Expectation
maximisation estimates the document's language proportions from the words' likelihoods; of
the nested sets of its languages by proportion, the one with the best penalised likelihood
is its language set, and the largest proportion in that set the prediction.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import let_workers_import, text_chunks

TABLE_BITS = 17
#: Values (letters or words x languages) that inference holds at a time, besides the words of a single long text.
BLOCK_VALUES = 1 << 23
SMOOTHING = 0.1
ROUNDS = 8
#: Cost of one more language, besides half the logarithm of the number of words.
PENALTY = 3.0


class Model(NamedTuple):
    languages: list[str]
    bits: int
    log_probability: np.ndarray  # slots x languages, float32


_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def trigram_slots(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lower-cased texts: the slot of the trigram that ends at each letter, where
    words (runs of letters) begin among them, and the document of each word."""
    lowered = [t.lower() for t in texts]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered)))
    codes = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = letter_table()[codes]
    c = np.where(inside, codes, 0).astype(np.uint64)
    p1 = np.concatenate([[0], c[:-1]]).astype(np.uint64)
    p2 = np.where(p1 == 0, 0, np.concatenate([[0], p1[:-1]])).astype(np.uint64)
    at = np.flatnonzero(inside)
    mixed = (c[at] * np.uint64(0x9E3779B97F4A7C15)) ^ (p1[at] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (p2[at] * np.uint64(0x165667B19E3779F9))
    slots = ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64)
    begins = np.flatnonzero(p1[at] == 0)
    return slots, begins, np.searchsorted(ends, at[begins], side="right")


def mixture(likelihood: np.ndarray, first: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """EM for many documents at once. likelihood: words x languages; first: each document's
    first word (no document empty); allowed: documents x languages. Gives the proportions
    and each document's log-likelihood (less what likelihood was scaled by)."""
    counts = np.diff(np.append(first, len(likelihood)))[:, None]
    share = (allowed / allowed.sum(1, keepdims=True)).astype(np.float32)
    for _ in range(rounds):
        weight = likelihood * np.repeat(share, counts[:, 0], axis=0)
        weight /= weight.sum(1, keepdims=True) + np.float32(1e-30)
        share = (np.add.reduceat(weight, first, axis=0) / counts).astype(np.float32)
    total = np.log((likelihood * np.repeat(share, counts[:, 0], axis=0)).sum(1) + np.float32(1e-30), dtype=np.float64)
    return share, np.add.reduceat(total, first)


def infer(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(proportions documents x languages of the chosen set, predicted index or -1, its proportion)."""
    n, k = len(texts), len(model.languages)
    shares, best, score = np.zeros((n, k), np.float32), np.full(n, -1), np.zeros(n)
    slots, begins, owner = trigram_slots(texts, model.bits)
    if not len(begins) or not k:
        return shares, best, score
    words = np.empty((len(begins), k), np.float32)
    ends, lo = np.append(begins[1:], len(slots)), 0
    while lo < len(begins):  # bounded pieces of whole words, as the letters take 4 bytes a language each
        hi = max(lo + 1, int(np.searchsorted(ends, begins[lo] + BLOCK_VALUES // k, side="right")))
        words[lo:hi] = np.add.reduceat(model.log_probability[slots[begins[lo] : ends[hi - 1]]], begins[lo:hi] - begins[lo], axis=0)
        lo = hi
    docs, first, counts = np.unique(owner, return_index=True, return_counts=True)
    alone = np.add.reduceat(words, first, axis=0, dtype=np.float64)  # log-likelihood of each language on its own
    top = words.max(1, keepdims=True)
    likelihood = np.exp(words - top)
    base = np.add.reduceat(top[:, 0], first, dtype=np.float64)
    share, _ = mixture(likelihood, first, np.ones((len(docs), k), bool))
    order = np.argsort(-share, axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    penalty = PENALTY + 0.5 * np.log(counts)
    one = order[:, 0]
    chosen = np.zeros_like(share)
    chosen[np.arange(len(docs)), one] = 1
    value = alone[np.arange(len(docs)), one]
    # sets of two and more: only where the smaller proportions come to at least half a word
    more = np.flatnonzero(np.sort(share, axis=1)[:, -2] * counts >= 0.5) if k > 1 else np.zeros(0, int)
    for size in range(2, k + 1):
        more = more[(share[more, order[more, size - 1]] * counts[more]) >= 0.5]
        if not len(more):
            break
        lengths = counts[more]
        at = np.repeat(first[more] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        own, ll = mixture(likelihood[at], np.concatenate([[0], np.cumsum(lengths)[:-1]]), rank[more] < size)
        ll = ll + base[more] - penalty[more] * (size - 1)
        better = ll > value[more]
        value[more[better]] = ll[better]
        chosen[more[better]] = own[better]
    shares[docs] = chosen
    best[docs] = chosen.argmax(1)
    score[docs] = np.clip(chosen.max(1), 0, 1)
    return shares, best, score


def learn(docs: DataFrame, folds: int = 4, held_out: int = 2) -> Model:
    """Trigram counts over all texts with a language whose crc32(doc_id as text) mod folds is not held_out.

    Counted in the tasks and summed by a shuffle; what reaches the driver is bounded by
    languages x 2 ** TABLE_BITS counts.
    """
    spark = docs.sparkSession
    let_workers_import(spark)
    used = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    used = used.where(f"lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL AND crc32(CAST(doc_id AS STRING)) % {folds} <> {held_out}")
    languages = [r[0] for r in used.select("lang").distinct().orderBy("lang").collect()]
    bits = TABLE_BITS

    def flushed(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, count in sums.items():
            at = np.flatnonzero(count)
            for i in range(0, len(at), 10_000):
                own = at[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(own)), pa.array(own), pa.array(count[own])], names=["lang", "slot", "n"])
        sums.clear()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            for lo, hi, raw, offsets in text_chunks(batch.column(1)):
                own = names[lo:hi]
                for name in set(own):
                    texts = [raw[offsets[i] : offsets[i + 1]].tobytes().decode() for i in np.flatnonzero(own == name)]
                    slots = trigram_slots(texts, bits)[0]
                    got = np.bincount(slots, minlength=1 << bits)
                    sums[name] = sums[name] + got if name in sums else got
                    if len(sums) * len(got) > BLOCK_VALUES:
                        yield from flushed(sums)
        yield from flushed(sums)

    sums = used.select("lang", "text").mapInArrow(counted, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    counts = np.zeros((1 << bits, len(languages)))
    place = {name: i for i, name in enumerate(languages)}
    got = sums.toArrow()
    where = np.array([place[x] for x in got.column("lang").to_pylist()], int)
    counts[got.column("slot").to_numpy(), where] = got.column("n").to_numpy()
    log_p = np.log((counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * len(counts)))
    return Model(languages, bits, log_p.astype(np.float32))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, lang_pred, score, languages) for every row of docs, from the text alone.

    languages maps each language of the chosen set to its proportion. A text that is null
    or has no letter gets `und`, score 0 and an empty map; so does every text when no
    language was learnt. Repeated rows keep one result row each; other columns of docs are
    ignored; an empty table gives an empty result. Equal proportions go to the language
    that comes first in code-point order.
    """
    spark = docs.sparkSession
    let_workers_import(spark)
    shared = spark.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        names = np.array([*model.languages, "und"], dtype=object)
        limit = min(1 << 20, max(1, BLOCK_VALUES // max(1, len(model.languages))))
        for batch in batches:
            got = []
            for lo, hi, raw, offsets in text_chunks(batch.column(1), limit):
                got.append(infer([raw[offsets[i] : offsets[i + 1]].tobytes().decode() for i in range(hi - lo)], model))
            if not got:
                continue
            shares, best, score = (np.concatenate(x) for x in zip(*got, strict=True))
            maps = [[(names[j], float(s[j])) for j in np.flatnonzero(s)] for s in shares]
            arrays = [batch.column(0), pa.array(names[best], pa.string()), pa.array(score), pa.array(maps, pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "lang_pred", "score", "languages"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, languages map<string,double>")
