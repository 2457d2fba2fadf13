"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as two vectors: one of its own (hashed words) and one of its characters (the sum of
hashed runs of three and four bytes, word ends included, over the square root of their number), so
that a word never seen is judged by its spelling. Two gated units read a window of words from
either end; attention weighs the states at each word, and the weighted state gives the window's
logit. Every text is read in overlapping windows to its end; its highest window and the number of
windows make the score, by a calibration on rows that training did not see.

Labels are of texts, not of windows. Training takes every window of a toxic text for toxic first;
after each round only those windows of it stay that the network then finds toxic, or its highest.
Of the many windows of clean texts a round takes as many as of toxic ones: at first by chance, then
those that the network finds most toxic, with half as many more by chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import _sample
from .shared import dropped, let_workers_import, text_chunks, word_hashes, word_spans

WINDOW, STRIDE = 32, 20
WORD_ROWS, CHAR_ROWS, WORD_DIM, CHAR_DIM, UNITS = 8192, 65536, 8, 12, 8
#: The bounded sample that training takes: labelled texts of at most TEXT_BYTES, so many bytes of class 0 and of class 1.
TEXT_BYTES, CLASS_BYTES = 1 << 15, (12 << 20, 3 << 20)
#: Passes of each round over its windows (some more than once to reach LEAST_WINDOWS), and what training needs besides.
ROUNDS, LEAST_WINDOWS, LEAST_BATCH, BATCH, RATE, WORD_DROP, DECAY = (1, 1), 20_000, 64, 512, 0.01, 0.3, 0.2
#: A word has a vector of its own from so many training texts on.
LEAST_TEXTS = 4
#: Windows that are scored at a time.
STEP_WINDOWS = 4096
ACCEPT = 0.3

#: A-Z to a-z; digits, a-z and all bytes of other characters than ASCII stay; the rest parts words.
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


class Words(NamedTuple):
    """words: of each text in turn, as numbers of distinct words; firsts: the first of each text (n + 1); own: the row
    of each distinct word; grams, cuts: its rows of characters, from cuts[i] to cuts[i + 1]."""

    words: np.ndarray
    firsts: np.ndarray
    own: np.ndarray
    grams: np.ndarray
    cuts: np.ndarray


class Model(NamedTuple):
    """net: the arrays of the network; calibration: centre and scale of the features, weights; prior: the score without a network."""

    net: dict[str, np.ndarray] | None
    calibration: tuple[np.ndarray, np.ndarray, np.ndarray] | None
    prior: float


def read_words(raw: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of texts (UTF-8 bytes and offsets), lower-cased in A-Z, parted by all other ASCII than letters and digits."""
    folded = _FOLD[raw]
    starts, ends, firsts = word_spans(folded, offsets)
    hashes, first_at, words = np.unique(word_hashes(folded, starts, ends), return_index=True, return_inverse=True)
    lengths = (ends - starts)[first_at]
    # the distinct words between spaces: " one two "
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1] + 1
    size = int(lengths.sum() + len(lengths) + 1)
    line = np.full(size + 3, 32, np.uint32)
    inside = np.repeat(starts[first_at] - begins, lengths) + (spots := np.repeat(begins, lengths) + _steps(lengths))
    line[spots] = folded[inside]
    three = line[:-2] | line[1:-1] << np.uint32(8) | line[2:] << np.uint32(16)
    four = three[:-1] | line[3:] << np.uint32(24)
    # of a word of n bytes n runs of three and n - 1 of four, one space on either side taken in
    both = 2 * lengths - 1
    cuts = np.concatenate([[0], np.cumsum(both)])
    step = _steps(both)
    is_four = step >= np.repeat(lengths, both)
    at = np.repeat(begins - 1, both) + np.where(is_four, step - np.repeat(lengths, both), step)
    runs = np.where(is_four, four[at], three[at]) if len(at) else np.zeros(0, np.uint32)
    grams = (runs * np.uint32(2654435761) ^ is_four.astype(np.uint32) << np.uint32(31)) >> np.uint32(12)
    return Words(words.astype(np.int32), firsts, (hashes % np.uint64(WORD_ROWS)).astype(np.int64), grams.astype(np.int64) % CHAR_ROWS, cuts)


def _steps(lengths: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each n of lengths, one after the other."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def window_starts(firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of every window: from each STRIDE-th word until the end is read; one empty window of a text without words."""
    sizes = np.diff(firsts)
    many = np.maximum(1, -(-(sizes - (WINDOW - STRIDE)) // STRIDE))
    text = np.repeat(np.arange(len(sizes)), many)
    begin = firsts[:-1][text] + _steps(many) * STRIDE
    return text, begin, np.minimum(WINDOW, firsts[1:][text] - begin)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _char_sums(table: np.ndarray, grams: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Of each word the sum of its rows of characters over the square root of their number; no word is without rows."""
    if len(cuts) < 2:
        return np.zeros((0, table.shape[1]), np.float32)
    return np.add.reduceat(table[grams], cuts[:-1], axis=0) / np.sqrt(np.diff(cuts))[:, None].astype(np.float32)


def word_inputs(net: dict[str, np.ndarray], own: np.ndarray, grams: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.concatenate([net["word"][own], _char_sums(net["char"], grams, cuts)], axis=1)


def gated_states(net: dict[str, np.ndarray], table: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (2, T, B, UNITS) after each word, of the reading from the start and of that from the end.

    table: what distinct words add to the three gates (2, words, 3 * UNITS); at, mask: the word at
    each place of the windows (T, B) and whether there is one. keep takes what training needs.
    """
    long, wide = at.shape
    h = np.zeros((2, wide, UNITS), np.float32)
    states = np.empty((2, long, wide, UNITS), np.float32)
    u = UNITS
    for t in range(long):
        back = long - 1 - t
        x = np.stack([table[0][at[t]], table[1][at[back]]])
        y = h @ net["u"]
        gates = _sigmoid(x[..., : 2 * u] + y[..., : 2 * u])
        z, r = gates[..., :u], gates[..., u:]
        n = np.tanh(x[..., 2 * u :] + r * y[..., 2 * u :])
        live = np.stack([mask[t], mask[back]])[..., None]
        new = np.where(live, n + z * (h - n), h)
        if keep is not None:
            keep.append((h, y[..., 2 * u :], z, r, n, live))
        h = new
        states[0, t], states[1, back] = h[0], h[1]
    return states


def pooled(net: dict[str, np.ndarray], states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(logits, attention (T, B), weighted states (2, B, UNITS)); a window without words has the logit of its constant."""
    energy = np.einsum("dtbu,du->tb", states, net["attend"]) + np.where(mask, 0, -1e9).astype(np.float32)
    energy = np.exp(energy - energy.max(0)) * mask
    share = energy / np.maximum(energy.sum(0), 1e-9)
    context = np.einsum("tb,dtbu->dbu", share, states)
    return np.einsum("dbu,du->b", context, net["out"]) + net["bias"][0], share, context


def _placed(words: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = begin + np.arange(WINDOW)[:, None]
    mask = np.arange(WINDOW)[:, None] < size
    return (words[np.minimum(at, len(words) - 1)] if len(words) else np.zeros(at.shape, np.int32)), mask


def window_logits(net: dict[str, np.ndarray], read: Words, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    table = word_inputs(net, read.own, read.grams, read.cuts) @ net["w"] + net["b"][:, None]
    if not table.shape[1]:
        table = np.zeros((2, 1, 3 * UNITS), np.float32)
    out = [np.zeros(0, np.float32)]
    for lo in range(0, len(begin), STEP_WINDOWS):
        at, mask = _placed(read.words, begin[lo : lo + STEP_WINDOWS], size[lo : lo + STEP_WINDOWS])
        out.append(pooled(net, gated_states(net, table, at, mask), mask)[0])
    return np.concatenate(out)


def gradients(net: dict[str, np.ndarray], read: Words, begin: np.ndarray, size: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """(weighted cross-entropy, its gradients) over windows; with rng, WORD_DROP of the distinct words lose their own vector."""
    at, mask = _placed(read.words, begin, size)
    used, at = np.unique(at, return_inverse=True)
    at = at.reshape(mask.shape)
    lengths = np.diff(read.cuts)[used]
    grams = read.grams[np.repeat(read.cuts[used], lengths) + _steps(lengths)]
    cuts = np.concatenate([[0], np.cumsum(lengths)])
    x = word_inputs(net, read.own[used], grams, cuts)
    held = np.ones(len(used), np.float32) if rng is None else (rng.random(len(used)) >= WORD_DROP).astype(np.float32)
    x[:, :WORD_DIM] *= held[:, None]
    table = x @ net["w"] + net["b"][:, None]
    keep: list = []
    states = gated_states(net, table, at, mask, keep)
    logits, share, context = pooled(net, states, mask)
    p = _sigmoid(logits)
    loss = float(-(weight * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / weight.sum())

    g = {k: np.zeros_like(v) for k, v in net.items()}
    d_logit = (weight * (p - y) / weight.sum()).astype(np.float32)
    g["bias"][0] = d_logit.sum()
    g["out"] = np.einsum("b,dbu->du", d_logit, context)
    d_context = d_logit[:, None] * net["out"][:, None]
    d_share = np.einsum("dtbu,dbu->tb", states, d_context)
    d_energy = share * (d_share - (share * d_share).sum(0))
    g["attend"] = np.einsum("tb,dtbu->du", d_energy, states)
    d_states = share[None, ..., None] * d_context[:, None] + d_energy[None, ..., None] * net["attend"][:, None, None]
    u, long = UNITS, len(at)
    d_table = np.zeros_like(table)
    d_h = np.zeros_like(keep[0][0])
    d_gates = np.empty((2, long, at.shape[1], 3 * u), np.float32)
    for t in reversed(range(long)):
        h, yn, z, r, n, live = keep[t]
        back = long - 1 - t
        d_h = d_h + np.stack([d_states[0, t], d_states[1, back]])
        d_new = d_h * live
        d_n = d_new * (1 - z) * (1 - n * n)
        d_z = d_new * (h - n) * z * (1 - z)
        d_r = d_n * yn * r * (1 - r)
        d_y = np.concatenate([d_z, d_r, d_n * r], axis=-1)
        g["u"] += h.transpose(0, 2, 1) @ d_y
        d_gates[0, t], d_gates[1, back] = np.concatenate([d_z[0], d_r[0], d_n[0]], axis=-1), np.concatenate([d_z[1], d_r[1], d_n[1]], axis=-1)
        d_h = d_h * (1 - live) + d_new * z + d_y @ net["u"].transpose(0, 2, 1)
    order = np.argsort(at, axis=None, kind="stable")
    edges = np.flatnonzero(np.diff(at.ravel()[order], prepend=-1))
    for d in (0, 1):
        d_table[d] = np.add.reduceat(d_gates[d].reshape(-1, 3 * u)[order], edges, axis=0)
    g["b"] = d_table.sum(1)
    g["w"] = x.T @ d_table
    d_x = (d_table @ net["w"].transpose(0, 2, 1)).sum(0)
    own = read.own[used]
    d_own = d_x[:, :WORD_DIM] * held[:, None]
    d_char = np.repeat(d_x[:, WORD_DIM:] / np.sqrt(lengths)[:, None], lengths, axis=0)
    g["word"] = np.stack([np.bincount(own, d_own[:, i], WORD_ROWS) for i in range(WORD_DIM)], axis=1).astype(np.float32)
    g["char"] = np.stack([np.bincount(grams, d_char[:, i], CHAR_ROWS) for i in range(CHAR_DIM)], axis=1).astype(np.float32)
    return loss, g


def fresh_net(rng: np.random.Generator) -> dict[str, np.ndarray]:
    wide = WORD_DIM + CHAR_DIM
    made = {
        "word": rng.normal(0, 0.02, (WORD_ROWS, WORD_DIM)), "char": rng.normal(0, 0.05, (CHAR_ROWS, CHAR_DIM)),
        "w": rng.normal(0, wide**-0.5, (2, wide, 3 * UNITS)), "u": rng.normal(0, UNITS**-0.5, (2, UNITS, 3 * UNITS)), "b": np.zeros((2, 3 * UNITS)),
        "attend": rng.normal(0, 0.5, (2, UNITS)), "out": rng.normal(0, 0.5, (2, UNITS)), "bias": np.zeros(1),
    }
    return {k: v.astype(np.float32) for k, v in made.items()}


def own_rows(read: Words) -> np.ndarray:
    """Which rows of hashed words stand in LEAST_TEXTS texts or more; rarer ones say more of their text than of the class."""
    text = np.repeat(np.arange(len(read.firsts) - 1), np.diff(read.firsts))
    pairs = np.unique(text * WORD_ROWS + read.own[read.words])
    return np.bincount(pairs % WORD_ROWS, minlength=WORD_ROWS) >= LEAST_TEXTS


def fit_network(read: Words, y: np.ndarray, seed: int = 0, rounds: tuple[int, ...] = ROUNDS) -> dict[str, np.ndarray]:
    """A network trained by Adam on the windows of labelled texts; between rounds the toxic texts' windows are judged anew."""
    rng = np.random.default_rng(seed)
    net = fresh_net(rng)
    text, begin, size = window_starts(read.firsts)
    label = y[text].astype(np.float32)
    known = own_rows(read)
    net["word"][~known] = 0
    toxic, clean = np.flatnonzero(label > 0), np.flatnonzero(label == 0)
    chosen = rng.permutation(clean)[: len(toxic)]
    first = {k: np.zeros_like(v) for k, v in net.items()}
    second = {k: np.zeros_like(v) for k, v in net.items()}
    passes, step = 0, 0
    for count in rounds:
        used = np.concatenate([toxic, chosen])
        weight = np.where(label > 0, 0.5 * len(used) / len(toxic), 0.5 * len(used) / len(chosen)).astype(np.float32)
        for _ in range(count):
            order = np.concatenate([rng.permutation(used) for _ in range(1 + LEAST_WINDOWS // len(used))])
            rate = RATE * (1 - passes / sum(rounds))
            passes += 1
            batch = int(np.clip(len(used) // 16, LEAST_BATCH, BATCH))  # few windows need more steps
            for lo in range(0, len(order), batch):
                rows = order[lo : lo + batch]
                _, g = gradients(net, read, begin[rows], size[rows], label[rows], weight[rows], rng)
                g["word"][~known] = 0
                step += 1
                norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                scale = rate * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                for k, v in g.items():
                    v = v / max(1.0, norm)
                    first[k] += 0.1 * (v - first[k])
                    second[k] += 0.001 * (v * v - second[k])
                    net[k] -= (scale * first[k] / (np.sqrt(second[k]) + 1e-8) + rate * DECAY * net[k]).astype(np.float32)
        logits = window_logits(net, read, begin, size)
        best = np.full(len(y), -np.inf, np.float32)
        np.maximum.at(best, text, logits)
        toxic = np.flatnonzero((label > 0) & ((logits > 0) | (logits == best[text])))
        hard = clean[np.argsort(-logits[clean], kind="stable")[: len(toxic)]]
        chosen = np.union1d(hard, rng.permutation(clean)[: len(toxic) // 2])
    return net


def text_features(net: dict[str, np.ndarray], read: Words) -> np.ndarray:
    """Of each text (1, its highest window's logit, the logarithm of its windows)."""
    text, begin, size = window_starts(read.firsts)
    logits = window_logits(net, read, begin, size)
    n = len(read.firsts) - 1
    best = np.full(n, -np.inf)
    np.maximum.at(best, text, logits)
    return np.stack([np.ones(n), best, np.log(np.bincount(text, minlength=n))], axis=1) if n else np.zeros((0, 3))


def calibrate(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton's method, its constant set to the share of label 1 among all labels."""
    centre, scale = x.mean(0), x.std(0)
    centre[0], scale[0] = 0, 1
    scale[scale == 0] = 1
    z, w = (x - centre) / scale, np.zeros(x.shape[1])
    ridge = np.array([0, 0.5, 0.5])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-6), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    seen = y.mean()
    w[0] += np.log(prior / (1 - prior)) - np.log(seen / (1 - seen))
    return centre, scale, w


def _joined(texts: list[bytes]) -> Words:
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return read_words(np.frombuffer(b"".join(texts), np.uint8), offsets)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held_out: int = 2) -> Model:
    """Fit on labelled rows whose crc32(doc_id as text) mod folds is not held_out.

    The sample is bounded by quality.MAX_LABELLED rows of each class, by TEXT_BYTES a text and
    CLASS_BYTES of a class (a fixed share of the rows by a hash); it comes to the driver. Four fifths
    train the network, the rest calibrates it. Without labels of both classes there is no network.
    """
    sample, prior = _sample(docs, labels, label, folds, held_out)
    if sample is None:
        return Model(None, None, prior)
    fit = sample.withColumn("_n", F.octet_length("_t")).where(F.col("_n") <= TEXT_BYTES)
    totals = {r["_y"]: r["n"] for r in fit.groupBy("_y").agg(F.sum("_n").alias("n")).collect()}
    share = {y: int(min(1.0, CLASS_BYTES[y] / max(1, n)) * 1_000_000) for y, n in totals.items()}
    limit = F.expr(f"CASE _y WHEN 1 THEN {share.get(1, 0)} ELSE {share.get(0, 0)} END")
    rows = fit.where(F.pmod(F.xxhash64("_h"), F.lit(1_000_000)) < limit).select("_h", "_y", "_t").collect()
    dropped(docs.sparkSession, sample)
    rows = sorted((r["_h"], r["_y"], bytes(r["_t"])) for r in rows)
    parts = [[r for i, r in enumerate(sorted(rows, key=lambda r: r[1])) if (i % 5 == 4) == rest] for rest in (False, True)]
    if any({r[1] for r in part} != {0, 1} for part in parts):
        return Model(None, None, prior)
    learn, check = parts
    net = fit_network(_joined([r[2] for r in learn]), np.array([r[1] for r in learn], np.float32))
    x = text_features(net, _joined([r[2] for r in check]))
    return Model(net, calibrate(x, np.array([r[1] for r in check], float), prior), prior)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of docs, from all overlapping windows of its whole text, without a shuffle.

    A null text counts as empty; a text without words is one empty window. Repeated rows keep a row
    each and score alike; other columns are left out; an empty table gives an empty result. Without
    labels of both classes every score is the share of label 1 (0.5 without any label).
    """
    spark = docs.sparkSession
    let_workers_import(spark)
    shared = spark.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            parts = [np.zeros(0)]
            for lo, hi, raw, offsets in text_chunks(batch.column(1)):
                if model.net is None:
                    parts.append(np.full(hi - lo, model.prior))
                    continue
                centre, scale, w = model.calibration
                parts.append(1 / (1 + np.exp(-np.clip((text_features(model.net, read_words(raw, offsets)) - centre) / scale @ w, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
