"""Substring dedup with suffix automata over shards of reference text.

One automaton over the whole corpus does not fit a machine, and streaming every document
past every shard would take time that grows with the square of the corpus. So texts are
sharded by content: of the five-word runs inside a window of 20 words the one with the
smallest hash is the window's anchor, and equal windows have equal anchors wherever they
stand. Consecutive windows with one anchor form a fragment. An anchor with one fragment in
the corpus has no repeated window. Equal fragments form a class: all but the first of a
class are removed whole. Where an anchor has several classes, the first fragments of each
go to the shard of their anchor and stream in document order past the shard's suffix
automaton, which gives for each word the longest run ending there that was seen before,
and are added to it. Windows whose run is long enough are the ones to remove.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import let_workers_import, mix64, range_hashes, run_hashes, text_chunks, word_hashes, word_spans, written

WINDOW = 20
ANCHOR_WORDS = 5
NO_ID = -(1 << 63)


class SuffixAutomaton:
    """Over words of many texts, grown word by word; longest() is the longest suffix of the text so far that was there before."""

    __slots__ = ("next", "link", "length", "last")

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def start(self) -> None:
        self.last = 0

    def _clone(self, p: int, q: int, word) -> int:
        copy = len(self.next)
        self.next.append(self.next[q].copy())
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, word) -> int:
        """Append a word; returns the length of the longest suffix that ended somewhere before."""
        p = self.last
        q = self.next[p].get(word)
        if q is not None:  # this suffix is known from a text before
            if self.length[q] != self.length[p] + 1:
                q = self._clone(p, q, word)
            self.last = q
            return self.length[q]
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[p] + 1)
        self.link.append(0)
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            if self.length[q] != self.length[p] + 1:
                q = self._clone(p, q, word)
            self.link[new] = q
        self.last = new
        return self.length[self.link[new]]


def anchored_runs(raw: np.ndarray, offsets: np.ndarray, window: int = WINDOW, k: int = ANCHOR_WORDS) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (text, first window, number of windows, anchor hash, hash of all their words)."""
    starts, ends, first = word_spans(raw, offsets)
    words = word_hashes(raw, starts, ends)
    grams = run_hashes(words, k)
    span = window - k + 1
    n = len(grams) - span + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    # the leftmost of the smallest, so equal windows have their anchor at equal places
    low, place, width = grams, np.arange(len(grams)), 1

    def halves(x: np.ndarray, step: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        return x[:size], x[step : step + size]

    while width * 2 <= span:
        (a, b), (pa_, pb) = halves(low, width, len(low) - width), halves(place, width, len(low) - width)
        low, place, width = np.minimum(a, b), np.where(b < a, pb, pa_), width * 2
    (a, b), (pa_, pb) = halves(low, span - width, n), halves(place, span - width, n)
    low, place = np.minimum(a, b), np.where(b < a, pb, pa_)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    valid = owner[:n] == owner[window - 1 : window - 1 + n]
    change = np.ones(n, bool)
    change[1:] = (place[1:] != place[:-1]) | ~valid[:-1] | (owner[1:n] != owner[: n - 1])
    heads = np.flatnonzero(change & valid)
    bounds = np.flatnonzero(change | ~valid)
    stops = np.append(bounds, n)[np.searchsorted(bounds, heads, side="right")]
    digest = range_hashes(words, heads, stops + window - 1).view(np.int64)
    return owner[heads], heads - first[owner[heads]], stops - heads, (low[heads] >> np.uint64(1)).view(np.int64), digest


#: A run is one long: 15 bits of the text's hash, 40 bits of its first window, 8 bits of how many windows.
#: The hash tells rows apart that share a doc_id.


def _base(docs: DataFrame) -> DataFrame:
    # no column can be null, so neither join adds a filter and both read one exchange
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.pmod(F.xxhash64(text), F.lit(1 << 15)), F.lit(0)).alias("part"), text.alias("text"))


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments as (anchor, digest, doc, run). Of equal fragments that meet here all but the
    first are settled; they get a negative anchor of their own, so no hot anchor gathers them."""

    def settled(parts: list) -> Iterator[pa.RecordBatch]:
        anchor, digest, doc, run = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((run, doc, digest, anchor))
        anchor, digest, doc, run = anchor[order], digest[order], doc[order], run[order]
        head = np.ones(len(anchor), bool)
        head[1:] = (anchor[1:] != anchor[:-1]) | (digest[1:] != digest[:-1])
        lead = np.flatnonzero(head)[np.cumsum(head) - 1]
        later = (doc != doc[lead]) | (run != run[lead])
        own = mix64(doc.view(np.uint64) * np.uint64(31) + run.view(np.uint64))
        anchor = np.where(later, (own | np.uint64(1 << 63)).view(np.int64), anchor)
        digest = np.where(later, 0, digest)
        for i in range(0, len(anchor), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 20_000]) for c in (anchor, digest, doc, run)], names=["anchor", "digest", "doc", "run"])

    for batch in batches:
        docs, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        parts, held = [], 0
        for lo, _, raw, offsets in text_chunks(batch.column(2)):
            text, begin, count, anchor, digest = anchored_runs(raw, offsets)
            if not len(text):
                continue
            own = lo + text
            parts.append((anchor, digest, docs[own], (prints[own] << 48) | (begin << 8) | count))
            held += len(text)
            if held > 250_000:
                yield from settled(parts)
                parts, held = [], 0
        if parts:
            yield from settled(parts)


def _fragment_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each open run: (anchor, doc, run, body)."""
    for batch in batches:
        out: list[tuple] = []
        for doc, text, runs in zip(*batch.columns, strict=True):
            words = text.as_py().encode().split()
            for one in runs.as_py():
                begin = (one["run"] >> 8) & ((1 << 40) - 1)
                out.append((one["anchor"], doc.as_py(), one["run"], b" ".join(words[begin : begin + (one["run"] & 255) + WINDOW - 1])))
            if len(out) > 20_000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["anchor", "doc", "run", "body"])


def _shard_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matching statistics per anchor; input sorted by (anchor, doc, run). Gives removed windows as runs."""
    anchor, automaton, before = None, SuffixAutomaton(), None
    for batch in batches:
        out: list[tuple] = []
        for own, doc, run, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != anchor:
                anchor, automaton, before = own, SuffixAutomaton(), None
            if (doc, run) != before:  # a repeated row is the same fragment again
                _stream(automaton, body, doc, run, out)
                before = doc, run
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc", "run"])


def _stream(automaton: SuffixAutomaton, body: bytes, doc: int, run: int, out: list) -> None:
    automaton.start()
    high, begin = run >> 48 << 48, (run >> 8) & ((1 << 40) - 1)
    found = None
    for i, word in enumerate(body.split(b" ")):
        if automaton.add(word) >= WINDOW:
            at = begin + i - WINDOW + 1
            if found is not None and found[0] + found[1] == at:
                found[1] += 1
            else:
                if found is not None:
                    out.append((doc, high | found[0] << 8 | found[1]))
                found = [at, 1]
    if found is not None:
        out.append((doc, high | found[0] << 8 | found[1]))


def _removed_mask(n: int, spans: list) -> np.ndarray:
    edges = np.zeros(n + 1, np.int64)
    runs = np.array(spans, np.int64)
    begin = (runs >> 8) & ((1 << 40) - 1)
    np.add.at(edges, begin, 1)
    np.subtract.at(edges, np.minimum(n, begin + (runs & 255) + WINDOW - 1), 1)
    return np.cumsum(edges[:n]) > 0


def removed_windows(docs: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Runs of windows to remove: (doc, run), a row per run."""
    let_workers_import(docs.sparkSession)
    base = base if base is not None else _base(docs).repartition("doc")
    runs = _base(docs).mapInArrow(_anchor_batches, "anchor long, digest long, doc long, run long").repartition("anchor")
    of_class, of_anchor = Window.partitionBy("anchor", "digest"), Window.partitionBy("anchor")
    runs = runs.withColumn("first", F.min(F.struct("doc", "run")).over(of_class))
    runs = runs.withColumn("low", F.min("digest").over(of_anchor)).withColumn("high", F.max("digest").over(of_anchor))
    later = F.expr("anchor < 0 OR struct(doc, run) > first")
    # text is fetched only for the first fragments of anchors with several classes; the rest is settled
    runs = written(runs.where(later | (F.col("low") != F.col("high"))).select("anchor", "doc", "run", later.alias("later")), "runs")
    open_runs = runs.where("NOT later").groupBy("doc", F.expr("shiftright(run, 48)").alias("part")).agg(F.collect_list(F.struct("anchor", "run")).alias("runs"))
    with_text = base.join(open_runs, ["doc", "part"]).select("doc", "text", "runs")
    fragments = with_text.mapInArrow(_fragment_batches, "anchor long, doc long, run long, body binary")
    shards = fragments.repartition("anchor").sortWithinPartitions("anchor", "doc", "run")
    return runs.where("later").select("doc", "run").unionByName(shards.mapInArrow(_shard_batches, "doc long, run long"))


def remove_repeated_spans(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 and, with keep_text, kept (the words left).

    Words are [^\\x20\\x09-\\x0D]+, unchanged; a null text has none. Every word is removed
    that a window of WINDOW words covers whose words also start earlier: in a smaller doc_id
    or earlier in the same document. A null doc_id is smaller than any other; rows that share
    a doc_id go by a hash of their text, and equal rows are one document with equal results.
    Texts with fewer words than a window stay as they are; other columns are ignored; an
    empty table gives an empty result.
    """
    base = _base(docs).repartition("doc")
    spans = removed_windows(docs, base).groupBy(F.col("doc").alias("_doc"), F.expr("shiftright(run, 48)").alias("_part")).agg(F.collect_list("run").alias("spans"))
    rows = base.join(spans, (F.col("doc") == F.col("_doc")) & (F.col("part") == F.col("_part")), "left").select("doc", "text", "spans")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digests, texts = [], [], [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                words = text.as_py().encode().split()
                gone = spans.as_py()
                kept = words
                if gone:
                    mask = _removed_mask(len(words), gone)
                    kept = [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
                body = b" ".join(kept)
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(body).hexdigest())
                if keep_text:
                    texts.append(body.decode())
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                columns.append(pa.array(texts, pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    done = rows.mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if keep_text else ""))
    return done.withColumn("doc_id", F.expr("nullif(doc_id, CAST(-9223372036854775808 AS BIGINT))"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20)),
dup AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM dup),
kept AS (
  SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.p) AS t, count(*) AS n
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d) a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.p = g.p
  WHERE g.p IS NULL GROUP BY a.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
