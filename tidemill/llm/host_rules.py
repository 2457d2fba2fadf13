"""Quality rules with host verdicts: rule failures by domain, shrunk rates, verdicts joined back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import let_workers_import, mix64, run_hashes, text_chunks, word_hashes, word_spans, written

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW_WORDS = 8
#: A host whose shrunk failure rate is above this loses its remaining documents too.
MAX_HOST_RATE = 0.5
#: Strength of the prior in documents, where hosts differ less than chance would have it, or more than the data can tell.
STRENGTH = (1.0, 1e6)
BROADCAST_HOSTS = 200_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SCHEMA = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _dup_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip():
            seen.add(line)
    return n


def repeat_words(words: np.ndarray, first: np.ndarray, width: int = WINDOW_WORDS) -> np.ndarray:
    """Words of each text that lie in a window of width words found at least twice in that text."""
    n_docs = len(first) - 1
    hashes = run_hashes(words, width)
    if not len(hashes):
        return np.zeros(n_docs, np.int64)
    owner = np.repeat(np.arange(n_docs), np.diff(first))
    valid = np.flatnonzero(owner[: len(hashes)] == owner[width - 1 :])
    keys = mix64(hashes[valid] + owner[valid].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = valid[twice]
    edges = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + width, minlength=len(words) + 1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edges)[: len(words)] > 0)])
    return covered[first[1:]] - covered[first[:-1]]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = []
        for lo, hi, raw, offsets in text_chunks(batch.column(2)):
            starts, ends, first = word_spans(raw, offsets)
            runs = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
            inside = np.zeros(len(raw) + 1, np.int8)
            np.add.at(inside, starts, 1)
            np.subtract.at(inside, ends, 1)
            in_word = np.cumsum(inside[:-1]) > 0
            got.append((
                np.diff(first), runs(in_word & ((raw & 0xC0) != 0x80)), runs(_SYMBOL[raw]),
                np.array([_dup_lines(raw[offsets[i] : offsets[i + 1]].tobytes()) for i in range(hi - lo)], np.int64),
                repeat_words(word_hashes(raw, starts, ends), first),
            ))
        if got:
            columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*got, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=[f.split()[0] for f in _SCHEMA.split(", ")])


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the counts of every row of docs; see apply_host_rules."""
    let_workers_import(docs.sparkSession)
    where = F.col(host).cast("string") if host in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), where.alias("host"), F.col("text").cast("string").alias("text")).mapInArrow(_measure, _SCHEMA)


def host_of_url(url) -> F.Column:
    """Lower-cased host name of a URL column; null where there is none."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def prior(hosts: DataFrame) -> tuple[float, float]:
    """Beta prior (a, b) of the hosts' failure rates by the method of moments, hosts weighing as their documents."""
    t = hosts.agg(F.sum("n").alias("n"), F.sum("f").alias("f"), F.count("*").alias("k")).first()
    if not t["n"]:
        return 0.5, 0.5
    m = t["f"] / t["n"]
    if m <= 0 or m >= 1:
        return m + 1e-6, 1 - m + 1e-6
    v = hosts.agg((F.sum(F.col("n") * (F.col("f") / F.col("n") - F.lit(m)) * (F.col("f") / F.col("n") - F.lit(m))) / F.sum("n")).alias("v")).first()["v"]
    between = v - m * (1 - m) * t["k"] / t["n"]
    strength = min(max(m * (1 - m) / between - 1, STRENGTH[0]), STRENGTH[1]) if between > 0 else STRENGTH[1]
    return m * strength, (1 - m) * strength


def apply_host_rules(docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate, kept.

    A document fails the base rules with fewer than MIN_WORDS words or with more than
    MAX_REPEAT_PERCENT of its words in repeated windows. A host's rate is (failures + a) /
    (documents + a + b) with the prior over all hosts; above max_rate none of its documents
    is kept. A null text has no words and fails; a null host has no verdict of its own.
    Repeated rows count and return one by one; other columns of docs are ignored; an empty
    table gives an empty result.
    """
    rows = written(measure(docs, host), "host-rules")
    failed = F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")
    rows = rows.withColumn("base_failed", failed)
    hosts = written(rows.where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("f")), "hosts")
    a, b = prior(hosts)
    rates = hosts.select(F.col("host").alias("_host"), ((F.col("f") + F.lit(a)) / (F.col("n") + F.lit(a + b))).alias("host_rate"))
    rates = F.broadcast(rates) if rates.count() <= BROADCAST_HOSTS else rates
    out = rows.join(rates, F.col("host") == F.col("_host"), "left")
    kept = ~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= F.lit(max_rate))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", kept.alias("kept"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS ws FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS c FROM win) WHERE c >= 2),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN ln USING (doc_id)),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM b WHERE source IS NOT NULL GROUP BY source),
g AS (SELECT sum(f) / sum(n) AS m, count(*) AS k, sum(n) AS n FROM h),
v AS (SELECT sum(h.n * power(h.f / h.n - g.m, 2)) / sum(h.n) AS v FROM h, g),
s AS (SELECT m, CASE WHEN v - m * (1 - m) * k / n > 0 THEN least(greatest(m * (1 - m) / (v - m * (1 - m) * k / n) - 1, 1), 1e6) ELSE 1e6 END AS strength FROM g, v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND coalesce((h.f + s.m * s.strength) / (h.n + s.strength), 0) <= 0.5) AS kept
FROM b LEFT JOIN h ON b.source = h.source, s
"""
