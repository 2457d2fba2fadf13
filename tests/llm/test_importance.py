"""Importance resampling against a plain count of joined runs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemill.llm import catalog, importance

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string"


def runs(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def expected(docs, benchmark):
    of = [(doc, *runs(text)) for doc, text in docs]
    s, t = Counter(b for _, _, r in of for b in r), Counter(b for text in benchmark for b in runs(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)}
    rows = []
    for doc, words, r in of:
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in r)
        rows.append([doc, len(r), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0], r[1], r[2]))
    for rank, r in enumerate(able[: 5 * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize("sf", [SF, SF.replace("0.001", "0.01")])
def test_whole_table_against_joined_runs(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    benchmark = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = got(catalog.op12_crc_ring(spark, sf))
    assert found == expected(docs, benchmark)
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    cur = con.execute(catalog.oracle_sql()["op12_crc_ring"])
    assert [c[0] for c in cur.description] == ["doc_id", "n_features", "weight", "score", "rank"] and sorted(cur.fetchall(), key=str) == found


def test_ring_over_blocks_of_any_size(monkeypatch):
    text = "Ünïcödé ẞTRASSE 漢字 a-b_C9  \x00 end. x"
    whole = sorted(runs(text)[1])
    for size in (1, 2, 3, 7, 40, 1000):
        monkeypatch.setattr(importance, "BLOCK_BYTES", size)
        assert sorted(c % 10000 for _, levels in importance.ring_states(text.encode()) for level in levels for c in level) == whole
    assert list(importance.ring_states(b"")) == [] and [n for n, _ in importance.ring_states(b"one")] == [1]


def test_odd_rows_ties_and_clashing_names(spark):
    long_text = " ".join(f"w{i % 977}" for i in range(60_000))
    base = " ".join(f"Word{i}" for i in range(25))
    rows = [(1, None), (2, ""), (3, " \t"), (4, base), (4, base), (4, base + " x"), (None, base), (None, None), (5, long_text), (6, "é à"), *((i, base) for i in range(10, 60))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in ("short", "row", "place", "part", "bucket", "n", "score", "weight"):
        df = df.withColumn(name, F.lit("clash"))
    target = spark.createDataFrame([(1, base), (2, None)], SCHEMA)
    assert got(importance.resample(df, target)) == expected(rows, [base, None])
    assert got(importance.resample(spark.createDataFrame([], SCHEMA), target)) == []
    assert got(importance.resample(df, spark.createDataFrame([], SCHEMA))) == expected(rows, [])
