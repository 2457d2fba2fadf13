"""What op9 takes besides its result: files that are written, and memory for one long text."""

from __future__ import annotations

import random
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tidemill.llm import shared, simhash

SCHEMA = "doc_id long, text string"


def one_print(text):
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["doc_id", "text"])
    return next(simhash._fingerprint_batches(iter([batch]))).column(1).to_pylist()[0]


def whole_print(text):
    hashes = simhash.shingle_hashes(text.encode())
    return int(simhash.fingerprints_of(np.array(hashes, np.uint64), np.array([len(hashes)])).view(np.int64)[0])


def test_files_follow_the_cores_and_not_the_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_folder", lambda spark: f"file://{tmp_path}/shared")
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t + " end") for i, t in enumerate(texts)] + [(5000, None), (5001, " ")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(60)
    settings = {"spark.sql.shuffle.partitions": "70", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        simhash.simhash_near_duplicates(docs).write.parquet(f"{tmp_path}/out")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    most = 2 * spark.sparkContext.defaultParallelism
    tables = [f"{tmp_path}/out", *Path(tmp_path, "shared").iterdir()]
    assert len(tables) >= 4
    for table in tables:
        assert 1 <= len(list(Path(table).glob("part-*.parquet"))) <= most
    got = {r["doc_id"]: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    prints = {i: whole_print(t or "") for i, t in rows}
    label = {i: i for i in prints}
    while True:
        new = {i: min(label[j] for j in prints if ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= 3) for i in prints}
        if new == label:
            break
        label = new
    assert {i: r["component_id"] for i, r in got.items()} == label


@pytest.mark.parametrize("size", [1, 5, 64])
def test_pieces_of_a_text_give_its_fingerprint(monkeypatch, size):
    monkeypatch.setattr(simhash, "PIECE_BYTES", size)
    rng = random.Random(size)
    for _ in range(300):
        words = ["".join(rng.choices("abCÜ漢", k=rng.choice([1, 2, 9, 80]))) for _ in range(rng.choice([0, 1, 2, 3, 4, 30]))]
        text = "".join(rng.choice(["", " ", "\n\t"]) + w + rng.choice([" ", "\r\n", " \x0b\x0c ", " " * 70]) for w in words)
        assert one_print(text) == whole_print(text), text


def test_memory_for_a_long_text_does_not_grow_with_it():
    text = " ".join(f"W{i % 9973}x{i % 31}" for i in range(1_200_000))
    want = whole_print(text)
    array = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["doc_id", "text"])
    tracemalloc.start()
    try:
        got = next(simhash._fingerprint_batches(iter([array]))).column(1).to_pylist()[0]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got == want and peak < 60e6, peak
