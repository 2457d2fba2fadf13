"""The near-duplicate stage's SimHash index: fingerprints by majority, one-wildcard variants, recall at Jaccard 0.8."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402

from tidemill.llm import near_copies, simhash  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def linked_classes(pairs, n):
    root = list(range(n))
    for a, b in pairs:
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    return [top(x) for x in range(n)]


def test_fingerprints_are_majorities():
    rng = np.random.default_rng(3)
    counts = np.array([0, 1, 2, 255, 0, 256, 1000, 3, 511, 0])
    hashes = rng.integers(0, 1 << 64, counts.sum(), np.uint64) | np.uint64(1 << 63)
    ends = np.cumsum(counts)
    want = [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes[e - c : e]) > c) for c, e in zip(counts, ends, strict=True)]
    assert simhash.fingerprints_of(hashes, counts).tolist() == want
    assert simhash.fingerprints_of(hashes[:0], counts[:1]).tolist() == [0]


@pytest.mark.parametrize("large", [256, 4])
def test_variants_join_what_shares_one(monkeypatch, large):
    """One byte's index rows against all pairs: a segment of 16 bits with one wildcard, 66 of 256 bits."""
    monkeypatch.setattr(near_copies, "LARGE_VARIANT", large)
    rng = np.random.default_rng(5)
    families = rng.integers(0, 1 << 64, (20, 4), np.uint64)
    prints = []
    for own in families[rng.integers(0, 20, 300)]:
        bits = np.unpackbits(own.view(np.uint8)) ^ (rng.random(256) < rng.choice([0.02, 0.12, 0.2]))
        prints.append(np.packbits(bits.astype(np.uint8)).view(np.uint64))
    prints = np.array(prints).T.copy()
    deal = 256 * 3 + (prints[0].astype("<u8").view(np.uint8).reshape(-1, 8)[:, 3]).astype(np.int64)  # byte 3, its segment is bytes 2 and 3
    order = np.argsort(deal, kind="stable")
    deal, prints = deal[order], np.ascontiguousarray(prints[:, order])
    node = np.arange(300)
    segment = (prints[0] >> np.uint64(16)) & np.uint64(0xFFFF)
    want = []
    for i in range(300):
        for j in range(i):
            one = int(segment[i] ^ segment[j]).bit_count() <= 1 and deal[i] == deal[j]
            if one and sum(int(x).bit_count() for x in prints[:, i] ^ prints[:, j]) <= 66:
                want.append((j, i))
    a, b = near_copies.variant_links(deal, node, prints)
    assert len(want) > 100 and len(a) < 300 and (a < b).all()
    assert linked_classes(zip(a.tolist(), b.tolist(), strict=True), 300) == linked_classes(want, 300)


def copies_at_the_threshold():
    """Texts of distinct words, each with one at Jaccard 0.8 of its shingles or little more: words cut off at the end."""
    rows, word = [], 0
    for n in [4, 5, 6, 8, 10, 15, 25, 26, 30, 50, 100, 300] * 20:  # shingles of the shorter one
        words = [f"w{word + i}" for i in range(int(n / 0.8 + 1e-9) + 4)]
        word += len(words)
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[: n + 4]))]
    return rows


def test_index_finds_pairs_at_the_threshold(spark):
    rows = copies_at_the_threshold()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id AS row", "doc_id", "text")
    classes = near_copies._sketches(docs, near_copies.SHINGLE_WORDS).select("row", "class", "prints").collect()
    row_of = {r["class"]: r["row"] for r in classes}
    table = spark.createDataFrame([(r["class"], r["prints"]) for r in classes], "class long, prints array<long>")
    found = {tuple(sorted((row_of[r["a"]], row_of[r["b"]]))) for r in near_copies.candidate_links(table).collect()}
    assert found == {(i, i + 1) for i in range(0, len(rows), 2)}


def test_stage_takes_its_candidates_from_the_index(spark, monkeypatch):
    rows = copies_at_the_threshold()[:48]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert stage(spark, docs, "").count() == 24
    monkeypatch.setattr(near_copies, "candidate_links", lambda classes: spark.createDataFrame([], "a long, b long"))
    assert stage(spark, docs, "").count() == 48


def test_links_of_a_large_group_grow_with_its_texts(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(base[:at] + [f"x{k}"] + base[at:])) for k in range(600) for at in [rng.randrange(200)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id AS row", "doc_id", "text")
    links = near_copies.candidate_links(near_copies._sketches(docs, near_copies.SHINGLE_WORDS).select("class", "prints"))
    assert 599 <= links.count() <= 3 * 600
