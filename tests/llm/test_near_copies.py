"""The near-duplicate stage: five-word shingles, Jaccard 0.8, one row of each group."""

from __future__ import annotations

import random
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402

from tidemill.llm import components, near_copies  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def kept_by_brute_force(rows, similarity=0.8):
    """Positions in rows (doc_id, text) of the first row of each group."""
    sets, parent, holders = [shingle_set(t) for _, t in rows], list(range(len(rows))), defaultdict(list)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, own in enumerate(sets):
        shared = Counter(j for s in (own or {None}) for j in holders[s])
        for j, n in shared.items():
            if not own or n / (len(own) + len(sets[j]) - n) >= similarity:
                parent[root(i)] = root(j)
        for s in own or {None}:
            holders[s].append(i)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    return {min(g, key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)) for g in groups.values()}


def test_stage_against_brute_force(spark):
    for sf in ("sf0.001", "sf0.01"):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
        stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
        got = stage(spark, docs, f"/root/testdata/{sf}")
        assert got.columns == docs.columns
        assert sorted(r[0] for r in got.select("doc_id").collect()) == sorted(rows[i][0] for i in kept_by_brute_force(rows))


def test_near_copies_that_differ_in_many_bits(spark):
    """Copies with a few words changed, at 0.8 to 0.95, in chains and in one large group."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = []
    for _ in range(60):
        words = [word() for _ in range(rng.randint(60, 300))]
        for _ in range(rng.choice([1, 2, 3, 60])):
            words = list(words)
            for _ in range(max(1, len(words) // rng.randint(40, 90))):
                words[rng.randrange(len(words))] = word()
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    want = sorted(rows[i][0] for i in kept_by_brute_force(rows))
    assert len(want) < len(rows) / 2
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    assert sorted(r[0] for r in near_copies.keep_one_of_each(docs).select("doc_id").collect()) == want


def test_one_row_stays_where_ids_repeat_or_are_missing(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(4, base), (4, base), (None, base), (None, base + " end"), (None, "other words that stand alone here"), (None, "other words that stand alone here"), (7, None), (8, ""), (9, " \n"), (10, "two words"), (11, "Two  words")]
    got = near_copies.keep_one_of_each(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)).select("doc_id", "text").collect()
    assert sorted(map(str, (r[0] for r in got))) == ["10", "4", "7", "None"]
    assert near_copies.keep_one_of_each(spark.createDataFrame([], SCHEMA)).count() == 0


def test_held_sets_are_found_whole(monkeypatch):
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(40):
        now = rng.integers(0, 1 << 60, int(rng.integers(1, 200)), np.uint64)
        for _ in range(int(rng.integers(1, 12))):
            now = np.unique(np.concatenate([now[rng.random(len(now)) > 0.08], rng.integers(0, 1 << 60, len(now) // 20 + 1, np.uint64)]))
            sets.append(now)
    for postings in (near_copies.POSTINGS, 7):
        monkeypatch.setattr(near_copies, "POSTINGS", postings)
        held = near_copies.Held(list(range(len(sets))), sets)
        for own in sets[::3]:
            both = [len(np.intersect1d(own, other)) for other in sets]
            assert held.similar(own).tolist() == [i for i, other in enumerate(sets) if both[i] / (len(own) + len(other) - both[i]) >= 0.8]


@pytest.mark.parametrize("small", [True, False])
def test_groups_in_blocks(spark, small, monkeypatch):
    """One large group of copies and their copies, whose far ends are not similar, held and streamed in several blocks."""
    if small:
        monkeypatch.setattr(near_copies, "HELD_SHINGLES", 300)
        monkeypatch.setattr(near_copies, "STREAMED_TEXTS", 16)
        monkeypatch.setattr(components, "HEAVY_ROWS", 20)
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(500)}"
    base = [word() for _ in range(120)]
    rows = []
    for _ in range(12):  # families that share most of one text, at 0.6 to 0.9
        own = list(base)
        for _ in range(rng.randint(1, 6)):
            own[rng.randrange(len(own))] = word()
        for _ in range(12):
            copy = list(own)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
            if rng.random() < 0.3:
                own = copy
    want = sorted(rows[i][0] for i in kept_by_brute_force(rows))
    assert 1 < len(want) < len(rows) / 2
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    assert sorted(r[0] for r in near_copies.keep_one_of_each(docs).select("doc_id").collect()) == want
