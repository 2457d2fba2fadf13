"""The toxicity network: gradients by differences, states word by word, windows, held-out accuracy, odd rows."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import catalog, toxicity

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def read(texts):
    return toxicity._joined([t.encode() for t in texts])


def test_words_and_windows_cover_every_text():
    texts = ["Ünï cödé, ẞ-x A1\x00b", "", " .\n", "w " * 100, "a", "x " * 32, "x " * 33, "end"]
    found = read(texts)
    assert np.diff(found.firsts).tolist() == [len(words_of(t)) for t in texts]
    same = {}
    for number, word in zip(found.words.tolist(), (w for t in texts for w in words_of(t)), strict=True):
        assert same.setdefault(word, number) == number
    assert len(set(same.values())) == len(same)
    text, begin, size = toxicity.window_starts(found.firsts)
    for i, t in enumerate(texts):
        own = [(int(b - found.firsts[i]), int(n)) for x, b, n in zip(text, begin, size, strict=True) if x == i]
        covered = {w for b, n in own for w in range(b, b + n)}
        assert covered == set(range(len(words_of(t)))) and own
        assert all(b2 - b1 == toxicity.STRIDE and b1 + n1 - b2 == toxicity.WINDOW - toxicity.STRIDE for (b1, n1), (b2, _) in zip(own, own[1:], strict=False))


def test_characters_of_a_word_are_its_runs_with_its_ends():
    found = read(["abc zz abc"])
    counts = np.diff(found.cuts)
    assert sorted(counts.tolist()) == [3, 5]  # zz: " zz", "zz ", " zz "; abc: three runs of three, two of four
    alone = read(["zz"])
    at = int(np.argmin(counts))
    assert found.grams[found.cuts[at] : found.cuts[at + 1]].tolist() == alone.grams.tolist()


def test_states_agree_with_one_word_at_a_time():
    net = {k: v.astype(np.float64) for k, v in toxicity.fresh_net(np.random.default_rng(3)).items()}
    texts = ["one two three four five", "", "six", "two two six"]
    found = read(texts)
    x = toxicity.word_inputs(net, found.own, found.grams, found.cuts)
    u, sig = toxicity.UNITS, lambda v: 1 / (1 + np.exp(-v))
    want = []
    for i in range(len(texts)):
        own = found.words[found.firsts[i] : found.firsts[i + 1]]
        sides = []
        for d, order in ((0, list(own)), (1, list(own[::-1]))):
            h, states = np.zeros(u), []
            for w in order:
                a, b = x[w] @ net["w"][d] + net["b"][d], h @ net["u"][d]
                z, r = sig(a[:u] + b[:u]), sig(a[u : 2 * u] + b[u : 2 * u])
                h = (1 - z) * np.tanh(a[2 * u :] + r * b[2 * u :]) + z * h
                states.append(h)
            sides.append(states if d == 0 else states[::-1])
        both = [np.concatenate(s) for s in zip(*sides, strict=True)]
        energy = [math.exp(float(s @ net["attend"].ravel())) for s in both]
        context = sum((e / sum(energy) * s for e, s in zip(energy, both, strict=True)), np.zeros(2 * u))
        want.append(float(context @ net["out"].ravel() + net["bias"][0]))
    _, begin, size = toxicity.window_starts(found.firsts)
    assert np.allclose(toxicity.window_logits(net, found, begin, size), want, atol=1e-4)


@pytest.mark.parametrize("name", ["word", "char", "w", "u", "b", "attend", "out", "bias"])
def test_gradients_agree_with_differences(monkeypatch, name):
    monkeypatch.setattr(toxicity, "WINDOW", 6)
    monkeypatch.setattr(toxicity, "STRIDE", 4)
    rng = np.random.default_rng(1)
    net = {k: v.astype(np.float64) * 2 for k, v in toxicity.fresh_net(rng).items()}
    found = read(["one two three four five six seven eight nine", "", "two six ten", "one"])
    _, begin, size = toxicity.window_starts(found.firsts)
    y, weight = rng.integers(0, 2, len(begin)).astype(float), rng.random(len(begin)) + 0.5
    _, g = toxicity.gradients(net, found, begin, size, y, weight)
    spots = np.argsort(-np.abs(g[name]).ravel())[:4]
    for spot in spots:
        held, sides = net[name].ravel()[spot], []
        for step in (1e-3, -1e-3):
            net[name].ravel()[spot] = held + step
            sides.append(toxicity.gradients(net, found, begin, size, y, weight)[0])
        net[name].ravel()[spot] = held
        assert (sides[0] - sides[1]) / 2e-3 == pytest.approx(float(g[name].ravel()[spot]), rel=0.02, abs=2e-5)


def test_held_out_rows_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    found = catalog.op11_gated_toxicity(spark, sf).where("held_out")
    rows = found.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", "predicted", "toxic").collect()
    assert len(rows) > 900 and all(0 <= r["score"] <= 1 for r in rows)
    missed = sum(r["toxic"] == 1 and r["predicted"] == 0 for r in rows)
    blamed = sum(r["toxic"] == 0 and r["predicted"] == 1 for r in rows)
    assert missed <= 0.08 * sum(r["toxic"] for r in rows) and blamed <= 0.025 * len(rows)
    assert sum((r["score"] - r["toxic"]) ** 2 for r in rows) / len(rows) < 0.03


def test_odd_rows_and_missing_labels(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST_WINDOWS", 500)
    clean = [(i, f"plain words number {i} of a text that harms nobody at all") for i in range(200)]
    bad = [(i, f"plain words {i} of a nasty villain text that harms") for i in range(200, 300)]
    odd = [(900, None), (901, ""), (902, " \t."), (None, "a nasty villain"), (None, None), (903, "a nasty villain"), (903, "a nasty villain"), (904, "word " * 40_000 + "nasty villain"), (905, "漢字 \x00 \U0001f600")]
    df = spark.createDataFrame(clean + bad + odd, SCHEMA).repartition(3)
    for name in ("score", "_id", "_y", "_h", "_t", "_n", "toxic"):
        df = df.withColumn(name, F.lit("clash"))
    labels = spark.createDataFrame([*((i, 0) for i in range(200)), *((i, 1) for i in range(200, 300)), (None, 1), (7777, None)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    scored = toxicity.score_toxicity(df, model).collect()
    assert len(scored) == 300 + len(odd) and all(0 <= r["score"] <= 1 for r in scored)
    of = {}
    for r in scored:
        of.setdefault(r["doc_id"], []).append(r["score"])
    assert of[903][0] == of[903][1] and max(of[None]) > 0.3 and of[900] == of[901] == of[902]
    assert sum(of[i][0] >= 0.3 for i in range(200)) <= 4 and sum(of[i][0] >= 0.3 for i in range(200, 300)) >= 96
    assert toxicity.score_toxicity(spark.createDataFrame([], SCHEMA), model).count() == 0
    none = toxicity.train(df, labels.where("toxic = 0"))
    assert {r["score"] for r in toxicity.score_toxicity(df, none).collect()} == {0.0}
