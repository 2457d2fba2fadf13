"""Scores of continuations against a plain Python version."""

from __future__ import annotations

import random
from collections import Counter

from tidemill.operators import continuations

EVENTS = "array<struct<step: bigint, source: array<string>, relation: string, target: array<string>, mediators: array<string>>>"


def rates(h, p, t):
    precision, recall = h / p if p else float(t == 0), h / t if t else float(p == 0)
    return precision, recall, 2 * precision * recall / (precision + recall) if precision + recall else 0.0


def bag(a, b):
    a, b = Counter(a), Counter(b)
    return rates(sum((a & b).values()), sum(a.values()), sum(b.values()))


def lcs(a, b):
    if not a or not b:
        return 0
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def layers(events):
    out = []
    for i, e in enumerate(events):
        if not i or events[i - 1][0] != e[0]:
            out.append([])
        out[-1].append(e)
    return out


def key(e):
    return tuple(e[1]), e[2], tuple(e[4] or ()), tuple(e[3])


def expected(guess, truth):
    guess, truth = guess or [], truth or []
    gl, tl = layers(guess), layers(truth)
    gk, tk = ([tuple(sorted(map(key, layer))) for layer in side] for side in (gl, tl))
    sets = lambda part, a, b: bag({x for e in a for x in e[part]}, {x for e in b for x in e[part]})[2]
    some = bool(gl and tl)
    one, two = (gl[0], tl[0]) if some else ([], [])
    first = [float(gk[0] == tk[0]), bag(map(key, one), map(key, two))[2], sets(1, one, two), bag((e[2] for e in one), (e[2] for e in two))[2], sets(3, one, two)] if some else [0.0] * 5
    keys = list(map(key, guess)), list(map(key, truth))
    return [
        *first, *bag(*keys), sets(1, guess, truth), bag((e[2] for e in guess), (e[2] for e in truth))[2], sets(3, guess, truth), *rates(lcs(gk, tk), len(gk), len(tk)), float(gk == tk),
        float(keys[0][0] == keys[1][0]) if some else 0.0, *rates(lcs(*keys), len(guess), len(truth)), float(keys[0] == keys[1]),
    ]


def test_scores_of_random_continuations(spark):
    rng = random.Random(4)

    def side():
        if rng.random() < 0.1:
            return rng.choice([None, []])
        step, out = 0, []
        for _ in range(rng.randint(1, 7)):
            step += rng.choice([0, 0, 1])
            out.append((step, rng.sample("ab", rng.randint(1, 2)), rng.choice("xy"), rng.sample("cd", rng.randint(1, 2)), rng.choice([None, [], ["m"]])))
        return out

    rows = [(i, side(), side()) for i in range(150)]
    rows += [(200 + i, r[1], r[1]) for i, r in enumerate(rows[:10])]
    df = spark.createDataFrame(rows, f"i int, guess {EVENTS}, truth {EVENTS}")
    names = continuations.LAYER_SCORES + continuations.ORDER_SCORES
    got = {r["i"]: [r[n] for n in names] for r in continuations.score_continuations(df, "guess", "truth").collect()}
    for i, guess, truth in rows:
        assert all(abs(a - b) < 1e-12 for a, b in zip(got[i], expected(guess, truth), strict=True)), (guess, truth, dict(zip(names, got[i], strict=True)))
    assert continuations.score_continuations(df, "guess", "truth", ordered=False).columns == ["i", "guess", "truth", *continuations.LAYER_SCORES]
