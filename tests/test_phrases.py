"""Phrases by automaton and by join, against a regular expression of all phrases, longest first."""

from __future__ import annotations

import random

import pytest
import regex

from tidemill.operators import phrases
from tidemill.plans import catalog

LIST = [("Leads to", "lead"), ("leads  to", "zz"), ("leads", "go"), ("is", "be"), ("is converted to", "convert"), ("binding/association", "assoc"), ("é-x", "odd"), ("to", "to"), ("!bad", "no"), ("", "no"), (None, "no")]


def plain(text):
    known = {}
    for p, tag in LIST:
        p = regex.sub(r"\s+", " ", (p or "").strip().lower())
        if regex.fullmatch(r"[\p{L}\p{N}\p{M}_-](.*[\p{L}\p{N}\p{M}_-])?", p):
            known[p] = min(tag, known.get(p, tag))
    any_ = regex.compile(r"(?<![\w-])(" + "|".join(sorted(map(regex.escape, known), key=len, reverse=True)) + r")(?![\w-])")
    return [(m.start(), m.end(), m[1], known[m[1]]) for m in any_.finditer((text or "").lower())]


@pytest.mark.parametrize("bound", [200_000, 1])
def test_matches_equal_the_expression(spark, monkeypatch, bound):
    monkeypatch.setattr(phrases, "MOST_PHRASES", bound)
    rng = random.Random(bound)
    bits = ["leads", "to", "Leads", "is", "converted", "binding", "/", "association", "é", "-", "x", "É-X", "_", ",", " ", "  ", " ", "\n", "漢", "tois", "9"]
    rows = [(i, "".join(rng.choices([*bits, " ", " "], k=rng.randrange(25)))) for i in range(200)] + [(900, None), (901, ""), (902, "leads to"), (902, "leads to"), (903, "is converted to is")]
    df = spark.createDataFrame(rows, "i int, t string")
    known = spark.createDataFrame(LIST, "phrase string, tag string")
    got = sorted((r["i"], r["begin"], r["end"], r["phrase"], r["tag"]) for r in phrases.match_phrases(df, ["i"], "t", known).collect())
    assert got == sorted((i, *m) for i, t in rows for m in plain(t))
    assert phrases.match_phrases(df, ["i"], "t", known.limit(0)).count() == 0


def test_clauses_with_one_relation(spark):
    df = spark.createDataFrame([(1, "Gene A leads to gene B. C is D; E is F is G.\nleads to H. no relation"), (2, None)], "i int, t string")
    known = spark.createDataFrame(LIST, "phrase string, tag string")
    got = sorted(tuple(r) for r in phrases.atomic_clauses(df, ["i"], "t", known).collect())
    assert got == [(1, 0, "Gene A", "lead", "gene B"), (1, 1, "C", "be", "D")]


@pytest.mark.parametrize("bound", [200_000, 1])
def test_query_equals_the_expression(spark, monkeypatch, bound):
    monkeypatch.setattr(phrases, "MOST_PHRASES", bound)
    sf = "/root/testdata/sf0.001"
    heads = {}
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        words = r["text"].split(" ")
        for n in (1, 2, 3):
            p = " ".join(" ".join(words[:n]).lower().split())
            if regex.fullmatch(r"[\p{L}\p{N}\p{M}_-](.*[\p{L}\p{N}\p{M}_-])?", p):
                heads[p] = min(str(n), heads.get(p, str(n)))
    any_ = regex.compile(r"(?<![\w-])(" + "|".join(sorted(map(regex.escape, heads), key=len, reverse=True)) + r")(?![\w-])")
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        for m in any_.finditer((r["text"] or "").lower()):
            at = (r["doc_id"], heads[m[1]])
            want[at] = want.get(at, 0) + 1
    assert {(r["doc_id"], r["tag"]): r["n"] for r in catalog.queries()["phrase_matches"](spark, sf).collect()} == want
