"""Recall on the keys that the tables hold, recall and precision by shape on lines made apart from the training findings."""

from __future__ import annotations

import random
import re
import string

import pytest
from pyspark.sql import functions as F

from tidemill.llm import secrets

PLANTED = re.compile(r'token = "([0-9A-Fa-f]{40})"', re.IGNORECASE)


@pytest.fixture(scope="module")
def forest(spark):
    return secrets.train_forest(secrets.labelled_findings(spark))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_every_planted_key_is_found_and_redacted(spark, forest, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    with_keys = {r["doc_id"]: len(PLANTED.findall(r["text"])) for r in docs.collect() if PLANTED.search(r["text"] or "")}
    assert sum(with_keys.values()) >= (13 if sf == "sf0.01" else 156)
    found = secrets.scan_secrets(docs, forest=forest).where("is_secret AND kind = 'assignment'").groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in found} == with_keys
    clean = secrets.redact_secrets(docs.where(F.col("doc_id").isin(*with_keys)), forest=forest).collect()
    assert len(clean) == len(with_keys) and not any(PLANTED.search(r["text"]) for r in clean)


def shapes(rng):
    """(shape, is it a secret, line) from Python's generator; words are syllables, not the dictionary of the operator."""
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    mixed = lambda n: "".join(rng.choices(string.ascii_letters + string.digits, k=n))
    word = lambda: "".join(rng.choices(["ti", "on", "er", "the", "an", "re", "in", "ed", "ha", "ly"], k=rng.randint(2, 4)))
    prose = " ".join(word() for _ in range(6))
    yield "assigned hex", True, f'{prose} token = "{hexes(40)}" {prose}'
    yield "assigned mixed", True, f"{prose}\npassword={mixed(24)} {prose}"
    yield "assigned short", True, f"{prose} pwd={mixed(4)}{rng.randint(100, 999)}! {prose}"
    yield "cloud key", True, f"{prose} AKIA{''.join(rng.choices(string.ascii_uppercase + string.digits, k=16))} {prose}"
    yield "service key", True, f"{prose} ghp_{mixed(36)} {prose}"
    yield "digest", False, f"{prose} commit {hexes(40)} {prose}"
    yield "sha256", False, f"{prose} sha256: {hexes(64)} {prose}"
    yield "uuid", False, f"{prose} uuid {hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)} {prose}"
    yield "name", False, f"{prose} theDefault{rng.choice(['Connection', 'Session'])}PoolManagerFactory{rng.randint(1, 9)} {prose}"
    yield "number", False, f"{prose} {''.join(rng.choices(string.digits, k=20))} {prose}"
    yield "placeholder", False, f'{prose} api_key = "your_{rng.choice(["access", "client"])}_key_here" {prose}'


def test_recall_and_precision_by_shape(spark, forest):
    rng = random.Random(11)
    lines = [(i, shape, secret, line) for i, (shape, secret, line) in enumerate(x for _ in range(60) for x in shapes(rng))]
    docs = spark.createDataFrame([(i, line, "src1") for i, _, _, line in lines], "doc_id long, text string, source string")
    found = {r["doc_id"] for r in secrets.scan_secrets(docs, forest=forest).where("is_secret").collect()}
    share = {}
    for i, shape, secret, _ in lines:
        share.setdefault((shape, secret), []).append(i in found)
    share = {k: sum(v) / len(v) for k, v in share.items()}
    print(share)
    assert all(s >= 0.99 for (shape, secret), s in share.items() if secret and shape != "assigned short"), share
    assert all(s <= 0.02 for (_, secret), s in share.items() if not secret), share
    assert share["assigned short", True] >= 0.9


def test_transitions_are_learnt_from_the_findings(spark):
    rows = [("thethethe", 0), ("xqzxqz", 1), (None, 0), ("", 1)] * 5
    pairs = secrets.common_pairs(spark.createDataFrame(rows, "candidate string, label int"))
    assert "th" in pairs and "he" in pairs and not {"xq", "qz"} & set(pairs)
    assert secrets.common_pairs(spark.createDataFrame([], "candidate string, label int")) == []
