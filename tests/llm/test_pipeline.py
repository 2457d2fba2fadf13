"""The pipeline stage by stage: the scores' rule, brute force on word shingles, the library's tokens; odd rows and empty tables."""

from __future__ import annotations

import hashlib
import sys
from pathlib import Path

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path[:0] = [str(Path(__file__).resolve().parents[2]), str(Path(__file__).resolve().parent)]

import corpus_pipeline  # noqa: E402

from test_near_copies import kept_by_brute_force  # noqa: E402
from tidemill.llm import mixing, quality, secrets  # noqa: E402
from tidemill.llm.shared import written  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs
        docs = written(stage(spark, docs, SF), f"test-{name}")
        if name != "tokens":
            assert docs.columns == columns
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    model = quality.train(seen["quality"], spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(seen["near_duplicates"]) == ids(quality.score_quality(seen["quality"], model).where(f"score >= {quality.ACCEPT}"))
    rows = [(r["doc_id"], r["text"]) for r in seen["near_duplicates"].collect()]
    assert ids(seen["secrets"]) == sorted(rows[i][0] for i in kept_by_brute_force(rows))
    assert ids(seen["mixing"]) == ids(seen["secrets"])
    found = secrets.scan_secrets(seen["secrets"]).where("is_secret").collect()
    texts = {r["doc_id"]: r["text"] for r in seen["mixing"].collect()}
    assert all(r["candidate"] not in texts[r["doc_id"]] for r in found)
    mix = mixing.mix_sources(seen["mixing"]).collect()
    assert ids(seen["tokens"]) == sorted(r["doc_id"] for r in mix for _ in range(r["copies"]))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in docs.limit(40).collect():
        tokens = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(tokens) and r["ids"] == tokens and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, tokens)).encode()).hexdigest()


def test_run_equals_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).agg(F.count("*")).first()[0] > 0


def test_stages_on_odd_rows_and_nothing(spark):
    """Nulls in every column, blank and very long texts, repeated rows, extra columns with names of the operators' own."""
    base = " ".join(f"word{i}" for i in range(60))
    long_text = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "src1", 0), (3, base, "en", "src1", 9), (3, base, "en", "src1", 9), (None, base + " end", "en", None, 9), (4, long_text, "de", "src0", 9), (5, "token = 0641917ea4e9feb9cda83477b57ac2654884f485 " + base[:90], None, "src2", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for extra in ("row", "key", "class", "group", "hits", "gaps", "judged", "_id", "_key", "_own", "_kept", "_near_row", "a.b"):
        docs = docs.withColumn(extra, F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0
        got = stage(spark, docs, SF)
        assert name == "tokens" or got.columns == docs.columns
        n = len(got.collect())
        assert n == len(rows) if name in ("secrets", "tokens") else n <= 2 * len(rows)
        if name == "near_duplicates":
            assert n == 4  # one of the empty texts, one of the base texts, the long one, the one with a key
