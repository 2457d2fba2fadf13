"""A corpus pipeline of the text operators: quality, near duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept;
all but the last return the columns of documents. The first rejects texts of low quality,
the second keeps one document of each near-duplicate group, the third redacts secrets, the
fourth repeats and samples documents to the sources' target weights, the last encodes.

In every stage a null text counts as empty, repeated rows and rows without a doc_id are rows
like any other, further columns pass through whatever their names (the last stage leaves
them out), and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import bpe, mixing, near_copies, quality, secrets
from tidemill.llm.shared import written


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs whose quality score is at least quality.ACCEPT; learnt from labels outside the held-out fold."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def keep_one_near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of docs for each group of texts linked at a Jaccard similarity of 0.8 of their five-word shingles."""
    return near_copies.keep_one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with secrets replaced in text."""
    return secrets.redact_secrets(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs, each row as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests of the ids and of the decoded text, for each row of docs."""
    import public_tokenizers

    return bpe.encode_ids(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_good_quality),
    ("near_duplicates", keep_one_near_duplicate),
    ("secrets", redact_secrets),
    ("mixing", mix_to_weights),
    ("tokens", encode),
]

#: The learnt classifier and the fingerprints have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
