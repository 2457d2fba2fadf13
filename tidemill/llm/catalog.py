"""Queries of this package, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, host_rules, importance, language, mixing, quality, secrets, simhash, substring_dedup, token_counts, toxicity, vector_dedup

Builder = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fold(folds: int, held_out: int):
    """True for rows of the held-out fold; a row without doc_id is in no fold."""
    return F.coalesce(F.expr(f"crc32(CAST(doc_id AS STRING)) % {folds} = {held_out}"), F.lit(False))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "begin", "end", "kind", F.sha2("candidate", 256).alias("finding_sha256"), "score", "is_secret")


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op3_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2)
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language.identify(docs, language.learn(docs, folds=4, held_out=2))
    return found.select("doc_id", _fold(4, 2).alias("held_out"), "lang_pred", "score", F.to_json("languages").alias("languages"))


def op5_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"), folds=5, held_out=0)
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", _fold(5, 0).alias("held_out"), "score", (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"))


def op6_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op7_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op8_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated_spans(_table(spark, sf_dir, "documents"), keep_text=False)


def op9_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_near_duplicates(_table(spark, sf_dir, "documents"))


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = host_rules.apply_host_rules(_table(spark, sf_dir, "documents"))
    return rules.drop("host_rate")


def op11_gated_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), folds=4, held_out=2)
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", _fold(4, 2).alias("held_out"), "score", (F.col("score") >= toxicity.ACCEPT).cast("int").alias("predicted"))


def op12_crc_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_dial_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(_table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Builder]:
    every = (
        op1_secret_scan, op2_bpe_codec, op3_pareto_mix, op4_language_mixture, op5_compression_quality, op6_trie_token_counts,
        op7_collision_counting, op8_suffix_automata, op9_simhash_variants, op10_host_rules, op11_gated_toxicity, op12_crc_ring, op13_dial_repair, pipeline,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op3_pareto_mix": mixing.ORACLE, "op8_suffix_automata": substring_dedup.ORACLE, "op10_host_rules": host_rules.ORACLE, "op12_crc_ring": importance.ORACLE, "op13_dial_repair": conversations.ORACLE}
