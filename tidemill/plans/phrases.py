"""The first words of benchmark texts as a list of phrases, found in all documents; clauses around frequent words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import phrases
from ..sources.tables import table


def _matches(spark, sf_dir):
    words = F.split("text", " ")
    heads = table(spark, sf_dir, "benchmark").select(F.explode(F.array(*(F.struct(F.array_join(F.slice(words, 1, n), " ").alias("phrase"), F.lit(str(n)).alias("tag")) for n in (1, 2, 3)))).alias("x")).select("x.phrase", "x.tag")
    return phrases.match_phrases(table(spark, sf_dir, "documents"), ["doc_id"], "text", heads).groupBy("doc_id", "tag").agg(F.count("*").alias("n"), F.min("begin").alias("first"))


def _clauses(spark, sf_dir):
    """Clauses of all turns; a relation is one of the fifty commonest words of at least three letters."""
    turns = table(spark, sf_dir, "conversations")
    common = turns.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), 0)).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "phrase").limit(50)
    return phrases.atomic_clauses(turns, ["conv_id", "turn"], "text", common.withColumn("tag", F.upper("phrase")))


QUERIES = {"phrase_matches": (_matches, None), "phrase_clauses": (_clauses, None)}
