"""Phrases of a tagged list in texts: whole words, leftmost and longest first, for lists of any size.

A list of a checked size goes to the tasks as an automaton that reads each text once. A larger
one stays a table: the texts' runs of as many words as some phrase has are joined with it. Both
give the same candidates, of which each text keeps the leftmost, the longest of these, and what
then lies behind it.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds up to which a list is broadcast.
MOST_PHRASES, MOST_BYTES = 200_000, 16 << 20
#: What makes a word go on, for the bounds of a match.
_WORD = regex.compile(r"[\w-]")
TOKEN = r"[\p{L}\p{N}\p{M}_-]+"


def listed(phrases: DataFrame, phrase: str, tag: str) -> DataFrame:
    """(phrase, tag): lower case, white space collapsed; of one phrase the least tag. Phrases that do not begin and end with a word are left out."""
    plain = F.regexp_replace(F.trim(F.lower(F.col(phrase))), r"\s+", " ")
    return phrases.select(plain.alias("phrase"), F.col(tag).cast("string").alias("tag")).where(F.col("phrase").rlike(f"^{TOKEN}(.*{TOKEN})?$")).groupBy("phrase").agg(F.min("tag").alias("tag"))


def lowered(text: str) -> str:
    """Lower case, a character for a character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def spans(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str, str]]:
    """(begin, end, phrase, tag) of the matches that stand."""
    low, found = lowered(text), []
    for last, (phrase, tag) in automaton.iter(low):
        begin, end = last + 1 - len(phrase), last + 1
        if (begin == 0 or not _WORD.match(low[begin - 1])) and (end == len(low) or not _WORD.match(low[end])):
            found.append((begin, -end, phrase, tag))
    out, behind = [], 0
    for begin, end, phrase, tag in sorted(found):
        if begin >= behind:
            out.append((begin, -end, phrase, tag))
            behind = -end
    return out


def _by_automaton(rows: DataFrame, keys: list[str], text: str, known: list) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast([(r["phrase"], r["tag"]) for r in known])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for phrase, tag in shared.value:
            automaton.add_word(phrase, (phrase, tag))
        automaton.make_automaton()
        for batch in batches:
            at, made = [], []
            for i, value in enumerate(batch.column(len(keys)).to_pylist()):
                own = spans(value, automaton) if value and len(automaton) else []
                at += [i] * len(own)
                made += own
            columns = list(zip(*made, strict=True)) or [[]] * 4
            found = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in batch.columns[: len(keys)]), *found], names=[*keys, "begin", "end", "phrase", "tag"])

    kinds = dict(rows.dtypes)
    return rows.select(*keys, F.col(text).cast("string")).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", begin bigint, `end` bigint, phrase string, tag string")


def _by_join(rows: DataFrame, keys: list[str], text: str, known: DataFrame) -> DataFrame:
    sizes = [r["n"] for r in known.select(F.size(F.regexp_extract_all("phrase", F.lit(TOKEN), 0)).alias("n")).distinct().collect()]  # one number for each length of a phrase
    own = rows.select(*keys, F.lower(F.col(text).cast("string")).alias("_low"), F.monotonically_increasing_id().alias("_row"))
    words, gaps = F.regexp_extract_all("_low", F.lit(TOKEN), 0), F.split("_low", TOKEN, -1)
    # where each word begins: the lengths of all gaps and words before it
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(words)), words, lambda g, w: F.struct(F.length(g).alias("g"), F.length(w).alias("w")))
    placed = F.aggregate(steps, F.expr("CAST(array(struct(0, 0)) AS ARRAY<STRUCT<b: INT, e: INT>>)"), lambda out, s: F.concat(out, F.array(F.struct((F.element_at(out, -1)["e"] + s["g"]).alias("b"), (F.element_at(out, -1)["e"] + s["g"] + s["w"]).alias("e")))))
    own = own.withColumn("_at", F.slice(placed, F.lit(2), F.size(words)))
    runs = own.select(*keys, "_row", "_low", "_at", F.explode(F.array(*map(F.lit, sizes))).alias("_n")).where(F.size("_at") >= F.col("_n"))
    runs = runs.select(*keys, "_row", F.explode(F.transform(F.sequence(F.lit(0), F.size("_at") - F.col("_n")), lambda i: F.struct(F.get("_at", i)["b"].alias("b"), F.get("_at", i + F.col("_n") - 1)["e"].alias("e"), F.substr("_low", F.get("_at", i)["b"] + 1, F.get("_at", i + F.col("_n") - 1)["e"] - F.get("_at", i)["b"]).alias("s")))).alias("_x"))
    met = runs.join(known, F.col("_x.s") == F.col("phrase"))
    best = F.array_sort(F.collect_list(F.struct(F.col("_x.b").alias("begin"), (-F.col("_x.e")).alias("back"), "phrase", "tag")))
    empty = F.expr("CAST(array() AS ARRAY<STRUCT<begin: INT, back: INT, phrase: STRING, tag: STRING>>)")
    grouped = met.groupBy(*keys, "_row").agg(best.alias("_all")).select(*keys, F.explode(F.aggregate("_all", empty, lambda out, x: F.when(F.coalesce(x["begin"] >= -F.get(out, F.size(out) - 1)["back"], F.lit(True)), F.concat(out, F.array(x))).otherwise(out))).alias("_x"))
    return grouped.select(*keys, F.col("_x.begin").cast("bigint").alias("begin"), (-F.col("_x.back")).cast("bigint").alias("end"), F.col("_x.phrase").alias("phrase"), F.col("_x.tag").alias("tag"))


def match_phrases(rows: DataFrame, keys: list[str], text: str, phrases: DataFrame, phrase: str = "phrase", tag: str = "tag") -> DataFrame:
    """(keys, begin, end, phrase, tag) of every match, in code points from 0; without regard to case.

    A match has no letter, digit, underscore or hyphen on either side. The list is broadcast up to
    MOST_PHRASES phrases and MOST_BYTES, else joined. Null and empty texts match nothing; repeated
    rows repeat theirs; an empty list or table gives an empty result.
    """
    known = listed(phrases, phrase, tag)
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("phrase") + F.coalesce(F.octet_length("tag"), F.lit(0))), F.lit(0)).alias("b")).first()
    if size["n"] <= MOST_PHRASES and size["b"] <= MOST_BYTES:
        return _by_automaton(rows, keys, text, known.collect())
    return _by_join(rows, keys, text, known)


def atomic_clauses(rows: DataFrame, keys: list[str], text: str, phrases: DataFrame, cut: str = r"(?:\s*[.;!?]\s+|\s*;\s*|\n+)") -> DataFrame:
    """(keys, clause, source, relation, target) of the clauses that hold exactly one phrase, with words on both its sides.

    Clauses are the pieces between the cuts, trimmed of blanks and closing marks; clause counts them from 0;
    relation is the phrase's tag.
    """
    edge = r"^[ \t\n,;:.]+|[ \t\n,;:.]+$"
    pieces = F.transform(F.split(F.col(text), cut, -1), lambda c, i: F.struct(i.cast("bigint").alias("clause"), F.regexp_replace(c, edge, "").alias("body")))
    clauses = rows.select(*keys, F.explode(pieces).alias("_c")).select(*keys, "_c.clause", "_c.body", F.col("_c.body").alias("_text")).where("body <> ''")
    met = match_phrases(clauses, [*keys, "clause", "body"], "_text", phrases).groupBy(*keys, "clause", "body").agg(F.count("*").alias("_n"), F.min("begin").alias("begin"), F.min("end").alias("end"), F.min("tag").alias("relation")).where("_n = 1")
    side = lambda column: F.regexp_replace(column, edge, "")
    out = met.select(*keys, "clause", side(F.expr("substring(body, 1, CAST(begin AS INT))")).alias("source"), "relation", side(F.expr("substring(body, CAST(end AS INT) + 1)")).alias("target"))
    return out.where("source <> '' AND target <> ''")
