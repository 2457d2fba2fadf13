"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Every source gets a target in words. What a target holds of whole passes over its source is
allocated as certain copies of each document; for the rest a fixed-size sample is drawn:
documents are ranked by the odds of a random number over their inclusion odds, and taken in
that order until the missing words are met. The rank is a 52-bit integer, and the cut of a
source is found by two rounds of 4096-bin histograms and a window over the distinct keys of
one leaf bin, so no source, however hot, meets in one task; then each document decides
alone, by comparing its own key with its source's cut. Rows of one rank go by doc_id and a
digest of their text; equal rows are counted, and the last of them that is taken is found
by the numbers that the tasks gave them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import dropped, written

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
SEED = "mix"
#: A plan of at most so many sources (about 100 bytes each) is broadcast; a larger one is joined by a shuffle.
BROADCAST_SOURCES = 100_000

_SCALE = float(1 << 52)
_NO_ID = -(1 << 63)


def _bits(seed: str) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def _ranked(rows: DataFrame) -> DataFrame:
    """rows with _key: random odds over inclusion odds as a 52-bit integer, then doc_id and text; its rank is null where nothing is sampled."""
    u = (F.col("_bits") + F.lit(0.5)) / F.lit(_SCALE)
    pi = F.col("_rest") / F.col("source_size")
    q = (u / (F.lit(1.0) - u)) / ((pi / (F.lit(1.0) - pi)) * F.col("_pref"))
    rank = F.when(F.col("_rest") > 0, F.least(F.floor(q / (F.lit(1.0) + q) * F.lit(_SCALE)), F.lit((1 << 52) - 1)))
    return rows.withColumn("_key", F.struct(rank.alias("rank"), F.coalesce("_id", F.lit(_NO_ID)).alias("id"), F.col("_text").alias("text")))


def _measures(seed: str, preference: str | None) -> list[Column]:
    """What a document is ranked by, and its size; _row tells equal rows apart."""
    text = F.col("text").cast("string")
    pref = F.lit(1.0) if preference is None else F.greatest(F.coalesce(F.col(preference).cast("double"), F.lit(1.0)), F.lit(1e-6))
    digest = F.conv(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 15), 16, 10).cast("long")
    return [
        F.col("doc_id").cast("long").alias("_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        _bits(seed).alias("_bits"), pref.alias("_pref"), digest.alias("_text"), F.monotonically_increasing_id().alias("_row"),
    ]


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """Rows (source, source_size, target): share of all words by weight, none above most times its source.

    With caps c and weights w, sorted by c / w, the level that fills the total is the largest
    of (total - caps before) / (weights from here on); a target is the smaller of its cap and
    level times weight, which is what resharing the excess again and again comes to. The
    windows without keys run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("_w", cycle).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("_w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) * F.lit(share) - before) / onward
    per = per.withColumn("_level", level).withColumn("_top", F.max("_level").over(everything))
    return per.select("source", "source_size", F.least("_cap", F.col("_top") * F.col("_w")).alias("target"))


def _joined(rows: DataFrame, small: DataFrame, small_enough: bool) -> DataFrame:
    small = small.withColumnRenamed("source", "_s")
    return rows.join(F.broadcast(small) if small_enough else small, F.col("source").eqNullSafe(F.col("_s")), "inner").drop("_s")


def _boundary(rows: DataFrame, bin_: Column, need: str) -> DataFrame:
    """The bin of each source in which its words first reach what it needs: (source, _bin, _rest_in)."""
    bins = rows.groupBy("source", bin_.alias("_bin")).agg(F.sum("size").alias("_n"), F.first(need).alias("_need"))
    upto = F.sum("_n").over(Window.partitionBy("source").orderBy("_bin"))
    bins = bins.withColumn("_upto", upto).where("_upto >= _need AND _upto - _n < _need")
    return bins.groupBy("source").agg(F.min_by("_bin", "_bin").alias("_bin"), F.min_by(F.col("_need") - F.col("_upto") + F.col("_n"), "_bin").alias("_rest_in"))


def mixture_plan(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: str = SEED, preference: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(sizes per document, plan per source: source_size, target, whole copies and the key and row of its cut)."""
    spark = docs.sparkSession
    sizes = written(docs.select(*_measures(seed, preference)), "mix-sizes")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = source_targets(sizes, weights, share, most).withColumn("whole", whole)
    plan = written(plan.withColumn("_rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))), "mix-plan")
    small = plan.count() <= BROADCAST_SOURCES
    ranked = _ranked(_joined(sizes, plan, small)).where("_rest > 0")
    first = written(_boundary(ranked, F.shiftright("_key.rank", 40), "_rest").select("source", F.col("_bin").alias("_b1"), F.col("_rest_in").alias("_r1")), "mix-first")
    inside = _joined(ranked, first, small).where(F.shiftright("_key.rank", 40) == F.col("_b1"))
    fine = F.shiftright("_key.rank", 28).bitwiseAND(F.lit(4095))
    second = written(_boundary(inside, fine, "_r1").select("source", F.col("_bin").alias("_b2"), F.col("_rest_in").alias("_r2")), "mix-second")
    leaf = _joined(inside, second, small).where(fine == F.col("_b2"))
    # the leaf's distinct keys; of the key in which the words are met, as many equal rows as come nearest
    keys = leaf.groupBy("source", "_key").agg(F.sum("size").alias("_n"), F.max("size").alias("_one"), F.count("*").alias("_rows"), F.first("_r2").alias("_r2"))
    before = F.sum("_n").over(Window.partitionBy("source").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    fits = F.when(F.col("_one") > 0, F.floor((F.col("_r2") - F.col("_before")) / F.col("_one") + F.lit(0.5))).otherwise(F.when(F.col("_before") <= F.col("_r2"), F.col("_rows")).otherwise(0))
    keys = keys.withColumn("_before", before).withColumn("_fit", F.least(fits.cast("long"), F.col("_rows"))).where("_fit > 0")
    last = keys.groupBy("source").agg(F.max_by(F.struct(F.col("_key").alias("_cut"), "_fit", "_rows"), "_key").alias("_last")).select(F.col("source").alias("_s"), "_last.*")
    # where none of a leaf fits, the cut is before the leaf
    low = F.struct((F.shiftleft("_b1", 40) + F.shiftleft("_b2", 28)).alias("rank"), F.lit(_NO_ID).alias("id"), F.lit(-1).cast("long").alias("text"))
    last = _joined(first, second, small).join(last, F.col("source").eqNullSafe(F.col("_s")), "left")
    last = written(last.select("source", F.coalesce("_cut", low).alias("_cut"), "_fit", "_rows"), "mix-last")
    # the row of that key at place _fit: rows are numbered task by task, so the tasks' counts find the task, and a window over its rows the place
    partial = _joined(leaf.select("source", "_key", "_row"), last.where("_fit < _rows"), small).where("_key = _cut").withColumn("_task", F.shiftright("_row", 33))
    tasks = partial.groupBy("source", "_task").agg(F.count("*").alias("_n"), F.first("_fit").alias("_fit"))
    upto = F.sum("_n").over(Window.partitionBy("source").orderBy("_task"))
    there = tasks.withColumn("_upto", upto).where("_upto >= _fit AND _upto - _n < _fit").select("source", F.col("_task").alias("_at"), (F.col("_fit") - F.col("_upto") + F.col("_n")).alias("_place"))
    number = F.row_number().over(Window.partitionBy("source").orderBy("_row"))
    rows = _joined(partial, there, small).where("_task = _at").withColumn("_number", number).where("_number = _place").select("source", F.col("_row").alias("_cut_row"))
    named = lambda df, prefix: df.withColumnRenamed("source", prefix)
    done = plan.join(named(last.select("source", "_cut"), "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    done = done.join(named(rows, "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    out = written(done, "mix-cuts")
    for used in (plan, first, second, last):
        dropped(spark, used)
    return sizes, out


def _copies() -> Column:
    """Whole copies, and one more for a row at or before its source's cut."""
    met = (F.col("_key") < F.col("_cut")) | ((F.col("_key") == F.col("_cut")) & (F.col("_row") <= F.coalesce("_cut_row", "_row")))
    return F.col("whole") + F.when(F.coalesce(met, F.lit(False)) & (F.col("_rest") > 0), 1).otherwise(0)


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: str = SEED, preference: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies, taken.

    weights repeat over the sources in code-point order, null last. preference names a
    positive column that multiplies a document's inclusion odds. A null text has size 0; a
    null source is a source of its own. Rows that share a doc_id are taken one by one, in the
    order of a digest of their texts; of equal rows the first ones are taken. Other columns
    of docs are ignored, an empty table gives an empty result, and the same rows and seed
    give the same mix.
    """
    sizes, plan = mixture_plan(docs, weights, share, most, seed, preference)
    small = plan.count() <= BROADCAST_SOURCES
    rows = _ranked(_joined(sizes, plan, small)).withColumn("copies", _copies())
    return rows.select(F.col("_id").alias("doc_id"), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: str = SEED, preference: str | None = None) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, its columns unchanged, without moving any text.

    docs is read twice and must give its rows in the same order each time, as a table does;
    nulls, repeats and ties are as for mix_sources. Columns of any name pass through; an
    empty table gives an empty result.
    """
    sizes, plan = mixture_plan(docs, weights, share, most, seed, preference)
    dropped(docs.sparkSession, sizes)
    small = plan.count() <= BROADCAST_SOURCES
    own = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("_own")
    rows = _ranked(_joined(docs.select(own, *_measures(seed, preference)), plan, small)).withColumn("_copies", _copies().cast("int"))
    rows = rows.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return rows.select(*(F.col(f"_own.c{i}").alias(c) for i, c in enumerate(docs.columns)))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT AS bits
  FROM documents),
s AS (
  SELECT source, sum(size)::DOUBLE AS source_size,
         (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS w
  FROM d GROUP BY source),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s),
t AS (SELECT source, source_size, least(2 * source_size, max(level) OVER () * w) AS target FROM l),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
r AS (
  SELECT d.*, p.source_size, p.target, p.whole, greatest(target - whole * source_size, 0) AS rest,
         (bits + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
q AS (
  SELECT *, CASE WHEN rest > 0 THEN (u / (1 - u)) / ((rest / source_size) / (1 - rest / source_size)) END AS odds FROM r),
c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY floor(odds / (1 + odds) * 4503599627370496::DOUBLE), doc_id NULLS FIRST, sha256(coalesce(text, '')) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM q)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (size * (whole + CASE WHEN rest > 0 AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
