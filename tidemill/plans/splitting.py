"""Splits without leakage: hash sampling, holdouts, group splits, overlap contracts, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dialect import ORACLE, on_oracle, relational
from ..operators.ranking import place_in_order
from ..sources.tables import table

#: Record = document, family = source, organism = lang, graph = source and lang.


def hash_rank_order(d):
    """A deterministic shuffle: the hex digest of namespace, seed and id as sort key."""
    return f"""SELECT doc_id, {d.sha("'order:17:' || CAST(doc_id AS STRING)")} AS rank_key,
      CAST(row_number() OVER (PARTITION BY source ORDER BY {d.sha("'order:17:' || CAST(doc_id AS STRING)")}) AS BIGINT) AS pos FROM @documents"""


def fraction(d, value):
    return f"(CAST({d.hex_number(f'substr({d.sha(value)}, 1, 16)')} AS DOUBLE) / 18446744073709551616.0)"


def bucket(d, namespace, value, n):
    zero = "char(0)" if type(d).__name__ == "Dialect" else "chr(0)"
    digits = d.hex_number(f"substr({d.sha(f'''concat('{namespace}', {zero}, {value})''')}, 1, 16)")
    return f"CAST({digits} % {n} AS BIGINT)"


def hash_fraction_sample(d):
    """Bernoulli sample: the first 16 hex digits as a fraction of 2 ** 64."""
    return f"""SELECT o_orderkey, round({fraction(d, "'sample:' || CAST(o_orderkey AS STRING)")}, 9) AS draw
      FROM @orders WHERE {fraction(d, "'sample:' || CAST(o_orderkey AS STRING)")} < 0.1"""


def hash_bucket_shard(d):
    """One in four by residue, dealt to eight shards by another namespace."""
    key = "CAST(o_orderkey AS STRING)"
    return f"""SELECT shard, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key
      FROM (SELECT o_orderkey, {bucket(d, 'shard', key, 8)} AS shard FROM @orders WHERE {bucket(d, 'sample', key, 4)} = 1) GROUP BY shard"""


def stable_identities(d):
    """Namespaced content ids: graph of a source, record of a document, a row without an id of its own."""
    return f"""SELECT doc_id, 'graph:' || substr({d.sha("concat('graph', chr(10), source, chr(10), " + d.sha('text') + ")")}, 1, 24) AS graph_id,
      substr({d.sha("concat(source, '|', lang, '|', CAST(doc_id AS STRING), '|', CAST(n_chars AS STRING))")}, 1, 24) AS record_id,
      'sample:' || {d.sha("coalesce(text, 'None')")} AS fallback_id FROM @documents"""


def group_candidate_sample(d):
    """The draw is bound to the source, so a group is in whole or out; labelled toxic rows get a second draw."""
    return f"""SELECT k.doc_id, k.source, k.by_group, k.forced FROM (
      SELECT x.doc_id, x.source, {fraction(d, "'group:' || x.source")} < 0.5 AS by_group,
             coalesce(l.toxic, 0) = 1 AND {fraction(d, "'extra:' || CAST(x.doc_id AS STRING)")} < 0.8 AS forced
      FROM @documents x LEFT JOIN @labels l ON x.doc_id = l.doc_id) k WHERE k.by_group OR k.forced"""


def family_holdout(d):
    """The families of lowest hash: a fifth of them, one at least, never all."""
    return f"""SELECT source, pos <= least(greatest(1, CAST({d.half_even('n * 0.2')} AS BIGINT)), greatest(1, n - 1)) AS held_out FROM (
      SELECT source, CAST(row_number() OVER (ORDER BY {d.sha("'family:7:' || source")}) AS BIGINT) AS pos, CAST(count(*) OVER () AS BIGINT) AS n
      FROM (SELECT DISTINCT source FROM @documents))"""


def family_three_way(d):
    """Strict test, validation and train families by intersection and difference of key sets."""
    return f"""WITH f AS (SELECT DISTINCT source FROM @documents), seen AS (SELECT DISTINCT source FROM @documents WHERE lang = 'en'),
      strict AS (SELECT source FROM f WHERE {fraction(d, "'strict:' || source")} < 0.15),
      val AS (SELECT source FROM (SELECT source FROM seen EXCEPT SELECT source FROM strict) WHERE {fraction(d, "'val:' || source")} < 0.2),
      train AS (SELECT source FROM seen EXCEPT SELECT source FROM strict EXCEPT SELECT source FROM val)
      SELECT source, 'strict' AS part FROM strict UNION ALL SELECT source, 'validation' FROM val UNION ALL SELECT source, 'train' FROM train"""


def _group_split(d, namespace, share):
    """Hash split by group; where a side stays empty, that share of the groups, by hash and never all, is the validation side."""
    return f"""g AS (SELECT lang, {fraction(d, f"'{namespace}:' || lang")} AS h FROM @documents GROUP BY lang),
      r AS (SELECT lang, h, CAST(row_number() OVER (ORDER BY h, lang) AS BIGINT) AS pos, CAST(count(*) OVER () AS BIGINT) AS n, sum(CASE WHEN h < {share} THEN 1 ELSE 0 END) OVER () AS low FROM g),
      s AS (SELECT lang, CASE WHEN CASE WHEN low = 0 OR low = n THEN pos <= least(greatest(1, CAST({d.half_even(f'n * {share}')} AS BIGINT)), n - 1) ELSE h < {share} END THEN 'validation' ELSE 'train' END AS part FROM r)"""


def group_split_safe(d):
    """Whole groups by hash, and the fallback for draws that leave a side empty: a share that no group's hash is below."""
    return f"""WITH {_group_split(d, 'split', 0.25)} SELECT x.doc_id, x.lang, s.part FROM @documents x JOIN s ON x.lang = s.lang"""


def group_split_fallback(d):
    """The same with a share so small that no group's hash lies below it."""
    return f"""WITH {_group_split(d, 'split', 0.000001)} SELECT x.doc_id, x.lang, s.part FROM @documents x JOIN s ON x.lang = s.lang"""


def _group_split_oracle(share):
    """Written apart from the query: the split by lists of groups in the order of their whole hashes."""
    return f"""WITH line AS (SELECT list(lang ORDER BY sha256('split:' || lang)) AS names FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)),
  low AS (SELECT names, list_filter(names, lambda g: ('0x' || substr(sha256('split:' || g), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE < {share}) AS below FROM line),
  val AS (SELECT CASE WHEN len(below) BETWEEN 1 AND len(names) - 1 THEN below ELSE names[1:least(greatest(1, round_even(len(names) * {share}, 0)::BIGINT), len(names) - 1)] END AS chosen FROM low)
SELECT doc_id, lang, CASE WHEN list_contains(chosen, lang) THEN 'validation' ELSE 'train' END AS part FROM documents, val WHERE lang IS NOT NULL"""


_COVERAGE = """cov AS (SELECT source, count(*) AS n_docs, count(DISTINCT lang) AS n_langs, CAST(sum(n_chars) AS BIGINT) AS chars FROM @documents GROUP BY source)"""


def source_coverage(d):
    return f"""SELECT source, count(*) AS records, count(DISTINCT {d.sha('text')}) AS texts, count(DISTINCT lang) AS langs, CAST(sum(n_chars) AS BIGINT) AS chars,
      CAST(sum(CASE WHEN text = '' THEN 1 ELSE 0 END) AS BIGINT) AS empty_texts, count(*) - count(DISTINCT {d.sha('text')}) AS duplicate_texts FROM @documents GROUP BY source"""


def _holdout(d, protected="'src0'", most_strata=10, share=0.2, seed=7):
    """Sources but the protected ones, by records, languages and mean length, in equal strata of two at least."""
    stratum = "'coverage_quantile_' || lpad(CAST(stratum AS STRING), 2, '0')"
    return f"""{_COVERAGE},
      candidates AS (SELECT source, row_number() OVER (ORDER BY n_docs, n_langs, CAST(chars AS DOUBLE) / n_docs, source) - 1 AS place, count(*) OVER () AS n_all FROM cov WHERE source NOT IN ({protected})),
      counted AS (SELECT source, place, n_all, least({most_strata}, greatest(1, floor(n_all / 2.0))) AS n_strata FROM candidates),
      strata AS (SELECT source, CAST(least(n_strata - 1, floor(place * n_strata / CAST(n_all AS DOUBLE))) AS BIGINT) AS stratum FROM counted),
      ranked AS (SELECT source, stratum, CAST(row_number() OVER (PARTITION BY stratum ORDER BY {d.sha(f"'coverage_holdout:' || {stratum} || ':{seed}:' || source")}, source) AS BIGINT) AS pos, CAST(count(*) OVER (PARTITION BY stratum) AS BIGINT) AS n FROM strata),
      held AS (SELECT source FROM ranked WHERE pos <= least(n - 1, greatest(1, CAST({d.half_even(f'n * {share}')} AS BIGINT))))"""


def coverage_quantile_holdout(d):
    """Sources in strata by coverage; of each stratum the lowest hashes are held out. A protected source is in no stratum."""
    return f"WITH {_holdout(d)} SELECT c.source, r.stratum, h.source IS NOT NULL AS held_out FROM cov c LEFT JOIN ranked r ON c.source = r.source LEFT JOIN held h ON c.source = h.source"


#: Written apart from the query: lists in place of windows.
_HOLDOUT_ORACLE = """WITH per AS (SELECT source, count(*) AS records, count(DISTINCT lang) AS langs, sum(n_chars) / count(*) AS mean FROM documents GROUP BY source),
  line AS (SELECT list(source ORDER BY records, langs, mean, source) AS names FROM per WHERE source <> 'src0'),
  placed AS (SELECT unnest(names) AS source, unnest(range(len(names))) AS i, len(names) AS n FROM line),
  strata AS (SELECT source, least(g - 1, i * g // n) AS stratum FROM (SELECT *, least(10, greatest(1, n // 2)) AS g FROM placed)),
  drawn AS (SELECT stratum, list(source ORDER BY sha256('coverage_holdout:coverage_quantile_' || right('0' || stratum::VARCHAR, 2) || ':7:' || source), source) AS names FROM strata GROUP BY stratum),
  held AS (SELECT unnest(CASE WHEN len(names) < 2 THEN [] ELSE names[1:least(len(names) - 1, greatest(1, round_even(len(names) * 0.2, 0)::BIGINT))] END) AS source FROM drawn)
SELECT per.source, stratum::BIGINT AS stratum, per.source IN (SELECT source FROM held) AS held_out FROM per LEFT JOIN strata USING (source)"""


def _splits(d):
    return f"""{_holdout(d)},
      fam AS (SELECT source, lang, CASE WHEN {fraction(d, "'assign:' || source || lang")} < 0.7 THEN 'train' WHEN {fraction(d, "'assign:' || source || lang")} < 0.9 THEN 'validation' ELSE 'test' END AS part
              FROM (SELECT DISTINCT source, lang FROM @documents)),
      splits AS (SELECT x.doc_id, x.source, x.lang, x.n_chars, {d.sha('x.text')} AS text_id,
                        CASE WHEN h.source IS NOT NULL AND f.part = 'test' THEN 'heldout_both' WHEN h.source IS NOT NULL THEN 'heldout_source' WHEN f.part = 'test' THEN 'test_family' ELSE f.part END AS split
                 FROM @documents x JOIN fam f ON x.source = f.source AND x.lang = f.lang LEFT JOIN held h ON x.source = h.source)"""


def split_assignment(d):
    """Records with their family's part and, by an outer join, whether their source is held out; a five-way truth table."""
    return f"WITH {_splits(d)} SELECT doc_id, split FROM splits"


def split_summary(d):
    """The flagship: leakage-safe splits and their coverage."""
    return f"""WITH {_splits(d)} SELECT split, count(*) AS records, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs, count(DISTINCT text_id) AS texts,
      CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS chars, count(*) - count(DISTINCT text_id) AS duplicates FROM splits GROUP BY split"""


def explicit_or_hashed_split(d):
    """Listed keys go to test; else a fraction of a chosen key's hash decides."""
    return f"""SELECT doc_id, CASE WHEN source IN ('src3', 'src7') THEN 'test' WHEN {fraction(d, "'key:' || CAST(doc_id AS STRING)")} < 0.1 THEN 'test' ELSE 'train' END AS part FROM @documents"""


def _overlap(d):
    return f"""{_splits(d)},
      keys AS (SELECT DISTINCT 'source' AS identity, source AS value, split FROM splits UNION SELECT DISTINCT 'lang', lang, split FROM splits UNION SELECT DISTINCT 'text', coalesce(text_id, ''), split FROM splits),
      pairs AS (SELECT i.identity, a.split AS a, b.split AS b FROM (SELECT DISTINCT split FROM splits) a JOIN (SELECT DISTINCT split FROM splits) b ON a.split < b.split, (SELECT DISTINCT identity FROM keys) i),
      shared AS (SELECT l.identity, l.split AS a, r.split AS b, count(DISTINCT l.value) AS n FROM keys l JOIN keys r ON l.identity = r.identity AND l.value = r.value AND l.split < r.split GROUP BY l.identity, l.split, r.split),
      matrix AS (SELECT p.identity, p.a, p.b, coalesce(s.n, 0) AS n_shared FROM pairs p LEFT JOIN shared s ON p.identity = s.identity AND p.a = s.a AND p.b = s.b)"""


def overlap_matrix(d):
    return f"WITH {_overlap(d)} SELECT identity, a, b, n_shared FROM matrix"


def overlap_contract(d):
    """Each pair and identity against its rule: forbidden, allowed or required."""
    return f"""WITH {_overlap(d)}, rules AS (SELECT identity, a, b, n_shared, CASE WHEN identity = 'text' THEN 'forbidden' WHEN identity = 'lang' THEN 'required' ELSE 'allowed' END AS rule FROM matrix)
      SELECT identity, a, b, rule, n_shared, CASE rule WHEN 'forbidden' THEN n_shared = 0 WHEN 'required' THEN n_shared > 0 ELSE true END AS holds FROM rules"""


def two_key_map(d):
    return f"SELECT source, {d.joined('lang || chr(58) || CAST(n AS STRING)', 'lang', ',')} AS by_lang, CAST(sum(n) AS BIGINT) AS total FROM (SELECT source, lang, count(*) AS n FROM @documents GROUP BY source, lang) GROUP BY source"


def seen_source_filter(d):
    """Left anti join on held-out sources, then counts of two keys."""
    return f"WITH {_holdout(d)} SELECT x.source, x.lang, count(*) AS n FROM @documents x LEFT ANTI JOIN held h ON x.source = h.source GROUP BY x.source, x.lang".replace("LEFT ANTI JOIN", "LEFT ANTI JOIN" if type(d).__name__ == "Dialect" else "ANTI JOIN")


def counterpart_coverage(d):
    """Labels with and without a document, and documents of labelled sources, by source."""
    return """SELECT x.source, count(*) AS docs, count(l.doc_id) AS labelled, CAST(sum(CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing
      FROM @documents x LEFT JOIN @labels l ON x.doc_id = l.doc_id WHERE x.source IN (SELECT y.source FROM @documents y JOIN @labels m ON y.doc_id = m.doc_id WHERE m.toxic = 1) GROUP BY x.source"""


def seeded_name_split(d):
    """Names in hash order: 15 % unseen, then 5 % of the rest for validation."""
    return f"""WITH r AS (SELECT p_brand, CAST(row_number() OVER (ORDER BY {d.sha("'names:42:' || p_brand")}) AS BIGINT) AS pos, CAST(count(*) OVER () AS BIGINT) AS n FROM (SELECT DISTINCT p_brand FROM @part))
      SELECT p_brand, CASE WHEN pos <= floor(n * 0.15) THEN 'unseen' WHEN pos <= floor(n * 0.15) + floor(n * 0.05) + 1 THEN 'validation' ELSE 'train' END AS part FROM r"""


def strided_shard(d):
    """Row i goes to shard i mod n; the global index stays with the row."""
    return """SELECT o_orderkey, idx, CAST(idx % 4 AS BIGINT) AS shard FROM (SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS idx FROM @orders)"""


def shard_merge_coverage(d):
    """Input against shard outputs on the index: missing, unexpected, repeated and changed rows."""
    return f"""WITH src AS (SELECT o_orderkey AS idx, o_orderstatus AS status, o_totalprice AS price FROM @orders),
      out AS (SELECT o_orderkey AS idx, CASE WHEN o_orderkey % 97 = 0 THEN 'X' ELSE o_orderstatus END AS status, o_totalprice AS price FROM @orders WHERE o_orderkey % 50 <> 3
              UNION ALL SELECT -o_orderkey, o_orderstatus, o_totalprice FROM @orders WHERE o_orderkey % 400 = 1 UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice FROM @orders WHERE o_orderkey % 300 = 5),
      dup AS (SELECT count(*) AS n FROM (SELECT idx FROM out GROUP BY idx HAVING count(*) > 1)),
      j AS (SELECT s.idx AS a, o.idx AS b, s.status IS NOT DISTINCT FROM o.status AND s.price IS NOT DISTINCT FROM o.price AS same FROM src s FULL OUTER JOIN (SELECT DISTINCT idx, status, price FROM out) o ON s.idx = o.idx)
      SELECT CAST(sum(CASE WHEN b IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, CAST(sum(CASE WHEN a IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unexpected,
             CAST(sum(CASE WHEN a IS NOT NULL AND b IS NOT NULL AND NOT same THEN 1 ELSE 0 END) AS BIGINT) AS changed, max(dup.n) AS repeated FROM j, dup"""


def disjointness_guard(d):
    """Values on both sides of a split that must be disjoint, with the first examples."""
    return f"""WITH {_splits(d)}, t AS (SELECT DISTINCT source FROM splits WHERE split = 'train'), v AS (SELECT DISTINCT source FROM splits WHERE split = 'validation'),
      both_sides AS (SELECT source FROM t INTERSECT SELECT source FROM v) SELECT count(*) AS n_shared, {d.joined('source', 'source', ',')} AS examples FROM both_sides"""


def paired_profile_contract(d):
    """Two projections of the same records: same ids, one a subset of the other, equal answers where shared."""
    return """WITH p0 AS (SELECT doc_id, lang AS answer FROM @documents), p1 AS (SELECT doc_id, lower(lang) AS answer FROM @documents), p2 AS (SELECT doc_id, lang AS answer FROM @documents WHERE n_chars > 500)
      SELECT CAST(sum(CASE WHEN p0.doc_id IS NULL OR p1.doc_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS only_one_side,
             CAST(sum(CASE WHEN p2.doc_id IS NOT NULL AND p0.doc_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS not_subset,
             CAST(sum(CASE WHEN p0.answer <> p1.answer THEN 1 ELSE 0 END) AS BIGINT) AS answers_differ, count(p2.doc_id) AS in_subset
      FROM p0 FULL OUTER JOIN p1 ON p0.doc_id = p1.doc_id FULL OUTER JOIN p2 ON p0.doc_id = p2.doc_id"""


def config_anti_join(d):
    """Required paths that no command names."""
    return """WITH need AS (SELECT r_name AS path FROM @region UNION ALL SELECT n_name FROM @nation), named AS (SELECT n_name AS path FROM @nation WHERE n_regionkey < 3)
      SELECT path FROM need WHERE NOT EXISTS (SELECT 1 FROM named WHERE named.path = need.path)"""


def union_allow_missing(d):
    return """SELECT s_name AS name, s_nationkey AS nation, s_acctbal AS balance, CAST(NULL AS STRING) AS segment FROM @supplier
      UNION ALL SELECT c_name, c_nationkey, c_acctbal, c_mktsegment FROM @customer"""


def _hash_rank_order(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.concat(F.lit("order:17:"), F.col("doc_id").cast("string")), 256).alias("rank_key"))
    return place_in_order(rows, ["rank_key"], ["source"]).select("doc_id", "rank_key", (F.col("place") + 1).alias("pos"))


def _strided_shard(spark, sf_dir):
    placed = place_in_order(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])
    return placed.select("o_orderkey", F.col("place").alias("idx"), (F.col("place") % 4).alias("shard"))


QUERIES = relational(
    hash_fraction_sample, hash_bucket_shard, stable_identities, group_candidate_sample, family_holdout, family_three_way, group_split_safe, group_split_fallback, source_coverage,
    coverage_quantile_holdout, split_assignment, split_summary, explicit_or_hashed_split, overlap_matrix, overlap_contract, two_key_map, seen_source_filter, counterpart_coverage,
    seeded_name_split, shard_merge_coverage, disjointness_guard, paired_profile_contract, config_anti_join, union_allow_missing,
) | {
    "hash_rank_order": (_hash_rank_order, on_oracle(hash_rank_order(ORACLE))),
    "strided_shard": (_strided_shard, on_oracle(strided_shard(ORACLE))),
}

QUERIES["coverage_quantile_holdout"] = (QUERIES["coverage_quantile_holdout"][0], _HOLDOUT_ORACLE)
QUERIES["group_split_safe"] = (QUERIES["group_split_safe"][0], _group_split_oracle(0.25))
QUERIES["group_split_fallback"] = (QUERIES["group_split_fallback"][0], _group_split_oracle(0.000001))
