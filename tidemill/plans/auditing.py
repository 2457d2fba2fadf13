"""Audits: histograms and percentiles, row and group contracts, digests, reductions."""

from __future__ import annotations

from ..functions.dialect import relational


def histogram_summary(d):
    """Count, range, mean and discrete percentiles of each group: the smallest value that covers the share."""
    return f"""SELECT lang, count(*) AS n, min(n_chars) AS low, max(n_chars) AS high, round(avg(n_chars), 6) AS mean, {d.discrete(0.5, 'n_chars')} AS p50, {d.discrete(0.9, 'n_chars')} AS p90,
      {d.discrete(0.95, 'n_chars')} AS p95, {d.discrete(0.99, 'n_chars')} AS p99 FROM @documents GROUP BY lang"""


def length_summary(d):
    """The other rule: first value whose running count reaches max(1, n * f rounded half to even)."""
    cut = lambda f: f"min(CASE WHEN upto >= greatest(1, {d.half_even(f'n * {f}')}) THEN n_chars END)"
    return f"""WITH h AS (SELECT lang, n_chars, count(*) AS c FROM @documents GROUP BY lang, n_chars),
      u AS (SELECT lang, n_chars, CAST(sum(c) OVER (PARTITION BY lang ORDER BY n_chars) AS BIGINT) AS upto, CAST(sum(c) OVER (PARTITION BY lang) AS BIGINT) AS n FROM h)
      SELECT lang, max(n) AS n, {cut('0.5')} AS p50, {cut('0.9')} AS p90, {cut('0.95')} AS p95, {cut('0.99')} AS p99 FROM u GROUP BY lang"""


def linear_percentiles(d):
    """Interpolated percentiles and the recommended length, the next multiple of eight."""
    return f"""SELECT lang, round({d.value_at(0.5, 'n_chars')}, 6) AS p50, round({d.value_at(0.95, 'n_chars')}, 6) AS p95, CAST(ceil({d.value_at(0.95, 'n_chars')} / 8) * 8 AS BIGINT) AS recommended FROM @documents GROUP BY lang"""


def median_metric(d):
    return f"SELECT l_returnflag, round({d.value_at(0.5, 'l_extendedprice')}, 6) AS median_price, count(*) AS n FROM @lineitem GROUP BY l_returnflag"


def _rules(d):
    return f"""v AS (
      SELECT doc_id, 'empty_text' AS rule FROM @documents WHERE text IS NULL OR text = '' UNION ALL
      SELECT doc_id, 'length_mismatch' FROM @documents WHERE n_chars <> {d.chars('text')} UNION ALL
      SELECT doc_id, 'unknown_lang' FROM @documents WHERE lang NOT IN ('en', 'de', 'fr') UNION ALL
      SELECT doc_id, 'bad_source' FROM @documents WHERE NOT {d.matches('source', '^src[0-9]+$')} UNION ALL
      SELECT doc_id, 'too_long' FROM @documents WHERE n_chars > 5000 UNION ALL
      SELECT x.doc_id, 'repeated_text' FROM (SELECT doc_id, {d.sha('text')} AS h FROM @documents) x JOIN (SELECT {d.sha('text')} AS h, min(doc_id) AS keeper FROM @documents GROUP BY {d.sha('text')} HAVING count(*) > 1) k ON x.h = k.h WHERE x.doc_id > k.keeper)"""


def audit_violations(d):
    return f"WITH {_rules(d)} SELECT rule, count(*) AS n, min(doc_id) AS first_doc FROM v GROUP BY rule"


def first_n_errors(d):
    return f"WITH {_rules(d)} SELECT rule, doc_id, pos FROM (SELECT rule, doc_id, CAST(row_number() OVER (PARTITION BY rule ORDER BY doc_id) AS BIGINT) AS pos FROM v) WHERE pos <= 5"


def status_inventory(d):
    """Status histogram with coalesced sums and ranges."""
    return "SELECT o_orderstatus AS status, count(*) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total, min(o_orderkey) AS low, max(o_orderkey) AS high FROM @orders GROUP BY o_orderstatus"


def group_consistency(d):
    """One value per group, none missing."""
    return """SELECT l_orderkey, count(DISTINCT l_returnflag) AS flags, min(l_returnflag) = max(l_returnflag) AS consistent, count(*) = count(l_shipdate) AS complete FROM @lineitem GROUP BY l_orderkey"""


def duplicate_ids(d):
    """Ids that occur twice inside a document, and the documents this rejects as a whole."""
    return f"""WITH b AS (SELECT l_orderkey, l_suppkey, count(*) AS n FROM @lineitem GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1)
      SELECT l_orderkey, count(*) AS bad_ids, {d.joined('CAST(l_suppkey AS STRING)', 'l_suppkey', ',')} AS ids FROM b GROUP BY l_orderkey"""


def whole_group_rejection(d):
    """One bad row rejects its group: groups without any."""
    return "SELECT o.o_orderkey, o.o_orderstatus FROM @orders o WHERE NOT EXISTS (SELECT 1 FROM @lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45)"


def strict_values(d):
    """Strict casts: positive integers and booleans by their text, everything else a violation."""
    value = d.json("props", "$.k")
    cast = f"TRY_CAST({value} AS BIGINT)"
    return f"SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN {cast} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS not_integer, CAST(sum(CASE WHEN {cast} > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive FROM @events GROUP BY event_type"


def set_digest(d):
    """Order-insensitive checksum: the hash of the sorted distinct ids, one a line."""
    return f"SELECT n_regionkey, {d.sha(d.joined('n_name', 'n_name', chr(10)))} AS digest, count(*) AS n FROM (SELECT DISTINCT n_regionkey, n_name FROM @nation) GROUP BY n_regionkey"


def row_contract_hash(d):
    """Checksum of the ordered fields of a row."""
    return f"""SELECT n_nationkey, {d.sha("concat('[', CAST(n_nationkey AS STRING), ',' || chr(34), n_name, chr(34) || ',', CAST(n_regionkey AS STRING), ']')")} AS row_hash FROM @nation"""


def inventory_digest(d):
    """Digest of path, tab, size lines in path order."""
    return f"""SELECT source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, {d.sha(d.joined("concat(CAST(doc_id AS STRING), chr(9), CAST(n_chars AS STRING))", 'doc_id', chr(10)))} AS digest FROM @documents GROUP BY source"""


def inventory_verify(d):
    """Declared against live hashes: missing, extra and changed."""
    return f"""WITH declared AS (SELECT doc_id, {d.sha('text')} AS h FROM @documents WHERE doc_id % 20 <> 7), live AS (SELECT doc_id, {d.sha("CASE WHEN doc_id % 33 = 4 THEN text || '!' ELSE text END")} AS h FROM @documents WHERE doc_id % 30 <> 11)
      SELECT CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN x.doc_id IS NULL THEN 'extra' WHEN x.h <> l.h THEN 'changed' ELSE 'same' END AS status, count(*) AS n
      FROM declared x FULL OUTER JOIN live l ON x.doc_id = l.doc_id GROUP BY CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN x.doc_id IS NULL THEN 'extra' WHEN x.h <> l.h THEN 'changed' ELSE 'same' END"""


def record_row_reconstruction(d):
    """Rows rebuilt from nested records and compared by hash with the flat rows."""
    return f"""WITH flat AS (SELECT l_orderkey, l_linenumber, {d.sha("concat(CAST(l_orderkey AS STRING), ':', CAST(l_linenumber AS STRING), ':', CAST(l_partkey AS STRING))")} AS h FROM @lineitem),
      rec AS (SELECT l_orderkey, {d.collect("concat(CAST(l_linenumber AS STRING), ':', CAST(l_partkey AS STRING))")} AS items FROM @lineitem GROUP BY l_orderkey),
      again AS (SELECT l_orderkey, {d.sha("concat(CAST(l_orderkey AS STRING), ':', item)")} AS h FROM (SELECT l_orderkey, {d.explode('items')} AS item FROM rec))
      SELECT count(*) AS n_rows, count(a.h) AS n_same FROM flat f LEFT JOIN again a ON f.l_orderkey = a.l_orderkey AND f.h = a.h"""


def nested_record_stats(d):
    """Counters over nested records: layers, items, duplicates."""
    return f"""WITH rec AS (SELECT o.o_orderpriority AS kind, l.l_orderkey, count(*) AS items, count(DISTINCT l_suppkey) AS partners, {d.collect('l_quantity')} AS q FROM @lineitem l JOIN @orders o ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderpriority, l.l_orderkey)
      SELECT kind, count(*) AS records, CAST(sum(items) AS BIGINT) AS items, CAST(sum(items - partners) AS BIGINT) AS repeats, CAST(sum({d.size(d.kept('q', 'x', 'x > 25'))}) AS BIGINT) AS large FROM rec GROUP BY kind"""


def nested_record_build(d):
    """One row per order with its lines in order."""
    return f"""SELECT o.o_orderkey, o.o_orderstatus, count(*) AS layers, {d.joined("concat(CAST(l_linenumber AS STRING), ':', CAST(l_partkey AS STRING), ':', l_returnflag)", 'l_linenumber, l_partkey, l_returnflag', '|')} AS body
      FROM @orders o JOIN @lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey, o.o_orderstatus"""


def token_budget_audit(d):
    """Token counters (one a character as proxy), head and tail kept of an over-long prompt, safe ratios."""
    return f"""WITH t AS (SELECT conv_id, role, {d.chars('text')} AS n FROM @conversations), m AS (SELECT *, least(192, greatest(1, CAST(floor(256 / 3) AS BIGINT))) AS head FROM t)
      SELECT role, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(CASE WHEN n > 256 THEN 1 ELSE 0 END) AS BIGINT) AS trimmed, CAST(sum(CASE WHEN n > 256 THEN n - 256 ELSE 0 END) AS BIGINT) AS lost,
             CAST(max(head) AS BIGINT) AS head, round(CAST(sum(least(n, 256)) AS DOUBLE) / nullif(sum(n), 0), 9) AS share FROM m GROUP BY role"""


def trimmed_prompts(d):
    """Head and tail of a prompt over budget: head = min(192, max(1, budget // 3))."""
    return f"""SELECT conv_id, turn, CASE WHEN {d.chars('text')} <= 120 THEN text ELSE substr(text, 1, 40) || substr(text, CAST({d.chars('text')} - 79 AS INT), 80) END AS kept FROM @conversations"""


def safe_means(d):
    """Mean with 0 on empty, and the plain one."""
    return "SELECT l_linestatus, round(coalesce(avg(CASE WHEN l_quantity > 49 THEN l_discount END), 0), 9) AS or_zero, round(avg(CASE WHEN l_quantity > 60 THEN l_discount END), 9) AS or_null FROM @lineitem GROUP BY l_linestatus"


def group_metric_means(d):
    return "SELECT l_suppkey, round(avg(l_quantity), 9) AS quantity, round(avg(l_discount), 9) AS discount, round(avg(l_tax), 9) AS tax FROM @lineitem GROUP BY l_suppkey"


def micro_totals(d):
    """tp, fp and fn over all rows and the scores from the totals."""
    return """WITH t AS (SELECT sum(CASE WHEN l_returnflag = 'R' AND l_quantity > 25 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN l_returnflag <> 'R' AND l_quantity > 25 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN l_returnflag = 'R' AND l_quantity <= 25 THEN 1 ELSE 0 END) AS fn FROM @lineitem)
      SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 9) AS prec, round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 9) AS rec, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1 FROM t"""


def weighted_reduce(d):
    """Mean over ranks weighted by their counts, from partial sums."""
    return """WITH p AS (SELECT l_orderkey % 8 AS rank_, sum(l_discount) AS s, count(*) AS n FROM @lineitem GROUP BY l_orderkey % 8) SELECT round(sum(s) / sum(n), 9) AS mean, CAST(sum(n) AS BIGINT) AS n, count(*) AS ranks FROM p"""


def merge_counters(d):
    """Finish reasons and attempts of merged shards."""
    return "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total, round(max(value), 4) AS top FROM @events GROUP BY event_type"


def strict_order_check(d):
    """Indices that must rise by one inside a record."""
    return """WITH s AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM @conversations)
      SELECT conv_id, min(turn) = 0 AND min(CASE WHEN before IS NULL OR turn = before + 1 THEN 1 ELSE 0 END) = 1 AS in_order, count(*) AS n FROM s GROUP BY conv_id"""


def group_rules(d):
    """Case validators: exactly one largest line, quantities in range, ids unique, at least one child."""
    return """WITH m AS (SELECT l_orderkey, max(l_extendedprice) AS top FROM @lineitem GROUP BY l_orderkey)
      SELECT l.l_orderkey, sum(CASE WHEN l.l_extendedprice = m.top THEN 1 ELSE 0 END) = 1 AS one_top, min(CASE WHEN l_quantity BETWEEN 1 AND 50 THEN 1 ELSE 0 END) = 1 AS in_range,
             count(*) = count(DISTINCT l_linenumber) AS unique_ids, sum(CASE WHEN l_discount BETWEEN 0 AND 1 THEN 0 ELSE 1 END) = 0 AS probabilities FROM @lineitem l JOIN m ON l.l_orderkey = m.l_orderkey GROUP BY l.l_orderkey"""


def field_provenance(d):
    """Null-safe comparison of each field across two sides."""
    return """SELECT CAST(sum(CASE WHEN a.c_name IS NOT DISTINCT FROM b.c_name THEN 0 ELSE 1 END) AS BIGINT) AS name_differs, CAST(sum(CASE WHEN a.seg IS NOT DISTINCT FROM b.seg THEN 0 ELSE 1 END) AS BIGINT) AS segment_differs,
             CAST(sum(CASE WHEN a.c_acctbal IS NOT DISTINCT FROM b.c_acctbal THEN 0 ELSE 1 END) AS BIGINT) AS balance_differs
      FROM (SELECT c_custkey, c_name, nullif(c_mktsegment, 'BUILDING') AS seg, c_acctbal FROM @customer) a JOIN (SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE nullif(c_mktsegment, 'BUILDING') END AS seg, c_acctbal FROM @customer) b ON a.c_custkey = b.c_custkey"""


def conflict_coalesce(d):
    """Two sources of one fact: available, missing, agreed or in conflict."""
    return """WITH s AS (SELECT x.doc_id, CASE WHEN x.doc_id % 3 = 0 THEN NULL ELSE lower(trim(x.lang)) END AS a, CASE WHEN l.quality IS NULL THEN NULL WHEN l.quality = 1 THEN lower(x.lang) ELSE 'xx' END AS b FROM @documents x LEFT JOIN @labels l ON x.doc_id = l.doc_id)
      SELECT CASE WHEN a IS NULL AND b IS NULL THEN 'missing' WHEN a IS NOT NULL AND b IS NOT NULL AND a <> b THEN 'conflict' ELSE 'available' END AS status, coalesce(a, b) AS value, count(*) AS n
      FROM s GROUP BY CASE WHEN a IS NULL AND b IS NULL THEN 'missing' WHEN a IS NOT NULL AND b IS NOT NULL AND a <> b THEN 'conflict' ELSE 'available' END, coalesce(a, b)"""


def scan_status_ladder(d):
    """Each row's first failing check names its status."""
    k = d.json("props", "$.k")
    return f"""SELECT CASE WHEN props IS NULL THEN 'read_error' WHEN NOT {d.matches('props', '^[{].*[}]$')} THEN 'invalid_json' WHEN {k} IS NULL THEN 'invalid_structure' WHEN TRY_CAST({k} AS BIGINT) < 10 THEN 'quarantined'
        WHEN value IS NULL THEN 'no_views' ELSE 'ok' END AS status, count(*) AS n FROM @events
      GROUP BY CASE WHEN props IS NULL THEN 'read_error' WHEN NOT {d.matches('props', '^[{].*[}]$')} THEN 'invalid_json' WHEN {k} IS NULL THEN 'invalid_structure' WHEN TRY_CAST({k} AS BIGINT) < 10 THEN 'quarantined'
        WHEN value IS NULL THEN 'no_views' ELSE 'ok' END"""


def dup_suffix_rename(d):
    """A repeated name gets a suffix with its number."""
    return """SELECT p_partkey, CASE WHEN r > 1 THEN p_type || '-dup' || CAST(r - 1 AS STRING) ELSE p_type END AS name FROM (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS r FROM @part)"""


def skip_reasons(d):
    """Rows that an export leaves out, with the reason."""
    return f"""WITH t AS (SELECT doc_id, {d.sha('text')} AS h, {d.size(d.words('text'))} AS w FROM @documents), g AS (SELECT h, min(doc_id) AS keeper FROM t GROUP BY h), r AS (SELECT t.doc_id, w, CASE WHEN t.doc_id > g.keeper THEN 2 ELSE 1 END AS k FROM t JOIN g ON t.h = g.h)
      SELECT CASE WHEN k > 1 THEN 'duplicate' WHEN w < 20 THEN 'short' ELSE 'kept' END AS reason, count(*) AS n FROM r GROUP BY CASE WHEN k > 1 THEN 'duplicate' WHEN w < 20 THEN 'short' ELSE 'kept' END"""


QUERIES = relational(
    histogram_summary, length_summary, linear_percentiles, median_metric, audit_violations, first_n_errors, status_inventory, group_consistency, duplicate_ids, whole_group_rejection, strict_values, set_digest,
    row_contract_hash, inventory_digest, inventory_verify, record_row_reconstruction, nested_record_stats, nested_record_build, token_budget_audit, trimmed_prompts, safe_means, group_metric_means, micro_totals,
    weighted_reduce, merge_counters, strict_order_check, group_rules, field_provenance, conflict_coalesce, scan_status_ladder, dup_suffix_rename, skip_reasons,
)
