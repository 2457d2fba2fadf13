"""Text and JSON: cleaning, entities, clauses, templates, payload checks, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dialect import ORACLE, on_oracle, relational
from ..operators.ranking import place_in_order
from ..operators.sentences import split_sentences
from ..sources.tables import table


def text_exact_projection(d):
    """Keys stay text: leading zeros kept, the family is the last five digits, else raw."""
    key = "lpad(CAST(doc_id AS STRING), 7, '0')"
    return f"""SELECT doc_id, {key} AS key, CASE WHEN doc_id % 5 = 0 THEN 'raw:' || lower(source) WHEN {d.matches(key, '[0-9]{5}$')} THEN {d.extract(key, '([0-9]{5})$', 1)} ELSE 'raw:<missing>' END AS family,
      {d.replace("'path:' || source", '^path:', '')} AS normalized FROM @documents"""


def vocab_topk(d):
    """Token vocabulary: the 200 most frequent, ties by token."""
    return f"""SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) AS BIGINT) AS pos FROM (SELECT token, count(*) AS n FROM (SELECT {d.explode(d.words('text'))} AS token FROM @documents) GROUP BY token ORDER BY n DESC, token LIMIT 200)"""


def rank_vectorise(d):
    """Weight of a token: number of tokens less its last place."""
    return f"""WITH w AS (SELECT conv_id, turn, {d.words('text')} AS ws FROM @conversations), p AS (SELECT conv_id, turn, ws, {d.explode(d.series(1, d.size('ws')))} AS i FROM w WHERE {d.size('ws')} > 0)
      SELECT conv_id, turn, {d.at('ws', 'CAST(i AS INT)')} AS token, CAST(max({d.size('ws')} - i) AS BIGINT) AS weight FROM p GROUP BY conv_id, turn, {d.at('ws', 'CAST(i AS INT)')}"""


def clause_split(d):
    """Clauses: cut at sentence marks and line ends."""
    return f"""WITH c AS (SELECT conv_id, turn, {d.explode(d.split('text', '[.;!?]+[ ]+|[.;!?]*[\\n]+'))} AS clause FROM @conversations) SELECT conv_id, turn, count(*) AS clauses, max({d.chars('clause')}) AS longest FROM c WHERE trim(clause) <> '' GROUP BY conv_id, turn"""


def metadata_leak_markers(d):
    """Which of the literal markers occur in a text."""
    marks = [("'@'", "mail"), ("'password'", "password"), ("'token'", "token"), ("'License'", "license"), ("'AKIA'", "key")]
    cols = ", ".join(f"CAST(sum(CASE WHEN instr(text, {m}) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS {k}" for m, k in marks)
    return f"SELECT source, {cols}, count(*) AS n FROM @documents GROUP BY source"


def forbidden_json_keys(d):
    return f"""SELECT event_type, CAST(sum({d.size(d.found('props', '"(k|secret|organism)" *:'))}) AS BIGINT) AS hits, count(*) AS n FROM @events GROUP BY event_type"""


def entity_extract(d):
    """All-caps symbols less a stop list, tagged phrases, normalised and distinct."""
    caps = d.found("text", "[A-Z][A-Z0-9]{2,}")
    return f"""WITH e AS (SELECT doc_id, {d.less(d.array_distinct(caps), d.array("'THE'", "'AND'", "'DER'", "'DIE'", "'LES'"))} AS es FROM @documents) SELECT doc_id, CAST({d.size('es')} AS BIGINT) AS n, {d.array_join(d.array_sort('es'), '|')} AS entities FROM e"""


def normalized_entities(d):
    """Upper case, white space collapsed, prefix stripped, aliases mapped by a join."""
    norm = d.replace(d.replace("upper(trim(p_name))", "[ ]+", " "), "^(THE|A) ", "")
    return f"""WITH alias AS (SELECT 'BRAND#11' AS name, 'ALPHA' AS canonical UNION ALL SELECT 'BRAND#22', 'BETA'), n AS (SELECT p_partkey, {norm} AS name, upper(p_brand) AS brand FROM @part)
      SELECT p_partkey, n.name, coalesce(a.canonical, n.brand) AS brand FROM n LEFT JOIN alias a ON n.brand = a.name"""


def relation_set(d):
    """Vocabulary words of a text as a set."""
    low = d.mapped(d.words("text"), "x", "lower(x)")
    return f"""SELECT doc_id, {d.array_join(d.array_sort(d.array_distinct(d.kept(low, 'x', "x IN ('the', 'and', 'der', 'und', 'les', 'que')"))), '|')} AS relations FROM @documents"""


def atomic_clause(d):
    """Clauses with exactly one relation word give (source, relation, target)."""
    rel = " (the|and|that|und|der|les|que|para) "
    return f"""WITH c AS (SELECT conv_id, turn, {d.explode(d.split('text', '[.;!?]+[ ]+|[.;!?]*[\\n]+'))} AS clause FROM @conversations),
      one AS (SELECT conv_id, turn, clause, trim({d.extract('clause', rel, 0)}) AS relation FROM c WHERE {d.size(d.found('clause', rel))} = 1)
      SELECT conv_id, turn, relation, trim(substr(clause, 1, instr(clause, ' ' || relation || ' ') - 1)) AS source, trim(substr(clause, instr(clause, ' ' || relation || ' ') + {d.chars('relation')} + 2)) AS target FROM one"""


def prompt_render(d):
    """A prompt from columns, and its chat wrapping."""
    return """SELECT p_partkey, concat('Part ', p_name, ' of ', p_brand, ' (', CAST(p_size AS STRING), ')') AS prompt, concat('<user>', p_type, '</user><assistant>') AS chat FROM @part"""


def template_render(d):
    """Class and subtype choose a template; names joined by ' and ', first letter raised, a fallback without one."""
    return """WITH t AS (SELECT 'AIR' AS mode, '{entry1} moves {entry2}' AS tpl UNION ALL SELECT 'SHIP', '{entry1} ships {entry2}'), r AS (SELECT s.s_suppkey, s.s_name, n.n_name, CASE s.s_suppkey % 3 WHEN 0 THEN 'AIR' WHEN 1 THEN 'SHIP' ELSE 'RAIL' END AS mode FROM @supplier s JOIN @nation n ON s.s_nationkey = n.n_nationkey)
      SELECT r.s_suppkey, concat(upper(substr(line, 1, 1)), substr(line, 2)) AS line FROM (
        SELECT r.s_suppkey, replace(replace(coalesce(t.tpl, '{entry1} relates to {entry2}'), '{entry1}', lower(r.s_name)), '{entry2}', concat(r.n_name, ' and ', r.mode)) AS line FROM r LEFT JOIN t ON r.mode = t.mode) r"""


def clean_template_text(d):
    return f"SELECT page_id, trim({d.replace(d.replace(d.replace('html', '<script[^>]*>[^<]*</script>', ' '), '<[^>]*>', ' '), '[ ]+', ' ')}) AS body FROM @pages"


def title_fallback(d):
    """Coalesce of title, url tail and constant; markdown fences stripped."""
    return f"SELECT page_id, coalesce(nullif({d.extract('html', '<title>([^<]*)</title>', 1)}, ''), nullif({d.extract('url', '/([^/?#]*)(?:[?#].*)?$', 1)}, ''), 'untitled') AS name FROM @pages"


def strip_fence(d):
    return f"SELECT conv_id, turn, {d.replace('fenced', '^(```json)|```$', '')} AS body FROM (SELECT conv_id, turn, concat('```json', text, '```') AS fenced FROM @conversations)"


def substring_reconcile(d):
    """Passages that some document holds word for word, and where."""
    return """SELECT b.item_id, x.doc_id, CAST(instr(x.text, b.text) AS BIGINT) AS at FROM @benchmark b JOIN @documents x ON instr(x.text, b.text) > 0"""


def span_locate(d):
    """Sequential spans: each word of a list searched from the end of the last."""
    return """WITH s AS (SELECT doc_id, text, instr(text, 'e') AS a FROM @documents), t AS (SELECT doc_id, text, a, CASE WHEN a > 0 THEN instr(substr(text, a + 1), 'a') END AS b0 FROM s)
      SELECT doc_id, CAST(a AS BIGINT) AS first_at, CAST(CASE WHEN b0 > 0 THEN a + b0 END AS BIGINT) AS second_at FROM t"""


def payload_parse(d):
    """Validity flags of a JSON payload: parsed, with its field, an integer in range."""
    k = d.json("props", "$.k")
    return f"""SELECT event_id, {k} IS NOT NULL AS json_valid, TRY_CAST({k} AS BIGINT) BETWEEN 0 AND 99 AS schema_valid, TRY_CAST({k} AS BIGINT) AS k FROM @events"""


def generation_validity(d):
    k = d.json("props", "$.k")
    return f"""SELECT event_id, CASE WHEN props IS NULL THEN 'empty' WHEN {k} IS NULL THEN 'no_field' WHEN TRY_CAST({k} AS BIGINT) < 50 THEN 'low' END AS error FROM @events"""


def row_upgrade(d):
    """An old row made new: id recomputed, strings replaced, status mapped, field lifted out of JSON."""
    return f"""SELECT event_id, substr({d.sha("concat(CAST(user_id AS STRING), '|', event_type, '|', CAST(event_id AS STRING))")}, 1, 24) AS record_id, replace(event_type, 'error', 'failure') AS kind,
      CASE event_type WHEN 'purchase' THEN 'final' WHEN 'view' THEN 'open' ELSE 'other' END AS status, coalesce({d.json('props', '$.k')}, '0') AS k FROM @events"""


def canonical_json(d):
    """Sorted keys, no spaces, nulls kept."""
    q = "chr(34)"
    return f"""SELECT n_nationkey, concat('{{', {q}, 'key', {q}, ':', CAST(n_nationkey AS STRING), ',', {q}, 'name', {q}, ':', {q}, n_name, {q}, ',', {q}, 'region', {q}, ':', CAST(n_regionkey AS STRING), '}}') AS body FROM @nation"""


def semantic_event_id(d):
    return f"""SELECT l_orderkey, l_linenumber, l_partkey, 'event:' || substr({d.sha("concat('event', chr(10), CAST(l_partkey AS STRING), chr(10), CAST(l_suppkey AS STRING), chr(10), l_returnflag)")}, 1, 24) AS event_id FROM @lineitem"""


def json_records_explode(d):
    return f"""SELECT event_type, {d.json('props', '$.k')} AS k, count(*) AS n FROM @events GROUP BY event_type, {d.json('props', '$.k')}"""


def prompt_tail_parse(d):
    """The part behind the last marker of a prompt."""
    return f"SELECT conv_id, turn, {d.extract('text', '([^ ]+)$', 1)} AS tail, {d.extract('text', '^([^ ]+)', 1)} AS head FROM @conversations"


def repair_prompt(d):
    """A retry prompt with the doubled token budget up to a cap."""
    return f"""SELECT conv_id, turn, concat('Repair: ', text, ' | error: short') AS prompt, CAST(least(2 * {d.chars('text')}, 4096) AS BIGINT) AS budget FROM @conversations WHERE {d.chars('text')} < 200"""


def eligibility_reasons(d):
    """Why records are left out, by reason: namespaced id grammar, size, price."""
    return f"""WITH r AS (SELECT p_partkey, CASE WHEN NOT {d.matches('p_brand', '^Brand#[0-9]{2}$')} THEN 'bad_id' WHEN p_size > 40 THEN 'too_large' WHEN p_retailprice < 950 THEN 'too_cheap' ELSE 'eligible' END AS reason FROM @part) SELECT reason, count(*) AS n, min(p_partkey) AS first_part FROM r GROUP BY reason"""


def neutralised_payload(d):
    """Names replaced by ids in a payload."""
    return f"SELECT p_partkey, replace(concat(p_name, ' by ', p_brand), p_brand, concat('ent:', substr({d.sha('p_brand')}, 1, 8))) AS body FROM @part"


def entity_projection_nodes(d):
    """Ordered participants: first occurrence names an entity, every occurrence stays as provenance."""
    return f"""WITH p AS (SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, x.p_brand AS canonical, x.p_name, row_number() OVER (PARTITION BY l.l_orderkey, x.p_brand ORDER BY l.l_linenumber, l.l_partkey) AS r FROM @lineitem l JOIN @part x ON l.l_partkey = x.p_partkey)
      SELECT l_orderkey, canonical, max(CASE WHEN r = 1 THEN p_name END) AS name, {d.joined('CAST(l_partkey AS STRING)', 'l_linenumber, l_partkey', ',')} AS provenance FROM p GROUP BY l_orderkey, canonical"""


def edge_endpoints(d):
    """Edges with both endpoints looked up."""
    return """SELECT c.c_custkey, n.n_name AS home, r.r_name AS region FROM @customer c JOIN @nation n ON c.c_nationkey = n.n_nationkey JOIN @region r ON n.n_regionkey = r.r_regionkey"""


def topology_role(d):
    """A role by the overlap of a row's tags with constant vocabularies."""
    tags = d.array("l_returnflag", "l_linestatus")
    return f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, {tags} AS tags FROM @lineitem)
      SELECT role, count(*) AS n FROM (SELECT CASE WHEN {d.size(d.both('tags', d.array("'R'")))} > 0 THEN 'backbone' WHEN {d.size(d.both('tags', d.array("'A'")))} > 0 THEN 'context' ELSE 'excluded' END AS role FROM t) GROUP BY role"""


def subtype_consistency(d):
    """Parallel lists that must agree: equal lengths, known values, last element."""
    return f"""WITH g AS (SELECT l_orderkey, {d.joined('l_returnflag', 'l_linenumber, l_partkey, l_returnflag', '')} AS flags, {d.joined('l_linestatus', 'l_linenumber, l_partkey, l_linestatus', '')} AS states FROM @lineitem GROUP BY l_orderkey)
      SELECT l_orderkey, {d.chars('flags')} = {d.chars('states')} AS same_length, {d.matches('flags', '^[ANR]+$')} AS known, substr(flags, {d.chars('flags')}, 1) AS last_flag FROM g"""


def edge_events(d):
    """Edge to event rows: arcs from source to target, reversed ones for reversible edges."""
    return """SELECT src, dst, 'forward' AS arc FROM (SELECT DISTINCT n_regionkey AS src, n_nationkey AS dst FROM @nation) UNION ALL SELECT n_nationkey, n_regionkey, 'reverse' FROM @nation WHERE n_nationkey % 2 = 0"""


def control_sentence(d):
    """The text between two markers."""
    return f"SELECT page_id, {d.extract('html', '<p>([^<]*)</p>', 1)} AS first_paragraph, {d.extract('html', '<h1>([^<]*)</h1>', 1)} AS heading FROM @pages"


def fallback_key_join(d):
    """Pages to documents by keys of falling priority; the first that matches wins."""
    return """WITH k AS (SELECT page_id, page_id AS key, 1 AS prio FROM @pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, page_id + 10, 2 FROM @pages UNION ALL SELECT page_id, page_id * 2, 3 FROM @pages),
      m AS (SELECT k.page_id, x.doc_id, k.prio, row_number() OVER (PARTITION BY k.page_id ORDER BY k.prio) AS r FROM k JOIN @documents x ON x.doc_id = k.key)
      SELECT p.page_id, m.doc_id, CAST(m.prio AS BIGINT) AS prio FROM @pages p LEFT JOIN m ON p.page_id = m.page_id AND m.r = 1"""


def control_pairing(d):
    """Each toxic row gets a control by hash, dealt from the pool of the others by position."""
    h = d.hex_number(f"substr({d.sha(chr(39) + 'pair:' + chr(39) + ' || CAST(doc_id AS STRING)')}, 1, 15)")
    return f"""WITH c AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM @labels WHERE toxic = 0), t AS (SELECT doc_id, {h} AS h FROM @labels WHERE toxic = 1)
      SELECT t.doc_id, c.doc_id AS control FROM t JOIN (SELECT max(n) AS n FROM c) z ON true JOIN c ON c.i = CAST(t.h % z.n AS BIGINT)"""


def _control_pairing(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    pool = place_in_order(labels.where("toxic = 0").select("doc_id"), ["doc_id"])
    n = pool.count()
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit("pair:"), F.col("doc_id").cast("string")), 256), 1, 15), 16, 10).cast("bigint")
    cases = labels.where("toxic = 1").select("doc_id", (draw % max(n, 1)).alias("place"))
    return cases.join(pool.withColumnRenamed("doc_id", "control"), "place").select("doc_id", "control")


def _sentences(spark, sf_dir):
    return split_sentences(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text")


QUERIES = relational(
    text_exact_projection, vocab_topk, rank_vectorise, clause_split, metadata_leak_markers, forbidden_json_keys, entity_extract, normalized_entities, relation_set, atomic_clause, prompt_render, template_render,
    clean_template_text, title_fallback, strip_fence, substring_reconcile, span_locate, payload_parse, generation_validity, row_upgrade, canonical_json, semantic_event_id, json_records_explode, prompt_tail_parse,
    repair_prompt, eligibility_reasons, neutralised_payload, entity_projection_nodes, edge_endpoints, topology_role, subtype_consistency, edge_events, control_sentence, fallback_key_join,
) | {"control_pairing": (_control_pairing, on_oracle(control_pairing(ORACLE))), "sentence_split": (_sentences, None)}
