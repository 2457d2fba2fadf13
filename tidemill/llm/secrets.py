"""Secret scan with a random forest that removes false positives, in DataFrame operations only.

Candidates are strings assigned to a credential word and long tokens with digits or of mixed
case, each the whole run of its characters however long. Each gets
features of its length, its character transitions, how much of it dictionary words cover,
the path it lies in and the words next to it. A forest trained on labelled findings scores
it; the trees are constant arrays that a higher-order function walks, so scanning and
redaction are one pass over the table without a shuffle, a Python worker or a model call.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Credential words, digest words, placeholder words, dictionary.
CREDENTIAL = "passwords?|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|bearer"
DIGEST = "commit|sha1|sha256|sha512|md5|checksum|digest|hash|revision|uuid|guid|etag|build|version"
PLACEHOLDER = "example|sample|dummy|placeholder|changeme|your|insert|fake|test|todo|redacted|xxxx"
DICTIONARY = (
    "about access account action active admin after all and array auth author back base before body buffer build button cache call case change check child class click "
    "client close code color column command commit common config connect content context control copy count create current data date debug default delete description "
    "detail device document domain down edit element email empty enable end error event example export factory field file filter find first flag font for form format from "
    "function generate get group handle head height help home host http icon image import index info input insert instance item key label language last layer layout left "
    "length level line link list load local location login main manager map mark match max media menu message method mode model module month name network new next node "
    "not note number object option order output page panel param parent part password path phone place player plugin point port position post preview previous print "
    "private process product profile project property public query queue random read record reference register release remove render report request reset resource response "
    "result return right role root route row run sample save scope screen script search section secret select send server service session set show side size sort source "
    "start state static status step stop store stream string style submit success switch system table tag target task template test text that the theme this thread time title "
    "token tool top total track type update upload user util valid value version video view visible web width window with word work write year your"
).split()

#: An assigned value is a candidate from so many characters on, a free token from 16.
LEAST = 6
PATTERN = (
    rf"(?i:(?:{CREDENTIAL})[\"']?[ \t]{{0,3}}[:=][ \t]{{0,3}}[\"']?)[^\s\"']{{{LEAST},}}+"
    r"|(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{16})(?=[A-Za-z+/_-]*+[0-9]|[A-Z0-9+/_-]*+[A-Za-z0-9+/_-]*?[a-z][A-Z])[A-Za-z0-9+/_-]{16,}+={0,2}"
)
HEAD = rf"^(?i:(?:{CREDENTIAL})[\"']?[ \t]{{0,3}}[:=][ \t]{{0,3}}[\"']?)(?=[^\s\"']{{{LEAST}}})"
CONTEXT = 48
REDACTED = "[REDACTED]"
ACCEPT = 0.5
TREES, DEPTH = 32, 8
#: Pairs of characters that are this many times likelier (log) in findings that are no secrets count as common.
PAIR_ODDS = 0.5

FEATURES = ("length", "digits", "uppers", "symbols", "class_changes", "common_pairs", "distinct", "longest_run", "dictionary", "path_test", "near_credential", "near_digest", "near_placeholder", "assigned", "own_placeholder")


class Forest(NamedTuple):
    """trees: nested tuples, a share of secrets or (feature index, threshold, left, right); pairs: common transitions."""

    trees: list
    pairs: list[str]


def _left(column: Column, pattern: str) -> Column:
    """Characters that a pattern covers."""
    return F.length(column) - F.length(F.regexp_replace(column, pattern, ""))


def common_pairs(findings: DataFrame) -> list[str]:
    """The character transitions that mark what is no secret: pairs of letters whose share among the
    pairs of findings labelled 0 is exp(PAIR_ODDS) times that among those labelled 1, each count plus one.

    Counts of at most 26 * 26 pairs a label come to the driver.
    """
    word = F.lower(F.col("candidate").cast("string"))
    pairs = findings.where("label IN (0, 1)").select("label", F.explode(F.concat(F.regexp_extract_all(word, F.lit("[a-z]{2}"), 0), F.regexp_extract_all(F.substr(word, F.lit(2)), F.lit("[a-z]{2}"), 0))).alias("pair"))
    counts = {(r["label"], r["pair"]): r["n"] for r in pairs.groupBy("label", "pair").agg(F.count("*").alias("n")).collect()}
    total = {y: sum(n for (k, _), n in counts.items() if k == y) + 676 for y in (0, 1)}
    odds = {pair: math.log((counts.get((0, pair), 0) + 1) / total[0]) - math.log((counts.get((1, pair), 0) + 1) / total[1]) for _, pair in counts}
    return sorted(pair for pair, o in odds.items() if o >= PAIR_ODDS)


def feature_columns(candidate: Column, path: Column, before: Column, after: Column, assigned: Column, pairs: list[str]) -> dict[str, Column]:
    n = F.greatest(F.length(candidate), F.lit(1)).cast("double")
    lower = F.lower(candidate)
    classes = candidate
    for pattern, mark in (("[a-z]", "l"), ("[A-Z]", "U"), ("[0-9]", "9"), ("[^lU9]", "-")):
        classes = F.regexp_replace(classes, pattern, mark)
    flag = lambda column, words: F.coalesce(column.rlike(f"(?i)(?:{words})"), F.lit(False)).cast("double")
    # a word beside the candidate counts where it stands alone: prose holds these letters inside other words
    near = lambda column, words: flag(column, rf"(?<![\p{{L}}])(?:{words})(?![\p{{L}}])")
    words = "|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=lambda w: (-len(w), w)))
    return {
        "length": n,
        "digits": _left(candidate, "[0-9]") / n,
        "uppers": _left(candidate, "[A-Z]") / n,
        "symbols": _left(candidate, "[^A-Za-z0-9]") / n,
        "class_changes": (F.length(F.regexp_replace(classes, r"(.)\1*", "x")) - 1) / n,
        "common_pairs": (_left(lower, "|".join(pairs)) / n if pairs else F.lit(0.0)),
        "distinct": F.size(F.array_distinct(F.split(candidate, ""))) / F.least(n, F.lit(24.0)),
        "longest_run": F.length(F.regexp_extract(lower, r"(.{1,4})\1{2,}|01234+|12345+|abcde+", 0)) / n,
        "dictionary": _left(lower, words) / n,
        "path_test": flag(path, "test|example|fixture|sample|mock|spec|doc"),
        "near_credential": near(F.concat(before, F.lit(" "), after), CREDENTIAL),
        "near_digest": near(before, DIGEST),
        "near_placeholder": near(F.concat(before, F.lit(" "), after), PLACEHOLDER),
        "assigned": assigned.cast("double"),
        "own_placeholder": flag(candidate, PLACEHOLDER),
    }


def labelled_findings(spark: SparkSession, per_kind: int = 160) -> DataFrame:
    """Findings with labels, made by rule: (candidate, path, before, after, assigned, label).

    The training table where a caller has no own one: random keys of the common shapes in
    credential contexts and in plain prose are secrets; digests, identifiers of dictionary
    words, placeholders, sequences, numbers and keys of test paths are not.
    """
    draw = lambda k, n: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)).cast("int")
    pick = lambda k, choices: F.element_at(F.split(F.lit("|".join(choices)), r"\|"), draw(k, len(choices)) + 1)
    ids = spark.range(per_kind).select("id", F.sha2(F.concat(F.lit("finding:"), F.col("id").cast("string")), 256).alias("hexes"))
    # columns of their own, so that each is computed once and the generated code stays small
    ids = ids.select("*", F.concat("hexes", F.md5("hexes")).alias("long"), F.base64(F.unhex("hexes")).alias("base64"), *(pick(k, DICTIONARY).alias(f"word{k}") for k in (1, 2, 3, 4)))
    ids = ids.select(
        "*", F.translate(F.upper("long"), "0123456789ABCDEF", "AQ2W7ERTY4UIOP9S").alias("upper"), F.regexp_replace("base64", "[+/=]", "k").alias("mixed"), F.regexp_replace("long", "[a-f]", "").alias("number"),
        pick("prose", ["and then the ", "of the page ", "we saw that ", "in it, ", "und das ", "la que "]).alias("prose"), pick("after", [" and so on", " is here", "", ", the end", " of it"]).alias("say"),
        F.concat(pick("ahead", ["", "of the page ", "it is thereon. ", "der die enlich, ", "queue ension ", "in 2024 ", "{"]), pick("cred", ["token = \"", "password=", "api_key: ", "secret = '", "token: ", "pwd=", "auth: \"", "access_key=", "bearer: "])).alias("credential"), pick("digest", ["commit ", "sha256: ", "md5 ", "checksum ", "revision ", "uuid "]).alias("digest"),
        pick("path", ["src1", "app/main", "web", "config/prod", ""]).alias("path"), pick("tests", ["tests/unit", "docs/example", "fixtures", "spec/sample"]).alias("tests"),
        pick("gh", ["ghp_", "gho_", "sk_live_", "xoxb-"]).alias("mark"), F.repeat(pick("steady", ["x", "0123456789", "abc123", "1234", "deadbeef"]), 6).alias("steady"),
        F.concat(pick("fill", ["your_", "changeme_", "example-", "insert_", "dummy_"]), "word1", F.lit("_"), pick("tail", ["key_here1", "token_1234", "password123", "secret_0000"])).alias("filler"),
        F.concat("word1", F.initcap("word2"), F.initcap("word3"), F.initcap("word4")).alias("name"), F.concat_ws("_", "word1", "word2", "word3", "word4").alias("snake"),
        F.concat_ws("-", *(F.col("hexes").substr(at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))).alias("uuid"),
    )
    ids = ids.select("*", F.translate("mixed", "0123456789", "qZwXvJkQjK").alias("letters"))
    word = lambda k: F.col(f"word{k}")
    hexes, base64, upper, mixed, letters, number, uuid, name, steady, filler = map(F.col, "hexes base64 upper mixed letters number uuid name steady filler".split())
    prose, say, credential, digest, path, tests = map(F.col, "prose say credential digest path tests".split())
    cut = lambda column, lo, hi: column.substr(F.lit(1), draw("cut", hi - lo + 1) + lo)
    camel, snake = F.concat("name", draw(9, 100).cast("string")), F.concat("snake", F.lit("_"), draw(9, 100).cast("string"))
    yes, no = F.lit(True), F.lit(False)
    kinds = [  # candidate, path, before, assigned, label
        (cut(hexes, 16, 64), path, credential, yes, 1),
        (cut(mixed, 16, 43), path, credential, yes, 1),
        (cut(base64, 20, 43), path, credential, yes, 1),
        (F.concat(F.lit("AKIA"), upper.substr(1, 16)), path, prose, no, 1),
        (F.concat(F.lit("AKIA"), upper.substr(1, 16)), path, credential, yes, 1),
        (F.concat("mark", mixed.substr(1, 36)), path, prose, no, 1),
        (cut(upper, 20, 40), path, credential, yes, 1),
        (cut(mixed, 24, 43), path, prose, no, 1),
        (letters.substr(1, 40), path, credential, yes, 1),
        (hexes.substr(1, 40), path, credential, yes, 1),
        (hexes.substr(1, 40), path, credential, yes, 1),
        (cut(mixed, 6, 15), path, credential, yes, 1),
        (F.concat(cut(F.translate(hexes, "0123456789", "ghjkmnpqrs"), 3, 6), draw(11, 9000).cast("string")), path, credential, yes, 1),
        (word(1), path, credential, yes, 0),
        (F.concat(word(1), F.lit(".")), path, credential, yes, 0),
        (cut(letters, 24, 43), path, prose, no, 1),
        (name, path, prose, no, 0),
        (name, path, credential, yes, 0),
        (hexes.substr(1, 40), path, digest, no, 0),
        (cut(hexes, 32, 64), path, digest, no, 0),
        (uuid, path, prose, no, 0),
        (uuid, path, digest, no, 0),
        (camel, path, prose, no, 0),
        (camel, path, credential, yes, 0),
        (snake, path, prose, no, 0),
        (F.concat_ws("/", word(1), word(2), word(3), word(4), (draw(9, 1101) + 1000).cast("string")), path, prose, no, 0),
        (filler, path, credential, yes, 0),
        (steady, path, credential, yes, 0),
        (steady, path, prose, no, 0),
        (cut(number, 16, 24), path, prose, no, 0),
        (cut(hexes, 16, 64), tests, credential, yes, 0),
        (F.concat(F.lit("AKIA"), upper.substr(1, 9), F.lit("EXAMPLE")), path, prose, no, 0),
        (F.concat(word(1), F.lit("."), word(2), F.lit("("), word(3), F.lit(")")), path, credential, yes, 0),
    ]
    kind = lambda i: F.struct(kinds[i][0].alias("candidate"), kinds[i][1].alias("path"), kinds[i][2].alias("before"), say.alias("after"), kinds[i][3].alias("assigned"), F.lit(kinds[i][4]).alias("label"))
    return ids.select(F.inline(F.array(*map(kind, range(len(kinds))))))


def train_forest(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> Forest:
    """The trees, and the transitions that their features were measured with."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    pairs = common_pairs(findings)
    columns = feature_columns(text("candidate"), text("path"), text("before"), text("after"), F.coalesce(F.col("assigned"), F.lit(False)), pairs)
    rows = findings.where("label IN (0, 1)").select(F.col("label").cast("double").alias("label"), *(c.cast("double").alias(k) for k, c in columns.items()))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows.coalesce(1))
    model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird", minInstancesPerNode=2).fit(rows)

    def read(node):
        if node.getClass().getSimpleName() == "LeafNode":
            counts = list(node.impurityStats().stats())
            return float(counts[1] / sum(counts)) if sum(counts) else 0.5
        split = node.split()
        return int(split.featureIndex()), float(split.threshold()), read(node.leftChild()), read(node.rightChild())

    return Forest([read(tree._java_obj.rootNode() if hasattr(tree, "_java_obj") else tree._call_java("rootNode")) for tree in model.trees], pairs)


def _constant(values: list, kind: str) -> Column:
    """An array literal as one expression, however long."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def forest_score(forest: list, values: Column) -> Column:
    """Mean share of secrets over the trees; values is the array of FEATURES.

    All nodes of all trees are numbered from 1; a leaf leads to itself, so each tree is walked
    as many steps as the deepest one has.
    """
    feature, threshold, low, high, share, roots = [], [], [], [], [], []

    def add(node, depth: int) -> tuple[int, int]:
        at = len(feature) + 1
        inner = isinstance(node, tuple)
        for column, value in zip((feature, threshold, low, high, share), (node[0] + 1, node[1], at, at, 0.0) if inner else (1, 0.0, at, at, node), strict=True):
            column.append(value)
        if not inner:
            return at, depth
        (low[at - 1], a), (high[at - 1], b) = add(node[2], depth + 1), add(node[3], depth + 1)
        return at, max(a, b)

    deepest = 0
    for tree in forest:
        root, depth = add(tree, 0)
        roots.append(root)
        deepest = max(deepest, depth)
    features, thresholds, lows, highs = _constant(feature, "int"), _constant(threshold, "double"), _constant(low, "int"), _constant(high, "int")
    step = lambda at, _: F.when(F.element_at(values, F.element_at(features, at)) <= F.element_at(thresholds, at), F.element_at(lows, at)).otherwise(F.element_at(highs, at))
    leaf = lambda root: F.aggregate(_constant(list(range(deepest)), "int"), root, step) if deepest else root
    total = F.aggregate(_constant(roots, "int"), F.lit(0.0), lambda sum_, root: sum_ + F.element_at(_constant(share, "double"), leaf(root)))
    return total / F.lit(float(len(forest)))


def _pieces(docs: DataFrame, path: str, carried: list[Column], filtered: bool = False) -> DataFrame:
    """(row, text, path, hits, gaps): row holds the carried columns, so that no name of theirs can
    clash; hits are the candidates in order and gaps the text around them, both null without any."""
    where = F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    rows = docs.select(F.struct(*carried).alias("row"), F.col("text").cast("string").alias("text"), where.alias("path"))
    has = F.coalesce(F.col("text").rlike(PATTERN), F.lit(False))
    if filtered:  # the lists are made for texts with candidates only
        rows, has = rows.where(has), F.lit(True)
    return rows.select("*", F.when(has, F.regexp_extract_all("text", F.lit(PATTERN), 0)).alias("hits"), F.when(has, F.split("text", PATTERN, -1)).alias("gaps"))


def _judged(forest: Forest) -> Column:
    """One struct per candidate: head (the assignment before it), candidate, features, then its score."""

    def facts(hit: Column, i: Column) -> Column:
        head = F.regexp_extract(hit, HEAD, 0)
        before = F.concat(F.right(F.element_at("gaps", (i + 1).cast("int")), F.lit(CONTEXT)), head)
        after = F.left(F.element_at("gaps", (i + 2).cast("int")), F.lit(CONTEXT))
        return F.struct(i.alias("i"), head.alias("head"), hit.substr(F.length(head) + 1, F.length(hit)).alias("candidate"), before.alias("before"), after.alias("after"))

    def measured(x: Column) -> Column:
        columns = feature_columns(x["candidate"], F.col("path"), x["before"], x["after"], F.length(x["head"]) > 0, forest.pairs)
        return F.struct(x["i"].alias("i"), x["head"].alias("head"), x["candidate"].alias("candidate"), F.array(*(columns[k].cast("double") for k in FEATURES)).alias("values"))

    def scored(x: Column) -> Column:
        return F.struct(x["i"].alias("i"), x["head"].alias("head"), x["candidate"].alias("candidate"), forest_score(forest.trees, x["values"]).alias("score"))

    return F.transform(F.transform(F.transform("hits", facts), measured), scored)


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None, path: str = "source", accept: float = ACCEPT, forest: Forest | None = None) -> DataFrame:
    """One row per candidate: doc_id, begin and end (0-based code points), candidate, kind, score, is_secret.

    findings are labelled findings (columns as in labelled_findings, which is the default);
    path names the column of docs that says where a text lies. A value assigned to a credential
    word is a candidate from LEAST characters on, up to the next white space or quote (a key over several
    lines is one candidate a line); a token that is not assigned to anything from 16 characters on, if it
    holds a digit or an upper-case letter right after a lower-case one. Null and empty texts have no candidates; repeated
    rows repeat theirs; other columns of docs are ignored, whatever their names; an empty
    table gives an empty result.
    """
    forest = forest or train_forest(findings if findings is not None else labelled_findings(docs.sparkSession))
    rows = _pieces(docs, path, [F.col("doc_id").cast("long").alias("doc_id")], True)
    upto = F.expr("aggregate(sequence(1, at.i + 1), 0, (n, k) -> n + char_length(element_at(gaps, k)) + if(k <= at.i, char_length(element_at(hits, k)), 0))")
    rows = rows.select("row.doc_id", "gaps", "hits", F.explode(_judged(forest)).alias("at")).withColumn("begin", (upto + F.length("at.head")).cast("long"))
    kind = F.when(F.length("at.head") > 0, "assignment").when(F.col("at.candidate").rlike("^(AKIA|ASIA)[0-9A-Z]{16}$"), "access_key_id").otherwise("token")
    return rows.select("doc_id", "begin", (F.col("begin") + F.length("at.candidate")).alias("end"), "at.candidate", kind.alias("kind"), "at.score", (F.col("at.score") >= accept).alias("is_secret"))


def redact_secrets(docs: DataFrame, findings: DataFrame | None = None, path: str = "source", accept: float = ACCEPT, forest: Forest | None = None) -> DataFrame:
    """docs with every secret replaced by REDACTED in text; all rows and columns stay.

    Null, empty and blank texts are unchanged; repeated rows are redacted alike; the other
    columns pass through whatever their names; an empty table gives an empty result.
    """
    forest = forest or train_forest(findings if findings is not None else labelled_findings(docs.sparkSession))
    rows = _pieces(docs, path, [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).withColumn("judged", _judged(forest))
    replaced = F.transform("judged", lambda x: F.concat(F.element_at("gaps", (x["i"] + 1).cast("int")), x["head"], F.when(x["score"] >= accept, F.lit(REDACTED)).otherwise(x["candidate"])))
    clean = F.when(F.col("hits").isNull(), F.col("text")).otherwise(F.concat(F.array_join(replaced, ""), F.element_at("gaps", -1)))
    return rows.select(*((clean if c == "text" else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(docs.columns)))
