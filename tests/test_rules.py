"""Rules of catalogue queries in plain Python, written apart from the queries and their oracle SQL."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import pytest

from tidemill.operators import graph, sentences
from tidemill.plans import catalog, ordering, scoring, splitting
from tidemill.functions.dialect import SPARK, on_spark

SF = "/root/testdata/sf0.001"


def rows_of(spark, name):
    return catalog.queries()[name](spark, SF).collect()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture
def small(spark, tmp_path):
    """A folder of tables made from rows."""

    def make(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"file://{tmp_path}/{name}.parquet")
        return f"file://{tmp_path}"

    return make


def test_even_prefixes(spark, small):
    lengths = {i: i for i in range(1, 14)}
    folder = small(conversations=([(c, t) for c, n in lengths.items() for t in range(n)], "conv_id long, turn long"))
    got = defaultdict(list)
    for r in on_spark(spark, folder, ordering.even_prefixes(SPARK)).collect():
        got[r["conv_id"]].append(r["prefix"])
    for c, n in lengths.items():
        inner = list(range(1, n))
        want = inner if len(inner) <= 3 else sorted({inner[round(i * (len(inner) - 1) / 2)] for i in range(3)})
        assert sorted(got[c]) == want


def tail(x, n, k, total):
    return sum(math.comb(k, j) * math.comb(total - k, n - j) for j in range(x, min(n, k) + 1)) / math.comb(total, n)


def enrichment(part):
    """{(q, s): (x, p, fdr)} by exact binomials; every set is tested."""
    queries, sets = defaultdict(set), defaultdict(set)
    for brand, kind, size in part:
        sets[f"S{size}"].add(kind)
        if size <= 25:
            queries[brand].add(kind)
    total, out = len({kind for _, kind, _ in part}), {}
    for q, own in queries.items():
        p = {s: (len(own & other), min(1.0, tail(len(own & other), len(own), len(other), total)) if own & other else 1.0) for s, other in sets.items()}
        line, running = sorted(p, key=lambda s: p[s][1]), 1.0
        for rank in range(len(line), 0, -1):
            s = line[rank - 1]
            running = min(running, p[s][1] * len(line) / rank)
            out[q, s] = (*p[s], running)
    return out


def parts_of(rows, kinds):
    return [(f"b{i % 7}", f"t{(i * 31 + i // 7) % kinds}", 1 + (i * 13) % 50) for i in range(rows)]


@pytest.mark.parametrize(("rows", "kinds"), [(300, 12), (900, 450)])
def test_enrichment_tests_every_set(spark, small, rows, kinds):
    """Also with more kinds than 400."""
    part = parts_of(rows, kinds)
    folder = small(part=(part, "p_brand string, p_type string, p_size int"))
    want = enrichment(part)
    got = {(r["q"], r["s"]): r for r in on_spark(spark, folder, scoring.enrichment_bh(SPARK)).collect()}
    assert got.keys() == want.keys()
    for key, (x, p, fdr) in want.items():
        assert got[key]["x"] == x and abs(got[key]["p"] - p) < 1e-6 and abs(got[key]["fdr"] - fdr) < 1e-6
    for r in on_spark(spark, folder, scoring.retrieval_rank(SPARK)).collect():
        mine = {s: v for (q, s), v in want.items() if q == r["q"]}
        truth = min(s for s, v in mine.items() if v[0])
        line = sorted(mine, key=lambda s: (round(mine[s][2], 8), round(mine[s][1], 9), s))
        assert r["place"] == line.index(truth) + 1 and abs(r["reciprocal"] - 1 / r["place"]) < 1e-9


def holdout(docs, protected, share=0.2, seed=7):
    per = defaultdict(list)
    for source, lang, n in docs:
        per[source].append((lang, n))
    free = sorted((s for s in per if s not in protected), key=lambda s: (len(per[s]), len({lang for lang, _ in per[s]}), sum(n for _, n in per[s]) / len(per[s]), s))
    count, strata = min(10, max(1, len(free) // 2)), defaultdict(list)
    for i, s in enumerate(free):
        strata[min(count - 1, i * count // len(free))].append(s)
    held = set()
    for at, names in strata.items():
        names.sort(key=lambda s: (sha(f"coverage_holdout:coverage_quantile_{at:02d}:{seed}:{s}"), s))
        held |= set(names[: 0 if len(names) < 2 else min(len(names) - 1, max(1, round(len(names) * share)))])
    return {s: (next((at for at, names in strata.items() if s in names), None), s in held) for s in per}


@pytest.mark.parametrize("sources", [3, 8, 27, 64])
def test_coverage_holdout(spark, small, sources):
    docs = [(i, f"src{i % sources}", "de" if (i * 7) % 3 else "en", 10 + (i * i) % 97) for i in range(sources * 4 + sources // 2)]
    folder = small(documents=(docs, "doc_id long, source string, lang string, n_chars long"))
    got = {r["source"]: (r["stratum"], r["held_out"]) for r in on_spark(spark, folder, splitting.coverage_quantile_holdout(SPARK)).collect()}
    want = holdout([d[1:] for d in docs], {"src0"})
    assert got == want and got["src0"] == (None, False)


@pytest.mark.parametrize("share", [0.25, 0.5, 0.000001, 0.999999])
def test_group_split_with_its_fallback(spark, small, share):
    groups = [f"g{i}" for i in range(9)]
    folder = small(documents=([(i, groups[i % 9]) for i in range(40)], "doc_id long, lang string"))
    below = {g for g in groups if int(sha(f"split:{g}")[:16], 16) / 16**16 < share}
    if not below or len(below) == len(groups):
        below = set(sorted(groups, key=lambda g: sha(f"split:{g}"))[: min(max(1, round(len(groups) * share)), len(groups) - 1)])
    sql = f"WITH {splitting._group_split(SPARK, 'split', f'{share:.6f}')} SELECT x.doc_id, x.lang, s.part FROM @documents x JOIN s ON x.lang = s.lang"
    got = on_spark(spark, folder, sql).collect()
    assert len(got) == 40 and {r["lang"] for r in got if r["part"] == "validation"} == below


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("It took 5 min. at pH 7. Then max. 3 hr. more.", ["It took 5 min. at pH 7.", "Then max. 3 hr. more."]),
        ("See ref. (cf. Fig. 2). Next.", ["See ref. (cf. Fig. 2).", "Next."]),
        ("Set {a, b.} Then on", ["Set {a, b.}", "Then on"]),
        ("Protein A. Gene B binds. E. coli grows.", ["Protein A.", "Gene B binds.", "E. coli grows."]),
        ("The U.S. market. EC 1.2.3.4 and p.R175H act!", ["The U.S. market.", "EC 1.2.3.4 and p.R175H act!"]),
        ("Mass of 4 wt. percent et al. Here.", ["Mass of 4 wt. percent et al.", "Here."]),
        ("What?! (Really.) Yes... and etc.) no stop", ["What?!", "(Really.)", "Yes...", "and etc.) no stop"]),
        ("Ends with vs.", ["Ends with vs."]),
    ],
)
def test_sentence_rules(text, want):
    assert sentences.sentences_of(text) == want


def test_closure_of_a_long_way(spark):
    edges = [(i, i + 1) for i in range(40)] + [(40, 38), (100, 101), (None, 3), (3, None)]
    got = {tuple(r) for r in graph.transitive_closure(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = {(i, j) for i in range(41) for j in range(i + 1, 41)} | {(i, j) for i in (38, 39, 40) for j in (38, 39, 40)} | {(100, 101)}
    assert got == want
    assert graph.transitive_closure(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
