"""Conversation repair against all edit sequences of small conversations, and in blocks."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from tidemill.llm import catalog, conversations

LEGAL = re.compile(r"(s?(ua)+)?\Z")
BLANK = re.compile(r"[\x20\x09-\x0D]*\Z")
SF = "/root/testdata/sf0.01"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind, role, text = zlib.crc32(name.encode()) % 20, " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def faults(turns):
    seen, out = set(), []
    for _, _, role, text in turns:
        if BLANK.match(text):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if text.rstrip(" \t\n\x0b\x0c\r")[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def every_edit(turns, marks, limit):
    """(cost, audit, lines) of all edit sequences of at most limit, without looking at the roles until the end."""

    def go(i, cost, audit, roles, lines, insertions):
        if cost > limit:
            return
        if i == len(turns) and LEGAL.match(roles):
            yield cost, audit, lines
        if insertions < 2:
            for role in ("user", "assistant"):
                yield from go(i, cost + 3, audit + "I", roles + role[0], [*lines, role + ":"], insertions + 1)
        if i == len(turns):
            return
        _, _, role, text = turns[i]
        yield from go(i + 1, cost + 4, audit + "D", roles, lines, 0)
        if marks[i] in ("blank", "duplicate"):
            return
        more = 3 if marks[i] == "truncated" else 0
        yield from go(i + 1, cost + more, audit + "K", roles + (role[:1] or "-"), [*lines, f"{role}:{text}"], 0)
        for new in ("user", "assistant"):
            yield from go(i + 1, cost + 3 + more, audit + "R", roles + new[0], [*lines, f"{new}:{text}"], 0)

    return go(0, 0, "", "", [], 0)


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(damage(r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        marks = faults(turns)
        numbers = [t[1] for t in turns if t[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        best = next(b for limit in range(0, 4 * len(turns) + 1) if (b := min(every_edit(turns, marks, limit), default=None)))
        digest = hashlib.sha256("\n".join(best[2]).encode()).hexdigest()
        out[conv] = (gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, best[0], best[1], digest)
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def got(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def sample(seed, conversations=60, longest=5):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", "", None], ["a.", "b!", "c", " \n", "d?\t", "e", None, "é. "]
    return [(c, rng.choice([t, t, t + 1, t * 3, None]), rng.choice(roles), rng.choice(texts)) for c in range(conversations) for t in range(rng.randint(1, longest))]


@pytest.mark.parametrize("bits", [16, 0, 1])
def test_repairs_are_the_least_of_all_edits(spark, monkeypatch, bits):
    monkeypatch.setattr(conversations, "BLOCK_BITS", bits)
    monkeypatch.setattr(conversations, "PIECE_BYTES", 4)
    rows = sample(bits) + [(None, 1, "user", "x."), (None, 2, "assistant", "y."), (None, 2, "assistant", "y.")]
    assert got(conversations.repair_report(table(spark, rows))) == expected(rows)


def test_a_hot_conversation_in_blocks_equals_one_block(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(7, t // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"{t}.", f"{t}", ""])) for t in range(3000)]
    one = got(conversations.repair_report(table(spark, rows).coalesce(1)))
    monkeypatch.setattr(conversations, "BLOCK_BITS", 4)
    monkeypatch.setattr(conversations, "PIECE_BYTES", 100)
    assert got(conversations.repair_report(table(spark, rows).repartition(3))) == one


def test_whole_table_against_all_edits(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = got(catalog.op13_dial_repair(spark, SF))
    assert set(found) == {r[0] for r in rows}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    assert {r[0]: r[1:] for r in con.execute(catalog.oracle_sql()["op13_dial_repair"]).fetchall()} == found
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for group in by.values():
        if len(group) <= 5:
            assert found[group[0][0]] == expected(group)[group[0][0]]


def test_empty_table_lost_conversations_and_clashing_names(spark):
    from pyspark.sql import functions as F

    assert got(conversations.repair_report(table(spark, []))) == {}
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = table(spark, [(lost, 0, "user", "x.")])
    for name in ("conv", "at", "block", "codes", "lone", "_kind", "audit", "parts", "place"):
        df = df.withColumn(name, F.lit("clash"))
    assert got(conversations.repair_report(df)) == {lost: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
