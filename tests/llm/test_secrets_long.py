"""Secrets longer than 256 characters are judged and redacted whole."""

from __future__ import annotations

import base64
import hashlib

from tidemill.llm import secrets


def long_key(n: int) -> str:
    raw = b"".join(hashlib.sha256(f"long key {i}".encode()).digest() for i in range(n // 32))
    return base64.b64encode(raw).decode().replace("=", "")[:n]


def test_long_keys_are_one_candidate(spark):
    forest = secrets.train_forest(secrets.labelled_findings(spark))
    key = long_key(400)
    late = key.translate(str.maketrans("0123456789", "abcdefghij"))[:300] + "7kQ2x"
    rows = [(1, f"and token = {key} then", "src1"), (2, f"of the page {key} is here", "src1"), (3, f"we saw {late} here", "src1"), (4, f'token = "{long_key(200_000)}"', "src1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = secrets.scan_secrets(df, forest=forest).collect()
    assert {(r["doc_id"], r["candidate"]) for r in found} == {(1, key), (2, key), (3, late), (4, long_key(200_000))} and len(found) == 4
    assert all(rows[r["doc_id"] - 1][1][r["begin"] : r["end"]] == r["candidate"] for r in found)
    judged = {r["doc_id"]: r["is_secret"] for r in found}
    assert judged[1] and judged[4]
    clean = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(df, forest=forest).collect()}
    assert clean[1] == "and token = [REDACTED] then" and clean[4] == 'token = "[REDACTED]"'
    for i in (2, 3):
        assert clean[i] == (rows[i - 1][1] if not judged[i] else rows[i - 1][1].replace(late if i == 3 else key, "[REDACTED]"))


def test_keys_of_every_length_leave_no_tail(spark):
    forest = secrets.train_forest(secrets.labelled_findings(spark))
    rows = [(n, f"then api_key={long_key(n)} is set", "src1") for n in (40, 100, 256, 257, 300, 1000, 5000)]
    clean = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string"), forest=forest).collect()}
    assert set(clean.values()) == {"then api_key=[REDACTED] is set"}


def test_candidates_equal_a_plain_scan(spark):
    """Every candidate of the pattern's definition, found by walking over tokens and assignments in plain Python."""
    import re

    credential = re.compile(rf"(?:{secrets.CREDENTIAL})[\"']?[ \t]{{0,3}}[:=][ \t]{{0,3}}[\"']?", re.IGNORECASE)

    def plain(text):
        out, at = set(), 0
        while at < len(text):
            head = credential.match(text, at)
            value = re.match(r"[^\s\"']+", text[head.end() :]) if head else None
            if value and len(value[0]) >= secrets.LEAST:
                out.add(value[0])
                at = head.end() + len(value[0])
                continue
            token = re.match(r"[A-Za-z0-9+/_-]+", text[at:])
            if token and (at == 0 or not re.match(r"[A-Za-z0-9+/_-]", text[at - 1])):
                run = token[0]
                if len(run) >= 16 and (any(c.isdigit() for c in run) or any(a.islower() and b.isupper() for a, b in zip(run, run[1:], strict=False))):
                    out.add(run + re.match("={0,2}", text[at + len(run) :])[0])
                    at += len(run)
                    continue
            at += 1
        return out

    letters = long_key(400).translate(str.maketrans("0123456789", "abcdefghij"))[:48]
    made = [f"the key {letters} of it", "UNDENKEITKEITHEITUND Enbescherverauheit", "password: hunter2hunter2 token=abc", f"see {'ab' * 10}1 and {letters.upper()}", "secret='xx' auth = \"quoted-value-0\" end"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    docs = docs.unionByName(spark.createDataFrame([(10_000 + i, t, "src1") for i, t in enumerate(made)], "doc_id long, text string, source string"))
    found = {}
    for r in secrets.scan_secrets(docs, forest=forest_of(spark)).collect():
        found.setdefault(r["doc_id"], set()).add(r["candidate"])
    want = {r["doc_id"]: c for r in docs.collect() if (c := plain(r["text"] or ""))}
    assert found == want and letters in found[10_000]


def forest_of(spark):
    return secrets.train_forest(secrets.labelled_findings(spark, 40))


def test_names_of_other_columns_do_not_clash(spark):
    key = long_key(40)
    docs = spark.createDataFrame([(1, f"token = {key}", [1, 2], "a", "b", "c"), (2, None, None, None, None, None)], "doc_id long, text string, hits array<int>, `gaps` string, row string, `judged.x` string")
    got = {r["doc_id"]: r for r in secrets.redact_secrets(docs, forest=forest_of(spark)).collect()}
    assert got[1].asDict() == {"doc_id": 1, "text": "token = [REDACTED]", "hits": [1, 2], "gaps": "a", "row": "b", "judged.x": "c"} and got[2]["text"] is None
    assert [r["candidate"] for r in secrets.scan_secrets(docs, path="gaps", forest=forest_of(spark)).collect()] == [key]
