"""Repair of the structure of conversations: cheapest edits that make the roles take legal turns.

The rows of a conversation are a path through a small automaton: nothing yet, after a system
turn, after a user turn, after an assistant turn. A node is (rows used up, state), an edit is
an arc with a cost of 0 to 6, so shortest paths come from Dial's ring of seven buckets in place
of a heap. The distances to the goal are recorded, and a walk from the start takes the tight arc
of the smallest letter at each node, which gives the cheapest edits whose letters sort first.

A conversation of any length is cut into blocks of rows. A block is summed up by its distances
between the states before and after it, blocks are chained by those, and each is then walked
alone; no task holds the turns of a whole conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import dropped, let_workers_import, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: White space of the contract: space and \x09 to \x0D.
BLANKS = " \t\n\x0b\x0c\r"
#: Rows of an order partition that make a block: a block of a conversation has at most so many.
BLOCK_BITS = 16

START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 50
RING = REROLE + TRUNCATED + 1
#: States from which the next turn may be of this role; the state after it has the same number.
BEFORE = {SYSTEM: (START,), USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
GOAL = (0, FAR, FAR, 0)

# A row is one letter: 4 * (initial of its role: 0 other, else the state) + (0 sound, 1 blank, 2 duplicate, 3 truncated), from "A" on.
SOUND, BLANK, DUPLICATE, CUT = range(4)


def row_code(letter: str) -> tuple[int, int]:
    return divmod(ord(letter) - 65, 4)


def distances(codes: str, after: tuple[int, ...]) -> list[int]:
    """Distance to the goal from each node 4 * i + state, i rows used up; after: the distances from the states behind the last row.

    Dial's algorithm against the arcs: nodes wait in a ring of buckets by distance, and no arc is longer than the ring.
    """
    n = len(codes)
    best = [FAR] * (4 * n + 4)
    ring: list[list[int]] = [[] for _ in range(RING)]
    seeds = sorted((d, 4 * n + q) for q, d in enumerate(after) if d < FAR)
    rows = [row_code(c) for c in codes]
    clock, waiting = seeds[0][0] if seeds else 0, 0

    def reach(node: int, d: int) -> int:
        if d >= best[node]:
            return 0
        best[node] = d
        ring[d % RING].append(node)
        return 1

    while seeds or waiting:
        while seeds and seeds[0][0] == clock:
            d, node = seeds.pop(0)
            waiting += reach(node, d)
        bucket = ring[clock % RING]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if best[node] != clock:
                continue
            i, state = divmod(node, 4)
            if state in ROLE:
                for p in BEFORE[state]:
                    waiting += reach(4 * i + p, clock + INSERT)
            if not i:
                continue
            role, fault = rows[i - 1]
            waiting += reach(node - 4, clock + DELETE)
            if state and fault not in (BLANK, DUPLICATE):
                extra = TRUNCATED if fault == CUT else 0
                for p in BEFORE[state]:
                    if role == state:
                        waiting += reach(4 * (i - 1) + p, clock + KEEP + extra)
                    if state in ROLE:
                        waiting += reach(4 * (i - 1) + p, clock + REROLE + extra)
        clock += 1
    return best


def walk(codes: str, best: list[int], state: int, last: bool) -> tuple[str, int]:
    """(letters, state behind the last row) of the path along tight arcs whose letters sort first."""
    out, i, n = [], 0, len(codes)
    while True:
        here = best[4 * i + state]
        if i == n and (here == 0 or not last):
            return "".join(out), state
        wanted = NEXT[state]
        if i < n:
            role, fault = row_code(codes[i])
            if here == DELETE + best[4 * i + 4 + state]:
                out.append("D")
                i += 1
                continue
        if here == INSERT + best[4 * i + wanted]:
            out.append("I")
            state = wanted
            continue
        extra = TRUNCATED if fault == CUT else 0
        if (role == wanted or (role == SYSTEM and state == START)) and here == KEEP + extra + best[4 * i + 4 + role]:
            out.append("K")
            state = role
        else:
            out.append("R")
            state = wanted
        i += 1


def summed_up(codes: str) -> tuple[list[int], list[int]]:
    """(distances: 4 * state before + state after the block; blank, duplicate, truncated, illegal neighbours)."""
    spans = [distances(codes, tuple(0 if q == end else FAR for q in range(4)))[:4] for end in range(4)]
    rows = [row_code(c) for c in codes]
    faults = [sum(f == kind for _, f in rows) for kind in (BLANK, DUPLICATE, CUT)]
    illegal = sum(not legal(a, b) for (a, _), (b, _) in zip(rows, rows[1:], strict=False))
    return [spans[end][start] for start in range(4) for end in range(4)], [*faults, illegal]


def legal(first: int, second: int) -> bool:
    return (first, second) in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))


def walks(codes: str, after: tuple[int, ...], last: bool, starts: tuple[int, ...]) -> list[tuple[str, int] | None]:
    best = distances(codes, after)
    return [walk(codes, best, s, last) if best[s] < FAR else None for s in starts]


#: Most conversations are short and few patterns of roles and faults are common; longer ones are not held.
CACHED_ROWS = 48


@lru_cache(1 << 14)
def short_summed_up(codes: str) -> tuple[list[int], list[int]]:
    return summed_up(codes)


@lru_cache(1 << 14)
def short_walks(codes: str, after: tuple[int, ...], last: bool, starts: tuple[int, ...]) -> list[tuple[str, int] | None]:
    return walks(codes, after, last, starts)


class Repair(NamedTuple):
    """report: a row for each conversation; turns: what is left of them, in order; tables: to drop when both are read."""

    report: DataFrame
    turns: DataFrame
    tables: list[DataFrame]


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of rows after the damage that crc32(conv_id:turn) % 20 names.

    0 drops a row, 1 empties its text, 2 takes its [.!?], 3 repeats it, 4 makes it a user's. A null
    conv_id or turn counts as one space in the checksum and stays null; a null role or text becomes
    one space. Repeated rows are damaged alike; further columns are left out.
    """
    at = {c: F.col(c).cast("long") for c in ("conv_id", "turn")}
    named = F.concat_ws(":", *(F.coalesce(at[c].cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    plain = rows.select(at["conv_id"].alias("conv_id"), at["turn"].alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(named.cast("binary")) % 20).alias("_d"))
    return plain.where("_d <> 0").select(
        "conv_id", "turn", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """rows with at: ascending with (conv, turn, role, text), nulls first; written, so that the numbers stay."""
    plain = rows.select(
        F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("")).alias("conv"), F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")),
    )
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    short = F.substring("text", 1, 256)  # the driver samples the keys of a range exchange
    near = plain.repartitionByRange(n, "conv", F.asc_nulls_first("turn"), "role", short)
    near = near.sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text")
    return written(near.withColumn("at", F.monotonically_increasing_id()), "turns")


def _code(kind: Column) -> Column:
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(0)
    return F.char(65 + 4 * role + kind)


def _mapped(df: DataFrame, schema: str, each) -> DataFrame:
    """df with each(columns as lists) applied to its Arrow batches; each gives lists in the order of schema."""
    let_workers_import(df.sparkSession)
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    fields = [f.strip().split(" ") for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(each(*(c.to_pylist() for c in batch.columns)))
            columns = zip(*rows, strict=True) if rows else ([] for _ in fields)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[f for f, _ in fields])

    return df.mapInArrow(run, schema)


def _blocks(turns: DataFrame) -> DataFrame:
    """(conv, block, at of the first row, codes): the rows of a conversation in a block as letters."""
    left = F.rtrim("text", F.lit(BLANKS))
    rows = turns.select("conv", "role", "at", F.sha2("text", 256).alias("digest"), (left == "").alias("blank"), (~F.substring(left, -1, 1).isin(".", "!", "?")).alias("cut"))
    first = rows.where("NOT blank").groupBy("conv", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    kind = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("cut"), CUT).otherwise(SOUND)
    marked = rows.drop("digest").join(first, "at", "left").select("conv", "at", F.shiftright("at", BLOCK_BITS).alias("block"), _code(kind).alias("code"))
    codes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]), "")
    return marked.groupBy("conv", "block").agg(F.min("at").alias("at"), codes.alias("codes"))


def _chained(conv: list, parts: list) -> Iterator[tuple]:
    """For each block of a conversation the distances behind it; with the first block the figures of the conversation."""
    for key, blocks in zip(conv, parts, strict=True):
        after, out, figures, ahead = list(GOAL), [], [0, 0, 0, 0], None
        for b in reversed(blocks):
            here = after
            after = [min(FAR, *(b["spans"][4 * p + q] + here[q] for q in range(4))) for p in range(4)]
            figures = [x + y for x, y in zip(figures, b["faults"], strict=True)]
            figures[3] += ahead is not None and not legal(b["ends"][1], ahead)
            ahead = b["ends"][0]
            out.append([key, b["block"], here, b is blocks[-1], len(blocks) == 1, None])
        out[-1][-1] = [*figures, after[START]]
        yield from out


def _composed(conv: list, parts: list) -> Iterator[tuple]:
    """The state in which each block of a conversation begins."""
    for key, blocks in zip(conv, parts, strict=True):
        state = START
        for b in blocks:
            yield key, b["block"], state
            state = b["exits"][state]


def _as_list(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", *columns))).alias("parts"))


def repair_conversations(rows: DataFrame) -> Repair:
    """Cheapest edits of each conversation of rows (conv_id, turn, role, text) and what they leave.

    Rows of a conversation stand by turn, nulls first, then by role and text. A row is blank
    (white space only), or a duplicate (role and text stood earlier), or truncated (the last
    character is none of [.!?]), by the first that holds. Keeping costs 0, another role (user or
    assistant) 3, deleting 4, which blank and duplicate rows need; an empty user or assistant
    turn anywhere 3; a truncated row that stays 3 more. The initials of the roles then read
    (s?(ua)+)?. Roles of other or no initial cannot be kept.

    report: conv_id, blank, duplicate, truncated, illegal (neighbours whose initials are not su,
    ua, au), cost, audit (initials of the edits, ascii-least of the cheapest). turns: conv_id,
    lone (the conversation lies in one block), block, place (order in it), role, text, in the order
    of the conversation within each partition. A null conv_id is a conversation like any other,
    and a null role or text counts as one space. An empty table gives empty results; further
    columns are left out. Call dropped on tables when both results are read.
    """
    turns = _ordered(rows)
    blocks = written(_blocks(turns), "blocks")

    def summaries(conv, block, codes):
        for c, b, code in zip(conv, block, codes, strict=True):
            spans, faults = (short_summed_up if len(code) <= CACHED_ROWS else summed_up)(code)
            yield c, b, spans, faults, [row_code(code[0])[0], row_code(code[-1])[0]]

    sums = _mapped(blocks.select("conv", "block", "codes"), "conv string, block long, spans array<long>, faults array<long>, ends array<long>", summaries)
    after = written(_mapped(_as_list(sums, "spans", "faults", "ends"), "conv string, block long, after array<long>, last boolean, lone boolean, figures array<long>", _chained), "after")

    def walked(conv, block, at, codes, after, last, lone):
        for c, b, a, code, d, end, one in zip(conv, block, at, codes, after, last, lone, strict=True):
            found = (short_walks if len(code) <= CACHED_ROWS else walks)(code, tuple(d), end, (START,) if one else (START, SYSTEM, USER, ASSISTANT))
            yield c, b, a, one, [f and f[0] for f in found], [f[1] if f else START for f in found]

    planned = blocks.join(after.drop("figures"), ["conv", "block"]).select("conv", "block", "at", "codes", "after", "last", "lone")
    planned = written(_mapped(planned, "conv string, block long, at long, lone boolean, audits array<string>, exits array<long>", walked), "plans")
    entries = _mapped(_as_list(planned.where("NOT lone"), "exits"), "conv string, block long, entry long", _composed)
    plans = planned.join(entries, ["conv", "block"], "left").withColumn("entry", F.coalesce("entry", F.lit(START)))
    plans = written(plans.select("conv", "block", "at", "lone", "entry", F.expr("audits[CAST(entry AS INT)]").alias("audit")), "plans")
    audits = _as_list(plans, "audit").select("conv", F.array_join(F.transform("parts", lambda p: p["audit"]), "").alias("audit"))
    figures = after.where("figures IS NOT NULL").select("conv", *(F.col("figures")[i].alias(c) for i, c in enumerate(("blank", "duplicate", "truncated", "illegal", "cost"))))
    report = figures.join(audits, "conv").select(_conv_id(), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return Repair(report, _repaired(turns, plans), [turns, blocks, after, planned, plans])


def _conv_id() -> Column:
    return F.when(F.col("conv") != "", F.col("conv").cast("long")).alias("conv_id")


def _repaired(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """The rows that the plans leave: a plan streams ahead of the rows of its block."""
    none = F.lit(None).cast("string")
    block = F.shiftright("at", BLOCK_BITS).alias("block")
    rows = turns.select("conv", block, "at", F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("entry"), F.lit(False).alias("lone"), "role", "text")
    ahead = plans.select("conv", "block", "at", F.lit(0).alias("_kind"), "entry", "lone", none.alias("role"), F.col("audit").alias("text"))
    stream = rows.unionByName(ahead).repartition("block").sortWithinPartitions("at", "_kind").drop("at")
    let_workers_import(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits, at, state, one, place, key = "", 0, START, True, 0, None
        names = ["conv", "lone", "block", "place", "role", "text"]

        def inserted(out):
            nonlocal at, state, place
            while at < len(edits) and edits[at] == "I":
                state, at, place = NEXT[state], at + 1, place + 1
                out.append((*key, place, ROLE[state], ""))

        def made(out):
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            out: list[tuple] = []
            for conv, block, kind, entry, lone, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:  # behind the last row of the plan before, insertions may be left
                    inserted(out)
                    edits, at, state, one, place, key = text, 0, entry, lone, 0, (conv, lone, block)
                    continue
                inserted(out)
                edit, at = edits[at], at + 1
                if edit == "D":
                    continue
                if edit == "R":
                    state = NEXT[state]
                    role = ROLE[state]
                else:
                    state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                place += 1
                out.append((*key, place, role, text))
            yield made(out)
        out = []
        inserted(out)
        yield made(out)

    return stream.mapInArrow(run, "conv string, lone boolean, block long, place long, role string, text string").select(_conv_id(), "lone", "block", "place", "role", "text")


#: Bytes of text after which a piece of a long conversation is passed on.
PIECE_BYTES = 1 << 20


def conversation_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the turns of repair_conversations, as lines role:text.

    Where a conversation lies in one block its digest is taken in the stream of the block. Of a
    longer one, pieces of about a megabyte go to one task, in order: SHA-256 is a chain, so that
    task reads all of its text, holding a piece at a time. Conversations without turns have no row.
    """
    let_workers_import(turns.sparkSession)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, count, held, size, place = None, 0, None, 0, 0

        def given(found):
            columns = list(zip(*found, strict=True)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)], names=["conv_id", "block", "place", "piece", "digest"])

        def closed():
            if held is None or held == []:
                return []
            return [(key[0], key[2], place, None, held.hexdigest())] if key[1] else [(key[0], key[2], place, b"\n".join(held), None)]

        for batch in batches:
            found = []
            for conv, lone, block, _, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                line = f"{role}:{text}".encode()
                if (conv, lone, block) != key or held is None:
                    found += closed()
                    key, held, size, count, place = (conv, lone, block), hashlib.sha256() if lone else [], 0, 0, 0
                if lone:
                    held.update(b"\n" + line if count else line)
                else:
                    held.append(line)
                    size += len(line)
                    if size >= PIECE_BYTES:
                        found += closed()
                        held, size, place = [], 0, place + 1
                count += 1
                if found and not lone:  # a piece may be large: one a batch
                    yield given(found)
                    found = []
            yield given(found)
        yield given(closed())

    parts = written(turns.mapInArrow(lines, "conv_id long, block long, place long, piece binary, digest string"), "digests")
    whole = parts.where("digest IS NOT NULL").select("conv_id", F.col("digest").alias("repaired_sha256"))
    pieces = parts.where("digest IS NULL").select("conv_id", "block", "place", "piece").repartition("conv_id").sortWithinPartitions("conv_id", "block", "place")

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            for conv, _, _, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is not None and conv == key:
                    state.update(b"\n")
                else:
                    if state is not None:
                        yield pa.RecordBatch.from_pydict({"conv_id": pa.array([key], pa.int64()), "repaired_sha256": [state.hexdigest()]})
                    key, state = conv, hashlib.sha256()
                state.update(piece)
        if state is not None:
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([key], pa.int64()), "repaired_sha256": [state.hexdigest()]})

    return whole.unionByName(pieces.mapInArrow(chained, "conv_id long, repaired_sha256 string"))


def repair_report(rows: DataFrame) -> DataFrame:
    """Every conv_id of rows, damaged and repaired: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    gaps: numbers that the turns left after the damage skip, nulls ignored. A conversation that
    loses all its rows has zeros, an empty audit and the digest of the empty string. The empty
    table gives an empty result; nulls, repeated rows and further columns as in damaged and
    repair_conversations.
    """
    left = damaged(rows)
    made = repair_conversations(left)
    turns = made.tables[0].select(_conv_id(), "turn")
    gaps = turns.groupBy("conv_id", "turn").agg(F.lit(1)).groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    digests = conversation_digests(made.turns)
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for part in (gaps, made.report, digests):
        names = [c for c in part.columns if c != "conv_id"]
        every = every.join(part.withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id")), "left").select(*every.columns, *names)
    whole = every.select(
        "conv_id", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"),
    )
    out = written(whole, "repairs")
    for table in made.tables:
        dropped(rows.sparkSession, table)
    return out


#: All edits of a row at a time, of which the best per state goes on; checksums folded byte by byte.
ORACLE = r"""WITH RECURSIVE tab AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
  named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
  kinds AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(name) + 1), lambda k: CAST(ascii(substr(name, k, 1)) AS BIGINT))), lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1])), 4294967295) % 20 AS kind FROM named, tab),
  hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM kinds, range(0, 2) c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
  numbered AS (SELECT *, row_number() OVER w AS i FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
  seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail FROM numbered),
  turns AS (SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS ahead, count(*) OVER (PARTITION BY conv_id) AS n FROM seen),
  stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND ahead || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id),
  -- the edits of a row: what it may turn the state into, with at most one insertion before it
  moves(state, letters, role, next_) AS (VALUES ('-', 'D', '', '-'), ('s', 'D', '', 's'), ('u', 'D', '', 'u'), ('a', 'D', '', 'a'), ('-', 'K', 's', 's'), ('-', 'K', 'u', 'u'), ('s', 'K', 'u', 'u'), ('u', 'K', 'a', 'a'), ('a', 'K', 'u', 'u'), ('-', 'R', 'u', 'u'), ('s', 'R', 'u', 'u'), ('u', 'R', 'a', 'a'), ('a', 'R', 'u', 'u')),
  inserts(state, letters, line, next_) AS (VALUES ('-', '', '', '-'), ('s', '', '', 's'), ('u', '', '', 'u'), ('a', '', '', 'a'), ('-', 'I', 'user:', 'u'), ('s', 'I', 'user:', 'u'), ('u', 'I', 'assistant:', 'a'), ('a', 'I', 'user:', 'u')),
  edits AS (SELECT i.state, i.letters || m.letters AS letters, m.letters AS edit, i.line, m.role, m.next_, CASE WHEN i.letters = 'I' THEN 3 ELSE 0 END + CASE m.letters WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END AS cost FROM inserts i JOIN moves m ON m.state = i.next_),
  paths(conv_id, i, state, cost, audit, body) AS (SELECT conv_id, 0, '-', 0, '', CAST([] AS VARCHAR[]) FROM stats
    UNION ALL SELECT conv_id, i, state, best.cost, best.audit, best.body FROM (SELECT p.conv_id, t.i, e.next_ AS state, min(struct_pack(cost := p.cost + e.cost + CASE WHEN e.edit <> 'D' AND t.fault = 'truncated' THEN 3 ELSE 0 END, audit := p.audit || e.letters,
        body := list_concat(p.body, list_concat(CASE WHEN e.line = '' THEN CAST([] AS VARCHAR[]) ELSE [e.line] END, CASE e.edit WHEN 'D' THEN CAST([] AS VARCHAR[]) WHEN 'K' THEN [t.role || ':' || t.text] ELSE [CASE e.role WHEN 'u' THEN 'user:' ELSE 'assistant:' END || t.text] END)))) AS best
      FROM paths p JOIN turns t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.i = p.i + 1 JOIN edits e ON e.state = p.state WHERE e.edit = 'D' OR (t.fault NOT IN ('blank', 'duplicate') AND (e.edit = 'R' OR e.role = t.initial)) GROUP BY p.conv_id, t.i, e.next_)),
  ends(state, letters, cost, body) AS (VALUES ('-', '', 0, CAST([] AS VARCHAR[])), ('a', '', 0, CAST([] AS VARCHAR[])), ('u', 'I', 3, ['assistant:']), ('s', 'II', 6, ['user:', 'assistant:']), ('-', 'II', 6, ['user:', 'assistant:'])),
  best AS (SELECT p.conv_id, min(struct_pack(cost := p.cost + e.cost, audit := audit || letters, body := list_concat(p.body, e.body))) AS b FROM paths p JOIN ends e USING (state) JOIN (SELECT conv_id, max(n) AS n FROM turns GROUP BY conv_id) s ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = s.n GROUP BY p.conv_id)
  SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(b.cost, 0) AS BIGINT) AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(b.body, chr(10)), '')) AS repaired_sha256
  FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id"""
