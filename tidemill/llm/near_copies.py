"""Near copies by the Jaccard similarity of word shingles: SimHash through one-wildcard variants, checked exactly.

The method is that of simhash.py, with a longer fingerprint: texts at Jaccard 0.8 lie about
9.7 of 64 bits apart, so two segments of 32 bits with one wildcard see few of them. Here a
text has eight fingerprints of 64 bits (majority bits of its distinct shingles, each under
its own hash), each in four segments of 16 bits. Two texts at 0.8 differ in at most one bit
of such a segment with probability 0.28, so in at least one of the 32 with 0.9999 or more
(above 0.8 more). Of few shingles the bits vary more, so short texts have 16 fingerprints.

Where one bit of a segment may differ, one of its two bytes is equal: the index is dealt by
that byte, and the variants with one masked bit of the other byte are made and compared for
equality in the task that holds them. Equal variants are candidates, verified on 256 bits of
the fingerprints; components of the verified links are groups of candidates. The first
fingerprint joins most of a large group, and the others only link what it leaves apart, so
the links grow with the texts and not with the square of a group.

A group can be of any size, so none is gathered. First each text is compared with one hub,
the smallest class that it is linked with, which settles most of a group of near copies.
Then, in groups that this leaves in several parts, the texts outside the largest part are
held in blocks of bounded size, and all texts of the group stream past each block. Every
comparison is by the exact similarity of the shingle sets, and every pair of a group whose
parts differ is compared.

Texts with equal shingles count as one class from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components, join_hot
from .shared import keep_first_of_groups, let_workers_import, mix64, range_hashes, run_hashes, text_chunks, word_hashes, word_spans, written
from .simhash import fingerprints_of

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Fingerprints of a text, and of one with at most SHORT distinct shingles.
PRINTS, SHORT, SHORT_PRINTS = 8, 24, 16
#: Candidates are verified on this many fingerprints, from the one whose variant is equal on, and may differ there in this many bits.
CHECKED, MAX_BITS = 4, 66
#: Index rows that a task compares at a time; variants held by more texts than this are linked one by one.
INDEXED_ROWS, LARGE_VARIANT = 1 << 15, 256
#: Bytes of text hashed at a time: about 40 bytes of working memory each.
HASHED_BYTES = 256 << 10
#: Shingles that a task holds (about 40 bytes each), and the fewest texts of a group that stream past them there; at least as many as it holds.
HELD_SHINGLES, STREAMED_TEXTS = 1 << 20, 256
#: Texts compared with one copy of their hub.
HUB_TEXTS = 32
#: Postings looked up at a time.
POSTINGS = 1 << 21

_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_FACTORS = np.random.default_rng(42).integers(0, 1 << 64, SHORT_PRINTS, np.uint64) | np.uint64(1)


def shingles(raw: np.ndarray, offsets: np.ndarray, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of words of each lower-cased text, and their number a text; a shorter text is one run, none without words."""
    low = _LOWER[raw]
    starts, ends, first = word_spans(low, offsets)
    found, n = word_hashes(low, starts, ends), np.diff(first)
    counts = np.where(n < words, np.minimum(n, 1), n - words + 1)
    short = np.repeat(n < words, counts)
    out = np.zeros(len(short), np.uint64)
    if len(found) >= words:
        owner = np.repeat(np.arange(len(n)), n)
        out[~short] = run_hashes(found, words)[owner[: len(owner) - words + 1] == owner[words - 1 :]]
    few = np.flatnonzero((n > 0) & (n < words))
    out[short] = range_hashes(found, first[few], first[few] + n[few])
    return out, counts


def simhash_prints(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of each text's distinct shingles, text by text, and their number a text; none without shingles."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, owner))
    own, found = owner[order], hashes[order]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (found[1:] != found[:-1])
    own, found = own[fresh], found[fresh]
    distinct = np.bincount(own, minlength=len(counts))
    few = distinct <= SHORT
    table = np.zeros((len(counts), SHORT_PRINTS), np.uint64)
    for i, factor in enumerate(_FACTORS):
        which = few if i >= PRINTS else np.ones(len(counts), bool)
        table[which, i] = fingerprints_of(mix64(found[which[own]] * factor), distinct[which])
    sizes = np.where(distinct == 0, 0, np.where(few, SHORT_PRINTS, PRINTS))
    return table[np.arange(SHORT_PRINTS) < sizes[:, None]], sizes


def index_rows(nodes: DataFrame, first: int, last: int) -> DataFrame:
    """(deal, node, f0, f1, ...) for each byte of the prints first up to last of nodes (node, prints): deal names the byte and its value.

    f0 is the fingerprint of the byte; the others are those that follow in its block of PRINTS.
    """
    slots = nodes.where("size(prints) > 0").select("node", "prints", F.explode(F.expr(f"sequence({8 * first}, 8 * least(size(prints), {last}) - 1)")).alias("slot"))
    at = lambda i: F.expr(f"prints[slot DIV {8 * PRINTS} * {PRINTS} + (slot DIV 8 + {i}) % {PRINTS}]")
    byte = F.expr("CAST(shiftrightunsigned(prints[CAST(slot DIV 8 AS INT)], 8 * (slot % 8)) & 255 AS INT)")
    return slots.select((F.col("slot") * 256 + byte).cast("long").alias("deal"), "node", *(at(i).alias(f"f{i}") for i in range(CHECKED)))


def _near(prints: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return sum(np.bitwise_count(row[i] ^ row[j]).astype(np.int16) for row in prints) <= MAX_BITS


def _forest(prints: np.ndarray, members: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that span the links among members: each one is compared with those not reached yet."""
    left = members
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = _near(prints, np.full(len(left), at), left)
            if near.any():
                yield np.full(near.sum(), at), left[near]
                frontier.extend(left[near].tolist())
                left = left[~near]


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that leads to each place, when i and j are joined as well."""
    while (apart := root[i] != root[j]).any():
        i, j = i[apart], j[apart]
        np.minimum.at(root, np.maximum(root[i], root[j]), np.minimum(root[i], root[j]))
        while (root[root] != root).any():
            root = root[root]
    return root


def variant_links(deal: np.ndarray, node: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (a, b), a < b, that span all pairs of rows that share a one-wildcard variant and differ in at most MAX_BITS bits."""
    byte = (deal >> 8) % 8
    other = (prints[0] >> (8 * (byte ^ 1)).astype(np.uint64)).astype(np.int64) & 255
    names, first, at = np.unique(node, return_index=True, return_inverse=True)
    root = first[at]
    for bit in range(8):
        variant = deal << 8 | other & ~(1 << bit)
        order = np.argsort(variant, kind="stable")
        begins = np.flatnonzero(np.diff(variant[order], prepend=-1))
        sizes = np.diff(np.append(begins, len(order)))
        for k in np.flatnonzero(sizes > LARGE_VARIANT):
            members = order[begins[k] : begins[k] + sizes[k]]
            if (root[members] != root[members[0]]).any():
                for i, j in _forest(prints, members):
                    root = _joined(root, i, j)
        after, step = np.repeat(np.where(sizes > LARGE_VARIANT, begins, begins + sizes), sizes), 1
        live = np.flatnonzero(np.arange(len(order)) + step < after)
        while len(live):
            i, j = order[live], order[live + step]
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]
            near = _near(prints, i, j)
            root = _joined(root, i[near], j[near])
            step += 1
            live = live[live + step < after[live]]
    tops = node[root[first]]
    moved = tops != names
    return np.minimum(tops, names)[moved], np.maximum(tops, names)[moved]


def _variant_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of index rows sorted by (deal, node); rows of a deal that goes on in the next batch are kept back."""

    def linked(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = variant_links(rows[0], rows[1], rows[2:].view(np.uint64))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    held, size, enough = [np.zeros((2 + CHECKED, 0), np.int64)], 0, INDEXED_ROWS
    for batch in batches:
        held.append(np.stack([column.to_numpy() for column in batch.columns]))
        size += batch.num_rows
        if size < enough:
            continue
        rows = np.concatenate(held, axis=1)
        last = int(np.searchsorted(rows[0], rows[0, -1]))
        yield from linked(rows[:, :last])
        held, size = [rows[:, last:].copy()], size - last
        enough = max(INDEXED_ROWS, 2 * size)
    yield from linked(np.concatenate(held, axis=1))


def simhash_links(nodes: DataFrame, first: int = 0, last: int = SHORT_PRINTS) -> DataFrame:
    """Links (a, b), a < b, that span the nodes (node, prints) which verified variants of the prints first up to last connect."""
    index = index_rows(nodes, first, last).repartition("deal").sortWithinPartitions("deal", "node")
    return index.mapInArrow(_variant_batches, "a long, b long").distinct()


def candidate_links(classes: DataFrame) -> DataFrame:
    """Links (a, b), a < b, that span the groups of classes (class, prints): by the first fingerprint, then by the others, where a class goes under the smallest that the first links it with."""
    # each class to its smallest neighbour, and its other ones to that one, which few pairs tell
    low = F.min("a").over(Window.partitionBy("b"))  # at most eight rows a class
    shared = written(simhash_links(classes.withColumnRenamed("class", "node"), last=1).select("a", "b", low.alias("low")), "near-shared")
    near = written(shared.select(F.col("low").alias("a"), "b").unionByName(shared.where("a <> low").select(F.col("low").alias("a"), F.col("a").alias("b"))).distinct(), "near-links")
    nodes = _named(classes, "class", shared.select(F.col("b").alias("node"), F.col("low").alias("component")).distinct(), "node").select("node", "prints")
    return near.unionByName(written(simhash_links(nodes, first=1), "near-links"))


class Held:
    """Sets of distinct hashes, by hash: those similar to another set are found from the hashes they share."""

    def __init__(self, labels: list[int], sets: list[np.ndarray]):
        self.labels, self.sizes = np.array(labels, np.int64), np.array(list(map(len, sets)), np.int64)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.hashes, self.begin, self.count = np.unique(flat[order], return_index=True, return_counts=True)

    def similar(self, own: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
        """Places of the held sets at similarity or more to the set own."""
        at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        at = at[self.hashes[at] == own]
        both = np.zeros(len(self.sizes), np.int64)
        upto, lo = np.cumsum(self.count[at]), 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + POSTINGS, side="right")))
            n = self.count[at[lo:hi]]
            where = np.repeat(self.begin[at[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both += np.bincount(self.owner[where], minlength=len(both))
            lo = hi
        return np.flatnonzero(both / np.maximum(len(own) + self.sizes - both, 1) >= similarity)


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    """(row, doc_id, class, n, prints) of docs (row, doc_id, text): equal shingles, equal class; n shingles; no prints without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, prints, sizes, numbers = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lo, hi, raw, offsets in text_chunks(batch.column(2), HASHED_BYTES):
                hashes, counts = shingles(raw, offsets, words)
                some = np.flatnonzero(counts)
                own = np.zeros(hi - lo, np.uint64)
                if len(some):
                    begins = np.cumsum(counts[some]) - counts[some]
                    own[some] = mix64(np.add.reduceat(mix64(hashes), begins) + counts[some].astype(np.uint64))
                found, number = simhash_prints(hashes, counts)
                classes.append(own)
                prints.append(found)
                numbers.append(number)
                sizes.append(counts)
            n = np.concatenate(sizes)
            ends = np.concatenate([[0], np.cumsum(np.concatenate(numbers))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prints).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(classes).view(np.int64)), pa.array(n), lists], names=["row", "doc_id", "class", "n", "prints"])

    return docs.mapInArrow(run, "row long, doc_id long, class long, n long, prints array<long>")


def cell_links(cells: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b) that span the linked labels of each cell of (cell, part, held, label, text): each text that is not held is compared with those held in its cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, labels, sets, ready, up = None, [], [], None, {}

        def root(x: int) -> int:
            while (above := up.setdefault(x, x)) != x:
                up[x] = x = up[above]
            return x

        for batch in batches:
            names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            held, own_labels, found = batch.column(2).to_pylist(), batch.column(3).to_pylist(), []
            for lo, _, raw, offsets in text_chunks(batch.column(4), HASHED_BYTES):
                hashes, counts = shingles(raw, offsets, words)
                for i, own in enumerate(np.split(hashes, np.cumsum(counts)[:-1]), lo):
                    if names[i] != now:
                        now, labels, sets, ready, up = names[i], [], [], None, {}
                    own = np.unique(own)
                    if held[i]:
                        labels.append(own_labels[i])
                        sets.append(own)
                    if held[i] or not labels:  # a block of few texts may be empty
                        continue
                    ready = ready or Held(labels, sets)
                    for other in set(ready.labels[ready.similar(own, similarity)].tolist()):
                        a, b = root(own_labels[i]), root(other)
                        if a != b:  # a link inside what is linked already tells nothing
                            up[a] = b
                            found.append((own_labels[i], other))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(side, pa.int64()) for side in zip(*found, strict=True)], names=["a", "b"])

    dealt = cells.select("cell", "part", "held", "label", "text").repartition("cell", "part").sortWithinPartitions("cell", "part", F.desc("held"))
    return dealt.mapInArrow(run, "a long, b long")


def _with_hubs(texts: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links of each class with its hub."""
    per = pairs.groupBy("hub").agg(F.count("*").alias("m")).withColumn("parts", F.ceil(F.col("m") / F.lit(HUB_TEXTS)))
    members = join_hot(pairs, "hub", per.select("hub", "parts"), pairs.count())
    part = F.pmod(F.xxhash64("class"), F.col("parts"))
    members = members.select("class", F.col("hub").alias("cell"), part.alias("part"), F.lit(False).alias("held"), F.col("class").alias("label"))
    hubs = per.select(F.col("hub").alias("class"), F.col("hub").alias("cell"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(True).alias("held"), F.col("hub").alias("label"))
    return cell_links(members.unionByName(hubs).join(texts.select("class", "text"), "class"), words, similarity)


def _between_parts(texts: DataFrame, labelled: DataFrame, count: int, words: int, similarity: float) -> DataFrame:
    """Links between the roots of labelled (class, group, n, root): all pairs of a group whose roots differ are compared."""
    per_root = labelled.groupBy("group", "root").agg(F.count("*").alias("m"))
    main = F.max_by("root", F.struct("m", "root"))
    groups = per_root.groupBy("group").agg(main.alias("main"), F.sum("m").alias("m"), F.count("*").alias("roots")).where("roots > 1")
    open_ = written(join_hot(labelled, "group", groups.select("group", "main", "m"), count).where("main IS NOT NULL"), "near-open")
    held = open_.where("root <> main")
    blocks = held.groupBy("group").agg(F.ceil(F.sum("n") / F.lit(HELD_SHINGLES)).alias("blocks"), F.count("*").alias("held_texts"))
    # a held text is copied once for as many streamed ones as are held, so the copies are no more than the group
    dealt = join_hot(open_, "group", blocks, count).withColumn("streams", F.ceil(F.col("m") / F.greatest("held_texts", F.lit(STREAMED_TEXTS))))
    own_stream, own_block = F.pmod(F.xxhash64("class", F.lit(1)), F.col("streams")), F.pmod(F.xxhash64("class"), F.col("blocks"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    streamed = dealt.withColumn("i", upto("blocks")).select("class", F.col("group").alias("cell"), (F.col("i") * F.col("streams") + own_stream).alias("part"), F.lit(False).alias("held"), F.col("root").alias("label"))
    kept = dealt.where("root <> main").withColumn("i", upto("streams")).select("class", F.col("group").alias("cell"), (own_block * F.col("streams") + F.col("i")).alias("part"), F.lit(True).alias("held"), F.col("root").alias("label"))
    return cell_links(streamed.unionByName(kept).join(texts.select("class", "text"), "class"), words, similarity)


def _named(rows: DataFrame, key: str, parts: DataFrame, name: str) -> DataFrame:
    """rows with the component of their key, or the key itself, as column name."""
    found = rows.join(parts.select(F.col("node").alias(key), F.col("component").alias("_c")), key, "left")
    return found.select(*rows.columns, F.coalesce("_c", key).alias(name))


def _grouped(rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """(row, doc_id, root) of rows (row, doc_id, text); rows is read twice and must give equal rows each time."""
    let_workers_import(rows.sparkSession)
    prints = written(_sketches(rows, words), "near-prints")
    classes = written(prints.groupBy("class").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("prints").alias("prints")), "near-classes")
    links = candidate_links(classes.select("class", "prints"))
    parts = connected_components(links).select(F.col("node").alias("class"), F.col("component").alias("group"))
    pairs = written(links.groupBy(F.col("b").alias("class")).agg(F.min("a").alias("hub")), "near-hubs")
    texts = written(classes.select("class", "row", "n").join(parts, "class").join(rows.select("row", "text"), "row").select("class", "group", "n", "text"), "near-texts")
    near_hubs = connected_components(_with_hubs(texts, pairs, words, similarity))
    labelled = written(_named(texts.select("class", "group", "n"), "class", near_hubs, "root"), "near-labelled")
    count = labelled.count()
    between = connected_components(_between_parts(texts, labelled, count, words, similarity))
    roots = labelled.select("class", F.col("root").alias("part"))
    roots = join_hot(roots, "part", between.select(F.col("node").alias("part"), F.col("component").alias("top")), count).select("class", F.coalesce("top", "part").alias("root"))
    return join_hot(prints.select("row", "doc_id", "class"), "class", roots, prints.count()).select("row", "doc_id", F.coalesce("root", "class").alias("root"))


def keep_one_of_each(docs: DataFrame, words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs for each group of rows whose shingle sets links of at least similarity connect.

    That with the smallest doc_id stays; among rows with it, or where no row has one, the
    first as written. Null, empty and blank texts are one group. Columns of any name pass
    through; an empty table gives an empty result.
    """
    return keep_first_of_groups(docs, lambda rows: _grouped(rows, words, similarity))
