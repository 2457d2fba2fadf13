"""SimHash near-duplicates through one-wildcard variants of two 32-bit segments.

Two fingerprints that differ in at most three bits differ in at most one bit of one of
their two halves. So each distinct fingerprint is indexed 64 times: for each half and each
of its bits, the half with that bit masked out. Equal keys are the candidates, verified on
all 64 bits; components of the verified links are the groups.

Texts that give equal fingerprints count as one node from the start, so a group of exact
copies costs one row in the index however large it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, with_minimum
from .shared import files_for, keep_first_of_groups, let_workers_import, text_chunks, written

MAX_BITS = 3
SEED = 42
SHINGLE_WORDS = 3
#: A key with more fingerprints than this is cut further by the bytes of its other half.
LARGE_KEY = 4096
#: A longer text is hashed in pieces of about so many bytes.
PIECE_BYTES = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The bits of each byte as eight bytes.
_COUNTERS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def shingle_hashes(text: bytes, words: int = SHINGLE_WORDS, seed: int = SEED) -> list[int]:
    """XXH64 of each run of words of the lower-cased text; a shorter text is one run, none without words."""
    found = text.translate(_LOWER).split()
    if len(found) < words:
        return [xxhash.xxh64_intdigest(b" ".join(found), seed)] if found else []
    digest = xxhash.xxh64_intdigest
    return [digest(b" ".join(run), seed) for run in zip(*(found[i:] for i in range(words)), strict=False)]


def bit_counts(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each run of sizes[i] > 0 hashes, how many have each of the 64 bits."""
    runs = -(-sizes // 255)  # eight counters of a byte each are added at once, so 255 hashes at a time
    first = np.cumsum(runs) - runs
    begins = np.repeat(np.cumsum(sizes) - sizes, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first, runs))
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.stack([np.add.reduceat(_COUNTERS[octets[:, i]], begins) for i in range(8)], axis=1)
    return np.add.reduceat(ones.view(np.uint8), first, axis=0, dtype=np.int64)


def _majorities(ones: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints_of(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Majority bits of each run of counts[i] hashes; an empty run gives 0."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        out[some] = _majorities(bit_counts(hashes, counts[some]), counts[some])
    return out


def _pieces(text: memoryview) -> Iterator[bytes]:
    """The text in pieces of about PIECE_BYTES that end before white space; every run of SHINGLE_WORDS words stands in just one.

    A piece begins with the last words of the one before. Only a text of fewer words is one shorter piece."""
    at, held, any_ = 0, b"", False
    while at < len(text):
        cut = _SPACE.search(text, min(at + PIECE_BYTES, len(text)))
        end = cut.start() if cut else len(text)
        piece = held + b" " + bytes(text[at:end])
        words = piece.rsplit(maxsplit=SHINGLE_WORDS)[-SHINGLE_WORDS:]
        whole = len(words) == SHINGLE_WORDS
        if whole or end == len(text) and not any_:
            any_ = True
            yield piece
        held, at = b" ".join(words[whole:]), end


def long_fingerprint(text: memoryview) -> np.ndarray:
    """fingerprints_of the shingles of one text, in memory of a few pieces."""
    ones, size = np.zeros((1, 64), np.int64), 0
    for piece in _pieces(text):
        found = np.array(shingle_hashes(piece), np.uint64)
        if len(found):
            ones += bit_counts(found, np.array([len(found)]))
            size += len(found)
    return _majorities(ones, np.array([size]))


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = []
        for lo, hi, raw, offsets in text_chunks(batch.column(1)):
            if hi - lo == 1 and len(raw) > PIECE_BYTES:
                got.append(long_fingerprint(memoryview(raw)))
                continue
            lists = [shingle_hashes(raw[offsets[i] : offsets[i + 1]].tobytes()) for i in range(hi - lo)]
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            hashes = np.fromiter((h for own in lists for h in own), np.uint64, int(counts.sum()))
            got.append(fingerprints_of(hashes, counts))
        prints = np.concatenate(got) if got else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, fp) for every row of docs; fp holds the 64 bits as a signed long."""
    let_workers_import(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def variants(prints: DataFrame) -> DataFrame:
    """The index: (key, fp) 64 times per fingerprint; a key names the half, the masked bit and the other 31 bits."""
    half = F.when(F.col("v") < 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    mask = F.expr("shiftleft(1L, CAST(v % 32 AS INT))")
    key = F.expr("shiftleft(v, 32)").bitwiseOR(half.bitwiseAND(F.bitwise_not(mask)))
    return prints.select("fp", F.explode(F.expr("sequence(0L, 63L)")).alias("v")).select(key.alias("key"), "fp")


def _forest(found: np.ndarray, out: list, limit: int = MAX_BITS) -> None:
    """Edges that span the links among distinct fingerprints: each one is compared with those not reached yet."""
    left = np.arange(len(found))
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(found[left] ^ found[at]) <= limit
            if near.any():
                hit = left[near]
                out.append((np.repeat(found[at], len(hit)), found[hit]))
                frontier.extend(hit.tolist())
                left = left[~near]


def _link_key(key: int, found: np.ndarray, out: list) -> None:
    """Links of one key. Where no two differ in the masked bit, the first masked bit's key has seen the same pairs."""
    v = key >> 32
    bit = v + 32 if v < 32 else v - 32
    if v % 32:
        set_ = (found >> np.uint64(bit)) & np.uint64(1)
        if set_.all() or not set_.any():
            return
    if len(found) <= LARGE_KEY:
        _forest(found, out)
        return
    other = found & np.uint64(0xFFFFFFFF) if v < 32 else found >> np.uint64(32)
    for byte in range(4):  # at most three bits differ there, so one of four bytes is equal
        value = (other >> np.uint64(8 * byte)) & np.uint64(255)
        order = np.argsort(value, kind="stable")
        for part in np.split(found[order], np.flatnonzero(np.diff(value[order])) + 1):
            if len(part) > 1:
                _forest(part, out)


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input sorted by (key, fp); groups that go on in the next batch are kept back."""
    held_key, held = None, []

    def emit(out: list) -> Iterator[pa.RecordBatch]:
        if out:
            a, b = (np.concatenate(side).view(np.int64) for side in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        found = batch.column(1).to_numpy().view(np.uint64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        out: list = []
        if held_key is not None:
            if keys[0] == held_key:
                held.append(found[: cuts[1]])
                if len(cuts) == 2:
                    continue
                cuts = cuts[1:]
            if sum(map(len, held)) > 1:
                _link_key(int(held_key), np.concatenate(held), out)
        lengths = np.diff(cuts)
        pairs = cuts[:-1][:-1][lengths[:-1] == 2]
        near = pairs[np.bitwise_count(found[pairs] ^ found[pairs + 1]) <= MAX_BITS]
        if len(near):
            out.append((found[near], found[near + 1]))
        for k in np.flatnonzero(lengths[:-1] > 2):
            _link_key(int(keys[cuts[k]]), found[cuts[k] : cuts[k + 1]], out)
        held_key, held = keys[cuts[-2]], [found[cuts[-2] : cuts[-1]].copy()]
        yield from emit(out)
    out = []
    if sum(map(len, held)) > 1:
        _link_key(int(held_key), np.concatenate(held), out)
    yield from emit(out)


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that span every group of distinct fingerprints fp linked at MAX_BITS bits or fewer."""
    index = variants(prints).repartition("key").sortWithinPartitions("key", "fp")
    return index.mapInArrow(_link_batches, "a long, b long").distinct()


def _rooted(prints: DataFrame, files: int | None = None) -> DataFrame:
    """(fp, rep, root): each distinct fingerprint with its smallest doc_id and the fingerprint that names its group."""
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    parts = connected_components(fingerprint_links(classes.select("fp")), files=files)
    return classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))


def simhash_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach).

    A null, empty or blank text has fingerprint 0 and links like any other. A null doc_id
    keeps its row; it names no component, so a group of such rows alone has a null
    component_id. Repeated rows and repeated doc_ids keep one result row each. Further
    columns of docs are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    prints = written(fingerprints(docs).repartition(files_for(spark, 0)), "simhash")  # as many tasks as docs has partitions
    files = files_for(spark, prints.count())
    rooted = written(_rooted(prints, files), "simhash-groups", files)
    named = with_minimum(rooted, "root", "rep", "component_id", rooted.count()).select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id").coalesce(files)


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs for each group: that with the smallest doc_id; among rows with it, or
    where no row has one, the first as written. Columns of any name pass through; an empty
    table gives an empty result."""

    def grouped(rows: DataFrame) -> DataFrame:
        numbered = written(rows.select(F.col("row").alias("doc_id"), "text").transform(fingerprints), "simhash")
        named = numbered.withColumnRenamed("doc_id", "row").join(_rooted(numbered).select("fp", "root"), "fp")
        return named.join(rows.select("row", "doc_id"), "row").select("row", "doc_id", "root")

    return keep_first_of_groups(docs, grouped)
