"""Embedding near-duplicates by collision counting over one-dimensional projections.

Unit vectors with cosine c are sqrt(2 - 2c) apart, and their projections on a random
direction differ by about that over the root of the dimension. Each vector is projected on
many random directions; around each query's value lies a window, and a pair collides on a
direction if one lies in the window of the other. Collisions of a pair at the threshold are
binomial, which gives the largest count that misses no more than an allowed share of such
pairs. Pairs that reach it are verified by their cosine in double precision.

The first direction also deals the work out: its axis is cut into bins, the vectors of a
bin are queries there, and every vector visits the bins that its window reaches. A bin
with many queries is split by hash, so a hot spot is many tasks. Visitors stream past the
queries in blocks; nothing but verified links, as edges of a spanning forest, and counts of
links leave a task. Equal vectors are one class from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import dropped, let_workers_import, written

MIN_COSINE = 0.95
DIRECTIONS = 32
#: Half a window in standard deviations of the projected difference of a pair at the threshold.
WINDOW_SIGMAS = 1.5
#: Half the window of the direction that deals out the work; beyond it lies 1 in 16,000 of such pairs.
DEAL_SIGMAS = 4.0
#: Share of pairs at the threshold that the count may miss; closer pairs are missed less.
MAX_MISS = 1e-4
BIN_WIDTH = 0.125
#: Queries of one task, and visitors compared with them at a time.
TASK_QUERIES, BLOCK = 8192, 256
SEED = 20240229


def needed_collisions(directions: int = DIRECTIONS, sigmas: float = WINDOW_SIGMAS, miss: float = MAX_MISS) -> int:
    """Largest count that a pair at the threshold reaches with probability 1 - miss."""
    p = math.erf(sigmas / math.sqrt(2))
    below = 0.0
    for count in range(directions + 1):
        below += math.comb(directions, count) * p**count * (1 - p) ** (directions - count)
        if below > miss:
            return count
    return directions


def sigma(dim: int, cosine: float = MIN_COSINE) -> float:
    return math.sqrt(2 - 2 * cosine) / math.sqrt(dim)


def directions_of(dim: int, seed: int = SEED) -> np.ndarray:
    """DIRECTIONS + 1 unit vectors of a dimension; the first deals out the work."""
    found = np.random.default_rng([seed, dim]).standard_normal((DIRECTIONS + 1, dim))
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def _unit(rows: np.ndarray) -> np.ndarray:
    scale = np.abs(rows).max(1, keepdims=True)  # so that no square overflows or vanishes
    rows = rows / scale
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, matrix) for each dimension in a list column without nulls."""
    values, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    offsets = offsets - offsets[0]
    lengths = np.diff(offsets)
    return [(int(d), at := np.flatnonzero(lengths == d), values[offsets[at][:, None] + np.arange(d)]) for d in np.unique(lengths)]


def _placed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        home = np.zeros(batch.num_rows, np.float64)
        for dim, at, rows in _matrix(batch.column(1)):
            home[at] = _unit(rows.astype(np.float64)) @ directions_of(dim)[0]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home)], names=["rep", "v", "n", "home"])


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that can link: no null or non-finite component, not zero."""
    v = F.col("embedding").cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    good = v.isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, F.transform(v, lambda x: x + F.lit(0.0))).alias("v")).where("v IS NOT NULL AND vec_id IS NOT NULL")


def _compare_batches(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell and queries first: (cell, is_visit, rep, n, v)."""
    state: _Cell | None = None
    for batch in batches:
        cells = batch.column(0).to_pylist()
        begin = 0
        while begin < len(cells):
            end = begin
            while end < len(cells) and cells[end] == cells[begin]:
                end += 1
            if state is None or state.name != cells[begin]:
                if state is not None:
                    yield from state.finish()
                state = _Cell(cells[begin], cosine)
            yield from state.take(batch.slice(begin, end - begin))
            begin = end
    if state is not None:
        yield from state.finish()


class _Cell:
    """The queries of a cell, the links counted for them, and a union-find over them."""

    def __init__(self, name: str, cosine: float):
        self.name, self.cosine, self.parts, self.ready = name, cosine, [], False

    def take(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        visit = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        rep, n = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        rows = _matrix(batch.column(4))[0][2].astype(np.float64)
        if not visit.all():
            self.parts.append((rep[~visit], rows[~visit]))
        at = np.flatnonzero(visit)
        for i in range(0, len(at), BLOCK):
            self._start()
            yield from self._block(rep[at[i : i + BLOCK]], n[at[i : i + BLOCK]], rows[at[i : i + BLOCK]])

    def _start(self) -> None:
        if self.ready:
            return
        self.ready = True
        self.rep = np.concatenate([p[0] for p in self.parts])
        self.rows = _unit(np.concatenate([p[1] for p in self.parts]))
        self.parts = []
        dim = self.rows.shape[1]
        self.axes = directions_of(dim)[1:]
        self.step = 32000.0 / 2  # unit projections lie in [-1, 1]
        self.reach = np.uint16(math.ceil(WINDOW_SIGMAS * sigma(dim, self.cosine) * self.step) + 1)
        self.need = needed_collisions()
        self.values = self._values(self.rows)
        self.links = np.zeros(len(self.rep), np.int64)
        self.parent = np.arange(len(self.rep))

    def _values(self, rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(np.rint((rows @ self.axes.T + 1.0) * self.step).astype(np.uint16).T)

    def _block(self, rep: np.ndarray, n: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = _unit(rows)
        theirs = self._values(rows)
        hits = np.zeros((len(rep), len(self.rep)), np.uint8)
        for own, other in zip(self.values, theirs, strict=True):
            hits += (own[None, :] + self.reach - other[:, None]) <= np.uint16(2 * self.reach)
        a, b = np.nonzero(hits >= self.need)
        links = np.zeros(0, bool)
        if len(a):
            found = np.concatenate([np.einsum("ij,ij->i", rows[a[i : i + 65536]], self.rows[b[i : i + 65536]]) for i in range(0, len(a), 65536)])
            links = (found >= self.cosine) & (rep[a] != self.rep[b])
            a, b = a[links], b[links]
        if not len(a):
            return
        np.add.at(self.links, b, n[a])
        visitors, first = np.unique(a, return_index=True)
        anchor = np.zeros(len(rep), np.int64)
        anchor[visitors] = b[first]
        self._union(b, anchor[a])
        yield self._rows("edge", rep[visitors], self.rep[anchor[visitors]])

    def _union(self, a: np.ndarray, b: np.ndarray) -> None:
        pairs = np.unique(np.stack([self._root(a), self._root(b)]), axis=1)
        pairs = pairs[:, pairs[0] != pairs[1]]
        while pairs.shape[1]:
            high, low = pairs.max(0), pairs.min(0)
            np.minimum.at(self.parent, high, low)
            pairs = np.unique(np.stack([self._root(high), self._root(low)]), axis=1)
            pairs = pairs[:, pairs[0] != pairs[1]]

    def _root(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[x]
            if (up == x).all():
                return x
            x = up

    def finish(self) -> Iterator[pa.RecordBatch]:
        if not self.ready:
            return
        root = self._root(np.arange(len(self.rep)))
        joined = np.flatnonzero(root != np.arange(len(root)))
        yield self._rows("edge", self.rep[joined], self.rep[root[joined]])
        some = np.flatnonzero(self.links)
        yield self._rows("links", self.rep[some], self.links[some])

    @staticmethod
    def _rows(kind: str, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(a), pa.string()), pa.array(a), pa.array(b)], names=["kind", "a", "b"])


def near_duplicate_vectors(vectors: DataFrame, cosine: float = MIN_COSINE) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    n_links counts the other vectors linked directly, component_id is the smallest vec_id
    that links reach. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing, nor do rows without a vec_id or vectors of different
    lengths. Equal vectors link with each other; repeated rows count as further vectors of
    the same id. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    let_workers_import(spark)
    good = written(usable(vectors).withColumn("hash", F.xxhash64("v")), "vectors")
    classes = good.groupBy("hash", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).select("rep", "v", "n")
    placed = written(classes.mapInArrow(_placed_batches, "rep long, v array<double>, n long, home double"), "placed")
    width = F.floor(F.col("home") / F.lit(BIN_WIDTH)).cast("int")
    bins = placed.groupBy(F.size("v").alias("dim"), width.alias("bin")).agg(F.count("*").alias("m")).select("dim", "bin", F.ceil(F.col("m") / F.lit(TASK_QUERIES)).cast("int").alias("splits"))
    # per dimension the bins lie in [-1, 1], so they are 2 / BIN_WIDTH + 1 at most
    bins = F.broadcast(bins)
    cell = lambda part: F.concat_ws(":", "dim", "bin", part)
    home = placed.withColumns({"dim": F.size("v"), "bin": width}).join(bins, ["dim", "bin"])
    queries = home.select(cell(F.pmod(F.xxhash64("rep"), F.col("splits"))).alias("cell"), F.lit(False).alias("visit"), "rep", "n", "v")
    reach = F.lit(DEAL_SIGMAS * math.sqrt(2 - 2 * cosine)) / F.sqrt(F.size("v").cast("double"))
    near = F.sequence(F.floor((F.col("home") - reach) / BIN_WIDTH).cast("int"), F.floor((F.col("home") + reach) / BIN_WIDTH).cast("int"))
    visits = placed.withColumn("dim", F.size("v")).withColumn("bin", F.explode(near)).join(bins, ["dim", "bin"])
    visits = visits.withColumn("part", F.explode(F.expr("sequence(0, splits - 1)"))).select(cell(F.col("part")).alias("cell"), F.lit(True).alias("visit"), "rep", "n", "v")
    dealt = queries.unionByName(visits).repartition("cell").sortWithinPartitions("cell", "visit")
    found = written(dealt.mapInArrow(lambda batches: _compare_batches(batches, cosine), "kind string, a long, b long"), "vector-links")
    parts = connected_components(found.where("kind = 'edge'").select("a", "b"))
    counts = found.where("kind = 'links'").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
    named = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").join(counts, "rep", "left")
    named = named.select(F.xxhash64("v").alias("hash"), F.col("v").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = good.join(named, "hash").where("v = _v").select(F.col("vec_id").alias("_id"), "n_links", "component_id")
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    # an id on several rows: its rows are told apart by their number only, so each shows the largest count and the smallest component
    linked = linked.groupBy("_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = every.join(linked, F.col("vec_id") == F.col("_id"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
