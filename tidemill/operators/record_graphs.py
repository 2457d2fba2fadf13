"""Layered records of graphs of bounded size: whole graphs in a task, a batch of them at a time.

The rules are those of records.py, which does the same by joins for graphs of any size. A graph
here is a run of rows of a stream sorted by graph. Python finds for each view the numbers of the rows
that make up its events; their texts and nodes are taken from the columns by these numbers.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .graph import strong_components

#: Rows of events that are worked on at once, and rows of result that are handed on at once.
BATCH_ROWS = 20_000
# Roles by strength, and what members of a merge disagree on.
ROLES = ("backbone", "context_cross_layer", "context")
FAULTS = ("content", "text", "producer")
CONFLICTS = [[name for bit, name in enumerate(FAULTS) if code >> bit & 1] for code in range(8)]

_rank_of = itemgetter(0)


def result_schema(graph: str, event: str, node: str) -> str:
    """The columns that made_records gives, of events with these types."""
    own = f"order:struct<t:{node},s:{node},e:{event}>,event_id:{event},producers:array<{event}>,semantic:string,sources:array<{node}>,targets:array<{node}>,role:string,arcs:array<struct<a:{node},b:{node}>>,content:string,text:string,conflicts:array<string>,n_context:bigint"
    return f"graph {graph}, view_id string, record_id string, sink_nodes string, layers array<struct<layer_index:bigint,distance_to_sink:bigint,events:array<struct<{own}>>>>, n_producers bigint, n_conflicts bigint, n_graph_events bigint, n_excluded bigint, n_unattached bigint, n_beyond bigint"


def stable_id(kind: str, *parts: str) -> str:
    return f"{kind}:{hashlib.sha256(chr(10).join((kind, *parts)).encode()).hexdigest()[:24]}"


def _least(nodes: list | None) -> object:
    some = [n for n in nodes or () if n is not None]
    return min(some) if some else None


def _nulls_first(value: object) -> tuple:
    """A sort key for what may be null or a list, nulls before all."""
    if value is None:
        return (0,)
    return (1, tuple(map(_nulls_first, value))) if isinstance(value, list | tuple) else (1, value)


def _views(arcs: set[tuple]) -> Iterator[tuple[str, dict]]:
    """For each sink of the condensed graph: its nodes as text, and of each node that leads to it the longest way."""
    label = strong_components(sorted({n for arc in arcs for n in arc}), list(arcs))
    onward, members = {c: set() for c in label.values()}, defaultdict(list)
    for node, c in label.items():
        members[c].append(node)
    back: dict = defaultdict(list)
    for a, b in arcs:
        if (c := label[a]) != (d := label[b]) and d not in onward[c]:
            onward[c].add(d)
            back[d].append(c)
    sinks = sorted(c for c, to in onward.items() if not to)
    left, order = {c: len(to) for c, to in onward.items()}, list(sinks)
    for c in order:  # each after all that it leads to
        for up in back[c]:
            left[up] -= 1
            if not left[up]:
                order.append(up)
    for at, sink in enumerate(sinks):
        far = {sink: 0}
        for c in order[at + 1 :]:
            if met := [far[d] for d in onward[c] if d in far]:
                far[c] = max(met) + 1
        yield ",".join(map(str, sorted(members[sink]))), {n: v for c, v in far.items() for n in members[c]}


def _values(column: pa.Array) -> list:
    if pa.types.is_string(column.type):  # few texts that come often are made once
        found = column.dictionary_encode(null_encoding="encode")
        texts = found.dictionary.to_numpy(zero_copy_only=False)
        return texts[found.indices.to_numpy()].tolist()
    return column.to_pylist() if column.null_count else column.to_numpy().tolist()


def _lists(column: pa.ListArray) -> list:
    ends, values = column.offsets.to_numpy().tolist(), _values(column.values)
    out = [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    for i in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)) if column.null_count else ():
        out[i] = None
    return out


class _Rows:
    """Columns of the events of whole graphs, as lists, and the rank of each row's key (least target, least source, event)."""

    def __init__(self, table: pa.Table) -> None:
        self.table = table = table.combine_chunks()
        one = lambda name: table[name].chunk(0) if table[name].num_chunks == 1 else table[name].combine_chunks()
        self.column = {name: one(name) for name in table.column_names}
        self.graph, self.event, self.role, self.semantic, self.content, self.text = (_values(self.column[c]) for c in ("graph", "event", "role", "semantic", "content", "text"))
        self.sources, self.targets = _lists(self.column["sources"]), _lists(self.column["targets"])
        node = table.schema.field("sources").type.value_type
        least = lambda lists: pa.array([x[0] if x is not None and len(x) == 1 else _least(x) for x in lists], node)
        self.key = pa.StructArray.from_arrays([least(self.targets), least(self.sources), self.column["event"]], ["t", "s", "e"])
        parts = self.key.flatten()
        order = np.asarray(pc.sort_indices(pa.table(parts, ["t", "s", "e"]), sort_keys=[(k, "ascending") for k in "tse"], null_placement="at_start"))
        new = np.zeros(len(order), bool)
        for part in parts:
            codes = np.asarray(part.dictionary_encode(null_encoding="encode").indices)[order]
            new[1:] |= codes[1:] != codes[:-1]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new)
        self.rank = rank.tolist()

    def member(self, i: int) -> tuple:
        return _nulls_first((self.sources[i], self.targets[i], self.content[i], self.text[i]))


class _Result:
    """Numbers of rows by record, layer and event, and the Arrow batch made of them."""

    def __init__(self, rows: _Rows) -> None:
        self.rows = rows
        self.records: list[tuple] = []
        self.layer_ends, self.layers, self.event_ends = [0], [], [0]
        self.first, self.role, self.faults, self.n_context = [], [], [], []
        self.n_producers, self.producers, self.n_arcs, self.arcs = [], [], [], []

    def batch(self) -> pa.RecordBatch:
        of = self.rows.column
        number = lambda values: pa.array(values, pa.int64())
        ends = lambda values: pa.array(values, pa.int32())
        first = number(self.first)
        node = of["sources"].type.value_type
        arcs = pa.StructArray.from_arrays([pa.array([a for a, _ in self.arcs], node), pa.array([b for _, b in self.arcs], node)], ["a", "b"])
        after = lambda counts: np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        arc_ends = pa.array(after(self.n_arcs), mask=np.array([*(strength > 0 for strength in self.role), False]))
        events = {
            "order": self.rows.key.take(first), "event_id": of["event"].take(first), "producers": pa.ListArray.from_arrays(pa.array(after(self.n_producers)), of["event"].take(number(self.producers))), "semantic": of["semantic"].take(first),
            "sources": of["sources"].take(first), "targets": of["targets"].take(first), "role": pa.array(ROLES).take(number(self.role)), "arcs": pa.ListArray.from_arrays(arc_ends, arcs), "content": of["content"].take(first), "text": of["text"].take(first),
            "conflicts": pa.array(CONFLICTS, pa.list_(pa.string())).take(number(self.faults)), "n_context": number(self.n_context),
        }
        inner = pa.ListArray.from_arrays(ends(self.event_ends), pa.StructArray.from_arrays(list(events.values()), list(events)))
        layers = pa.StructArray.from_arrays([number([x[0] for x in self.layers]), number([x[1] for x in self.layers]), inner], ["layer_index", "distance_to_sink", "events"])
        at, view, record, nodes, *counts = zip(*self.records, strict=True)
        columns = [of["graph"].take(number(at)), pa.array(view), pa.array(record), pa.array(nodes), pa.ListArray.from_arrays(ends(self.layer_ends), layers), *map(number, counts)]
        return pa.RecordBatch.from_arrays(columns, ["graph", "view_id", "record_id", "sink_nodes", "layers", "n_producers", "n_conflicts", "n_graph_events", "n_excluded", "n_unattached", "n_beyond"])


def _graph(rows: _Rows, low: int, high: int, into: Callable[[], _Result]) -> None:
    """The records of the graph of rows low to high, each put into what into() then gives."""
    event, sources, targets, role, semantic, content, text, rank = rows.event, rows.sources, rows.targets, rows.role, rows.semantic, rows.content, rows.text, rows.rank
    named, backbone, context, arcs = defaultdict(list), defaultdict(list), defaultdict(list), set()
    count = dict.fromkeys(("backbone", "context", "excluded"), 0)
    for i in range(low, high):
        kind, e = role[i], event[i]
        if e is not None:
            named[e].append(i)
        if kind in count:
            count[kind] += 1
        if kind == "backbone":
            to = targets[i] or ()
            backbone[e] += to
            arcs.update((a, b) for a in sources[i] or () if a is not None for b in to if b is not None)
        elif kind == "context" and sources[i] is not None and targets[i] is not None:
            ends = {*sources[i], *targets[i]}
            context[e, len(ends)] += ends
    if not arcs:
        return
    for nodes, far in _views(arcs):
        placed = []
        for e, to in backbone.items():
            met = [far[t] for t in to if t in far]
            if met:
                placed.append((min(met), 0, e))
        for (e, n), ends in context.items():
            met = [far[x] for x in ends if x in far]
            if n and len(met) == n:
                placed.append((low_ := min(met), 1 if low_ < max(met) else 2, e))
        merged: dict = {}
        for v, strength, e in placed:
            for i in named.get(e, ()):
                key = v, semantic[i]
                if (found := merged.get(key)) is None:
                    merged[key] = [strength, int(strength > 0), [i]]
                else:
                    found[0] = min(found[0], strength)
                    found[1] += strength > 0
                    found[2].append(i)
        if not merged:
            continue
        place = {v: k for k, v in enumerate(sorted({v for v, _, _ in placed}, reverse=True))}  # raw, the depth less v, counts from the top
        by_layer = defaultdict(list)
        for (v, meaning), (strength, n_context, members) in merged.items():
            first, fault = members[0], 0
            if len(members) > 1:
                members.sort(key=rank.__getitem__)
                first = members[0]
                if rank[members[1]] == rank[first]:
                    first = min((i for i in members if rank[i] == rank[first]), key=rows.member)
                fault = (len({content[i] for i in members} - {None}) > 1) + 2 * (len({text[i] for i in members} - {None}) > 1) + 4 * (len({event[i] for i in members}) < len(members))
            by_layer[v].append((rank[first], members, meaning, strength, n_context, first, fault))
        out = into()
        done = []
        for v in sorted(by_layer, reverse=True):
            own = by_layer[v]
            if len(own) > 1:
                own.sort(key=_rank_of)
                if any(x[0] == y[0] for x, y in zip(own, own[1:], strict=False)):  # one event of several meanings
                    own.sort(key=lambda x: (x[0], [event[i] for i in x[1]], _nulls_first(x[2])))
            done += own
            out.layers.append((place[v], v))
            out.event_ends.append(len(out.first) + len(done))
        out.layer_ends.append(len(out.layers))
        out.first += [x[5] for x in done]
        out.role += [x[3] for x in done]
        out.faults += [x[6] for x in done]
        out.n_context += (contexts := [x[4] for x in done])
        out.n_producers += (producers := [len(x[1]) for x in done])
        for _, members, _, strength, *_ in done:
            out.producers += members
            if strength:
                out.n_arcs.append(0)
            elif len(members) == 1 and len(sources[i := members[0]] or ()) == 1 and len(targets[i] or ()) == 1:
                out.arcs.append((sources[i][0], targets[i][0]))
                out.n_arcs.append(1)
            else:
                pairs = {(a, b) for i in members if sources[i] is not None and targets[i] is not None for a in sources[i] for b in targets[i]}
                out.arcs += pairs if len(pairs) < 2 else sorted(pairs, key=_nulls_first)
                out.n_arcs.append(len(pairs))
        n_producers, n_conflicts, attached = sum(producers), sum(len(CONFLICTS[x[6]]) for x in done if x[6]), sum(contexts)
        name = str(rows.graph[low])
        view = stable_id("view", name, nodes)
        out.records.append((low, view, stable_id("record", name, view), nodes, n_producers, n_conflicts, high - low, count["excluded"], count["context"] - attached, count["backbone"] - (n_producers - attached)))


def _made(table: pa.Table) -> Iterator[pa.RecordBatch]:
    rows = _Rows(table)
    codes = np.asarray(rows.column["graph"].dictionary_encode(null_encoding="encode").indices)
    bounds = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
    ready, result = [], _Result(rows)

    def into() -> _Result:
        nonlocal result
        if len(result.producers) >= BATCH_ROWS:
            ready.append(result.batch())
            result = _Result(rows)
        return result

    for low, high in zip(bounds, bounds[1:], strict=False):
        if rows.graph[low] is not None:
            _graph(rows, low, high, into)
            yield from ready
            ready.clear()
    if result.records:
        yield result.batch()


def made_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records, as result_schema has them, of a stream of events sorted by graph."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < BATCH_ROWS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        codes = np.asarray(table["graph"].combine_chunks().dictionary_encode(null_encoding="encode").indices)
        others = np.flatnonzero(codes != codes[-1])
        if len(others):  # the last graph may go on in the next batch
            cut = int(others[-1]) + 1
            yield from _made(table.slice(0, cut))
            table = table.slice(cut)
        held = table.to_batches()
    if held and sum(b.num_rows for b in held):
        yield from _made(pa.Table.from_batches(held))
