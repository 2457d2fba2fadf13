"""Greedy budget fill: take a record if it still fits, else skip it and go on."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def greedy_fill(rows: DataFrame, group: str, order: list[str], cost: str, budget: int) -> DataFrame:
    """rows with accepted and running (the budget used so far), per group in the given order.

    Whether a record is taken depends on every one before it, so a group is one ordered
    stream; groups are spread over tasks, a task streams its groups batch by batch and holds
    one number. Records whose cost is above the whole budget can never be taken.
    """
    at_group, at_cost = rows.columns.index(group), rows.columns.index(cost)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used = object(), 0
        for batch in batches:
            taken, upto = [], []
            for key, price in zip(batch.column(at_group).to_pylist(), batch.column(at_cost).to_pylist(), strict=True):
                if key != now:
                    now, used = key, 0
                fits = price is not None and used + price <= budget
                used += price if fits else 0
                taken.append(fits)
                upto.append(used)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(taken, pa.bool_()), pa.array(upto, pa.int64())], names=[*names, "accepted", "running"])

    names = rows.columns
    schema = ", ".join(f"`{k}` {t}" for k, t in rows.dtypes) + ", accepted boolean, running bigint"
    dealt = rows.repartition(F.col(group)).sortWithinPartitions(group, *order)
    return dealt.mapInArrow(run, schema)


def least_loaded(rows: DataFrame, group: str, order: list[str], options: str, labels: tuple) -> DataFrame:
    """rows with label: in order, each record of a group takes the least loaded of its options, ties by place in labels.

    A group is one ordered stream that holds a counter per label; without options the label is null.
    """
    at_group, at_options = rows.columns.index(group), rows.columns.index(options)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, load = object(), {}
        for batch in batches:
            found = []
            for key, own in zip(batch.column(at_group).to_pylist(), batch.column(at_options).to_pylist(), strict=True):
                if key != now:
                    now, load = key, dict.fromkeys(labels, 0)
                label = min(own, key=lambda o: (load[o], labels.index(o))) if own else None
                if label is not None:
                    load[label] += 1
                found.append(label)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*names, "label"])

    schema = ", ".join(f"`{k}` {t}" for k, t in rows.dtypes) + ", label string"
    return rows.repartition(F.col(group)).sortWithinPartitions(group, *order).mapInArrow(run, schema)
