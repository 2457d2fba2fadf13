"""Scores of a predicted continuation against the true one: sets, multisets and order of events, as folds inside a row.

An event is a struct (step, source, relation, target, mediators): step a number, source, target
and mediators arrays of strings. Neighbouring events of one step are a layer, which is compared
as a multiset; layers and events are compared in order by their longest common subsequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAYER_SCORES = ("next_layer_exact", "next_layer_f1", "next_source_f1", "next_relation_f1", "next_target_f1", "event_precision", "event_recall", "event_f1", "source_f1", "relation_f1", "target_f1", "layer_precision", "layer_recall", "layer_f1", "layer_sequence_exact")
ORDER_SCORES = ("next_event_exact", "ordered_event_precision", "ordered_event_recall", "ordered_event_f1", "event_sequence_exact")


def event_key(event: Column) -> Column:
    """What makes two events the same: source, relation, mediators and target, not the step."""
    part = lambda column: F.array_join(column, "\x1e")
    return F.concat_ws("\x1f", part(event["source"]), event["relation"], part(F.coalesce(event["mediators"], F.array().cast("array<string>"))), part(event["target"]))


def layers_of(events: Column) -> Column:
    """The events as an array of layers: a layer begins where the step differs from that of the event before."""
    begins = F.filter(F.transform(events, lambda e, i: F.when((i == 0) | ~e["step"].eqNullSafe(F.get(events, i - 1)["step"]), i)), lambda i: i.isNotNull())
    return F.transform(begins, lambda b, k: F.slice(events, b + 1, F.coalesce(F.get(begins, k + 1), F.size(events)) - b))


def multiset_overlap(a: Column, b: Column) -> Column:
    count = lambda where, x: F.size(F.filter(where, lambda y: y == x))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays of strings, a row of the table at a time."""
    start = F.transform(F.concat(F.array(F.lit("")), b), lambda _: F.lit(0))

    def next_row(row: Column, x: Column) -> Column:
        return F.aggregate(
            F.transform(b, lambda y, j: F.struct(y.alias("y"), j.alias("j"))), F.array(F.lit(0)),
            lambda new, cell: F.concat(new, F.array(F.when(cell["y"] == x, F.get(row, cell["j"]) + 1).otherwise(F.greatest(F.get(row, cell["j"] + 1), F.element_at(new, -1))))),
        )

    return F.element_at(F.aggregate(a, start, next_row), -1)


def _rates(overlap: Column, predicted: Column, true: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; of an empty side 1 where the other is empty too, else 0."""
    share = lambda n, other: F.when(n > 0, overlap / n).otherwise(F.when(other == 0, 1.0).otherwise(0.0))
    precision, recall = share(predicted, true), share(true, predicted)
    return precision, recall, F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def _multiset(a: Column, b: Column) -> tuple[Column, Column, Column]:
    return _rates(multiset_overlap(a, b), F.size(a), F.size(b))


def _set_f1(a: Column, b: Column) -> Column:
    a, b = F.array_distinct(a), F.array_distinct(b)
    return _rates(F.size(F.array_intersect(a, b)), F.size(a), F.size(b))[2]


def score_continuations(rows: DataFrame, predicted: str, true: str, ordered: bool = True) -> DataFrame:
    """rows with LAYER_SCORES and, where the order inside a layer counts too (ordered), ORDER_SCORES.

    A null side counts as without events; scores of the next layer or event are 0 where a side has
    none. Repeated rows are scored alike and all columns stay.
    """
    empty = lambda c: F.coalesce(F.col(c), F.filter(F.col(c), lambda _: F.lit(False)), F.expr("CAST(array() AS ARRAY<STRUCT<step BIGINT, source ARRAY<STRING>, relation STRING, target ARRAY<STRING>, mediators ARRAY<STRING>>>)"))
    sided = rows
    for side, column in (("p", predicted), ("t", true)):
        sided = sided.withColumn(f"_{side}", empty(column)).withColumn(f"_{side}l", layers_of(F.col(f"_{side}")))
        sided = sided.withColumn(f"_{side}k", F.transform(f"_{side}", event_key)).withColumn(f"_{side}lk", F.transform(f"_{side}l", lambda layer: F.array_join(F.array_sort(F.transform(layer, event_key)), "\x1d")))
        sided = sided.withColumn(f"_{side}1", F.get(F.col(f"_{side}l"), F.lit(0)))
    column = lambda name: (F.col(f"_p{name}"), F.col(f"_t{name}"))
    both = lambda f, name="": tuple(map(f, column(name)))
    of = lambda part: lambda events: F.transform(events, lambda e: e[part])
    union = lambda part: lambda events: F.flatten(F.transform(events, lambda e: e[part]))
    some = (F.size("_pl") > 0) & (F.size("_tl") > 0)
    first = lambda value: F.when(some, value).otherwise(0.0)
    same = lambda a, b: F.when(a == b, 1.0).otherwise(0.0)
    event, layer = _multiset(*column("k")), _rates(common_subsequence(*column("lk")), F.size("_pl"), F.size("_tl"))
    values = [
        first(same(F.get("_plk", F.lit(0)), F.get("_tlk", F.lit(0)))), first(_multiset(*both(lambda x: F.transform(x, event_key), "1"))[2]), first(_set_f1(*both(union("source"), "1"))), first(_multiset(*both(of("relation"), "1"))[2]),
        first(_set_f1(*both(union("target"), "1"))), *event, _set_f1(*both(union("source"))), _multiset(*both(of("relation")))[2], _set_f1(*both(union("target"))), *layer, same(*column("lk")),
    ]
    names = LAYER_SCORES
    if ordered:
        names += ORDER_SCORES
        values += [first(same(F.get("_pk", F.lit(0)), F.get("_tk", F.lit(0)))), *_rates(common_subsequence(*column("k")), F.size("_p"), F.size("_t")), same(*column("k"))]
    return sided.select(*(F.col(f"`{c}`") for c in rows.columns), *(v.cast("double").alias(n) for n, v in zip(names, values, strict=True)))
