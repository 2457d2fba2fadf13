"""Harvests from JSON texts of any depth: keys, strings, ids, and the text of an object or scalar."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def nodes(value: object, sort_keys: bool = False) -> Iterator[tuple[str | None, object]]:
    """(key, node) of a parsed JSON value, parents first; a list item and the top have no key."""
    open_ = [(None, value)]
    while open_:
        key, node = open_.pop()
        yield key, node
        if isinstance(node, dict):
            open_ += reversed(sorted(node.items()) if sort_keys else list(node.items()))
        elif isinstance(node, list):
            open_ += [(None, item) for item in reversed(node)]


def _filled(value: object) -> list[str]:
    return [value.strip()] if isinstance(value, str) and value.strip() else []


def _harvest(column: Column, rule: Callable[[object], Iterable[str]]) -> Column:
    def own(text: str | None) -> list[str] | None:
        try:
            return list(rule(json.loads(text))) if text is not None else None
        except (ValueError, RecursionError):
            return None

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(own, na_action=None)

    return run(column)


def strings(column: Column) -> Column:
    """All strings of the JSON text, by sorted keys, list items as they stand; null where it is null or no JSON."""
    return _harvest(column, lambda top: (node for _, node in nodes(top, sort_keys=True) if isinstance(node, str)))


def keys_among(column: Column, wanted: Iterable[str]) -> Column:
    """The wanted keys, trimmed and without case, that occur at any depth, sorted; null where the text is null or no JSON."""
    names = frozenset(wanted)
    return _harvest(column, lambda top: sorted(names & {key.strip().casefold() for key, _ in nodes(top) if key is not None}))


def entity_ids(column: Column, name: str = "canonical_id", others: str = "aliases") -> Column:
    """Of every object its id and its further ids, trimmed, none blank, outer objects first; null where the text is null or no JSON."""

    def rule(top: object) -> Iterator[str]:
        for _, node in nodes(top):
            if isinstance(node, dict):
                yield from _filled(node.get(name))
                more = node.get(others)
                for item in more if isinstance(more, list) else []:
                    yield from _filled(item)

    return _harvest(column, rule)


def text_of(column: Column, field: str = "text") -> Column:
    """The field of a JSON object, or a JSON scalar as text; trimmed, null where blank, absent, JSON null or no JSON."""
    value = F.try_parse_json(column)
    kind = F.schema_of_variant(value)
    inner = F.try_variant_get(value, f"$.{field}", "string")
    found = F.when(kind.startswith("OBJECT"), inner).when(~kind.startswith("ARRAY"), F.try_variant_get(value, "$", "string"))
    return F.nullif(F.trim(found), F.lit(""))
