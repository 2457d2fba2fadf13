"""Sentence splitter: stops that end a sentence, not those of numbers, names and abbreviations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Abbreviations whose stop ends no sentence.
ABBREVIATIONS = frozenset("approx. ca. cf. dept. dr. e.g. eq. etc. fig. hr. i.e. inc. max. min. mol. mr. mrs. ms. no. prof. ref. sec. st. vol. vs. wt.".split())

#: A run of stops with the closing marks after it, before a space or the end.
_STOP = regex.compile(r"(?P<stops>[.!?]+)[\"'\u2019\u201d)\]}]*(?=\s|$)")
_OPENING = regex.compile(r"[\s(\[{\"'\u2018\u201c]")
_LETTERS = regex.compile(r"(?:[A-Za-z]\.){2,}")
_NEXT_WORD = regex.compile(r"[A-Za-z]+")


def _inside_sentence(text: str, begin: int, end: int) -> bool:
    """Whether the stops text[begin:end] belong to an abbreviation, a row of initials or the initial of a name."""
    if text[begin:end].strip("."):
        return False
    first = begin
    while first and not _OPENING.match(text[first - 1]):
        first -= 1
    token = text[first:end]
    if token.casefold() in ABBREVIATIONS or _LETTERS.fullmatch(token):
        return True
    if len(token) == 2 and token[0].isalpha():
        word = _NEXT_WORD.search(text, end)
        return bool(word) and word[0][0].islower()
    return False


def sentences_of(text: str | None) -> list[str]:
    """White space collapsed; cut after runs of stops and closing marks before a space or the end."""
    text = " ".join((text or "").split())
    out, begin = [], 0
    for stop in _STOP.finditer(text):
        if not _inside_sentence(text, stop.start(), stop.end("stops")):
            out.append(text[begin : stop.end()].strip())
            begin = stop.end()
    out.append(text[begin:].strip())
    return [s for s in out if s]


def split_sentences(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per sentence: the keys, index from 0 and sentence; texts without any give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, index, found = [], [], []
            for i, value in enumerate(batch.column(len(keys)).to_pylist()):
                own = sentences_of(value)
                at += [i] * len(own)
                index += range(len(own))
                found += own
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns[: len(keys)]), pa.array(index, pa.int64()), pa.array(found, pa.string())], names=[*keys, "index", "sentence"])

    kinds = dict(rows.dtypes)
    return rows.select(*keys, text).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", `index` bigint, sentence string")
