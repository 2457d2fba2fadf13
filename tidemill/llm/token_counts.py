"""Unigram token counts by dynamic programming over a trie of distinct pre-tokens.

The best segmentation of a string under a unigram model is a forward recurrence over its
prefixes, so strings that share a prefix share its scores. The distinct pre-tokens of a
piece of text are walked in sorted order, which is the depth-first order of their trie: the
scores along the path to the current node are kept on a stack, only the part below the
common prefix with the string before is computed, and each terminal stores its count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import let_workers_import, text_chunks

#: Word start mark of the vocabulary.
MARK = "▁"
#: Score of a character outside the vocabulary below the lowest piece; it takes one token a byte.
UNKNOWN_MARGIN = 10.0
CACHE_WORDS = 200_000


class Unigram(NamedTuple):
    scores: dict[str, float]
    longest: int
    unknown: float


def load_unigram(path: str) -> Unigram:
    """Pieces and log-probabilities of a model file. A merge-ranked file has ranks in place
    of probabilities; its pieces get the logarithm of a Zipf law over the ranks."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    raw = [model.get_score(i) for i in ids]
    ranked = all(float(s).is_integer() for s in raw)
    total = math.log(sum(1 / (1 - s) for s in raw)) if ranked else 0.0
    scores = {model.id_to_piece(i): -math.log(1 - s) - total if ranked else s for i, s in zip(ids, raw, strict=True)}
    return Unigram(scores, max(map(len, scores)), min(scores.values()) - UNKNOWN_MARGIN)


def trie_counts(words: list[str], model: Unigram) -> dict[str, int]:
    """Tokens of the best segmentation of each distinct word; of equal scores the fewer tokens win."""
    scores, longest, unknown = model
    get = scores.get
    best, count = [0.0], [0]
    before, out = "", {}
    for word in sorted(set(words)):
        shared, most = 0, min(len(before), len(word))
        while shared < most and before[shared] == word[shared]:
            shared += 1
        del best[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            top, fewest = best[end - 1] + unknown, count[end - 1] + len(word[end - 1].encode())
            for begin in range(max(0, end - longest), end):
                s = get(word[begin:end])
                if s is not None:
                    s += best[begin]
                    if s > top or s == top and count[begin] + 1 < fewest:
                        top, fewest = s, count[begin] + 1
            best.append(top)
            count.append(fewest)
        out[word] = count[-1]
        before = word
    return out


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """Rows (doc_id, n_words, n_tokens) for every row of docs.

    Pre-tokens are the words [^\\x20\\x09-\\x0D]+ with the start mark before them. A null,
    empty or blank text has 0 words and 0 tokens. Repeated rows keep one result row each;
    other columns of docs are ignored; an empty table gives an empty result. The pieces
    (fixed by the model file) are broadcast.
    """
    spark = docs.sparkSession
    let_workers_import(spark)
    shared = spark.sparkContext.broadcast(tuple(load_unigram(model_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = Unigram(*shared.value), {}
        for batch in batches:
            n_words, n_tokens = [], []
            for lo, hi, raw, offsets in text_chunks(batch.column(1)):
                texts = [raw[offsets[i] : offsets[i + 1]].tobytes().split() for i in range(hi - lo)]
                new = {w for words in texts for w in words if w not in known}
                if len(known) + len(new) > CACHE_WORDS:
                    known.clear()
                    new = {w for words in texts for w in words}
                marked = {MARK + w.decode(): w for w in new}
                for word, n in trie_counts(list(marked), model).items():
                    known[marked[word]] = n
                n_words += map(len, texts)
                n_tokens += [sum(map(known.__getitem__, words)) for words in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(n_words, np.int64)), pa.array(np.array(n_tokens, np.int64))], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
