"""BPE encoding and decoding with forced boundaries.

A merge can only ever join two symbols whose touching characters stand next to each other
inside some vocabulary token. Where a pair of neighbouring byte characters stands inside no
token, no merge crosses, so the cut is certain: the fragments between such cuts are encoded
on their own and their ids concatenated, which gives the ids of the whole pre-token.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import let_workers_import

#: Most entries of a worker's word cache; a full cache is emptied, results don't depend on it.
CACHE_WORDS = 300_000
#: Fragments of more symbols than this are merged through a heap, in n log n; shorter ones are faster by scanning their ranks.
HEAP_SYMBOLS = 48
_NEVER = 1 << 60


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class _Cache(dict):
    """Results by word; emptied when full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str):
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = self.make(word)
        return found


class WordBpe:
    """Codec of a tokenizers file with word ends: NFC, lower case, white space dropped, byte-level symbols."""

    def __init__(self, content: str):
        spec = json.loads(content)
        library = Tokenizer.from_str(content)
        self.normalize, self.pre_split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.plain = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\r0-9a-z]+")
        self.common = re.compile("[\0-\u024f]*")
        self.characters = byte_characters()
        self.byte_of = {c: b for b, c in enumerate(self.characters)}
        self.inside = set()  # pairs of neighbouring characters inside any token
        for token in self.vocab:
            body = token[: -len(self.end)] if self.end and token.endswith(self.end) else token
            self.inside.update(zip(body, body[1:], strict=False))
        self.words, self.texts = _Cache(self.word), _Cache(lambda ids: self.decode(map(int, ids.split())))

    def fragments(self, word: str) -> list[list[str]]:
        """The symbols of a pre-token, cut wherever no token holds the two neighbours; the last has the word end."""
        chars = [self.characters[b] for b in word.encode()]
        cuts = [0, *(i for i in range(1, len(chars)) if (chars[i - 1], chars[i]) not in self.inside), len(chars)]
        chars[-1] += self.end
        return [chars[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def merged(self, symbols: list[str]) -> list[str]:
        """Merges by rank, leftmost first, until none applies; only the ranks beside a merge change."""
        if len(symbols) > HEAP_SYMBOLS:
            return self.merged_by_heap(symbols)
        get = self.ranks.get
        ranks = [get(pair, _NEVER) for pair in zip(symbols, symbols[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == _NEVER:
                break
            i = ranks.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((symbols[i - 1], symbols[i]), _NEVER)
            if i < len(ranks):
                ranks[i] = get((symbols[i], symbols[i + 1]), _NEVER)
        return symbols

    def merged_by_heap(self, symbols: list[str]) -> list[str]:
        """The same merges; an entry whose pair has changed since is passed over."""
        get, n = self.ranks.get, len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        now: list = [get(pair, _NEVER) for pair in zip(symbols, symbols[1:], strict=False)] + [_NEVER]
        heap = [(rank, i) for i, rank in enumerate(now) if rank != _NEVER]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if now[i] != rank:
                continue
            gone = after[i]
            symbols[i] += symbols[gone]
            symbols[gone], now[gone], after[i] = "", _NEVER, after[gone]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0:
                    now[left] = get((symbols[left], symbols[right]), _NEVER) if right < n else _NEVER
                    if now[left] != _NEVER:
                        heapq.heappush(heap, (now[left], left))
        return [s for s in symbols if s]

    def word(self, word: str) -> str:
        """Ids of a pre-token, joined by spaces."""
        return " ".join(str(self.vocab[t]) for part in self.fragments(word) for t in self.merged(part))

    def pre_tokens(self, text: str) -> list[str]:
        if text.isascii():
            return self.plain.findall(text.lower())
        if self.common.fullmatch(text):
            return self.pattern.findall(unicodedata.normalize("NFC", text).lower())
        # other scripts: which characters are letters or digits depends on the Unicode version, so the library says
        found = self.pre_split(self.normalize(text))
        return [bytes(self.byte_of[c] for c in word).decode() for word, _ in found]

    def encode(self, text: str) -> list[str]:
        """Ids of a text as decimals: for each pre-token one string, its ids joined by spaces."""
        if not (self.split_added and "<|" in text):
            known = self.words
            return [known[w] for w in self.pre_tokens(text)]
        found = []
        for part in self.split_added.split(text):
            found += [str(self.added[part])] if part in self.added else [self.words[w] for w in self.pre_tokens(part)]
        return found

    def decode(self, ids: Iterable[int]) -> str:
        """Without a decoder in the file, tokens are joined by spaces; ids outside the vocabulary are dropped."""
        return " ".join(self.token_of[i] for i in ids if i in self.token_of)

    def decode_parts(self, parts: list[str]) -> str:
        """decode() of the ids in strings as encode() gives them; equal strings are decoded once."""
        known = self.texts
        return " ".join(known[ids] for ids in parts)


_codecs: dict[str, WordBpe] = {}


def codec_of(content: str) -> WordBpe:
    """One codec per worker and vocabulary."""
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = WordBpe(content)
    return _codecs[key]


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids array, decoded string) for every row of docs.

    vocabulary is the path of a tokenizers file on the driver; its content (a few MB, fixed
    by the vocabulary) is broadcast. A null or empty text has no tokens and decodes to "".
    Repeated rows keep one result row each; other columns of docs are ignored; an empty
    table gives an empty result; ids never depend on other rows. decoded is made from the
    ids alone.
    """
    return _mapped(docs, vocabulary, "ids array<int>, decoded string")


def encode_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256): encode_documents with digests in place of ids and text."""
    return _mapped(docs, vocabulary, "ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids, ids_sha256, decoded_sha256): the ids of encode_documents, with both digests."""
    return _mapped(docs, vocabulary, "ids array<int>, ids_sha256 string, decoded_sha256 string")


def _mapped(docs: DataFrame, vocabulary: str, columns: str) -> DataFrame:
    spark = docs.sparkSession
    let_workers_import(spark)
    with open(vocabulary, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())
    names = ["doc_id", "n_tokens", *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                out: dict[str, list] = {name: [] for name in names[1:]}
                for text in part.column(1):
                    parts = codec.encode(text.as_py() or "")
                    ids = " ".join(parts)
                    out["n_tokens"].append(ids.count(" ") + 1 if ids else 0)
                    if "ids" in out:
                        out["ids"].append(np.fromstring(ids, np.int32, sep=" ") if ids else np.zeros(0, np.int32))
                    if "ids_sha256" in out:
                        out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                    decoded = codec.decode_parts(parts)
                    if "decoded" in out:
                        out["decoded"].append(decoded)
                    else:
                        out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, kinds.get(k, pa.string())) for k, v in out.items())], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, n_tokens long, {columns}")
