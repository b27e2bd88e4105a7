"""Byte-pair encoding of a whole corpus with a public tokenizer.

Prefix-sharing trie traversal.  The distinct words of a batch, in byte order,
are the paths of a trie; walking them in that order is its depth-first
traversal.  The state of a trie node is the last token of the encoding of its
prefix: the one token that ends there and fits the last token of the prefix
before it (two tokens fit if their joined bytes encode to just these two).  A
prefix shared by many words is computed once, and a word's encoding is read
back from its end, token by token.

Texts are cut into words by the tokenizer's public pattern; what a piece
between two single spaces encodes to does not depend on its surroundings, so
pieces met before are only looked up.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

#: The pre-tokenizing pattern of the public byte-level tokenizer, with its white
#: space spelled out (fixed value).
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: White space of two characters or more; a space in it does not part pieces.
_WIDE = re.compile(r"\s\s+")
#: Stands for such a space while a text is cut.
_HELD = "\ue000"
#: Most pieces, words and token pairs that a worker keeps; beyond it the memory starts anew.
CACHE_ITEMS = 400_000


def default_vocabulary() -> str:
    """Path of the public vocabulary byte_bpe_50k."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class TrieEncoder:
    """Encodes texts by last-token states over a trie of their distinct words."""

    def __init__(self, vocabulary: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.names = {i: t for t, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.pattern = regex.compile(PATTERN)
        self._fits: dict[tuple[int, int], bool] = {}
        self._words: dict[bytes, bytes] = {}
        self._pieces: dict[str, bytes] = {}
        self._after: dict[str, bytes] = {}

    def _merge(self, word: bytes) -> list[int]:
        """Merging by rank, the definition; used on two joined tokens only."""
        parts = [word[i : i + 1] for i in range(len(word))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _fit(self, a: int, b: int) -> bool:
        known = self._fits.get((a, b))
        if known is None:
            known = self._fits[(a, b)] = self._merge(self.names[a] + self.names[b]) == [a, b]
        return known

    def learn_words(self, words: set[bytes]) -> None:
        """Depth-first over the trie of ``words``; keeps the encoding of each."""
        ranks, names, longest = self.ranks, self.names, self.longest
        last: list[int] = [-1]  # last token of each prefix of the current path
        path = b""
        for word in sorted(words):
            shared = 0
            for x, y in zip(path, word):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :]
            for n in range(shared + 1, len(word) + 1):
                for size in range(min(n, longest), 0, -1):
                    token = ranks.get(word[n - size : n])
                    if token is not None and (size == n or self._fit(last[n - size], token)):
                        last.append(token)
                        break
            path = word
            ids, n = [], len(word)
            while n:
                ids.append(last[n])
                n -= len(names[last[n]])
            self._words[word] = np.array(ids[::-1], np.int32).tobytes()

    def _learn(self, texts: set[str]) -> None:
        """Encodings of pieces; each is kept under the piece itself."""
        if len(self._words) > CACHE_ITEMS:
            self._words.clear()
        if len(self._fits) > CACHE_ITEMS:
            self._fits.clear()
        cut = {p: [w.encode("utf-8", "replace") for w in self.pattern.findall(p.replace(_HELD, " "))] for p in texts}
        new = {w for ws in cut.values() for w in ws if w not in self._words}
        if new:
            self.learn_words(new)
        known = self._words
        for p, ws in cut.items():
            self._pieces[p] = b"".join([known[w] for w in ws])

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers; null gives none."""
        if len(self._pieces) > CACHE_ITEMS:
            self._pieces.clear()
            self._after.clear()
        cut: list[list[str]] = []
        heads: set[str] = set()
        tails: set[str] = set()
        for t in texts:
            t = t or ""
            if _HELD in t:
                parts = [t]  # holds the stand-in itself: encoded in one piece
            else:
                parts = _WIDE.sub(_hold, t).split(" ")
            heads.add(parts[0])
            tails.update(parts[1:])
            cut.append(parts)
        plain = {h for h in heads if _HELD in h and h in texts}
        tails.difference_update(self._after)
        self._learn(({" " + p for p in tails} | heads) - self._pieces.keys() - plain)
        for p in tails:
            self._after[p] = self._pieces[" " + p]
        get, out = self._after.__getitem__, []
        for parts in cut:
            head = self._whole(parts[0]) if parts[0] in plain else self._pieces[parts[0]]
            out.append(head + b"".join(map(get, parts[1:])))
        return out

    def _whole(self, text: str) -> bytes:
        words = [w.encode("utf-8", "replace") for w in self.pattern.findall(text)]
        self.learn_words({w for w in words if w not in self._words})
        return b"".join([self._words[w] for w in words])


def _hold(m: re.Match) -> str:
    return m.group().replace(" ", _HELD)


_ENCODERS: dict[int, TrieEncoder] = {}


def _encoder(vocabulary: bytes) -> TrieEncoder:
    key = hash(vocabulary)
    if key not in _ENCODERS:
        _ENCODERS[key] = TrieEncoder(vocabulary)
    return _ENCODERS[key]


def _slices(n: int, size: int = 256) -> Iterator[tuple[int, int]]:
    for a in range(0, n, size):
        yield a, min(size, n - a)


def _prepare(df: DataFrame, vocabulary_path: str | None):
    with open(vocabulary_path or default_vocabulary(), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file, under 2 MB


def encode(df: DataFrame, key: str, text: str, vocabulary_path: str | None = None) -> DataFrame:
    """``key, ids`` of every row: the token ids of its text, no special tokens.

    One row per input row, repeated ones too; a null or empty text gives an
    empty list, a null key stays null.  Texts are encoded whole.
    """
    shared = _prepare(df, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared.value)
        for batch in batches:
            for a, n in _slices(batch.num_rows):
                part = batch.slice(a, n)
                rows = enc.encode_batch(part.column(1).to_pylist())
                ends = np.cumsum([0, *[len(r) // 4 for r in rows]], dtype=np.int64).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(rows), np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["key", "ids"])

    schema = StructType([StructField("key", LongType()), StructField("ids", ArrayType(IntegerType()))])
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def count_tokens(df: DataFrame, keep: list[str], text: str, vocabulary_path: str | None = None) -> DataFrame:
    """The columns ``keep`` with ``n_tokens`` of the text of each row."""
    shared = _prepare(df, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared.value)
        for batch in batches:
            counts: list[int] = []
            for a, n in _slices(batch.num_rows):
                counts += [len(r) // 4 for r in enc.encode_batch(batch.slice(a, n).column(batch.num_columns - 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*keep, "n_tokens"])

    rows = df.select(*keep, F.col(text).alias("__text"))
    schema = StructType([*[rows.schema[c] for c in keep], StructField("n_tokens", LongType())])
    return rows.mapInArrow(run, schema)
