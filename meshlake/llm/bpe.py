"""Byte-level BPE: encoding by a priority queue of merge ranks, decoding by joining vocabulary strings.

A pre-token's bytes form a doubly linked list of symbols. A heap holds (merge rank, position) of adjacent pairs;
the least is taken, skipped if the pair at that position has changed meanwhile (a stale entry), and otherwise merged,
which queues the two new pairs. That is O(n log n) for a pre-token of any length.

Results of short pre-tokens and of the stretches between single spaces are kept in two dictionaries of bounded size
per Python worker. A text in which white space never comes in runs is split at spaces and line feeds, which is
where the pattern would split it as well; any other text goes through the pattern itself.

Defined cases: null and empty texts give no ids; the vocabulary's special strings in a text become their ids; ids out
of the vocabulary fail on decoding; invalid UTF-8 on decoding becomes U+FFFD; other columns pass through unless their name
is that of an output column, which replaces them.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .store import sliced, tidy

#: Fixed value: the pre-tokenizer pattern that the vocabulary file names.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORDS_KEPT, CHUNKS_KEPT, LONGEST_KEPT = 300_000, 200_000, 64
#: Links of longer pre-tokens are kept as machine integers.
LONG_WORD = 10_000
#: White space other than single spaces or line feeds between other characters. U+001C to U+001F are white space to Python only.
_ODD_SPACE = re.compile(r"\s\s|[^\S \n]|[\x1c-\x1f]")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable, else the next code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Token bytes, merge ranks and special strings of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.table: list[bytes | None] = [None] * size
        for token, i in ids.items():
            self.table[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            self.table[i] = token.encode()
        self.byte_ids = [0] * 256
        for c, b in alphabet.items():
            self.byte_ids[b] = ids[c]
        self.size = size
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for r, m in enumerate(model["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            self.rank[ids[left] * size + ids[right]] = r
            self.merged.append(ids[left + right])

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.byte_ids[b] for b in word]
        n, size, rank = len(ids), self.size, self.rank
        heap = [r * n + i for i in range(n - 1) if (r := rank.get(ids[i] * size + ids[i + 1])) is not None]
        if not heap:
            return ids
        heapq.heapify(heap)
        held = list if n < LONG_WORD else lambda r: array("q", r)
        before, after = held(range(-1, n - 1)), held(range(1, n + 1))
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            j = after[i]
            if ids[i] < 0 or j == n or rank.get(ids[i] * size + ids[j]) != r:
                continue  # stale
            ids[i], ids[j] = self.merged[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := rank.get(ids[i] * size + ids[k])) is not None:
                    heapq.heappush(heap, q * n + i)
            h = before[i]
            if h >= 0 and (q := rank.get(ids[h] * size + ids[i])) is not None:
                heapq.heappush(heap, q * n + h)
        return [x for x in ids if x >= 0]


class _Kept(dict):
    """A dictionary of bounded size that computes what it lacks."""

    def __init__(self, make, most: int):
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= LONGEST_KEPT:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class ChunkedEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers; ``word_ids`` encodes one pre-token."""

    def __init__(self, word_ids, special: dict[str, int]):
        find = regex.compile(PATTERN).findall
        self.words = words = _Kept(lambda w: np.array(word_ids(w), "<u4").tobytes(), WORDS_KEPT)
        self.heads = _Kept(lambda c: b"".join([words[w] for w in find(c)]), CHUNKS_KEPT)
        self.tails = _Kept(lambda c: b"".join([words[w] for w in find(" " + c)]), CHUNKS_KEPT)
        self.find, self.special = find, special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.cut and any(s in text for s in self.special):
            return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self.plain(p) for p in self.cut.split(text))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        if _ODD_SPACE.search(text):
            words = self.words
            return b"".join([words[w] for w in self.find(text)])
        heads, tails, out = self.heads, self.tails, []
        feed = b""
        for line in text.split("\n"):
            out.append(feed)
            feed = feed or self.words["\n"]
            chunks = line.split(" ")
            out.append(heads[chunks[0]])
            out += [tails[c] for c in chunks[1:]]
        return b"".join(out)


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(4)
def encoder(path: str) -> ChunkedEncoder:
    v = vocabulary(path)
    return ChunkedEncoder(lambda w: v.merge(w.encode("utf-8", "replace")), v.special)


def decode(path: str, ids: bytes | None) -> str:
    table = vocabulary(path).table
    return b"".join([table[i] for i in np.frombuffer(ids or b"", "<u4").tolist()]).decode("utf-8", "replace")


def _replacing(batch: pa.RecordBatch, new: dict[str, pa.Array], names: list[str]) -> pa.RecordBatch:
    at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)} | new
    return pa.RecordBatch.from_arrays([at[n] for n in names], names=names)


def _schema(df: DataFrame, *new: T.StructField) -> T.StructType:
    gone = {f.name for f in new}
    return T.StructType([f for f in df.schema.fields if f.name not in gone] + list(new))


def encode_column(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", count_col: str = "n_tokens") -> DataFrame:
    """``df`` without its text, with the ids (binary, little-endian unsigned 32-bit) and their number."""
    rest = df.drop(text_col).drop(ids_col, count_col)
    schema = _schema(rest, T.StructField(ids_col, T.BinaryType()), T.StructField(count_col, T.LongType()))
    names = schema.names
    source = df.select(*[c for c in rest.columns], df[text_col].alias("__text"))

    @tidy
    def run(batches):
        enc = encoder(path).encode
        for b in sliced(batches):
            ids = [enc(t.as_py()) for t in b.column(b.num_columns - 1)]
            yield _replacing(b, {ids_col: pa.array(ids, pa.binary()), count_col: pa.array([len(x) // 4 for x in ids], pa.int64())}, names)

    return source.mapInArrow(run, schema)


def decode_column(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``df`` with the text of its ids."""
    schema = _schema(df, T.StructField(text_col, T.StringType()))
    names = schema.names

    @tidy
    def run(batches):
        for b in sliced(batches):
            ids = b.column(b.schema.names.index(ids_col))
            yield _replacing(b, {text_col: pa.array([decode(path, x.as_py()) for x in ids], pa.string())}, names)

    return df.mapInArrow(run, schema)
