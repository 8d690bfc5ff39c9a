"""Packing by concatenate and cut.

Pass 1 encodes every document once (ids and an end id), and writes the ids with the running token count inside its
partition. The partition totals, one row a partition, are summed up to each partition's global start. Pass 2 adds the
start and cuts the stream at every multiple of the window, so that a document on a boundary gives a piece on each side.
Sequence n is the n-th window; only the last one can be short.

A document of any length is cut into as many pieces as it needs; no row moves between partitions, so no key is hot. Partition
ids and running counts are written with the ids by committed tasks, so repeated tasks cannot disagree with them.

Defined cases: null and empty texts still give the end id; repeated rows and null ids are packed like others; an empty table gives no
pieces; only the two named columns are read; texts of one white-space run or one word of many megabytes are encoded like others.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .store import sliced, tidy, written

WINDOW = 1024
LONG_SPACE = 10_000
_LONG_SPACE = regex.compile(rf"\s{{{LONG_SPACE},}}")
#: Partition totals (16 bytes each) up to this many are broadcast; more are joined by a shuffle.
BROADCAST_TOTALS = 1_000_000


class WholeEncoder:
    """Ids of whole texts (as ``bpe.ChunkedEncoder`` gives them) by a compiled library, one call a text.

    The library's pattern matcher fails on a run of about a million white-space characters, and only then; so long runs are cut out
    first, where the pattern ends a pre-token as well: all of a run but its last character, or all of it at the text's end, is one pre-token, as
    a pattern that matches everything has it."""

    def __init__(self, ranks: dict[bytes, int], special: dict[str, int]):
        import tiktoken

        encoder = lambda pattern: tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
        self.special, self.encode_text = special, encoder(bpe.PATTERN)
        self.single = lru_cache(1)(lambda: encoder("(?s:.+)"))
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        special = self.special
        if self.cut and any(s in text for s in special):
            return b"".join([np.array([special[p]], "<u4").tobytes() if p in special else self.plain(p) for p in self.cut.split(text)])
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        if len(text) < LONG_SPACE or not (found := list(_LONG_SPACE.finditer(text))):
            return self.piece(text)
        out, at = [], 0
        for m in found:
            end = m.end() if m.end() == len(text) else m.end() - 1
            out += [self.piece(text[at : m.start()]), self.single()(text[m.start() : end], disallowed_special=()).astype("<u4", copy=False).tobytes()]
            at = end
        return b"".join([*out, self.piece(text[at:])])

    def piece(self, text: str) -> bytes:
        return self.encode_text(text, disallowed_special=()).astype("<u4", copy=False).tobytes() if text else b""


@lru_cache(2)
def whole_encoder(path: str) -> WholeEncoder:
    v = bpe.vocabulary(path)
    return WholeEncoder({t: i for i, t in enumerate(v.table) if t is not None and i not in v.special.values()}, v.special)


@lru_cache(4)
def rank_encoder(path: str) -> WholeEncoder:
    """An encoder of a rank file (a base64 token and its rank a line), without special tokens."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    return WholeEncoder(ranks, {})


def tokenised(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Pass 1: doc_id, ids (little-endian unsigned 32-bit, with the end id), part, local_start."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("ids", T.BinaryType()), T.StructField("part", T.LongType()), T.StructField("local_start", T.LongType())])

    @tidy
    def run(batches):
        enc, end, part, at = whole_encoder(path).encode, np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0
        for b in sliced(batches):
            ids, starts = [], []
            for t in b.column(1):
                ids.append(enc(t.as_py()) + end)
                starts.append(at)
                at += len(ids[-1]) // 4
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array([part] * len(ids), pa.int64()), pa.array(starts, pa.int64())], names=["doc_id", "ids", "part", "local_start"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", broadcast_totals: int = BROADCAST_TOTALS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset."""
    rows = written(tokenised(docs, path, end_id, id_col, text_col), "packing-ids")
    totals = rows.groupBy("part").agg(F.max(F.col("local_start") + F.expr("octet_length(ids) div 4")).alias("total"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("total").over(upto), F.lit(0)).alias("part_start"))
    n = starts.count()
    placed = rows.join(F.broadcast(starts) if n <= broadcast_totals else starts, "part").select("doc_id", "ids", (F.col("part_start") + F.col("local_start")).alias("at"))
    schema = T.StructType([rows.schema["doc_id"]] + [T.StructField(n, t) for n, t in (("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()))])

    @tidy
    def cut(batches):
        for b in sliced(batches):
            sizes = pc.binary_length(b.column(1)).to_numpy().astype(np.int64) // 4
            at = b.column(2).to_numpy()
            first, last = at // window, (at + sizes - 1) // window
            pieces = last - first + 1
            row = np.repeat(np.arange(len(b)), pieces)
            seq = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces) + first[row]
            begin = np.maximum(seq * window, at[row])
            length = np.minimum((seq + 1) * window, (at + sizes)[row]) - begin
            start = begin - at[row]
            data = b.column(1).to_pylist()
            out = [data[r][s * 4 : (s + k) * 4] for r, s, k in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(out, pa.binary()), pa.array(sizes[row]), pa.array(seq), pa.array(begin - seq * window)], names=schema.names
            )

    return placed.mapInArrow(cut, schema)
