"""Suffix-array deduplication: every byte covered by a ``length``-byte string that also starts elsewhere is removed.

Sorting all suffixes of a corpus is narrowed to those that can matter. Each string of ``length`` bytes is assigned to an anchor inside it
(see ``anchors``); equal strings have anchors of equal bytes at equal distances. So only strings of anchors that occur twice are compared:

1. Anchor runs are computed where the documents lie; runs whose anchor hash occurs once end here (counts are pre-aggregated).
2. Runs that agree in both their hashes (of the anchor, and of all their bytes) form a class. Its first and last run stand for it, and classes that follow each other in
   the same two documents are one passage. The two texts of each passage are fetched and sorted deep-shallow; they repeat as a whole if the sort puts them side by side
   with all their bytes in common, and then so does every run of the passage's classes.
3. For classes that share an anchor and differ, the bytes of one run each are fetched, and split by the distance d of a string's start to its
   anchor into chunks; the strings of a chunk share a core of bytes, and only runs of equal cores meet in a task. There
   the suffixes that begin at the cores are sorted deep-shallow: multikey quicksort to ``SHALLOW`` bytes, then a blind trie for
   each group that still shares its prefix. Walking from a suffix along its neighbours with the least common prefix on the way, together with
   the common bytes left of the cores, gives exactly the strings that occur in another run.
4. A core that more than ``group`` runs share is not sorted in one task: its runs are split again into smaller chunks with longer cores,
   down to single strings, whose groups are counted and not compared.

Removal is judged on the input. Joins back to runs broadcast the hot anchors and runs, whose number is bounded (see ``store.join_keyed``). Grams and cores meet by 64-bit hashes,
sorted texts are compared by their bytes; a passage that the sort does not confirm (both hashes of different runs equal) fails the job. Rows are numbered once and written with their numbers, so that later passes agree on them whatever happens to executors.

Defined cases: null and empty texts, and texts under ``length`` bytes, keep all their bytes; overlapping repeats count, in one document as well;
repeated rows remove each other's repeated strings; null ids pass through; an empty table gives an empty result; other columns pass through only if named in ``carry``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .anchors import Anchors
from .jaccard_join import _BASE, mixed
from .store import discard, join_bounded, join_keyed, sliced, tidy, written

LENGTH, GRAM, SHALLOW, GROUP = 200, 80, 32, 1024
CHUNKS = (61, 16, 4, 1)
BROADCAST_REQUESTS = 1_000_000
BROADCAST_SPANS = 2_000_000
#: Texts of passages that are sorted at once.
TWIN_BYTES = 4 << 20


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    lo, hi = known, min(len(a), len(b))
    if a[lo:hi] == b[lo:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class BlindTrie:
    """Orders strings that share a long prefix. Inner nodes hold only the depth at which their strings differ and one branch a byte; a string walks down
    without being compared, is compared once with a leaf it reaches, and is inserted at the depth so found. The end of a string sorts before all bytes."""

    __slots__ = ("strings", "root")

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None

    def insert(self, i: int, known: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [i]
            return
        node = self.root
        while type(node) is tuple:
            depth, branches = node
            node = branches.get(s[depth] if depth < len(s) else -1) or next(iter(branches.values()))
        other = self.strings[node[0]]
        at = common_prefix(s, other, known)
        if at == len(s) == len(other):
            node.append(i)
            return
        above, key, node = None, -1, self.root
        while type(node) is tuple and node[0] < at:
            above, key = node, s[node[0]] if node[0] < len(s) else -1
            node = node[1][key]
        own = s[at] if at < len(s) else -1
        if type(node) is tuple and node[0] == at:
            node[1][own] = [i]
            return
        new = (at, {own: [i], (other[at] if at < len(other) else -1): node})
        if above is None:
            self.root = new
        else:
            above[1][key] = new

    def ordered(self) -> tuple[list[int], list[int]]:
        """Strings in order, and for each the bytes it shares with the one before (the first: 0)."""
        order: list[int] = []
        shared: list[int] = []
        todo: list[tuple[object, int]] = [(self.root, 0)] if self.root is not None else []
        while todo:
            node, depth = todo.pop()
            if type(node) is tuple:
                branches = sorted(node[1].items(), reverse=True)
                # The first branch keeps what the node shares with what stands before it.
                todo += [(b, node[0]) for _, b in branches[:-1]] + [(branches[-1][1], depth)]
            else:
                order += node
                shared += [depth] + [len(self.strings[node[0]])] * (len(node) - 1)
        return order, shared


def multikey_quicksort(strings: list[bytes], depth: int) -> list[list[int]]:
    """Groups of strings that agree in their first ``depth`` bytes, in order. Eight bytes are one character of the sort; each
    step sorts all open groups at once by (group, character) and opens the ties at the next character. ``depth`` is a multiple of eight."""
    group = np.zeros(len(strings), np.int64)
    order = np.arange(len(strings))
    for at in range(0, depth, 8):
        # A shorter string is padded; its length, up to nine, tells it from one with zero bytes.
        word = np.frombuffer(b"".join([s[at : at + 8].ljust(8, b"\0") for s in strings]), ">u8")
        held = np.array([min(9, max(0, len(s) - at)) for s in strings], np.int64)
        order = np.lexsort((held, word, group))
        g, w, h = group[order], word[order], held[order]
        new = np.r_[False, (g[1:] != g[:-1]) | (w[1:] != w[:-1]) | (h[1:] != h[:-1])]
        group = np.empty_like(group)
        group[order] = np.cumsum(new)
    cut = np.flatnonzero(np.diff(group[order])) + 1 if len(strings) else []
    return [x.tolist() for x in np.split(order, cut)] if len(strings) else []


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Order of the strings, and the bytes each shares with the one before it (counted exactly from ``shallow`` on, else as 0)."""
    order: list[int] = []
    shared: list[int] = []
    for tied in multikey_quicksort(strings, shallow):
        if len(tied) == 1:
            order += tied
            shared.append(0)
            continue
        trie = BlindTrie(strings)
        known = min(shallow, *(len(strings[i]) for i in tied))
        for i in tied:
            trie.insert(i, known)
        o, s = trie.ordered()
        order += o
        shared += s
    return order, shared


class Chunk:
    """Distances c * size .. c * size + size - 1 of string starts to their anchor, and the core that all such strings hold."""

    def __init__(self, c: int, size: int, length: int):
        self.low, self.high = c * size, c * size + size - 1
        self.core = length - size + 1  # bytes, from low bytes left of the anchor on


def key_of(gram: int, chunk: int, size: int, core: bytes) -> int:
    words = np.frombuffer(core.ljust(-(-len(core) // 8) * 8, b"\0"), "<u8")
    at = np.arange(1, len(words) + 1, dtype=np.uint64) * np.uint64(_BASE)
    start = np.array([gram & 0xFFFFFFFFFFFFFFFF, chunk << 20 | size], np.uint64)
    total = np.add.reduce(mixed(words * np.uint64(_BASE) + at), keepdims=True) + mixed(start[:1]) * np.uint64(3) + mixed(start[1:] + np.uint64(7))
    return int(mixed(total).view(np.int64)[0])


#: A run's strings with starts ``low`` to ``high`` bytes left of the anchor at byte ``anchor`` of row ``rid``; data are their bytes.
PIECES = "key long, gram long, chunk int, rid long, single boolean, anchor long, low int, high int, data binary"
FOUND = "rid long, first long, last long"


def _piece_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [x.split() for x in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def pieces_of(gram: int, rid: int, single: bool, anchor: int, low: int, high: int, data: bytes, size: int, length: int) -> list[tuple]:
    """The run's strings as rows of PIECES, a row for each chunk of ``size``. ``data`` begins ``high`` bytes left of the anchor."""
    out = []
    for c in range(low // size, high // size + 1):
        chunk = Chunk(c, size, length)
        lo, hi = max(low, chunk.low), min(high, chunk.high)
        own = data[high - hi : high - lo + length]
        # The core begins chunk.low bytes left of the anchor, hi - chunk.low bytes into the piece.
        core = own[hi - chunk.low : hi - chunk.low + chunk.core]
        out.append((key_of(gram, c, size, core), gram, c, rid, single, anchor, lo, hi, own))
    return out


def repeated(rows: list[tuple], size: int, length: int) -> Iterator[tuple[int, int, int]]:
    """rid, first and last start of the strings of single runs that another row of the group (equal key) holds too. Rows: (chunk, rid, single, anchor, low, high, data)."""
    chunk = Chunk(rows[0][0], size, length)
    # Left of the core, reversed, and from the core on.
    offset = [r[5] - chunk.low for r in rows]
    suffix = [r[6][o:] for r, o in zip(rows, offset, strict=True)]
    left = [r[6][:o][::-1] for r, o in zip(rows, offset, strict=True)]
    order, shared = deep_shallow(suffix, min(SHALLOW, chunk.core) // 8 * 8)
    n = len(order)
    for k, i in enumerate(order):
        _, rid, single, anchor, low, high, _ = rows[i]
        if not single:
            continue
        got = np.zeros(high - low + 1, bool)
        # A string that starts d bytes left of the anchor needs this many common bytes from the core on.
        least = length - (high - chunk.low)
        for step in (1, -1):
            common, j = len(suffix[i]), k
            while True:
                edge = j + 1 if step == 1 else j
                if not 0 < edge < n:
                    break
                common = min(common, shared[edge])
                j += step
                if common < least:
                    break
                other = order[j]
                d_low = max(low, rows[other][4], chunk.low + length - common)
                d_high = min(high, rows[other][5], chunk.low + common_prefix(left[i], left[other]))
                if d_low <= d_high:
                    got[d_low - low : d_high - low + 1] = True
                    if got.all():
                        break
            if got.all():
                break
        edges = np.flatnonzero(np.diff(np.r_[False, got, False]))
        for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True):
            yield rid, anchor - (low + b - 1), anchor - (low + a)


def numbered(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])


def anchor_runs(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """rid, start, count, back, gram, span of all runs."""

    @tidy
    def run(batches):
        anchors = Anchors(length, gram)
        for b in sliced(batches):
            r = anchors.runs(b.column(1).to_pylist())
            rid = b.column(0).to_numpy()[r["doc"]] if len(r["doc"]) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(r["start"]), pa.array(r["count"].astype(np.int32)), pa.array(r["back"].astype(np.int32)), pa.array(r["gram"].view(np.int64)), pa.array(r["span"].view(np.int64))], names=["rid", "start", "count", "back", "gram", "span"])

    return rows.select("rid", "text").mapInArrow(run, "rid long, start long, count int, back int, gram long, span long")


def _compared(rows: DataFrame, size: int, length: int) -> DataFrame:
    """FOUND of groups of equal keys, which stand together in sorted partitions."""

    @tidy
    def run(batches):
        key, group, found = None, [], []

        def close():
            if len(group) > 1 and any(r[2] for r in group):
                found.extend(repeated(group, size, length))
            group.clear()

        for b in batches:
            for k, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != key:
                    close()
                    key = k
                group.append(row)
            if found:
                yield _found(found)
                found = []
        close()
        yield _found(found)

    return rows.select("key", "chunk", "rid", "single", "anchor", "low", "high", "data").repartition("key").sortWithinPartitions("key").mapInArrow(run, FOUND)


def _found(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["rid", "first", "last"])


def _passages(classes: DataFrame) -> DataFrame:
    """rid, start, other, other_start, count, id: classes (with first run r and last run z) whose runs follow each other in the same two
    rows at the same distance, as one. A window holds what one pair of rows shares."""
    c = classes.select(F.col("r.rid").alias("rid"), F.col("r.start").alias("start"), F.col("r.count").cast("long").alias("count"), F.col("z.rid").alias("other"), (F.col("z.start") - F.col("r.start")).alias("shift"))
    w = Window.partitionBy("rid", "other", "shift").orderBy("start")
    follows = F.col("start") == F.lag(F.col("start") + F.col("count")).over(w)
    c = c.withColumn("begin", F.when(~F.coalesce(follows, F.lit(False)), F.col("start")))
    c = c.withColumn("begin", F.last("begin", ignorenulls=True).over(w))
    c = c.groupBy("rid", "other", "shift", "begin").agg(F.sum("count").alias("count"))
    return c.select("rid", F.col("begin").alias("start"), "other", (F.col("begin") + F.col("shift")).alias("other_start"), "count", F.monotonically_increasing_id().alias("id"))


def _equal_twins(rows: DataFrame) -> DataFrame:
    """n: how many keys have two texts that the deep-shallow sort finds equal. Texts of many keys are sorted at once; the two of a key stand together in sorted partitions."""

    @tidy
    def run(batches):
        keys, texts, size, equal = [], [], 0, 0

        def settle(ids: list[int], strings: list[bytes]) -> int:
            order, shared = deep_shallow(strings)
            group = np.empty(len(order), np.int64)
            new = [k == 0 or not shared[k] == len(strings[i]) == len(strings[order[k - 1]]) for k, i in enumerate(order)]
            group[order] = np.cumsum(new)
            at: dict[int, int] = {}
            return sum(at.setdefault(i, g) == g for i, g in zip(ids, group.tolist(), strict=True)) - len(at)

        for b in sliced(batches):
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if size > TWIN_BYTES and key != keys[-1]:
                    equal += settle(keys, texts)
                    keys, texts, size = [], [], 0
                keys.append(key)
                texts.append(text)
                size += len(text)
        equal += settle(keys, texts)
        yield pa.RecordBatch.from_arrays([pa.array([equal], pa.int64())], names=["n"])

    return rows.select("key", "data").repartition("key").sortWithinPartitions("key").mapInArrow(run, "n long")


def repeated_starts(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, chunks: tuple[int, ...] = CHUNKS, broadcast_requests: int = BROADCAST_REQUESTS) -> DataFrame:
    """rid, first, last: ranges of starts of strings that occur elsewhere too, for numbered rows."""
    runs = written(anchor_runs(rows, length, gram), "suffix-runs")
    twice = runs.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    twice = written(twice, "suffix-grams")
    shared = written(join_keyed(runs, twice, ["gram"], "n", runs.count()).drop("n"), "suffix-shared-runs")
    discard(runs)
    run = F.struct("rid", "start", "count", "back")
    classes = written(shared.groupBy("gram", "span").agg(F.count("*").alias("n"), F.min(run).alias("r"), F.max(run).alias("z")), "suffix-classes")
    whole = join_keyed(shared, classes.where("n > 1").select("gram", "span", "n"), ["gram", "span"], "n", shared.count())
    whole = whole.select("rid", F.col("start").alias("first"), (F.col("start") + F.col("count") - 1).alias("last"))
    passages = written(_passages(classes.where("n > 1")), "suffix-passages")
    twins = passages.select(F.explode(F.array(F.struct("rid", "start"), F.struct(F.col("other").alias("rid"), F.col("other_start").alias("start")))).alias("t"), "id", "count")
    twins = twins.select("t.rid", F.struct(F.col("id").alias("gram"), F.lit(True).alias("single"), "t.start", "count", F.lit(-1).alias("back")).alias("q"))
    mixed_grams = classes.groupBy("gram").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1 AND least = 1").select("gram", "k")
    asked = join_keyed(classes, mixed_grams, ["gram"], "k", classes.count())
    asked = asked.select(F.col("r.rid").alias("rid"), F.struct("gram", (F.col("n") == 1).alias("single"), "r.start", F.col("r.count").cast("long").alias("count"), "r.back").alias("q"))
    asked = written(asked.unionByName(twins).groupBy("rid").agg(F.collect_list("q").alias("q")), "suffix-requests")
    total = asked.agg(F.sum(F.size("q"))).first()[0] or 0
    fetched = join_bounded(rows.select("rid", "text"), asked, "rid", "inner", total, broadcast_requests)

    @tidy
    def fetch(batches):
        for b in sliced(batches):
            out = []
            for rid, text, asks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for q in asks:
                    start, count, back = q["start"], q["count"], q["back"]
                    data = text[start : start + count - 1 + length]
                    if back < 0:
                        out.append((q["gram"], q["gram"], -1, rid, True, start, 0, 0, data))
                    else:
                        out += pieces_of(q["gram"], rid, q["single"], start + back, back - count + 1, back, data, chunks[0], length)
            yield _piece_rows(out)

    pieces = written(fetched.mapInArrow(fetch, PIECES), "suffix-pieces")
    equal = _equal_twins(pieces.where("chunk = -1")).agg(F.sum("n")).first()[0] or 0
    if equal != passages.count():
        raise ValueError("two different passages share both 64-bit hashes of their runs")
    pieces = pieces.where("chunk >= 0")
    found = []
    for i, size in enumerate(chunks):
        counts = pieces.groupBy("key").agg(F.count("*").alias("n"), F.max("single").alias("any"))
        if size == 1:  # equal strings: nothing is left to compare
            counts = written(counts.where("n > 1"), "suffix-counts")
            same = join_keyed(pieces, counts.select("key", "n"), ["key"], "n", pieces.count()).where("single")
            found.append(same.select("rid", (F.col("anchor") - F.col("high")).alias("first"), (F.col("anchor") - F.col("low")).alias("last")))
            break
        hot = written(counts.where((F.col("n") > group) & F.col("any")).select("key"), "suffix-hot")
        n_hot = hot.count()
        alive = pieces.join(counts.where((F.col("n") > 1) & (F.col("n") <= group) & F.col("any")).select("key"), "key", "left_semi")
        found.append(written(_compared(alive, size, length), "suffix-found"))
        if not n_hot:
            break
        smaller = chunks[i + 1]

        @tidy
        def refine(batches, smaller=smaller):
            for b in batches:
                out = []
                for r in b.to_pylist():
                    out += pieces_of(r["gram"], r["rid"], r["single"], r["anchor"], r["low"], r["high"], r["data"], smaller, length)
                yield _piece_rows(out)

        pieces = written(join_bounded(pieces, hot, "key", "left_semi", n_hot, broadcast_requests).mapInArrow(refine, PIECES), "suffix-pieces")
    out = whole
    for f in found:
        out = out.unionByName(f)
    return out


def merged_spans(ranges: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal covered byte ranges [start, end) of ranges of starts."""
    spans: list[list[int]] = []
    for first, last in sorted(ranges):
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], last + length)
        else:
            spans.append([first, last + length])
    return [(a, b) for a, b in spans]


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), group: int = GROUP, chunks: tuple[int, ...] = CHUNKS, broadcast_spans: int = BROADCAST_SPANS) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte ranges, array of struct start, end), kept (the remaining bytes), and the carried columns of every row."""
    rows = written(numbered(docs, id_col, text_col, carry), "suffix-rows")
    starts = repeated_starts(rows, length, gram, group, chunks)
    gathered = starts.groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))

    @tidy
    def merge(batches):
        for b in batches:
            spans = [[x for s in merged_spans([(r["first"], r["last"]) for r in rs], length) for x in s] for rs in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(pa.int64()))], names=["rid", "ends"])

    # Runs follow each other, so a document has few spans however many runs repeat.
    ranges = written(gathered.mapInArrow(merge, "rid long, ends array<long>"), "suffix-spans")
    total = ranges.agg(F.sum(F.size("ends")) / 2).first()[0] or 0
    joined = join_bounded(rows, ranges, "rid", "left", total, broadcast_spans)
    carried = [f"c{i}" for i in range(len(carry))]
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    @tidy
    def cut(batches):
        for b in sliced(batches):
            names = b.schema.names
            texts = b.column(names.index("text")).to_pylist()
            spans, kept = [], []
            for t, r in zip(texts, b.column(names.index("ends")).to_pylist(), strict=True):
                s = list(zip((r or [])[0::2], (r or [])[1::2], strict=True))
                ends = [0, *(e for _, e in s)]
                spans.append([{"start": a, "end": e} for a, e in s])
                kept.append(b"".join(t[e:a] for e, a in zip(ends, [*(a for a, _ in s), len(t)], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [b.column(names.index("id")), pa.array([len(t) for t in texts], pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary()), *[b.column(names.index(c)) for c in carried]], names=["doc_id", "n_bytes", "spans", "kept", *carried]
            )

    kinds = dict(rows.dtypes)
    schema = ", ".join([f"doc_id {kinds['id']}", "n_bytes long", "spans array<struct<start long, end long>>", "kept binary", *[f"{c} {kinds[c]}" for c in carried]])
    out = joined.select("id", "text", "ends", *carried).mapInArrow(cut, schema)
    return out.select("doc_id", "n_bytes", "spans", "kept", *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])


def with_kept_text(left: DataFrame) -> DataFrame:
    """``left`` (of ``remove_repeats``) with the remaining bytes as text; the loose bytes of characters that a span cuts through are left out."""
    names = [c for c in left.columns if c not in ("kept", "spans", "n_bytes")]
    schema = left.select(*names).withColumn("text", F.lit("")).schema

    @tidy
    def run(batches):
        for b in sliced(batches):
            text = pa.array([k.decode("utf-8", "ignore") for k in b.column(b.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], text], names=[*names, "text"])

    return left.select(*names, "kept").mapInArrow(run, schema)
