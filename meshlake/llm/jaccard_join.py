"""N-gram Jaccard self-join, size-aware: fixed-size subsets for small sets, inverted lists for large ones.

A document's set holds the 64-bit hashes of its distinct word n-grams. Documents of equal sets form a class; everything below is done
once a class. Two sets of sizes r and s are linked when 100 * overlap >= percent * union, that is, when they share at least
c(r, s) = ceil(percent * (r + s) / (100 + percent)) members, and 100 * min(r, s) >= percent * max(r, s).

* Light sets (up to the boundary): for each partner size s the set's c(r, s)-subsets are enumerated. Two light sets are linked exactly if they have such a
  subset in common, so no pair is verified, and a group of equal subsets is joined to its least members instead of pairwise.
* Heavy sets: inverted lists of prefixes. Members are ordered by an estimate of their document frequency (rare first; a count-min sketch of fixed size
  over all documents), and only as many of the first members are listed as any linked pair must have one in common. Light
  sets that can be linked to heavy ones are listed too. A pair is a candidate only if sizes and positions allow the overlap, and if the prefixes do, in which a link leaves
  more than one member in common (``promising``); what is left is verified on the whole sets.
* The boundary is the size at which enumerating costs less than listing, by the histogram of set sizes.

Only the components are asked for, so a list of k similar sets is not turned into k^2 pairs. First each list's sets are compared with one
pivot of the list: the one with the fewest rarer members, which is nearest to what the list has in common. That settles lists of two. In longer lists that are not connected
then, the sets outside the component of the member whose comparisons so far have been links most often are compared with that member; and what is still outside the list's
largest component with every member that is in another component: exact, and empty where the pivots have connected the list.

Lists are joined by token with pre-aggregated pivots; the pivots of long lists, whose number is bounded, are broadcast (see ``store.join_keyed``). Sets themselves are fetched only for candidates.
Class ids are 64-bit hashes of whole sets, members 64-bit hashes of n-grams.

Defined cases: null and empty texts, and texts without words, have the empty set, no links and their own id as component; texts of fewer words than n are
one n-gram; a null id takes no part in the smallest id, and is the component only of documents that no id reaches; repeated rows are
equal sets; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlake.operators.graph import star_components

from .store import discard, join_bounded, join_keyed, sliced, tidy, written

SKETCH_BITS = 21
SKETCH_PARTS, SKETCH_FAN = 8, 32
#: What a posting costs, in subsets: it is written, counted, joined, and may be verified.
POSTING_COST = 4
PIVOTS = 8
BROADCAST_IDS = 500_000
_LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE, _M1, _M2 = 0x9E3779B97F4A7C55 | 1, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
SLICE = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_M1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_M2)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of n-gram hashes of many texts at once. Words are hashed by prefix sums of a polynomial over the bytes."""

    def __init__(self, n: int):
        self.n, self.power, self.inverse = n, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _powers(self, size: int) -> None:
        if len(self.power) < size:
            size = max(size, SLICE)
            inverse = pow(_BASE, -1, 1 << 64)
            for name, base in (("power", _BASE), ("inverse", inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """Sorted distinct hashes of each text."""
        out: list[np.ndarray] = []
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) < SLICE):
                size += len(texts[j]) + 1
                j += 1
            out += self._sets(texts[i:j])
            i = j
        return out

    def _sets(self, texts: list[bytes]) -> list[np.ndarray]:
        joined = b" " + b" ".join(texts) + b" "
        data = np.frombuffer(joined.translate(_LOW), np.uint8)
        self._powers(len(data))
        space = _IS_SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        start, end = edge[0::2], edge[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=sums[1:])
        word = mixed((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        first = np.searchsorted(start, np.cumsum(sizes) - sizes + 1)
        last = np.r_[first[1:], len(start)]
        n = self.n
        gram = word[: max(0, len(word) - n + 1)].copy()
        for k in range(1, n):
            gram = mixed(gram * np.uint64(_BASE) + word[k : k + len(gram)])
        out = []
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            if b - a >= n:
                g = np.sort(gram[a : b - n + 1])
                out.append(g[np.r_[True, g[1:] != g[:-1]]])
            elif b > a:
                h = np.uint64(b - a) * np.ones(1, np.uint64)
                for w in word[a:b]:
                    h = mixed(h * np.uint64(_BASE) + w + np.uint64(1))
                out.append(h)
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def class_of(s: np.ndarray) -> int:
    """The class id of a set: a 64-bit hash of its sorted members; 0 for the empty set."""
    if not len(s):
        return 0
    at = np.arange(1, len(s) + 1, dtype=np.uint64) * np.uint64(_M2)
    total = mixed(np.add.reduce(mixed(s ^ np.uint64(_BASE)), keepdims=True)) ^ np.bitwise_xor.reduce(mixed(s + at), keepdims=True)
    return int(mixed(total).view(np.int64)[0]) or 1


def overlap(percent: int, r: int, s: int) -> int:
    return -(-percent * (r + s) // (100 + percent))


def partners(percent: int, r: int) -> range:
    """Sizes that sets of size r can be linked to."""
    return range(-(-percent * r // 100), 100 * r // percent + 1)


def prefix_length(percent: int, r: int) -> int:
    return r - overlap(percent, r, -(-percent * r // 100)) + 1


def prefix_of(s: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The listed members of a set, rare first, and their estimated frequencies."""
    weight = counts[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    order = np.lexsort((s, weight))[: prefix_length(percent, len(s))]
    return s[order], weight[order]


def headed_prefix(s: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    members, weight = prefix_of(s, counts, percent)
    return np.concatenate([np.array([len(s), weight[-1], members[-1]], np.uint64), np.sort(members)])


def _common(x: np.ndarray, y: np.ndarray) -> int:
    both = np.sort(np.concatenate([x, y]))
    return int((both[1:] == both[:-1]).sum())


def linked(percent: int, x: np.ndarray, y: np.ndarray) -> bool:
    common = _common(x, y)
    return 100 * common >= percent * (len(x) + len(y) - common)


def promising(percent: int, x: np.ndarray, y: np.ndarray) -> bool:
    """Whether headed prefixes allow a link. Where the one prefix ends first in the common order, its members that the other prefix lacks are nowhere in the other set."""
    (n, *end), (m, *other_end) = x[:3].tolist(), y[:3].tolist()
    left = n - (len(x) - 3) if end <= other_end else m - (len(y) - 3)
    return _common(x[3:], y[3:]) + left >= overlap(percent, n, m)


def sketch_of(shared) -> np.ndarray:
    return np.frombuffer(zlib.decompress(shared.value), np.uint32)


def subset_cost(percent: int, r: int, most: int) -> int:
    return sum(math.comb(r, overlap(percent, r, s)) for s in partners(percent, r) if s <= most)


def boundary(percent: int, histogram: dict[int, int]) -> int:
    """The largest size of light sets, at the least total cost. Sizes are tried until their subsets alone cost more than the best total."""
    listing = {r: c * POSTING_COST * prefix_length(percent, r) for r, c in histogram.items()}
    sizes = sorted(histogram)
    best, x = (sum(listing.values()), 0), 0
    while x < max(sizes, default=0):
        x += 1
        subsets = 0
        for r in sizes:
            if r > x or subsets > best[0]:
                break
            subsets += histogram[r] * subset_cost(percent, r, x)
        if subsets > best[0]:
            break
        best = min(best, (subsets + sum(c for r, c in listing.items() if r > x or 100 * r >= percent * (x + 1)), x))
    return best[1]


def _batches(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [t or b"" for t in batch.column(column).to_pylist()]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))


def sized_sets(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """id, size and class of every document; and, as rows with a part, the task's share of the frequency sketch."""
    id_type = docs.schema[id_col].dataType.simpleString()
    width = (1 << SKETCH_BITS) // SKETCH_PARTS

    @tidy
    def run(batches):
        shingler, sketch, arrow_id = Shingler(n), np.zeros(1 << SKETCH_BITS, np.uint32), None
        for b in sliced(batches):
            arrow_id, sets = b.column(0).type, shingler.sets(_batches(b, 1))
            for s in sets:
                # Members of one set that share a slot may count once: any order of the members is valid.
                sketch[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] += 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array([class_of(s) for s in sets], pa.int64()), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], names=["id", "n", "cls", "part", "counts"])
        if arrow_id is not None and sketch.any():
            blobs = [zlib.compress(sketch[i * width : (i + 1) * width].tobytes(), 1) for i in range(SKETCH_PARTS)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(blobs), arrow_id), pa.nulls(len(blobs), pa.int32()), pa.nulls(len(blobs), pa.int64()), pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(blobs, pa.binary())], names=["id", "n", "cls", "part", "counts"])

    return _texts(docs, id_col, text_col).mapInArrow(run, f"id {id_type}, n int, cls long, part int, counts binary")


def summed_sketch(rows: DataFrame) -> bytes:
    """The whole sketch: 2^SKETCH_BITS counters of 32 bits, whatever the size of the corpus. Summed in three levels: where the parts lie, in SKETCH_FAN
    groups of such tasks, and at last by part. A task holds SKETCH_PARTS sums at most."""

    @tidy
    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for part, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                counts = np.frombuffer(zlib.decompress(blob.as_buffer()), np.uint32).astype(np.uint64)
                total[part] = total[part] + counts if part in total else counts
        rows = sorted(total.items())
        data = [zlib.compress(np.minimum(c, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1) for _, c in rows]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array(data, pa.binary())], names=["part", "counts"])

    parts = rows.where("part IS NOT NULL").select("part", "counts").mapInArrow(add, "part int, counts binary")
    parts = parts.repartition("part", F.spark_partition_id() % SKETCH_FAN).mapInArrow(add, "part int, counts binary")
    parts = parts.repartition("part").mapInArrow(add, "part int, counts binary")
    found = {r.part: zlib.decompress(r.counts) for r in parts.collect()}
    empty = bytes(4 * (1 << SKETCH_BITS) // SKETCH_PARTS)
    return b"".join(found.get(p, empty) for p in range(SKETCH_PARTS))


def postings(docs: DataFrame, n: int, percent: int, light: int, shared, id_col: str, text_col: str) -> DataFrame:
    """token, cls, n, pos of listed prefix members (kind 0), and of light sets' subsets (kind 1, pos the partner size). Each class about once a task."""

    @tidy
    def run(batches):
        counts = sketch_of(shared)
        shingler, seen = Shingler(n), set()
        for b in sliced(batches):
            tokens, owners, sizes, places, kinds = [], [], [], [], []

            def put(values, cls, size, pos, kind):
                tokens.append(np.asarray(values, np.uint64))
                owners.append(np.full(len(values), cls, np.int64))
                sizes.append(np.full(len(values), size, np.int32))
                places.append(np.asarray(pos, np.int32) if kind == 0 else np.full(len(values), pos, np.int32))
                kinds.append(np.full(len(values), kind, np.int8))

            for s in shingler.sets(_batches(b, 1)):
                r = len(s)
                if not r or (cls := class_of(s)) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(cls)
                if r > light or 100 * r >= percent * (light + 1):
                    members, _ = prefix_of(s, counts, percent)
                    put(members, cls, r, np.arange(len(members)), 0)
                if r <= light:
                    for t in partners(percent, r):
                        if t <= light:
                            pick = np.array(list(combinations(range(r), overlap(percent, r, t))), np.int64)
                            key = np.full(len(pick), (min(r, t) << 16) + max(r, t), np.uint64)
                            for column in pick.T:
                                key = mixed(key * np.uint64(_BASE) + s[column])
                            put(key, cls, r, t, 1)
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places)), pa.array(np.concatenate(kinds))], names=["token", "cls", "n", "pos", "kind"]
                )

    return _texts(docs, id_col, text_col).mapInArrow(run, "token long, cls long, n int, pos int, kind byte")


def _light_links(rows: DataFrame) -> DataFrame:
    """u, v: every light set with the least set of the other size (of its own, for equal sizes) that has the same subset."""
    kept = rows.where("kind = 1").select("token", "cls", "n", F.col("pos").alias("s"))
    least = kept.groupBy("token", "n", "s").agg(F.min("cls").alias("other"))
    # A set of size r with subsets for partner size s meets sets of size s with subsets for partner size r.
    met = kept.alias("a").join(least.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.n") == F.col("b.s")) & (F.col("a.s") == F.col("b.n")))
    return met.select(F.col("a.cls").alias("u"), F.col("b.other").alias("v")).where("u <> v").distinct()


def _possible(percent: int, a: str, b: str) -> Column:
    """Sizes and positions (columns n and pos behind the prefixes) allow the overlap."""
    n1, n2, p1, p2 = (F.col(x) for x in (f"{a}n", f"{b}n", f"{a}pos", f"{b}pos"))
    needed = F.ceil(F.lit(percent) * (n1 + n2) / F.lit(100 + percent))
    return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent) & (F.least(n1 - p1, n2 - p2) >= needed)


def _pairs(df: DataFrame) -> DataFrame:
    return df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


class Join:
    """State of one run: class table, lists, verified links."""

    def __init__(self, docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, broadcast_ids: int):
        self.docs, self.n, self.percent, self.id_col, self.text_col, self.broadcast_ids = docs, n, percent, id_col, text_col, broadcast_ids
        rows = written(sized_sets(docs, n, id_col, text_col), "jaccard-sets")
        self.sets = rows.where("part IS NULL").select("id", "n", "cls")
        self.classes = written(self.sets.where("n > 0").groupBy("cls").agg(F.min("id").alias("rep"), F.max("n").alias("n")), "jaccard-classes")
        # One row for each size that occurs.
        sizes = {r.n: r["count"] for r in self.classes.groupBy("n").count().collect()}
        self.light = boundary(percent, sizes)
        sketch = summed_sketch(rows)
        self.sketch = docs.sparkSession.sparkContext.broadcast(zlib.compress(sketch, 1))
        self.rows = written(postings(docs, n, percent, self.light, self.sketch, id_col, text_col), "jaccard-postings")

    def fetched(self, pairs: DataFrame, whole: bool) -> DataFrame:
        """cls and members (binary) of the classes in ``pairs``, hash-partitioned by cls: the whole set in ascending order, or its size and the order key of its last
        prefix member (two numbers) before the prefix in ascending order."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(self.classes, "cls").select("cls", "rep")
        wanted = written(wanted, "jaccard-wanted")
        known, nameless = wanted.agg(F.count("rep"), F.count("*") - F.count("rep")).first()
        n, percent, shared = self.n, self.percent, self.sketch
        docs = _texts(self.docs, self.id_col, self.text_col)

        @tidy
        def run(batches):
            shingler, counts = Shingler(n), None if whole else sketch_of(shared)
            for b in sliced(batches):
                sets = shingler.sets(_batches(b, 1))
                own = [class_of(s) for s in sets]
                # Rows that repeat the id of another text are not what was asked for; rows without an id name their own class.
                keep = [i for i, (c, o) in enumerate(zip(b.column(0).to_pylist(), own, strict=True)) if c is None or c == o]
                data = [sets[i] if whole else headed_prefix(sets[i], counts, percent) for i in keep]
                yield pa.RecordBatch.from_arrays([pa.array([own[i] for i in keep], pa.int64()), pa.array([d.tobytes() for d in data], pa.binary())], names=["cls", "members"])

        schema = "cls long, members binary"
        named = join_bounded(docs, wanted.where("rep IS NOT NULL"), docs["id"] == wanted["rep"], "inner", known, self.broadcast_ids).select("cls", "text")
        out = named.mapInArrow(run, schema)
        if nameless:  # classes that only rows without an id have: those rows are read once and kept by their class
            rest = docs.where("id IS NULL").select(F.lit(None).cast("long").alias("cls"), "text").mapInArrow(run, schema)
            out = out.unionByName(join_bounded(rest, wanted.where("rep IS NULL").select("cls"), "cls", "left_semi", nameless, self.broadcast_ids))
        return out.dropDuplicates(["cls"])

    def compared(self, pairs: DataFrame, whole: bool) -> DataFrame:
        """a, b: the pairs that are linked, by their whole sets; or those that can be, by their prefixes. The sets are shuffled once, by class; both joins read them from there."""
        percent, sets, test = self.percent, self.fetched(pairs, whole), linked if whole else promising
        one = sets.select(F.col("cls").alias("a"), F.col("members").alias("x"))
        two = sets.select(F.col("cls").alias("b"), F.col("members").alias("y"))

        @tidy
        def run(batches):
            for batch in sliced(batches):
                keep = [test(percent, np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
                yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

        first = join_bounded(one, pairs.select("a", "b"), "a", "inner", pairs.count(), self.broadcast_ids)
        return first.join(two.hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """u, v: the pairs that are linked. Prefixes, a sixth of the sets, are compared first."""
        hopeful = written(self.compared(pairs, False), "jaccard-hopeful")
        return self.compared(hopeful, True).select(F.col("a").alias("u"), F.col("b").alias("v"))

    def labels(self) -> DataFrame:
        """cls, label: the component of every class that has a link."""
        percent = self.percent
        light = written(_light_links(self.rows), "jaccard-light")
        listed = self.rows.where("kind = 0").select("token", "cls", "n", "pos")
        # Lists of one set are most; they go before anything is joined.
        long = listed.groupBy("token").agg(F.count("*").alias("k")).where("k > 1")
        lists = written(listed.join(long, "token"), "jaccard-lists")
        discard(self.rows)
        total, size = lists.count(), F.max("k").alias("size")
        pivots = lists.groupBy("token").agg(F.min_by(F.struct("cls", "n", "pos"), F.struct("pos", F.xxhash64("cls", F.pmod("token", F.lit(PIVOTS))))).alias("p"), size)
        near = join_keyed(lists, written(pivots, "jaccard-pivots"), ["token"], "size", total).where(_possible(percent, "", "p."))
        tried = written(_pairs(near.select(F.col("cls").alias("a"), F.col("p.cls").alias("b"))), "jaccard-pairs")
        links = written(self.verified(tried).unionByName(light), "jaccard-links")
        labels = written(star_components(links).select(F.col("node").alias("cls"), "label"), "jaccard-labels")
        # Again with the member of the best record, for lists that are not connected yet; then all that is left. Lists of two are done.
        for by_record in (True, False):
            ends = lambda df, one, two, name: df.select(F.explode(F.array(one, two)).alias("cls")).groupBy("cls").agg(F.count("*").alias(name))
            record = ends(tried, "a", "b", "t").join(ends(links, "u", "v", "l"), "cls", "left").select("cls", ((F.coalesce("l", F.lit(0)) + 1) / (F.col("t") + 4)).alias("d"))
            marks = written(labels.join(record, "cls", "full"), "jaccard-marks")
            marked = join_bounded(lists.where("k > 2"), marks, "cls", "left", marks.count(), self.broadcast_ids)
            known = marked.select("token", "cls", "n", "pos", "k", F.coalesce("label", "cls").alias("label"), F.coalesce("d", F.lit(0.0)).alias("d"))
            member = F.struct("cls", "n", "pos", "label")
            if by_record:
                hubs = known.groupBy("token").agg(F.max_by(member, F.struct("d", F.xxhash64("cls"))).alias("p"), F.min("label").alias("lo"), F.max("label").alias("hi"), size).where("lo <> hi")
                met = join_keyed(known, written(hubs.drop("lo", "hi"), "jaccard-hubs"), ["token"], "size", total)
                found = met.where((F.col("label") != F.col("p.label")) & _possible(percent, "", "p.")).select(F.col("cls").alias("a"), F.col("p.cls").alias("b"))
            else:
                parts = known.groupBy("token", "label").agg(F.count("*").alias("m"), size)
                major = parts.groupBy("token").agg(F.max_by("label", F.struct("m", "label")).alias("major"), F.count("*").alias("labels"), F.max("size").alias("size")).where("labels > 1")
                open_lists = written(join_keyed(known, written(major, "jaccard-open"), ["token"], "size", total).select("token", "major", "cls", "n", "pos", "label"), "jaccard-members")
                x = open_lists.where("label <> major").select("token", member.alias("x"))
                y = open_lists.select("token", member.alias("y"))
                found = x.join(y, "token").where((F.col("x.label") != F.col("y.label")) & _possible(percent, "x.", "y.")).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"))
            new = written(_pairs(found).join(tried, ["a", "b"], "left_anti"), "jaccard-pairs")
            if new.isEmpty():
                continue
            tried = tried.unionByName(new)
            more = written(self.verified(new), "jaccard-links")
            if more.isEmpty():
                continue
            links = links.unionByName(more)
            stars = labels.where("cls <> label").select(F.col("cls").alias("u"), F.col("label").alias("v"))
            labels = written(star_components(stars.unionByName(more)).select(F.col("node").alias("cls"), "label"), "jaccard-labels")
        return labels


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """doc_id, n_shingles, class_id (null for empty sets) and component_id of every row."""
    join = Join(docs, n, percent, id_col, text_col, broadcast_ids)
    named = join.classes.join(join.labels(), "cls", "left").select("cls", "rep", F.coalesce("label", "cls").alias("label"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    classes = written(named.join(least, "label").select("cls", "component_id"), "jaccard-components")
    filled = join.sets.where("n > 0").join(classes, "cls").select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("cls").alias("class_id"), "component_id")
    empty = join.sets.where("n = 0").select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("class_id"), F.col("id").alias("component_id"))
    return filled.unionByName(empty)


def without_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """The rows, all columns, that have the smallest id of their component, or no id."""
    found = jaccard_components(docs, n, percent, id_col, text_col, broadcast_ids)
    dropped = written(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__dropped")).distinct(), "jaccard-dropped")
    return join_bounded(docs, dropped, docs[id_col] == dropped["__dropped"], "left_anti", dropped.count(), broadcast_ids)
