"""Approximate nearest neighbours by collision counting on single projections.

Largest inner products are turned into least distances: in a block of vectors each is divided by the block's largest norm and gets one more component
that makes it a unit vector; a query is normalised and gets a zero. Each of ``projections`` Gaussian directions gives one number a vector.

Index: a task takes ``block * fan`` rows at a time, orders them by norm and cuts them into even blocks of at most ``block`` rows; so the norms in a block are alike. A block holds, for each
direction, the numbers of its rows in order, and each row's rank among them. Every row is indexed; only the directions (by seed) and the dimension are shared by all blocks.

Search: a query opens a window around its own number in each sorted array. A row whose rank lies inside the window collides. Windows widen by the factor
``widen`` (virtual rehashing: a wider window is the same array read further to either side).

1. Unless blocks before have answered the query, its windows widen until ``2 k`` rows collide in at least ``share`` of the directions. These are verified by the inner product of
   the original vectors in double precision.
2. The k-th best score so far says how near a row must be to matter. A block whose largest norm does not reach it is left out: no row of it can. Otherwise
   the windows are set to that distance, at which a row collides in a known share p of the directions on average, and every row is verified that
   collides in at least p less ``slack`` standard deviations of them. A row at that very distance is missed with the probability of a normal deviate below -slack (7 per cent for 1.5), a nearer
   one with a smaller one, whatever the vectors are; what varies with them is how many rows are verified.

Each block gives its best k, which are merged by a ranked window whose limit is applied before the shuffle.

Queries and rows meet block by block: the query blocks are dealt to groups of ``fan`` row blocks (fewer where there would be fewer groups than cores) by an equi-join, so a
task holds some blocks, never a whole side, and no side is broadcast. That is the stated query set against all rows, in blocks; how rows fall into blocks only changes
which candidates are verified.

Defined cases: null or zero vectors, those with null or non-finite components and those of another dimension than the most frequent
(the larger on ties) take no part, nor do rows with a null id; fewer candidates than k give fewer rows; ties go to the smaller id; a row whose id equals the query's is
the query's own and is left out; rows that repeat an id are all candidates of other queries, and a repeated query is answered once, for the least of its vectors;
empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import tidy, written

PROJECTIONS, BLOCK, FAN, QUERY_BLOCK = 128, 8192, 4, 1024
SHARE, SLACK, FIRST_WINDOW, WIDEN, SEED = 0.5, 1.5, 0.5, 1.25, 11
#: Query blocks whose best scores so far a task remembers.
REMEMBERED = 256
BLOCKS = "block long, largest double, ids binary, vectors binary, sorted binary, ranks binary"


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and v (array<double>) of the vectors that take part, but for their dimension."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def directions(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim + 1, count))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def indexed(rows: DataFrame, dim: int, projections: int = PROJECTIONS, block: int = BLOCK, fan: int = FAN, seed: int = SEED) -> DataFrame:
    """Blocks (columns BLOCKS) of the rows where they lie."""

    @tidy
    def run(batches):
        from pyspark import TaskContext

        a, part, n = directions(dim, projections, seed), TaskContext.get().partitionId(), 0

        def flush(kept):
            nonlocal n
            ids, x = np.concatenate([c.column(0).to_numpy() for c in kept]).astype("<i8"), np.concatenate([_matrix(c.column(1), dim) for c in kept])
            norms = np.sqrt((x * x).sum(1))
            by_norm = np.argsort(-norms, kind="stable")
            for pick in np.array_split(by_norm, -(-len(by_norm) // block)):
                largest = norms[pick[0]]
                unit = x[pick] / largest
                unit = np.c_[unit, np.sqrt(np.maximum(0, 1 - (unit * unit).sum(1)))]
                values = (unit @ a).astype("<f4")
                order = np.argsort(values, axis=0, kind="stable")
                data = (ids[pick], x[pick].astype("<f8"), np.take_along_axis(values, order, 0).T, np.argsort(order, axis=0).T.astype("<u2" if block < 1 << 16 else "<u4"))
                arrays = [pa.array([part << 32 | n], pa.int64()), pa.array([float(largest)])] + [pa.array([np.ascontiguousarray(d).tobytes()], pa.binary()) for d in data]
                n += 1
                yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in BLOCKS.split(", ")])

        kept: list[pa.RecordBatch] = []
        held = 0
        for b in batches:
            while len(b):
                piece = b.slice(0, block * fan - held)
                b = b.slice(len(piece))
                kept.append(piece)
                held += len(piece)
                if held == block * fan:
                    yield from flush(kept)
                    kept, held = [], 0
        if held:
            yield from flush(kept)

    return rows.select("id", "v").mapInArrow(run, BLOCKS)


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, best first, ties to smaller ids."""
    if len(score) > k:
        pick = np.flatnonzero(score >= np.partition(score, -k)[-k])
        return pick[np.lexsort((ids[pick], -score[pick]))[:k]]
    return np.lexsort((ids, -score))


class BlockIndex:
    """One block's sorted arrays, and the rank of each row in each of them."""

    def __init__(self, largest: float, ids: bytes, vectors: bytes, values: bytes, ranks: bytes, dim: int, count: int):
        self.largest, self.ids, self.x = largest, np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<f8").reshape(-1, dim)
        self.values = np.frombuffer(values, "<f4").reshape(count, -1)
        self.ranks = np.frombuffer(ranks, "<u2" if len(ranks) // 2 == self.values.size else "<u4").reshape(count, -1)
        self.verified = 0

    def windows(self, at: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First rank and number of ranks of the windows of each query (rows of ``at``) in each array."""
        ends = [(np.searchsorted(v, c - width, "left"), np.searchsorted(v, c + width, "right")) for v, c in zip(self.values, at.T, strict=True)]
        lo, hi = (np.stack([e[i] for e in ends], 1) for i in (0, 1))
        return lo, hi - lo

    def collisions(self, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
        """In how many of one query's windows each row is."""
        kind = self.ranks.dtype
        # Below the window the difference wraps around to a large number.
        inside = (self.ranks - lo.astype(kind)[:, None]) < np.minimum(size, np.iinfo(kind).max).astype(kind)[:, None]
        return np.add.reduce(inside.view(np.uint8), 0, np.uint16)

    def best(self, rows: np.ndarray, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        rows = rows[self.ids[rows] != query_id]
        self.verified += len(rows)
        score = self.x[rows] @ q
        pick = best_of(score, self.ids[rows], k)
        return self.ids[rows[pick]], score[pick]

    def search(self, query_ids: np.ndarray, q: np.ndarray, a: np.ndarray, k: int, best: np.ndarray, share: float = SHARE, slack: float = SLACK, first: float = FIRST_WINDOW, widen: float = WIDEN):
        """For each query that this block can better: its number, and ids and exact inner products of its best k candidates here. ``best`` holds the k-th best score of
        each query so far (-inf if unknown) and is raised in place."""
        n, count = len(self.ids), len(self.values)
        length = np.sqrt((q * q).sum(1))
        at = (q / length[:, None]) @ a[:-1]
        asked = np.flatnonzero(self.largest * length >= best)
        open_, width, least = asked[np.isinf(best[asked])], first, math.ceil(share * count)
        while len(open_):
            lo, size = self.windows(at[open_], width)
            left = []
            for i, w_lo, w_size in zip(open_.tolist(), lo, size, strict=True):
                found = np.flatnonzero(self.collisions(w_lo, w_size) >= least)
                if len(found) < min(n, 2 * k + 1):
                    left.append(i)
                    continue
                _, score = self.best(found, query_ids[i], q[i], k)
                if len(score) == k:
                    best[i] = max(best[i], score[-1])
            open_, width = np.array(left, np.int64), width * widen
        # Distance of a row with the k-th best score and the block's largest norm; rounding is on the safe side.
        known = np.where(np.isfinite(best[asked]), best[asked], 0.0)
        reach = np.sqrt(np.maximum(1e-6, 2 - 2 * known / (self.largest * length[asked]))) * (1 + 1e-5)
        lo, size = self.windows(at[asked], reach)
        p = math.erf(1 / math.sqrt(2))
        enough = max(0, math.floor(count * p - slack * math.sqrt(count * p * (1 - p))))
        for i, w_lo, w_size in zip(asked.tolist(), lo, size, strict=True):
            # With fewer than k candidates so far every row matters.
            rows = np.flatnonzero(self.collisions(w_lo, w_size) >= enough) if np.isfinite(best[i]) else np.arange(n)
            ids, score = self.best(rows, query_ids[i], q[i], k)
            if len(score) == k:
                best[i] = max(best[i], score[-1])
            yield i, ids, score


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", projections: int = PROJECTIONS, block: int = BLOCK, fan: int = FAN, query_block: int = QUERY_BLOCK,
    share: float = SHARE, slack: float = SLACK, first: float = FIRST_WINDOW, widen: float = WIDEN, seed: int = SEED,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row with ``is_query`` (a condition on the column id) the k nearest rows found."""
    rows = usable(vectors, id_col, vec_col)
    shape = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if shape is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = shape.dim
    rows = rows.where(F.size("v") == dim)
    blocks = written(indexed(rows, dim, projections, block, fan, seed), "ann-index")
    # Of rows that repeat a query's id, that with the least vector asks.
    asked = rows.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    parts = max(1, -(-asked.count() // query_block))

    @tidy
    def gather(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            for i in range(0, len(b), query_block):
                c = b.slice(i, query_block)
                data = (c.column(0).to_numpy().astype("<i8"), _matrix(c.column(1), dim).astype("<f8"))
                yield pa.RecordBatch.from_arrays([pa.array([part << 32 | n], pa.int64())] + [pa.array([d.tobytes()], pa.binary()) for d in data], names=["query_block", "query_ids", "queries"])
                n += 1

    queries = written(asked.repartition(parts).mapInArrow(gather, "query_block long, query_ids binary, queries binary"), "ann-queries")
    n_blocks = blocks.count()
    groups = max(-(-n_blocks // fan), min(n_blocks, vectors.sparkSession.sparkContext.defaultParallelism))
    number = F.shiftright("block", 32) + F.col("block").bitwiseAND(F.lit((1 << 32) - 1))
    pairs = blocks.withColumn("group", F.pmod(number, F.lit(groups))).join(_dealt(queries, groups), "group")

    @tidy
    def run(batches):
        a, known = directions(dim, projections, seed), OrderedDict()
        for b in batches:
            for _, largest, ids, x, values, order, number, query_ids, q in zip(*(b.column(n) for n in ("block", "largest", "ids", "vectors", "sorted", "ranks", "query_block", "query_ids", "queries")), strict=True):
                index = BlockIndex(largest.as_py(), *(v.as_buffer() for v in (ids, x, values, order)), dim, projections)
                qid = np.frombuffer(query_ids.as_buffer(), "<i8")
                best = known.setdefault(number.as_py(), np.full(len(qid), -np.inf))
                known.move_to_end(number.as_py())
                if len(known) > REMEMBERED:
                    known.popitem(last=False)
                found = list(index.search(qid, np.frombuffer(q.as_buffer(), "<f8").reshape(-1, dim), a, k, best, share, slack, first, widen))
                if found:
                    sizes = [len(f[1]) for f in found]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(qid[[f[0] for f in found]], sizes)), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))], names=["query_id", "vec_id", "score"]
                    )

    best = pairs.select("block", "largest", "ids", "vectors", "sorted", "ranks", "query_block", "query_ids", "queries").mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _dealt(queries: DataFrame, groups: int) -> DataFrame:
    """Each query block once for every group of row blocks: the stated queries against all rows, in blocks."""
    return queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"), "query_block", "query_ids", "queries")
