"""Nearest points between meshes by a grid join, distances between meshes, and rigid alignment by iterated closest points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlake.functions.state import written


def nearest(points: DataFrame, targets: DataFrame, cell: float, max_rounds: int = 40) -> DataFrame:
    """item, other, distance: the target nearest each point (the least id on ties). Columns item, x, y, z on both sides.

    A point is compared with the targets of its own and the 26 neighbouring cells; a target found within the cell's size is certainly the nearest. Points
    without such a target are tried again with cells twice as wide."""
    left, out = points.select("item", "x", "y", "z"), None
    for _ in range(max_rounds):
        key = [F.floor(F.col(k) / cell).alias(f"c{k}") for k in "xyz"]
        around = F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy"), (F.col("cz") + k).alias("cz")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
        mine = left.select("item", "x", "y", "z", *key).select("item", "x", "y", "z", F.explode(around).alias("c")).select("item", "x", "y", "z", "c.*")
        theirs = targets.select(F.col("item").alias("other"), *[F.col(k).alias(f"o{k}") for k in "xyz"], *key)
        theirs = theirs.select("other", "ox", "oy", "oz", "cx", "cy", "cz")
        d = F.sqrt(sum((F.col(k) - F.col(f"o{k}")) * (F.col(k) - F.col(f"o{k}")) for k in "xyz"))
        best = mine.join(theirs, ["cx", "cy", "cz"]).groupBy("item").agg(F.min(F.struct(d.alias("distance"), F.col("other").alias("other"))).alias("b"))
        sure = written(best.where(F.col("b.distance") <= cell).select("item", "b.other", "b.distance"), "nearest")
        out = sure if out is None else out.unionByName(sure)
        left = written(left.join(sure.select("item"), "item", "left_anti"), "nearest-left")
        if left.isEmpty() or targets.isEmpty():
            return out
        cell *= 2
    raise RuntimeError("the targets are too far away")


def mesh_distance(one: DataFrame, two: DataFrame, cell: float) -> DataFrame:
    """One row: largest and mean distance each way between vertex sets, and the larger of the two (Hausdorff)."""
    ab = nearest(one, two, cell).agg(F.max("distance").alias("max_ab"), F.avg("distance").alias("mean_ab"))
    ba = nearest(two, one, cell).agg(F.max("distance").alias("max_ba"), F.avg("distance").alias("mean_ba"))
    return ab.join(F.broadcast(ba)).withColumn("hausdorff", F.greatest("max_ab", "max_ba"))


def rigid(sums) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and shift of least squares from the sums of pairs (n, p, q and the nine products)."""
    p, q = np.array([sums[f"p{k}"] for k in "xyz"]) / sums["n"], np.array([sums[f"q{k}"] for k in "xyz"]) / sums["n"]
    h = np.array([[sums[f"p{i}q{j}"] for j in "xyz"] for i in "xyz"]) / sums["n"] - np.outer(p, q)
    u, _, vt = np.linalg.svd(h)
    turn = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))]) @ u.T
    return turn, q - turn @ p


def align(points: DataFrame, targets: DataFrame, cell: float, rounds: int = 20, least: float = 1e-9) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The moved points, the rotation and the shift. Each round sums fifteen products over all pairs; only these reach the driver."""
    turn, shift, state = np.eye(3), np.zeros(3), points.select("item", "x", "y", "z")
    for _ in range(rounds):
        pair = nearest(state, targets, cell).join(state, "item").join(targets.select(F.col("item").alias("other"), *[F.col(k).alias(f"t{k}") for k in "xyz"]), "other")
        sums = pair.agg(F.count("*").alias("n"), *[F.sum(k).alias(f"p{k}") for k in "xyz"], *[F.sum(f"t{k}").alias(f"q{k}") for k in "xyz"], *[F.sum(F.col(i) * F.col(f"t{j}")).alias(f"p{i}q{j}") for i in "xyz" for j in "xyz"]).first()
        r, s = rigid(sums)
        state = written(state.select("item", *[(sum(float(r[i, j]) * F.col(k) for j, k in enumerate("xyz")) + float(s[i])).alias(c) for i, c in enumerate("xyz")]), "aligned")
        turn, shift = r @ turn, r @ shift + s
        if np.abs(r - np.eye(3)).max() + np.abs(s).max() < least:
            break
    return state, turn, shift
