"""Synthetic triangulations over the unit square and bent forms of it, from a row range; and the fixed test solids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.operators.mesh import Mesh
from meshlake.operators.remesh import subdivide

#: The octahedron and the cube.
OCTAHEDRON = ([(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)], [(0, 2, 4), (2, 1, 4), (1, 3, 4), (3, 0, 4), (2, 0, 5), (1, 2, 5), (3, 1, 5), (0, 3, 5)])
CUBE = ([(x, y, z) for z in (0, 1) for y in (0, 1) for x in (0, 1)], [(0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5)])


def solid(spark: SparkSession, which: tuple = OCTAHEDRON) -> Mesh:
    points, faces = which
    v = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "vid long, x double, y double, z double")
    return Mesh(v, spark.createDataFrame([(i, list(f)) for i, f in enumerate(faces)], "fid long, vs array<long>"))


def square(spark: SparkSession, times: int = 0) -> Mesh:
    """Two triangles, subdivided."""
    mesh = solid(spark, ([(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)], [(0, 1, 2), (0, 2, 3)]))
    for _ in range(times):
        mesh, _ = subdivide(mesh)
    return mesh


def _grid(spark: SparkSession, n: int) -> tuple[DataFrame, DataFrame]:
    side = max(2, int(np.sqrt(n)))
    p = spark.range(side * side).select(F.col("id").alias("vid"), (F.col("id") % side).alias("i"), F.floor(F.col("id") / side).alias("j"))
    cell = p.where((F.col("i") < side - 1) & (F.col("j") < side - 1))
    a = F.col("vid")
    f = cell.select(F.explode(F.array(F.struct((2 * a).alias("fid"), F.array(a, a + 1, a + side).alias("vs")), F.struct((2 * a + 1).alias("fid"), F.array(a + 1, a + side + 1, a + side).alias("vs")))).alias("f")).select("f.*")
    return p.withColumns({"u": F.col("i") / float(side - 1), "w": F.col("j") / float(side - 1)}), f


def triangulation(spark: SparkSession, n: int, kind: int = 0, seed: int = 1) -> Mesh:
    """About n vertices of kind 0 uniform, 1 denser by the third power of y, 2 four strips of densities 1:2:4:8, 3 half-pipe, 4 cut half-pipe,
    5 deformed cube, 6 triangle, 7 subdivided square. Points are jittered grid points, so no triangulation of a point cloud has to be computed in one task."""
    if kind == 5:
        mesh = solid(spark, CUBE)
        while mesh.vertices.count() < n:
            mesh, _ = subdivide(mesh)
        bend = 1 + 0.2 * F.sin(3 * F.col("z"))
        return Mesh(mesh.vertices.select("vid", ((F.col("x") - 0.5) * bend).alias("x"), ((F.col("y") - 0.5) * bend).alias("y"), "z"), mesh.faces)
    if kind == 7:
        return square(spark, max(0, int(np.ceil(np.log2(max(1, np.sqrt(n) - 1))))))
    p, f = _grid(spark, n)
    side = max(2, int(np.sqrt(n)))
    r = lambda k: (F.pmod(F.xxhash64("vid", F.lit(seed), F.lit(k)), F.lit(1 << 30)) / float(1 << 30) - 0.5) * (0.5 / side)
    inside = (F.col("u") > 0) & (F.col("u") < 1) & (F.col("w") > 0) & (F.col("w") < 1)
    u = F.when(inside, F.col("u") + r(1)).otherwise(F.col("u"))
    w = F.when(inside, F.col("w") + r(2)).otherwise(F.col("w"))
    p = p.select("vid", u.alias("u"), w.alias("w"))
    u, w, zero = F.col("u"), F.col("w"), F.lit(0.0)
    if kind == 1:
        place = (u, F.pow(w, F.lit(1 / 4)), zero)
    elif kind == 2:
        share = np.array([1, 2, 4, 8]) / 15
        ends = np.cumsum(share)
        y = F.when(w < ends[0], w / share[0] / 4)
        for i in (1, 2, 3):
            y = y.when(w <= ends[i], 0.25 * i + (w - ends[i - 1]) / share[i] / 4) if i < 3 else y.otherwise(0.75 + (w - ends[2]) / share[3] / 4)
        place = (u, y, zero)
    elif kind in (3, 4):
        turn = F.lit(np.pi) * u
        place = (F.cos(turn), w if kind == 3 else w * (0.5 + 0.5 * u), F.sin(turn))
    elif kind == 6:
        place = (u * (1 - w) + 0.5 * w, w, zero)
    else:
        place = (u, w, zero)
    return Mesh(p.select("vid", *[c.alias(k) for k, c in zip("xyz", place, strict=True)]), f)
