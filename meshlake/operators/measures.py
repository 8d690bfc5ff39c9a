"""Aggregates over meshes: areas, normals, valences, quality, reports, sampling, quadrics. Sums are partial before every shuffle."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshlake.functions import geometry as g
from meshlake.functions.state import written

from . import mesh as m
from .mesh import Mesh


def triangle_table(mesh: Mesh) -> DataFrame:
    """Fan triangles with corners, lengths, area, min_angle and quality."""
    t = m.lengths(m.corners(m.triangles(mesh.faces), mesh.vertices))
    l1, l2, l3 = F.col("l1"), F.col("l2"), F.col("l3")
    return t.withColumns({"min_angle": g.min_angle(l1, l2, l3), "quality": g.quality(F.col("area"), l1, l2, l3)})


def face_areas(mesh: Mesh) -> DataFrame:
    """fid, area and area-weighted centre of each polygon (the mean of its points if the area is 0)."""
    t = m.lengths(m.corners(m.triangles(mesh.faces), mesh.vertices))
    mid = {k: (F.col(f"a{k}") + F.col(f"b{k}") + F.col(f"c{k}")) / 3.0 for k in "xyz"}
    s = t.groupBy("fid").agg(F.sum("area").alias("area"), *[F.sum(F.col("area") * c).alias(f"w{k}") for k, c in mid.items()], *[F.avg(c).alias(f"m{k}") for k, c in mid.items()])
    return s.select("fid", "area", *[F.when(F.col("area") > 0, F.col(f"w{k}") / F.col("area")).otherwise(F.col(f"m{k}")).alias(f"c{k}") for k in "xyz"])


def vertex_areas(mesh: Mesh) -> DataFrame:
    """vid, area: each face's area in equal parts to its vertices."""
    share = face_areas(mesh).join(mesh.faces, "fid").select(F.explode("vs").alias("vid"), (F.col("area") / F.size("vs")).alias("part"))
    return share.groupBy("vid").agg(F.sum("part").alias("area"))


def vertex_normals(mesh: Mesh) -> DataFrame:
    """vid, nx, ny, nz: minus the area-weighted sum of face normals, normalised."""
    t = m.corners(m.triangles(mesh.faces), mesh.vertices)
    raw = g.cross(g.sub(g.vec("b"), g.vec("a")), g.sub(g.vec("c"), g.vec("a")))
    t = t.select(F.explode(F.array("a", "b", "c")).alias("vid"), *[(0.5 * c).alias(f"n{k}") for k, c in zip("xyz", raw, strict=True)])
    s = t.groupBy("vid").agg(*[(-F.sum(f"n{k}")).alias(f"n{k}") for k in "xyz"])
    return s.select("vid", *[c.alias(f"n{k}") for k, c in zip("xyz", g.unit(g.vec("n")), strict=True)])


def valences(faces: DataFrame) -> DataFrame:
    """vid, edges, faces."""
    by_edge = m.edge_counts(faces).select(F.explode(F.array("v1", "v2")).alias("vid")).groupBy("vid").agg(F.count("*").alias("edges"))
    by_face = m.vertex_faces(faces).groupBy("vid").agg(F.count("*").alias("faces"))
    return by_edge.join(by_face, "vid")


def valence_histogram(faces: DataFrame) -> DataFrame:
    return m.vertex_faces(faces).groupBy("vid").agg(F.count("*").alias("valence")).groupBy("valence").agg(F.count("*").alias("vertices"))


def valence_entropy(faces: DataFrame) -> DataFrame:
    """Entropy in bits of the number of faces of a vertex."""
    h = valence_histogram(faces)
    total = h.agg(F.sum("vertices").alias("total"))
    p = F.col("vertices") / F.col("total")
    return h.join(F.broadcast(total)).agg((-F.sum(p * F.log2(p))).alias("entropy"))


def triangle_stats(mesh: Mesh) -> DataFrame:
    """One row: cells, area_min, area_avg, q_min, q_avg, p30 (per cent of triangle angles counted by least angles under 30 degrees)."""
    t = triangle_table(mesh)
    return t.agg(
        F.count("*").alias("cells"), F.min("area").alias("area_min"), F.avg("area").alias("area_avg"), F.min("quality").alias("q_min"), F.avg("quality").alias("q_avg"),
        (100.0 * F.sum(F.when(F.col("min_angle") < 30, 1).otherwise(0)) / (3.0 * F.count("*"))).alias("p30"),
    )


def quality_histogram(mesh: Mesh, bins: int = 100) -> DataFrame:
    """bin, triangles; every bin is listed, and quality 1 falls in the last."""
    b = F.least(F.floor(F.col("quality") * bins), F.lit(bins - 1)).cast("long")
    counted = triangle_table(mesh).groupBy(b.alias("bin")).agg(F.count("*").alias("triangles"))
    return mesh.vertices.sparkSession.range(bins).select(F.col("id").alias("bin")).join(counted, "bin", "left").select("bin", F.coalesce("triangles", F.lit(0)).cast("long").alias("triangles"))


def full_report(mesh: Mesh) -> DataFrame:
    """``mesh_report`` with the number of connected components (vertices without edges included) and the entropy of the valences."""
    from . import graph

    parts = graph.component_sizes(graph.mesh_components(mesh.vertices, m.edge_counts(mesh.faces))).agg(F.count("*").alias("components"))
    return mesh_report(mesh).join(F.broadcast(parts)).join(F.broadcast(valence_entropy(mesh.faces)))


def mesh_report(mesh: Mesh) -> DataFrame:
    """One row of counts and extents."""
    e = m.edge_counts(mesh.faces)
    v = mesh.vertices.agg(F.count("*").alias("vertices"), *[f(k).alias(f"{n}_{k}") for k in "xyz" for n, f in (("min", F.min), ("max", F.max))])
    f = mesh.faces.agg(F.count("*").alias("faces"), F.sum((F.size("vs") == 3).cast("long")).alias("triangles"), F.sum((F.size("vs") == 4).cast("long")).alias("quads"), F.sum((F.size("vs") > 4).cast("long")).alias("polygons"))
    s = e.agg(F.count("*").alias("edges"), F.sum((F.col("nf") == 1).cast("long")).alias("boundary_edges"), F.sum((F.col("nf") > 2).cast("long")).alias("nonmanifold_edges"))
    val = valences(mesh.faces).agg((100.0 * F.avg((F.col("edges") != 6).cast("double"))).alias("irregular_percent"))
    out = v
    for part in (f, s, val):
        out = out.join(F.broadcast(part))
    return out.withColumn("euler", F.col("vertices") - F.col("edges") + F.col("faces"))


def volume_properties(mesh: Mesh) -> DataFrame:
    """One row: surface, signed_volume, volume, centroid and the normalised shape index surface^1.5 / volume against the sphere's."""
    t = m.lengths(m.corners(m.triangles(mesh.faces), mesh.vertices)).withColumn("v", g.signed_tetra(g.vec("a"), g.vec("b"), g.vec("c")))
    mid = [F.sum(F.col("v") * (F.col(f"a{k}") + F.col(f"b{k}") + F.col(f"c{k}")) / 4.0).alias(f"w{k}") for k in "xyz"]
    s = t.agg(F.sum("area").alias("surface"), F.sum("v").alias("signed_volume"), *mid)
    centre = [F.when(F.col("signed_volume") != 0, F.col(f"w{k}") / F.col("signed_volume")).alias(f"c{k}") for k in "xyz"]
    sphere = 6.0 * math.sqrt(math.pi)
    index = F.when(F.col("signed_volume") != 0, F.pow("surface", F.lit(1.5)) / F.abs("signed_volume") / F.lit(sphere))
    return s.select("surface", "signed_volume", F.abs("signed_volume").alias("volume"), *centre, index.alias("shape_index"))


def ensure_outward(mesh: Mesh) -> Mesh:
    """Faces turned over if the signed volume is negative."""
    flip = F.broadcast(volume_properties(mesh).select((F.coalesce("signed_volume", F.lit(0.0)) < 0).alias("flip")))
    return Mesh(mesh.vertices, mesh.faces.join(flip).select("fid", F.when(F.col("flip"), F.reverse("vs")).otherwise(F.col("vs")).alias("vs")))


def average_edge_length(mesh: Mesh) -> DataFrame:
    return m.edge_lengths(mesh).agg(F.avg("length").alias("average"))


def normalised_indicator(values: DataFrame, column: str, most: float = 100.0) -> DataFrame:
    """Clamped to ``most`` times the mean, divided by the largest."""
    mean = values.agg(F.avg(column).alias("__mean"))
    clamped = values.join(F.broadcast(mean)).withColumn(column, F.least(F.col(column), F.col("__mean") * most)).drop("__mean")
    top = clamped.agg(F.max(column).alias("__top"))
    return clamped.join(F.broadcast(top)).withColumn(column, F.when(F.col("__top") > 0, F.col(column) / F.col("__top")).otherwise(F.lit(0.0))).drop("__top")


def item_weights(areas: DataFrame, indicator: DataFrame | None, gradation: float, ratio: float) -> DataFrame:
    """item, w: area * k^gradation, clamped to the mean divided and multiplied by the ratio."""
    w = areas.select(F.col("vid").alias("item"), F.col("area").alias("w"))
    if indicator is not None and gradation > 0:
        w = w.join(indicator.select(F.col("elt").alias("item"), "k"), "item").select("item", (F.col("w") * F.pow("k", F.lit(gradation))).alias("w"))
    mean = w.agg(F.avg("w").alias("mean"))
    return w.join(F.broadcast(mean)).select("item", F.least(F.greatest("w", F.col("mean") / ratio), F.col("mean") * ratio).alias("w"))


# Quadrics


def face_quadrics(mesh: Mesh) -> DataFrame:
    t = m.corners(m.triangles(mesh.faces), mesh.vertices)
    q = g.triangle_quadric(g.vec("a"), g.vec("b"), g.vec("c"))
    return t.select("fid", *[c.alias(n) for n, c in zip(g.QUADRIC, q, strict=True)]).groupBy("fid").agg(*[F.sum(n).alias(n) for n in g.QUADRIC])


def vertex_quadrics(mesh: Mesh) -> DataFrame:
    return face_quadrics(mesh).join(m.vertex_faces(mesh.faces), "fid").groupBy("vid").agg(*[F.sum(n).alias(n) for n in g.QUADRIC])


#: Singular values below this part of the largest count as zero.
SINGULAR = 1e-3


def best_points(q: np.ndarray, start: np.ndarray, rank: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Points of least quadric error from the start points, moving only along singular directions of weight; and the rank deficiency."""
    a = np.empty((len(q), 3, 3))
    a[:, 0, 0], a[:, 0, 1], a[:, 0, 2], a[:, 1, 1], a[:, 1, 2], a[:, 2, 2] = q[:, 0], q[:, 1], q[:, 2], q[:, 4], q[:, 5], q[:, 7]
    a[:, 1, 0], a[:, 2, 0], a[:, 2, 1] = q[:, 1], q[:, 2], q[:, 5]
    b = -np.stack([q[:, 3], q[:, 6], q[:, 8]], 1)
    u, s, vt = np.linalg.svd(a)
    keep = (s > SINGULAR * s[:, :1]) & (np.arange(3) < rank) & (s[:, :1] > 0)
    inverse = np.where(keep, 1 / np.where(keep, s, 1), 0)
    rest = b - np.einsum("nij,nj->ni", a, start)
    step = np.einsum("nji,nj->ni", vt, inverse * np.einsum("nji,nj->ni", u, rest))
    return start + step, 3 - keep.sum(1)


def quadric_points(quadrics: DataFrame, key: str, rank: int = 3) -> DataFrame:
    """key, x, y, z, deficiency for rows of quadrics with start points x, y, z."""

    @F.pandas_udf("x double, y double, z double, deficiency int")
    def solve(q: pd.DataFrame) -> pd.DataFrame:
        p, d = best_points(q[g.QUADRIC].to_numpy(), q[["x", "y", "z"]].to_numpy(), rank)
        return pd.DataFrame({"x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "deficiency": d.astype(np.int32)})

    return quadrics.select(key, solve(F.struct(*g.QUADRIC, "x", "y", "z")).alias("p")).select(key, "p.*")


# Running sums and sampling


def cumulative(df: DataFrame, key: str, value: str, width: int = 1 << 14) -> DataFrame:
    """Adds upto: the running sum of the value in order of a unique integer key. Ranges are summed first, so no task sees all rows."""
    ranged = df.withColumn("__range", F.floor(F.col(key) / width))
    sums = ranged.groupBy("__range").agg(F.sum(value).alias("__s"))
    before = sums.select("__range", F.coalesce(F.sum("__s").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.sum(value).over(Window.partitionBy("__range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.join(before, "__range").withColumn("upto", F.col("__before") + inside).drop("__range", "__before")


def least_rows(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """The first k rows by the columns ``order`` (by row number of sorted ranges on ties). Rows are ranked where a range partitioning puts them, so that k may be large."""
    if df.isEmpty():
        return df
    ranked = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranked = written(ranked, "ranked")
    part, inside = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranked.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    out = ranked.withColumn("__part", part).join(F.broadcast(before), "__part").where(F.col("__before") + inside < k)
    return out.select(*df.columns)


def sample_surface(mesh: Mesh, points: int, seed: int = 1) -> DataFrame:
    """sample, fid, x, y, z, nx, ny, nz: points uniform over the area. Stratified draws of the total area are located by buckets of the running area."""
    t = m.lengths(m.corners(m.triangles(mesh.faces).select((F.col("fid") * 64 + F.col("part")).alias("key"), "fid", "a", "b", "c"), mesh.vertices)).where("area > 0")
    total = t.agg(F.sum("area").alias("total"))
    run = cumulative(t, "key", "area").join(F.broadcast(total)).withColumns({"lo": (F.col("upto") - F.col("area")) / F.col("total") * points, "hi": F.col("upto") / F.col("total") * points})
    # Draw number i lies in [i, i + 1); a triangle meets the draws from floor(lo) to floor(hi).
    own = run.withColumn("sample", F.explode(F.sequence(F.floor("lo"), F.least(F.floor("hi"), F.lit(points - 1)))))
    u = lambda k: F.pmod(F.xxhash64("sample", F.lit(seed), F.lit(k)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    own = own.withColumn("at", F.col("sample") + u(0)).where("at >= lo AND at < hi")
    r1, r2 = F.sqrt(u(1)), u(2)
    n = g.triangle_normal(g.vec("a"), g.vec("b"), g.vec("c"))
    place = [((1 - r1) * F.col(f"a{k}") + r1 * (1 - r2) * F.col(f"b{k}") + r1 * r2 * F.col(f"c{k}")).alias(k) for k in "xyz"]
    return own.select("sample", "fid", *place, *[c.alias(f"n{k}") for k, c in zip("xyz", n, strict=True)])


def weighted_slices(items: DataFrame, slices: int, buckets: int = 10_000) -> DataFrame:
    """item, slice: slices of about equal weight along the longest axis, cut at bucket borders. Columns item, x, y, z, w."""
    b = m.bounds(items.select(F.col("item").alias("vid"), "x", "y", "z"))
    spread = {k: F.col(f"h{k}") - F.col(f"l{k}") for k in "xyz"}
    axis = F.when(spread["x"] >= F.greatest(spread["y"], spread["z"]), 0).when(spread["y"] >= spread["z"], 1).otherwise(2)
    at = F.when(axis == 0, F.col("x") - F.col("lx")).when(axis == 1, F.col("y") - F.col("ly")).otherwise(F.col("z") - F.col("lz"))
    bucket = F.when(F.col("widest") > 0, F.least(F.floor(at / F.col("widest") * buckets), F.lit(buckets - 1))).otherwise(F.lit(0))
    placed = items.join(F.broadcast(b)).select("item", "w", bucket.cast("long").alias("bucket"))
    sums = placed.groupBy("bucket").agg(F.sum("w").alias("s"))  # at most ``buckets`` rows
    everything = Window.orderBy("bucket")
    run = sums.select("bucket", (F.sum("s").over(everything.rowsBetween(Window.unboundedPreceding, 0)) - F.col("s")).alias("before"), F.sum("s").over(Window.partitionBy(F.lit(0))).alias("total"))
    part = F.least(F.floor(F.col("before") / F.col("total") * slices), F.lit(slices - 1)).cast("int")
    return placed.join(F.broadcast(run), "bucket").select("item", part.alias("slice"))


def mesh_difference(one: DataFrame, two: DataFrame) -> DataFrame:
    """One row: vertices, unmatched (ids of one mesh only), max_error, mean_error, mean displacement, and worst vertex (the least on ties)."""
    a = one.select("vid", *[F.col(k).alias(f"p{k}") for k in "xyz"])
    b = two.select("vid", *[F.col(k).alias(f"q{k}") for k in "xyz"])
    j = a.join(b, "vid", "full").withColumn("e", g.distance(g.vec("p"), g.vec("q")))
    return j.agg(
        F.count("e").alias("vertices"), F.sum(F.col("e").isNull().cast("long")).alias("unmatched"), F.max("e").alias("max_error"), F.avg("e").alias("mean_error"),
        *[F.avg(F.col(f"q{k}") - F.col(f"p{k}")).alias(f"mean_d{k}") for k in "xyz"], F.max_by("vid", F.struct("e", -F.col("vid"))).alias("worst"),
    )


def nearest_in_cluster(items: DataFrame, centres: DataFrame) -> DataFrame:
    """cluster, item, distance: each cluster's item nearest its centre (the least id on ties). Columns item, cluster, x, y, z; cluster, cx, cy, cz."""
    j = items.join(centres, "cluster").withColumn("d", g.distance(g.vec(), g.vec("c")))
    return j.groupBy("cluster").agg(F.min_by("item", F.struct("d", "item")).alias("item"), F.min("d").alias("distance"))
