"""Subdivision, splitting, flips, collapses, and remeshing from clusters. Batch rewrites act on sets of elements that do not touch each other."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlake.functions import geometry as g
from meshlake.functions.state import discard, join_bounded, written

from . import clustering, collapse, flips, graph, measures, volume
from . import mesh as m
from .clustering import Metric, Options
from .mesh import Mesh


SMALL = 100_000  # rows that are sent to every executor


def _kept(mesh: Mesh, name: str) -> Mesh:
    return Mesh(written(mesh.vertices.select("vid", "x", "y", "z"), f"{name}-v"), written(mesh.faces.select("fid", "vs"), f"{name}-f"))


# Subdivision


def midpoints(mesh: Mesh, chosen: DataFrame | None = None) -> DataFrame:
    """vid, v1, v2, x, y, z of the midpoint of every (chosen) edge. Ids are n + v1 n + v2 with n above all vertex ids: unique without a sort."""
    e = m.edge_counts(mesh.faces).select("v1", "v2") if chosen is None else chosen.select("v1", "v2")
    n = F.broadcast(mesh.vertices.agg((F.max("vid") + 1).alias("n")))
    p = m.with_ends(e, mesh.vertices).join(n)
    return p.select((F.col("n") + F.col("v1") * F.col("n") + F.col("v2")).alias("vid"), "v1", "v2", *[((F.col(f"p{k}") + F.col(f"q{k}")) / 2).alias(k) for k in "xyz"])


def _with_side_points(tris: DataFrame, points: DataFrame) -> DataFrame:
    """Triangles with mab, mbc, mca: the new vertex of each side, or null."""
    for p, q in (("a", "b"), ("b", "c"), ("c", "a")):
        own = points.select(F.col("v1").alias("__1"), F.col("v2").alias("__2"), F.col("vid").alias(f"m{p}{q}"))
        tris = tris.join(own, (F.least(p, q) == F.col("__1")) & (F.greatest(p, q) == F.col("__2")), "left").drop("__1", "__2")
    return tris


def _split(tris: DataFrame) -> DataFrame:
    """fid, vs: triangles cut at their side points: none, one, two or all three."""
    ring = lambda *names: F.filter(F.array(*[F.col(n) for n in names]), lambda v: v.isNotNull())
    start = F.when(F.col("mab").isNotNull(), ring("mab", "b", "mbc", "c", "mca", "a")).when(F.col("mbc").isNotNull(), ring("mbc", "c", "mca", "a", "mab", "b")).when(F.col("mca").isNotNull(), ring("mca", "a", "mab", "b", "mbc", "c")).otherwise(F.array("a", "b", "c"))
    fan = F.transform(F.sequence(F.lit(2), F.size("ring") - 1), lambda i: F.array(F.element_at("ring", 1), F.element_at("ring", i.cast("int")), F.element_at("ring", (i + 1).cast("int"))))
    four = F.array(F.array("a", "mab", "mca"), F.array("mab", "b", "mbc"), F.array("mca", "mbc", "c"), F.array("mab", "mbc", "mca"))
    whole = F.col("mab").isNotNull() & F.col("mbc").isNotNull() & F.col("mca").isNotNull()
    parts = tris.withColumn("ring", start).select("fid", F.posexplode(F.when(whole, four).otherwise(fan)).alias("part", "vs"))
    return parts.select((F.col("fid") * 4 + F.col("part")).alias("fid"), "vs")


def subdivide(mesh: Mesh) -> tuple[Mesh, DataFrame]:
    """Every triangle to four; and the parents (vid, v1, v2) of the new vertices."""
    mid = midpoints(mesh)
    tris = _with_side_points(m.triangles(mesh.faces).select("fid", "a", "b", "c"), mid)
    return Mesh(mesh.vertices.select("vid", "x", "y", "z").unionByName(mid.select("vid", "x", "y", "z")), _split(tris)), mid.select("vid", "v1", "v2")


def _opposites(mesh: Mesh) -> DataFrame:
    """v1, v2, w: the third vertices of the triangles on each edge."""
    t = m.triangles(mesh.faces)
    parts = [t.select(F.least(p, q).alias("v1"), F.greatest(p, q).alias("v2"), F.col(r).alias("w")) for p, q, r in (("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _sum_at(rows: DataFrame, key: list[str], at: str, vertices: DataFrame) -> DataFrame:
    own = vertices.select(F.col("vid").alias(at), "x", "y", "z")
    return rows.join(own, at).groupBy(*key).agg(*[F.sum(k).alias(f"s{k}") for k in "xyz"], F.count("*").alias("n"))


def subdivide_loop(mesh: Mesh) -> Mesh:
    """Loop subdivision, with the boundary rules."""
    mid = midpoints(mesh)
    opp = _sum_at(_opposites(mesh), ["v1", "v2"], "w", mesh.vertices)
    ends = m.with_ends(mid.select("vid", "v1", "v2"), mesh.vertices).join(opp, ["v1", "v2"])
    odd = [F.when(F.col("n") == 2, (F.col(f"p{k}") + F.col(f"q{k}")) * 0.375 + F.col(f"s{k}") * 0.125).otherwise((F.col(f"p{k}") + F.col(f"q{k}")) / 2).alias(k) for k in "xyz"]
    new = ends.select("vid", *odd)
    ring = _sum_at(m.vertex_neighbours(mesh.faces), ["vid"], "other", mesh.vertices)
    e = m.boundary_edges(mesh.faces)
    rim = _sum_at(e.select(F.col("v1").alias("vid"), F.col("v2").alias("other")).unionByName(e.select(F.col("v2").alias("vid"), F.col("v1").alias("other"))), ["vid"], "other", mesh.vertices)
    rim = rim.select("vid", *[F.col(f"s{k}").alias(f"b{k}") for k in "xyz"])
    inner = F.cos(2 * np.pi / F.col("n")) / 4 + 0.375
    beta = (F.lit(0.625) - inner * inner) / F.col("n")
    j = mesh.vertices.join(ring, "vid", "left").join(rim, "vid", "left")
    even = [F.when(F.col(f"b{k}").isNotNull(), F.col(k) * 0.75 + F.col(f"b{k}") * 0.125).when(F.col("n").isNotNull(), F.col(k) * (1 - F.col("n") * beta) + F.col(f"s{k}") * beta).otherwise(F.col(k)).alias(k) for k in "xyz"]
    old = j.select("vid", *even)
    faces = _split(_with_side_points(m.triangles(mesh.faces).select("fid", "a", "b", "c"), mid))
    return Mesh(old.unionByName(new), faces)


def subdivide_butterfly(mesh: Mesh) -> Mesh:
    """Butterfly subdivision: edges with a full eight-point stencil are interpolated by it, others at their midpoint."""
    mid = midpoints(mesh)
    third = _opposites(mesh)
    two = _sum_at(third, ["v1", "v2"], "w", mesh.vertices)
    # Wings: opposite vertices across the four other sides of the two triangles.
    sides = third.select("v1", "v2", "w", F.explode(F.array("v1", "v2")).alias("end")).select("v1", "v2", "w", F.least("end", "w").alias("o1"), F.greatest("end", "w").alias("o2"), F.when(F.col("end") == F.col("v1"), F.col("v2")).otherwise(F.col("v1")).alias("own"))
    wings = sides.join(third.select(F.col("v1").alias("o1"), F.col("v2").alias("o2"), F.col("w").alias("wing")), ["o1", "o2"]).where("wing <> own")
    four = _sum_at(wings, ["v1", "v2"], "wing", mesh.vertices).select("v1", "v2", *[F.col(f"s{k}").alias(f"w{k}") for k in "xyz"], F.col("n").alias("wings"))
    ends = m.with_ends(mid.select("vid", "v1", "v2"), mesh.vertices).join(two, ["v1", "v2"]).join(four, ["v1", "v2"], "left")
    full = (F.col("n") == 2) & (F.col("wings") == 4)
    new = ends.select("vid", *[F.when(full, (F.col(f"p{k}") + F.col(f"q{k}")) / 2 + F.col(f"s{k}") / 8 - F.col(f"w{k}") / 16).otherwise((F.col(f"p{k}") + F.col(f"q{k}")) / 2).alias(k) for k in "xyz"])
    faces = _split(_with_side_points(m.triangles(mesh.faces).select("fid", "a", "b", "c"), mid))
    return Mesh(mesh.vertices.select("vid", "x", "y", "z").unionByName(new), faces)


def split_long_edges(mesh: Mesh, ratio: float, max_rounds: int = 20) -> Mesh:
    """Edges longer than ratio times the first average are halved until none is left."""
    limit = measures.average_edge_length(mesh).first()[0]
    for _ in range(max_rounds):
        long = written(m.edge_lengths(mesh).where(F.col("length") > ratio * (limit or 0.0)), "split-edges")
        if long.isEmpty():
            return mesh
        mid = midpoints(mesh, long)
        tris = _with_side_points(m.triangles(mesh.faces).select("fid", "a", "b", "c"), mid)
        wide = Mesh(mesh.vertices.select("vid", "x", "y", "z").unionByName(mid.select("vid", "x", "y", "z")), _split(tris))
        mesh = _kept(m.dense_ids(wide), "split")  # ids grow as a product, so they are compacted every round
    raise RuntimeError("edges did not get short")


def subsample_guard(mesh: Mesh, clusters: int, ratio: float) -> Mesh:
    """Subdivided until there are at least ratio times as many vertices as clusters."""
    while mesh.vertices.count() < ratio * clusters:
        mesh = _kept(m.dense_ids(subdivide(mesh)[0]), "subdivided")
    return mesh


# Edits


def delete_faces(mesh: Mesh, gone: DataFrame) -> Mesh:
    return Mesh(mesh.vertices, mesh.faces.join(gone.select("fid"), "fid", "left_anti"))


def delete_vertices(mesh: Mesh, gone: DataFrame) -> Mesh:
    """With the faces that use them."""
    hit = m.vertex_faces(mesh.faces).join(gone.select("vid"), "vid", "left_semi").select("fid").distinct()
    return Mesh(mesh.vertices.join(gone.select("vid"), "vid", "left_anti"), mesh.faces.join(hit, "fid", "left_anti"))


def add_vertices(mesh: Mesh, new: DataFrame) -> Mesh:
    """Rows x, y, z with a unique integer key get ids after the last."""
    top = F.broadcast(mesh.vertices.agg((F.coalesce(F.max("vid"), F.lit(-1)) + 1).alias("n")))
    return Mesh(mesh.vertices.select("vid", "x", "y", "z").unionByName(m.dense_rank(new, "key").join(top).select((F.col("n") + F.col("rank")).alias("vid"), "x", "y", "z")), mesh.faces)


def add_faces(mesh: Mesh, new: DataFrame) -> Mesh:
    """Rows vs with a unique integer key; faces that exist in any order are not added again."""
    top = F.broadcast(mesh.faces.agg((F.coalesce(F.max("fid"), F.lit(-1)) + 1).alias("n")))
    known = mesh.faces.select(F.array_sort("vs").alias("k"))
    fresh = new.withColumn("k", F.array_sort("vs")).join(known, "k", "left_anti")
    once = fresh.groupBy("k").agg(F.min("key").alias("key"), F.min_by("vs", "key").alias("vs"))
    return Mesh(mesh.vertices, mesh.faces.select("fid", "vs").unionByName(m.dense_rank(once, "key").join(top).select((F.col("n") + F.col("rank")).alias("fid"), "vs")))


def merge_vertices(mesh: Mesh, into: DataFrame) -> Mesh:
    """Vertices (vid, into) are replaced; faces that lose a corner go, and of equal faces the first stays."""
    at = mesh.faces.select("fid", F.posexplode("vs").alias("pos", "vid")).join(into, "vid", "left").select("fid", "pos", F.coalesce("into", "vid").alias("vid"))
    new = at.groupBy("fid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "vid"))), lambda s: s["vid"]).alias("vs")).where("size(array_distinct(vs)) = size(vs)")
    once = new.groupBy(F.array_sort("vs").alias("k")).agg(F.min_by("vs", "fid").alias("vs"), F.min("fid").alias("fid")).select("fid", "vs")
    return Mesh(mesh.vertices.join(into.where("vid <> into").select("vid"), "vid", "left_anti"), once)


def bisect_edges(mesh: Mesh, chosen: DataFrame) -> Mesh:
    """Chosen edges (v1, v2) get their midpoint; the triangles on them are cut."""
    mid = midpoints(mesh, chosen)
    tris = _with_side_points(m.triangles(mesh.faces).select("fid", "a", "b", "c"), mid)
    return Mesh(mesh.vertices.select("vid", "x", "y", "z").unionByName(mid.select("vid", "x", "y", "z")), _split(tris))


def _flip_rows(mesh: Mesh, least: float) -> DataFrame:
    """v1, v2, f (runs v1 to v2), h (runs back), w, u (their third vertices), excess over ``least`` of edges between two consistently turned triangles, with no edge from w to u. Angles are summed with the count of an
    edge's triangles, so only edges over the limit are looked at again."""
    t = m.triangles(mesh.faces).select("fid", "a", "b", "c")
    for c in "abc":  # a triangle with a vertex that isn't there still counts
        t = t.join(mesh.vertices.select(F.col("vid").alias(c), *[F.col(k).alias(f"{c}{k}") for k in "xyz"]), c, "left")
    t = m.lengths(t)
    l1, l2, l3 = F.col("l1"), F.col("l2"), F.col("l3")
    turns = F.array(*[F.struct(F.col(p).alias("src"), F.col(q).alias("dst"), F.col(r).alias("w"), x.alias("angle")) for p, q, r, x in (("a", "b", "c", g.angle(l1, l3, l2)), ("b", "c", "a", g.angle(l2, l1, l3)), ("c", "a", "b", g.angle(l3, l2, l1)))])
    he = t.select("fid", F.explode(turns).alias("t")).select("fid", "t.*").where("src <> dst")
    ends = [F.least("src", "dst").alias("v1"), F.greatest("src", "dst").alias("v2")]
    up, down = F.col("src") < F.col("dst"), F.col("src") > F.col("dst")
    third = [F.max(F.when(way, F.col(c))).alias(name) for way, c, name in ((up, "fid", "f"), (down, "fid", "h"), (up, "w", "w"), (down, "w", "u"))]
    e = he.groupBy(*ends).agg(F.count("*").alias("nf"), F.sum("angle").alias("opposite"), *third).withColumn("excess", g.delaunay_excess(F.col("opposite")))
    rows = written(e.where("nf = 2 AND f IS NOT NULL AND h IS NOT NULL AND w <> u").where(F.col("excess") > least).select("v1", "v2", "f", "h", "w", "u", "excess"), "over")
    n = rows.count()
    if not n:
        return rows
    sides = [F.least("w", "u").alias("e1"), F.greatest("w", "u").alias("e2")]
    known = m.half_edges(mesh.faces).select(F.col("v1").alias("e1"), F.col("v2").alias("e2"))
    known = join_bounded(known, rows.select(*sides).distinct(), ["e1", "e2"], "left_semi", n, SMALL).distinct()
    return rows.withColumns({"e1": sides[0], "e2": sides[1]}).join(known, ["e1", "e2"], "left_anti").select(*rows.columns)


def flip_edges(mesh: Mesh, flips: DataFrame) -> Mesh:
    """Flips (v1, v2, f, h, w, u) of edges whose triangles are all different."""
    new = flips.select(F.explode(F.array(F.struct(F.col("f").alias("fid"), F.array("v1", "u", "w").alias("nvs")), F.struct(F.col("h").alias("fid"), F.array("u", "v2", "w").alias("nvs")))).alias("n")).select("n.*")
    return Mesh(mesh.vertices, mesh.faces.join(new, "fid", "left").select("fid", F.coalesce("nvs", "vs").alias("vs")))


def bad_edges(mesh: Mesh, least: float = 1e-9, flippable: Column | None = None) -> DataFrame:
    """v1, v2, f, h, w, u, excess: edges of two triangles f and h (opposite vertices w and u) whose opposite angles sum to over pi, that may be flipped: no edge joins w and u
    yet, and no triangle turns over."""
    rows = _flip_rows(mesh, least)
    n = rows.count()
    for key, name in (("v1", "p"), ("v2", "q"), ("w", "r"), ("u", "s")):
        rows = join_bounded(mesh.vertices.select(F.col("vid").alias(key), *[F.col(k).alias(f"{name}{k}") for k in "xyz"]), rows, key, "inner", n, SMALL)
    p, q, r, s = (g.vec(k) for k in "pqrs")
    bad = rows.where(g.dot(g.cross(g.sub(s, p), g.sub(r, p)), g.cross(g.sub(q, s), g.sub(r, s))) > 0)
    return (bad if flippable is None else bad.where(flippable)).select("v1", "v2", "f", "h", "w", "u", "excess")


def _flips_by_joins(mesh: Mesh, max_rounds: int, least: float, flippable: Column | None) -> tuple[Mesh, int]:
    """A flip is made only if its edge does not exist and no other flip of the round touches its triangles or makes the same edge."""
    total = 0
    for _ in range(max_rounds):
        bad = written(bad_edges(mesh, least, flippable), "flips")
        rank = F.struct("excess", (-F.col("v1")).alias("a"), (-F.col("v2")).alias("b"))
        best = bad.select(F.explode(F.array("f", "h")).alias("face"), rank.alias("r")).groupBy("face").agg(F.max("r").alias("r"))
        one = lambda c: best.select(F.col("face").alias(c), F.col("r").alias(f"r{c}"))
        mine = bad.join(one("f"), "f").join(one("h"), "h").where((F.col("rf") == rank) & (F.col("rh") == rank))
        made = mine.groupBy(F.least("w", "u").alias("n1"), F.greatest("w", "u").alias("n2")).agg(F.max_by(F.struct("v1", "v2", "f", "h", "w", "u"), rank).alias("x")).select("x.*")
        made = written(made, "flips")
        n = made.count()
        if not n:
            return mesh, total
        total += n
        mesh = Mesh(mesh.vertices, written(flip_edges(mesh, made).faces, "flipped"))
    raise RuntimeError(f"flips did not settle in {max_rounds} rounds")


def _flip_bins(vertices: DataFrame, bins: int) -> DataFrame:
    """vid, x, y, z, k: bins of about equal numbers of vertices along the widest axis; the others part vertices that are level on it."""
    if bins == 1:
        return vertices.select("vid", "x", "y", "z", F.lit(0).alias("k"))
    finite = {k: F.when(F.abs(k) < float("inf"), F.col(k)) for k in "xyz"}
    box = vertices.agg(*[f(finite[k]).alias(f"{f.__name__}{k}") for k in "xyz" for f in (F.min, F.max)]).first()
    wide = {k: (box[f"max{k}"] or 0.0) - (box[f"min{k}"] or 0.0) for k in "xyz"}
    place = sum(((finite[k] - box[f"min{k}"]) / wide[k] * 1000.0**-i for i, k in enumerate(sorted("xyz", key=lambda k: -wide[k])) if wide[k] > 0), F.lit(0.0))
    at = vertices.select("vid", "x", "y", "z", F.coalesce(place, F.lit(0.0)).alias("at"))
    edges = np.array(at.agg(F.percentile_approx("at", [i / bins for i in range(1, bins)], 20_000).alias("e")).first().e)

    @F.pandas_udf("int")
    def binned(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, x.to_numpy()).astype(np.int32))

    return written(at.select("vid", "x", "y", "z", binned("at").alias("k")), "flip-bins")


def _flip_blocks(marked: np.ndarray, turn: int, bins_of_block: int) -> np.ndarray:
    """A block's number for each bin, -1 where none is needed: runs of the marked bins with a margin that grows by the turn, cut where they are long, elsewhere in every turn."""
    margin = min(2 << turn, max(1, bins_of_block // 2))
    edges = np.r_[0, np.cumsum(marked), [marked.sum()] * margin]
    at = np.arange(len(marked))
    near = edges[at + margin + 1] > edges[np.maximum(at - margin, 0)]
    begins = near & ~np.r_[False, near[:-1]]
    run = np.cumsum(begins) - 1
    place = at - np.flatnonzero(begins)[np.maximum(run, 0)] if begins.any() else at
    length = np.bincount(run[near], minlength=len(marked))
    cut = np.where(length[np.maximum(run, 0)] > bins_of_block, (place + int(bins_of_block * (turn * 0.618 % 1))) // bins_of_block, 0)
    new = near & (begins | np.r_[True, cut[1:] != cut[:-1]])
    return np.where(near, np.cumsum(new) - 1, -1)


FLIP_TYPES = "fid long, a long, b long, c long, ka int, kb int, kc int, open boolean, own boolean, flips long"


def _flipped(least: float, max_rounds: int):
    """The task of a block: its own triangles after its flips, and of the others those that are to be looked at again."""

    def run(rows: pd.DataFrame, faces: pd.DataFrame) -> pd.DataFrame:
        faces, rows = faces.sort_values("fid", ignore_index=True), rows.sort_values("vid", ignore_index=True)
        own = faces["own"].to_numpy(bool)
        if not own.any():
            return pd.DataFrame(columns=["fid", "a", "b", "c", "ka", "kb", "kc", "open", "own", "flips"])
        ids, corners = np.unique(faces[["a", "b", "c"]].to_numpy(np.int64), return_inverse=True)
        at = np.searchsorted(ids, rows["vid"].to_numpy())
        here = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == rows["vid"].to_numpy())
        points, bins = np.full((len(ids), 3), np.nan), np.zeros(len(ids), np.int32)
        points[at[here]], bins[at[here]] = rows[["x", "y", "z"]].to_numpy(float)[here], rows["k"].to_numpy()[here]
        x = flips.Flipper(points, corners.reshape(-1, 3), own, faces["open"].to_numpy(bool), least)
        x.run(max_rounds)
        freed = x.freed()
        opened, sent = x.left_open() | freed, np.flatnonzero(own | freed)
        out = pd.DataFrame({"fid": faces["fid"].to_numpy()[sent]})
        out[["a", "b", "c"]], out[["ka", "kb", "kc"]] = ids[x.t[sent]], bins[x.t[sent]]
        out["open"], out["own"], out["flips"] = opened[sent], own[sent], 0
        out.loc[out.index[:1], "flips"] = x.made
        return out

    return run


def delaunay(mesh: Mesh, max_rounds: int = 10_000, least: float = 1e-9, flippable: Column | None = None, block_items: int = 150_000) -> tuple[Mesh, int]:
    """Flips edges whose opposite angles sum to over pi, the worst of each neighbourhood first. Returns the mesh and the number of flips.

    Blocks of about ``block_items`` vertices flip their own edges in a task each until none is left (see ``flips``). Triangles beside an edge that no block has decided stay open; the next turn cuts blocks around these alone, and
    it ends when none is open. Should open triangles be too long for any block, or with a predicate, rounds of joins go over the whole mesh."""
    mesh = Mesh(mesh.vertices, m.triangles(mesh.faces).select("fid", F.array("a", "b", "c").alias("vs")))
    if flippable is not None:
        return _flips_by_joins(mesh, max_rounds, least, flippable)
    n = mesh.vertices.count()
    bins = 1 if n <= block_items else max(8, min(2048, -(-n // block_items) * 32))
    per_block = max(1, bins * block_items // max(n, 1))
    vertices = _flip_bins(mesh.vertices, bins)
    faces = mesh.faces.select("fid", *[F.element_at("vs", i + 1).alias(k) for i, k in enumerate("abc")])
    for k in "abc":
        faces = faces.withColumn(f"k{k}", F.lit(0)) if bins == 1 else faces.join(vertices.select(F.col("vid").alias(k), F.col("k").alias(f"k{k}")), k, "left").withColumn(f"k{k}", F.coalesce(f"k{k}", F.lit(0)))
    faces = faces.select("fid", "a", "b", "c", "ka", "kb", "kc", F.lit(True).alias("open"))
    if bins > 1:
        faces = written(faces, "flip-faces")
    used = [vertices, faces] if bins > 1 else []
    total, idle, fewest = 0, 0, None

    def settled() -> Mesh:
        out = Mesh(mesh.vertices, written(faces.select("fid", F.array("a", "b", "c").alias("vs")), "flipped"))
        for table in used:
            discard(table)
        return out

    for turn in range(max_rounds):
        if turn:
            low, high = F.least("ka", "kb", "kc"), F.greatest("ka", "kb", "kc")
            ends = faces.where("open").select(F.explode(F.array(F.struct(low.alias("k"), F.lit(1).alias("n")), F.struct((high + 1).alias("k"), F.lit(-1).alias("n")))).alias("e"))
            ends = ends.select("e.*").groupBy("k").agg(F.sum("n").alias("n"), F.sum((F.col("n") > 0).cast("long")).alias("opened")).collect()  # two rows a bin at most
            left, steps = sum(r.opened for r in ends), np.zeros(bins + 1)
            for r in ends:
                steps[r.k] += r.n
            marked = np.cumsum(steps[:-1]) > 0
            if not left:
                return settled(), total
            idle = 0 if made or fewest is None or left < fewest else idle + 1
            fewest = left if fewest is None else min(fewest, left)
            if idle == 8:
                rest, more = _flips_by_joins(settled(), max_rounds, least, None)
                return rest, total + more
        else:
            marked = np.ones(bins, bool)
        blocks = F.split(F.lit(",".join(map(str, _flip_blocks(marked, turn, per_block)))), ",").cast("array<int>")
        of = lambda k: F.element_at(blocks, F.col(k) + 1)
        dealt = faces.withColumns({f"d{k}": of(f"k{k}") for k in "abc"})
        inside = (F.col("da") >= 0) & (F.col("da") == F.col("db")) & (F.col("da") == F.col("dc"))
        sent = dealt.withColumn("own", inside).withColumn("block", F.explode(F.filter(F.array_distinct(F.array("da", "db", "dc")), lambda x: x >= 0))).select("block", "fid", "a", "b", "c", "open", "own")
        points = vertices.withColumn("block", of("k")).where("block >= 0")
        done = written(points.groupBy("block").cogroup(sent.groupBy("block")).applyInPandas(_flipped(least, max_rounds), FLIP_TYPES), "flip-done")
        used.append(done)
        sums = done.agg(F.coalesce(F.sum("flips"), F.lit(0)).alias("made"), F.coalesce(F.sum((~F.col("own")).cast("long")), F.lit(0)).alias("freed")).first()
        made, total = sums.made, total + sums.made
        rest = dealt.where(~inside).select(*faces.columns)
        if sums.freed:
            again = done.where("NOT own").select("fid").distinct().withColumn("again", F.lit(True))
            rest = rest.join(again, "fid", "left").withColumn("open", F.col("open") | F.coalesce("again", F.lit(False))).select(*faces.columns)
        faces = done.where("own").select(*faces.columns)
        if bins > 1:
            faces = faces.unionByName(rest)
            if turn % 4 == 3:  # tables that later turns read through
                faces = written(faces, "flip-faces")
                used.append(faces)
    raise RuntimeError(f"flips did not settle in {max_rounds} rounds")


def _slabs(vertices: DataFrame, n: int, turn: int, block_items: int) -> DataFrame:
    """vid, block: slabs of about ``block_items`` vertices along one axis, cut elsewhere and along another axis in every turn of a cycle."""
    count = -(-n // block_items)
    if count <= 1:
        return vertices.select("vid", F.lit(0).alias("block"))
    axis, shift = clustering.CYCLE[turn % len(clustering.CYCLE)]
    k = "xyz"[axis]
    edges = vertices.agg(F.percentile_approx(k, [(i + shift) / count for i in range(0 if shift else 1, count)], 10_000).alias("e")).first().e
    return vertices.select("vid", sum((F.col(k) > F.lit(e)).cast("int") for e in edges).alias("block"))


def _collapsed(share: dict[int, int]):
    """The task of a block that makes its share of the collapses: changed vertices with where they went, their places and quadrics."""

    def run(rows: pd.DataFrame, faces: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vid", ignore_index=True)
        ids = rows["vid"].to_numpy()
        if not len(rows) or not len(faces):
            return pd.DataFrame(columns=["vid", "into", "x", "y", "z", *g.QUADRIC])
        corners = np.searchsorted(ids, np.array(faces.sort_values("fid")["vs"].tolist(), np.int64))
        c = collapse.Collapser(rows[["x", "y", "z"]].to_numpy(), corners, rows[g.QUADRIC].to_numpy(), rows["fixed"].to_numpy(bool))
        c.run(share.get(int(rows["block"].iloc[0]), 0))
        to = np.array([c.root(i) for i in range(len(ids))])
        changed = np.flatnonzero((to != np.arange(len(ids))) | (np.array(c.version) > 0))
        out = pd.DataFrame({"vid": ids[changed], "into": ids[to[changed]]})
        out[["x", "y", "z"]] = np.array(c.p).reshape(-1, 3)[changed]
        out[g.QUADRIC] = c.q[changed]
        return out

    return run


def simplify(mesh: Mesh, vertices: int, max_rounds: int = 10_000, block_items: int = 50_000) -> Mesh:
    """Quadric edge collapses down to ``vertices`` (never below), by blocks of vertices (see ``collapse``): each block makes its part of the collapses in a task of its own, and leaves the vertices of
    triangles alone that reach into another block. Blocks are cut elsewhere in the next round. Ends above ``vertices`` when a whole cycle can collapse nothing."""
    mesh = _kept(Mesh(mesh.vertices, m.triangles(mesh.faces).select((F.col("fid") * 64 + F.col("part")).alias("fid"), F.array("a", "b", "c").alias("vs"))), "simplify")
    quadrics = written(measures.vertex_quadrics(mesh), "simplify-q")
    n, idle = mesh.vertices.count(), 0
    for turn in range(max_rounds):
        cycle = len(clustering.CYCLE) if n > block_items else 1
        if n <= vertices or idle == cycle:
            return mesh
        at = written(_slabs(mesh.vertices, n, turn, block_items), "simplify-blocks")
        sides = mesh.faces.select("fid", "vs", F.explode("vs").alias("vid")).join(at, "vid")
        inside = written(sides.groupBy("fid").agg(F.first("vs").alias("vs"), F.min("block").alias("near"), F.max("block").alias("far")), "simplify-faces")
        fixed = inside.where("near <> far").select(F.explode("vs").alias("vid")).distinct().withColumn("fixed", F.lit(True))
        own = mesh.vertices.join(at, "vid").join(quadrics, "vid").join(fixed, "vid", "left").withColumn("fixed", F.coalesce("fixed", F.lit(False)))
        own = written(own, "simplify-own")
        free = {r.block: r.n for r in own.where("NOT fixed").groupBy("block").agg(F.count("*").alias("n")).collect()}  # one row a block
        ask = n - vertices
        parts = {b: ask * k / sum(free.values()) for b, k in free.items()}
        share = {b: int(x) for b, x in parts.items()}
        for b in sorted(parts, key=lambda b: (share[b] - parts[b], b))[: ask - sum(share.values())]:
            share[b] += 1

        links = inside.where("near = far").select("near", "fid", "vs")
        types = "vid long, into long, " + ", ".join(f"{k} double" for k in ("x", "y", "z", *g.QUADRIC))
        done = written(own.groupBy("block").cogroup(links.groupBy("near")).applyInPandas(_collapsed(share), types), "simplify-done")
        gone = done.where("vid <> into").count()
        idle = 0 if gone else idle + 1
        if not gone:
            continue
        n -= gone
        kept = done.where("vid = into")
        moved = mesh.vertices.join(kept.select("vid", *[F.col(k).alias(f"n{k}") for k in "xyz"]), "vid", "left").select("vid", *[F.coalesce(f"n{k}", k).alias(k) for k in "xyz"])
        mesh = _kept(merge_vertices(Mesh(moved, mesh.faces), done.where("vid <> into").select("vid", "into")), "simplify")
        rest = quadrics.join(done.select("vid"), "vid", "left_anti")
        quadrics = written(rest.unionByName(kept.select("vid", *g.QUADRIC)), "simplify-q")
    raise RuntimeError(f"{n} vertices were left after {max_rounds} rounds")


def clean(mesh: Mesh, max_rounds: int = 1000) -> Mesh:
    """While edges have over two faces, the least face of each such edge is deleted."""
    for _ in range(max_rounds):
        bad = m.nonmanifold_edges(mesh.faces).select("v1", "v2")
        gone = written(m.half_edges(mesh.faces).join(bad, ["v1", "v2"], "left_semi").groupBy("v1", "v2").agg(F.min("fid").alias("fid")).select("fid").distinct(), "clean")
        if gone.isEmpty():
            return mesh
        mesh = _kept(delete_faces(mesh, gone), "cleaned")
    raise RuntimeError("the mesh did not get clean")


def fill_holes(mesh: Mesh) -> Mesh:
    """Every loop of boundary edges is closed by a fan around the mean of its vertices."""
    rim = m.boundary_edges(mesh.faces).select("v1", "v2")
    sides = m.half_edges(mesh.faces).join(rim, ["v1", "v2"], "left_semi").select("src", "dst")
    loop = graph.star_components(rim.select(F.col("v1").alias("u"), F.col("v2").alias("v"))).select(F.col("node").alias("vid"), "label")
    top = F.broadcast(mesh.vertices.agg((F.max("vid") + 1).alias("top")))
    centres = mesh.vertices.join(loop, "vid").groupBy("label").agg(*[F.avg(k).alias(k) for k in "xyz"]).join(top).select((F.col("top") + F.col("label")).alias("vid"), "x", "y", "z", "label")
    centres = written(centres, "holes")
    fan = sides.join(loop.withColumnRenamed("vid", "src"), "src").join(centres.select("label", F.col("vid").alias("centre")), "label")
    new = fan.select(F.array("dst", "src", "centre").alias("vs")).withColumn("key", F.abs(F.xxhash64("vs")))
    return add_faces(Mesh(mesh.vertices.unionByName(centres.select("vid", "x", "y", "z")), mesh.faces), new)


def finished_surface(mesh: Mesh, biggest: bool = True, fill: bool = True, vertices: int | None = None, smoothing: int = 0) -> Mesh:
    """A label's surface with what is asked for, in this order: the biggest component alone, holes filled, collapsed to a number of vertices, smoothed."""
    if biggest:
        kept = graph.biggest_components(graph.mesh_components(mesh.vertices, m.edge_counts(mesh.faces)), 1)
        mesh = _kept(delete_vertices(mesh, mesh.vertices.join(kept.select("vid"), "vid", "left_anti").select("vid")), "surface")
    if fill:
        mesh = _kept(fill_holes(mesh), "surface")
    if vertices is not None:
        mesh = simplify(mesh, vertices)
    if smoothing:
        mesh = Mesh(volume.smoothed(mesh.vertices, m.vertex_neighbours(mesh.faces), smoothing), mesh.faces)
    return mesh


def dual(mesh: Mesh, colours: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Barycentric dual: six triangles a face, each of the vertex that it belongs to (fid, part, vid, ax..cz); and the colours by vertex, if given."""
    t = m.corners(m.triangles(mesh.faces).select("fid", "a", "b", "c"), mesh.vertices)
    mid = {k: (F.col(f"a{k}") + F.col(f"b{k}") + F.col(f"c{k}")) / 3.0 for k in "xyz"}
    rows = []
    for p, q, r in (("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b")):
        half = lambda u, p=p: {k: (F.col(f"{p}{k}") + F.col(f"{u}{k}")) / 2.0 for k in "xyz"}
        own = {k: F.col(f"{p}{k}") for k in "xyz"}
        for tri in ((own, half(q), mid), (own, mid, half(r))):
            rows.append(F.struct(F.lit(len(rows)).alias("part"), F.col(p).alias("vid"), *[c[k].alias(f"{n}{k}") for n, c in zip("abc", tri, strict=True) for k in "xyz"]))
    out = t.select("fid", F.explode(F.array(*rows)).alias("r")).select("fid", "r.*")
    return out, out.select("fid", "part", "vid").join(colours, "vid") if colours is not None else out.select("fid", "part", "vid")


# Remeshing from clusters


def cluster_mesh(mesh: Mesh, labels: DataFrame, places: DataFrame) -> Mesh:
    """A vertex for each cluster (cluster, x, y, z), and a face for each input face that touches three clusters (two for four), once each, turned as in the input."""
    at = mesh.faces.select("fid", F.posexplode("vs").alias("pos", "item")).join(labels, "item").where("cluster IS NOT NULL")
    ring = at.groupBy("fid").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "cluster"))), lambda s: s["cluster"])).alias("cs")).where("size(cs) >= 3")
    fan = m.triangles(ring.select("fid", F.col("cs").alias("vs")))
    key = F.array_sort(F.array("a", "b", "c"))
    once = fan.groupBy(key.alias("k")).agg(F.min(F.struct("fid", "part", "a", "b", "c")).alias("t")).select((F.col("t.fid") * 64 + F.col("t.part")).alias("fid"), F.array("t.a", "t.b", "t.c").alias("vs"))
    return Mesh(places.select(F.col("cluster").alias("vid"), "x", "y", "z"), once)


def face_cluster_mesh(mesh: Mesh, labels: DataFrame, places: DataFrame) -> Mesh:
    """As ``cluster_mesh`` for clusters of faces (item: fid): a polygon, fanned, for each input vertex whose faces, in order around it, are of three clusters or more."""
    tri = m.triangles(mesh.faces)
    turns = [tri.select(F.col(p).alias("vid"), F.col(q).alias("src"), F.col(r).alias("dst"), F.col("fid").alias("item")) for p, q, r in (("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b"))]
    at = turns[0].unionByName(turns[1]).unionByName(turns[2]).join(labels, "item").where("cluster IS NOT NULL")
    rings = at.groupBy("vid").agg(F.collect_list(F.struct("src", "dst", "cluster")).alias("l"), F.countDistinct("cluster").alias("n")).where("n >= 3").select("vid", "l")

    def run(batches):
        for b in batches:
            rows = []
            for vid, links in zip(b["vid"], b["l"], strict=True):
                after = {r["src"]: r for r in sorted(links, key=lambda r: (r["src"], r["dst"]), reverse=True)}
                # An open fan starts at the link that none leads to, a closed one at the least.
                start = min(after.keys() - {r["dst"] for r in links}, default=min(after))
                ring, seen = [], set()
                while start in after and start not in seen:
                    seen.add(start)
                    if not ring or ring[-1] != after[start]["cluster"]:
                        ring.append(after[start]["cluster"])
                    start = after[start]["dst"]
                ring = list(dict.fromkeys(ring))
                rows += [(vid, i, ring[0], ring[i + 1], ring[i + 2]) for i in range(len(ring) - 2)]
            yield pd.DataFrame(rows, columns=["vid", "part", "a", "b", "c"]).astype("int64")

    fan = rings.mapInPandas(run, "vid long, part long, a long, b long, c long")
    key = F.array_sort(F.array("a", "b", "c"))
    once = fan.groupBy(key.alias("k")).agg(F.min(F.struct("vid", "part", "a", "b", "c")).alias("t")).select((F.col("t.vid") * 64 + F.col("t.part")).alias("fid"), F.array("t.a", "t.b", "t.c").alias("vs"))
    return Mesh(places.select(F.col("cluster").alias("vid"), "x", "y", "z"), once)


def fix_boundary(mesh: Mesh, labels: DataFrame, out: Mesh) -> Mesh:
    """Adds the midpoints of input boundary edges between two clusters, a triangle from each to its clusters, and one between the two midpoints of a cluster."""
    rim = m.boundary_edges(mesh.faces).select("v1", "v2")
    he = m.half_edges(mesh.faces).join(rim, ["v1", "v2"], "left_semi").select("src", "dst")
    one = labels.select(F.col("item").alias("src"), F.col("cluster").alias("p"))
    two = labels.select(F.col("item").alias("dst"), F.col("cluster").alias("q"))
    cut = he.join(one, "src").join(two, "dst").where("p <> q")
    cut = m.with_ends(cut.select(F.col("src").alias("v1"), F.col("dst").alias("v2"), "p", "q"), mesh.vertices)
    top = F.broadcast(out.vertices.agg((F.max("vid") + 1).alias("n")))
    size = F.broadcast(mesh.vertices.agg((F.max("vid") + 1).alias("s")))
    cut = written(cut.join(top).join(size).select((F.col("n") + F.col("v1") * F.col("s") + F.col("v2")).alias("vid"), "p", "q", *[((F.col(f"p{k}") + F.col(f"q{k}")) / 2).alias(k) for k in "xyz"]), "boundary-cuts")
    # Face p -> m -> q keeps the side of the input face, whose boundary runs from p to q.
    tri = cut.select(F.array("p", "vid", "q").alias("vs"))
    enter = cut.groupBy(F.col("q").alias("c")).agg(F.min("vid").alias("i"), F.count("*").alias("ni"))
    leave = cut.groupBy(F.col("p").alias("c")).agg(F.min("vid").alias("o"), F.count("*").alias("no"))
    fan = enter.join(leave, "c").where("ni = 1 AND no = 1 AND i <> o").select(F.array("c", "i", "o").alias("vs"))
    new = tri.unionByName(fan)
    return add_faces(Mesh(out.vertices.unionByName(cut.select("vid", "x", "y", "z")), out.faces), new.withColumn("key", F.abs(F.xxhash64("vs"))))


def broken_clusters(out: Mesh) -> DataFrame:
    """Clusters whose output vertex is neither on the boundary nor manifold."""
    rim = m.boundary_edges(out.faces).select(F.explode(F.array("v1", "v2")).alias("vid")).distinct()
    return m.vertex_manifold(out.faces).where("NOT manifold").join(rim, "vid", "left_anti").select(F.col("vid").alias("cluster"))


@dataclass
class Remeshed:
    mesh: Mesh
    labels: DataFrame
    log: list[dict]


def remesh_faces(mesh: Mesh, metric: Metric, o: Options, weights: DataFrame | None = None) -> Remeshed:
    """Clusters the triangles instead of the vertices (items: fid), by area or by ``weights`` (item, w), and triangulates the clusters."""
    items = written(clustering.face_items(mesh, weights), "items")
    pairs = written(clustering.face_pairs(mesh.faces), "pairs")
    done = clustering.cluster(items, pairs, metric, o)
    out = _kept(face_cluster_mesh(mesh, done.labels, clustering.centroids(items, done.labels, metric)), "remeshed")
    return Remeshed(out, done.labels, done.log)


def remesh(mesh: Mesh, metric: Metric, o: Options, items: DataFrame | None = None, quadric_level: int = 0, subsampling: float = 0, boundary: bool = False, manifold_rounds: int = 0) -> Remeshed:
    """Clusters the vertices and triangulates the clusters. ``quadric_level`` moves vertices to quadric optima of up to that rank;
    ``manifold_rounds`` splits clusters behind vertices that are not manifold and minimises again."""
    if subsampling:
        mesh = subsample_guard(mesh, o.clusters, subsampling)
    if items is None:
        weights = measures.item_weights(measures.vertex_areas(mesh), None, 0.0, 1e5)
        items = clustering.place_items(mesh.vertices.select(F.col("vid").alias("item"), "x", "y", "z"), weights)
        extra = [s for s in metric.stats if s in g.QUADRIC]
        if extra:
            items = items.join(measures.vertex_quadrics(mesh).withColumnRenamed("vid", "item"), "item")
    items = written(items, "items")
    pairs = written(m.vertex_neighbours(mesh.faces).select(F.col("vid").alias("item"), "other").join(items.select("item"), "item", "left_semi").join(items.select(F.col("item").alias("other")), "other", "left_semi"), "pairs")
    done = clustering.cluster(items, pairs, metric, o)
    labels = done.labels
    for attempt in range(manifold_rounds + 1):
        places = clustering.centroids(items, labels, metric)
        if quadric_level:
            q = measures.vertex_quadrics(mesh).withColumnRenamed("vid", "item").join(labels, "item").groupBy("cluster").agg(*[F.sum(n).alias(n) for n in g.QUADRIC])
            places = measures.quadric_points(q.join(places, "cluster"), "cluster", quadric_level)
        out = _kept(cluster_mesh(mesh, labels, places), "remeshed")
        if attempt == manifold_rounds:
            break
        bad = written(broken_clusters(out), "broken")
        if bad.isEmpty():
            break
        # Each broken cluster is cut in two: items nearer to its farthest item than to its centre become a cluster named by that item.
        at = items.join(labels, "item").join(bad, "cluster").join(places.select("cluster", *[F.col(k).alias(f"c{k}") for k in "xyz"]), "cluster")
        at = at.select("item", "cluster", *[(F.col(f"s{k}") / F.col("w")).alias(k) for k in "xyz"], "cx", "cy", "cz").withColumn("d", g.distance(g.vec(), g.vec("c")))
        far = at.groupBy("cluster").agg(F.max_by(F.struct("item", "x", "y", "z"), F.struct("d", "item")).alias("f"), F.count("*").alias("n")).where("n > 1")
        moved = at.join(far, "cluster").where(g.distance(g.vec(), (F.col("f.x"), F.col("f.y"), F.col("f.z"))) < F.col("d")).select("item", F.col("f.item").alias("fresh"))
        taken = labels.select(F.col("cluster").alias("fresh")).distinct()
        moved = moved.join(taken, "fresh", "left_anti")
        labels = clustering.minimise(items, pairs, labels.join(moved, "item", "left").select("item", F.coalesce("fresh", "cluster").alias("cluster")), metric, o, done.log)
    if boundary:
        out = _kept(fix_boundary(mesh, labels, out), "remeshed")
    return Remeshed(out, labels, done.log)
