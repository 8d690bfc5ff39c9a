"""The mesh tables and what is read off them by joins and filters.

vertices (vid, x, y, z), faces (fid, vs: vertex ids in order, which is the orientation). Edges, rings and half-edges are derived.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlake.functions import geometry as g


@dataclass(frozen=True)
class Mesh:
    vertices: DataFrame
    faces: DataFrame

    def active(self) -> Mesh:
        """Without rows marked inactive."""
        keep = lambda df: df.where(F.coalesce("active", F.lit(True))) if "active" in df.columns else df
        return Mesh(keep(self.vertices), keep(self.faces))


def from_triangles(vertices: DataFrame, triangles: DataFrame) -> Mesh:
    return Mesh(vertices, triangles.select("fid", F.array("a", "b", "c").alias("vs")))


def half_edges(faces: DataFrame) -> DataFrame:
    """fid, pos, src, dst in face order, with the undirected key v1 < v2."""
    n = F.size("vs")
    he = faces.select("fid", F.explode(F.transform("vs", lambda v, i: F.struct(i.alias("pos"), v.alias("src"), F.element_at("vs", ((i + 1) % n + 1).cast("int")).alias("dst")))).alias("h"))
    return he.select("fid", "h.*", F.least("h.src", "h.dst").alias("v1"), F.greatest("h.src", "h.dst").alias("v2"))


def edges(faces: DataFrame) -> DataFrame:
    """v1, v2, nf, faces (ascending). Faces with equal first vertices are inactive and give no edges."""
    he = half_edges(faces).where("v1 <> v2")
    return he.groupBy("v1", "v2").agg(F.count("*").alias("nf"), F.sort_array(F.collect_set("fid")).alias("faces"))


def edge_counts(faces: DataFrame) -> DataFrame:
    """v1, v2, nf: partial counts only, no lists."""
    return half_edges(faces).where("v1 <> v2").groupBy("v1", "v2").agg(F.count("*").alias("nf"))


def triangles(faces: DataFrame) -> DataFrame:
    """Fan split from the first vertex: fid, part, a, b, c."""
    fan = F.transform(F.sequence(F.lit(1), F.size("vs") - 2), lambda i: F.struct((i - 1).alias("part"), F.element_at("vs", 1).alias("a"), F.element_at("vs", (i + 1).cast("int")).alias("b"), F.element_at("vs", (i + 2).cast("int")).alias("c")))
    return faces.where(F.size("vs") >= 3).select("fid", F.explode(fan).alias("t")).select("fid", "t.*")


def corners(tris: DataFrame, vertices: DataFrame) -> DataFrame:
    """Triangles with ax..cz. One exchange of the vertices serves the three joins."""
    p = vertices.select("vid", "x", "y", "z")
    for c in "abc":
        own = p.select(F.col("vid").alias(c), *[F.col(k).alias(f"{c}{k}") for k in "xyz"])
        tris = tris.join(own, c)
    return tris


def lengths(cornered: DataFrame) -> DataFrame:
    """Adds l1 = |ab|, l2 = |bc|, l3 = |ac| and the area."""
    a, b, c = g.vec("a"), g.vec("b"), g.vec("c")
    out = cornered.withColumns({"l1": g.distance(a, b), "l2": g.distance(b, c), "l3": g.distance(a, c)})
    return out.withColumn("area", g.heron_area(F.col("l1"), F.col("l2"), F.col("l3")))


def with_ends(pairs: DataFrame, vertices: DataFrame, one: str = "v1", two: str = "v2") -> DataFrame:
    """Joins both ends' coordinates as px.. and qx.."""
    for key, name in ((one, "p"), (two, "q")):
        pairs = pairs.join(vertices.select(F.col("vid").alias(key), *[F.col(k).alias(f"{name}{k}") for k in "xyz"]), key)
    return pairs


def edge_lengths(mesh: Mesh) -> DataFrame:
    return with_ends(edge_counts(mesh.faces), mesh.vertices).select("v1", "v2", g.distance(g.vec("p"), g.vec("q")).alias("length"))


def vertex_neighbours(faces: DataFrame) -> DataFrame:
    """vid, other: both directions of each edge."""
    e = edge_counts(faces)
    return e.select(F.col("v1").alias("vid"), F.col("v2").alias("other")).unionByName(e.select(F.col("v2").alias("vid"), F.col("v1").alias("other")))


def vertex_faces(faces: DataFrame) -> DataFrame:
    """vid, fid, without repetition."""
    return faces.select(F.explode(F.array_distinct("vs")).alias("vid"), "fid")


def face_neighbours(faces: DataFrame) -> DataFrame:
    """fid, other, v1, v2: faces on the same edge, the face itself included."""
    he = half_edges(faces).where("v1 <> v2").select("fid", "v1", "v2")
    return he.join(he.withColumnRenamed("fid", "other"), ["v1", "v2"])


def one_ring(faces: DataFrame, seeds: DataFrame) -> DataFrame:
    """Vertices of the set (column vid) and their neighbours."""
    near = vertex_neighbours(faces).join(seeds.select("vid"), "vid").select(F.col("other").alias("vid"))
    return seeds.select("vid").unionByName(near).distinct()


def across(faces: DataFrame, start: DataFrame) -> DataFrame:
    """For (fid, v1, v2): the face on the other side and, for triangles, its third vertex."""
    near = face_neighbours(faces).where("fid <> other")
    found = start.join(near, ["fid", "v1", "v2"])
    opposite = faces.select(F.col("fid").alias("other"), F.col("vs").alias("ovs"))
    third = F.element_at(F.array_except("ovs", F.array("v1", "v2")), 1)
    return found.join(opposite, "other").select("fid", "v1", "v2", "other", third.alias("third"))


def ring_order(faces: DataFrame) -> DataFrame:
    """vid, ring: the vertices opposite each triangle corner as directed links, sorted by start (oriented ring as a linked list)."""
    tri = triangles(faces)
    turns = [tri.select(F.col(p).alias("vid"), F.struct(F.col(q).alias("src"), F.col(r).alias("dst")).alias("l")) for p, q, r in (("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b"))]
    return reduce(DataFrame.unionByName, turns).groupBy("vid").agg(F.sort_array(F.collect_list("l")).alias("ring"))


# Predicates


def boundary_edges(faces: DataFrame) -> DataFrame:
    return edge_counts(faces).where("nf = 1")


def manifold_edges(faces: DataFrame) -> DataFrame:
    return edge_counts(faces).where("nf = 2")


def nonmanifold_edges(faces: DataFrame) -> DataFrame:
    return edge_counts(faces).where("nf > 2")


def boundary_count(faces: DataFrame) -> DataFrame:
    """vid, boundaries: incident edges with one face."""
    return boundary_edges(faces).select(F.explode(F.array("v1", "v2")).alias("vid")).groupBy("vid").agg(F.count("*").alias("boundaries"))


def vertex_manifold(faces: DataFrame) -> DataFrame:
    """vid, manifold: at least two edges, all with two faces, and one fan around the vertex. Boundary vertices are not manifold.

    With every edge of two faces the fans are cycles of the link; a vertex has one fan exactly if walking the link from its least
    vertex meets all of its edges. Links are small, so the walk is an array expression."""
    e = edge_counts(faces)
    ends = e.select(F.explode(F.array("v1", "v2")).alias("vid"), "nf").groupBy("vid").agg(F.count("*").alias("valence"), F.every(F.col("nf") == 2).alias("all_two"))
    tri = triangles(faces)
    links = reduce(DataFrame.unionByName, [tri.select(F.col(p).alias("vid"), F.array(q, r).alias("l")) for p, q, r in (("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b"))])
    link = links.groupBy("vid").agg(F.collect_list("l").alias("link"))
    grow = lambda reached, _: F.aggregate("link", reached, lambda s, l: F.when(F.arrays_overlap(s, l), F.array_union(s, l)).otherwise(s))
    reached = F.aggregate(F.sequence(F.lit(1), F.size("link")), F.slice(F.element_at("link", 1), 1, 1), grow)
    return ends.join(link, "vid").select("vid", ((F.col("valence") >= 2) & F.col("all_two") & (F.size(reached) == F.col("valence"))).alias("manifold"))


def is_edge(faces: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (p, q) that are edges."""
    e = edge_counts(faces)
    return pairs.join(e, (F.least("p", "q") == e["v1"]) & (F.greatest("p", "q") == e["v2"]), "left_semi")


def is_face(faces: DataFrame, triples: DataFrame) -> DataFrame:
    """triples (p, q, r) that are faces in any order."""
    known = faces.select(F.array_sort("vs").alias("k"))
    return triples.withColumn("k", F.array_sort(F.array("p", "q", "r"))).join(known, "k", "left_semi").drop("k")


def edges_between(faces: DataFrame, pairs: DataFrame) -> DataFrame:
    """For pairs of faces (fid, other): the edges they share."""
    return face_neighbours(faces).join(pairs, ["fid", "other"]).select("fid", "other", "v1", "v2")


def face_normals(mesh: Mesh) -> DataFrame:
    """fid, nx, ny, nz of each face's first triangle."""
    t = corners(triangles(mesh.faces).where("part = 0"), mesh.vertices)
    n = g.triangle_normal(g.vec("a"), g.vec("b"), g.vec("c"))
    return t.select("fid", *[c.alias(f"n{k}") for k, c in zip("xyz", n, strict=True)])


def edge_normals(mesh: Mesh) -> DataFrame:
    """v1, v2, and both normals of edges with two faces."""
    e = edges(mesh.faces).where("size(faces) = 2").select("v1", "v2", F.element_at("faces", 1).alias("f1"), F.element_at("faces", 2).alias("f2"))
    n = face_normals(mesh)
    for i in "12":
        e = e.join(n.select(F.col("fid").alias(f"f{i}"), *[F.col(f"n{k}").alias(f"m{i}{k}") for k in "xyz"]), f"f{i}")
    return e


def sharp_vertices(mesh: Mesh, threshold: float) -> DataFrame:
    """vid, sharp: some edge is on a boundary or bends by |n1 x n2| over the threshold."""
    bend = edge_normals(mesh).select("v1", "v2", (g.norm(g.cross(g.vec("m1"), g.vec("m2"))) > threshold).alias("sharp"))
    flagged = edge_counts(mesh.faces).join(bend, ["v1", "v2"], "left").select("v1", "v2", ((F.col("nf") == 1) | F.coalesce("sharp", F.lit(False))).alias("sharp"))
    return flagged.select(F.explode(F.array("v1", "v2")).alias("vid"), "sharp").groupBy("vid").agg(F.bool_or("sharp").alias("sharp"))


def disconnected_vertices(mesh: Mesh) -> DataFrame:
    return mesh.vertices.join(mesh.faces.select(F.explode("vs").alias("vid")), "vid", "left_anti").select("vid")


def structure_errors(faces: DataFrame, edge_table: DataFrame) -> DataFrame:
    """kind, n: face sides without edge, and edges with an end outside one of their faces."""
    he = half_edges(faces)
    missing = he.join(edge_table, ["v1", "v2"], "left_anti").agg(F.lit("side_without_edge").alias("kind"), F.count("*").alias("n"))
    listed = edge_table.select("v1", "v2", F.explode("faces").alias("fid"))
    foreign = listed.join(he.select("fid", "v1", "v2"), ["fid", "v1", "v2"], "left_anti").agg(F.lit("end_outside_face").alias("kind"), F.count("*").alias("n"))
    return missing.unionByName(foreign)


def contractible_edges(mesh: Mesh) -> DataFrame:
    """v1, v2 whose ends share exactly as many neighbours as the edge has faces."""
    near = vertex_neighbours(mesh.faces)
    e = edge_counts(mesh.faces)
    one = near.select(F.col("vid").alias("v1"), F.col("other").alias("w"))
    two = near.select(F.col("vid").alias("v2"), F.col("other").alias("w"))
    common = e.join(one, "v1").join(two, ["v2", "w"]).groupBy("v1", "v2").agg(F.count("*").alias("common"))
    return e.join(common, ["v1", "v2"], "left").where(F.coalesce("common", F.lit(0)) == F.col("nf")).select("v1", "v2")


def turning_edges(mesh: Mesh, collapses: DataFrame) -> DataFrame:
    """v1, v2 of the collapses (v1, v2, and the new place x, y, z) that would turn a triangle around their ends over, or make it degenerate."""
    t = corners(triangles(mesh.faces).select("fid", "part", "a", "b", "c"), mesh.vertices)
    at = t.select(F.explode(F.array("a", "b", "c")).alias("end"), *t.columns)
    ends = collapses.select("v1", "v2", *[F.col(k).alias(f"n{k}") for k in "xyz"], F.explode(F.array("v1", "v2")).alias("end"))
    # Triangles with both ends go.
    other = F.when(F.col("end") == F.col("v1"), F.col("v2")).otherwise(F.col("v1"))
    stay = ends.join(at, "end").where(~F.array_contains(F.array("a", "b", "c"), other))
    moved = {c: tuple(F.when(F.col(c) == F.col("end"), F.col(f"n{k}")).otherwise(F.col(f"{c}{k}")) for k in "xyz") for c in "abc"}
    normal = lambda a, b, c: g.cross(g.sub(b, a), g.sub(c, a))
    was, new = normal(*(g.vec(c) for c in "abc")), normal(*(moved[c] for c in "abc"))
    return stay.where(g.dot(was, new) <= 0).select("v1", "v2").distinct()


def half_space(mesh: Mesh, normal: tuple[float, float, float], offset: float) -> DataFrame:
    """Clipped triangles: (fid, part, ax..cz) of what lies where normal.p >= offset; triangles across the plane are split."""
    t = corners(triangles(mesh.faces), mesh.vertices)
    side = lambda p: g.dot(p, tuple(F.lit(float(k)) for k in normal)) - F.lit(float(offset))
    point = lambda p: F.struct(*[c.alias(k) for k, c in zip("xyz", p, strict=True)])
    t = t.withColumns({f"s{c}": side(g.vec(c)) for c in "abc"})

    def cut(p: str, q: str) -> Column:
        w = F.col(f"s{p}") / (F.col(f"s{p}") - F.col(f"s{q}"))
        return F.struct(*[(F.col(f"{p}{k}") + w * (F.col(f"{q}{k}") - F.col(f"{p}{k}"))).alias(k) for k in "xyz"])

    # The polygon's points in order: each kept corner, and a point on each side that crosses.
    empty = F.array().cast("array<struct<x:double,y:double,z:double>>")
    parts = []
    for p, q in (("a", "b"), ("b", "c"), ("c", "a")):
        parts.append(F.when(F.col(f"s{p}") >= 0, F.array(point(g.vec(p)))).otherwise(empty))
        parts.append(F.when((F.col(f"s{p}") >= 0) != (F.col(f"s{q}") >= 0), F.array(cut(p, q))).otherwise(empty))
    t = t.select("fid", F.concat(*parts).alias("ring")).where("size(ring) >= 3")
    fan = F.transform(F.sequence(F.lit(1), F.size("ring") - 2), lambda i: F.struct((i - 1).alias("part"), F.element_at("ring", 1).alias("a"), F.element_at("ring", (i + 1).cast("int")).alias("b"), F.element_at("ring", (i + 2).cast("int")).alias("c")))
    t = t.select("fid", F.explode(fan).alias("t"))
    return t.select("fid", F.col("t.part").alias("part"), *[F.col(f"t.{c}.{k}").alias(f"{c}{k}") for c in "abc" for k in "xyz"])


def constraint_violations(moved: DataFrame, original: DataFrame, fixed: DataFrame) -> DataFrame:
    """Fixed vertices (column vid) that are gone or have moved."""
    was = original.join(fixed.select("vid"), "vid", "left_semi").select("vid", *[F.col(k).alias(f"p{k}") for k in "xyz"])
    both = was.join(moved.select("vid", *[F.col(k).alias(f"q{k}") for k in "xyz"]), "vid", "left")
    return both.where(F.col("qx").isNull() | (g.distance(g.vec("p"), g.vec("q")) > 0)).select("vid")


# Whole-mesh projections


def bounds(vertices: DataFrame) -> DataFrame:
    """One row: lx, hx, ... and widest."""
    b = vertices.agg(*[f(k).alias(f"{p}{k}") for k in "xyz" for p, f in (("l", F.min), ("h", F.max))])
    return b.withColumn("widest", F.greatest(*[F.col(f"h{k}") - F.col(f"l{k}") for k in "xyz"]))


def with_bounds(vertices: DataFrame) -> DataFrame:
    """The one row of bounds beside every vertex."""
    return vertices.join(F.broadcast(bounds(vertices)))


def rescale(vertices: DataFrame) -> DataFrame:
    return with_bounds(vertices).select("vid", *[g.rescaled(F.col(k), F.col(f"l{k}"), F.col("widest")).alias(k) for k in "xyz"])


def quantise(vertices: DataFrame, bits: int) -> DataFrame:
    """vid, qx, qy, qz and the factors to go back: factor, lx, ly, lz."""
    f = g.quantise_factor(bits, F.col("widest"))
    return with_bounds(vertices).withColumn("factor", f).select("vid", *[g.quantised(F.col(k), F.col(f"l{k}"), F.col("factor")).alias(f"q{k}") for k in "xyz"], "factor", "lx", "ly", "lz")


def unquantise(quantised: DataFrame) -> DataFrame:
    return quantised.select("vid", *[g.unquantised(F.col(f"q{k}"), F.col(f"l{k}"), F.col("factor")).alias(k) for k in "xyz"])


def diagonal(vertices: DataFrame) -> DataFrame:
    d = [F.col(f"h{k}") - F.col(f"l{k}") for k in "xyz"]
    return bounds(vertices).select(g.norm(tuple(d)).alias("diagonal"))


def add_noise(vertices: DataFrame, magnitude: float, seed: int = 10) -> DataFrame:
    """Uniform noise of up to the diagonal times the magnitude to either side, a function of seed and vertex."""
    r = lambda k: F.pmod(F.xxhash64("vid", F.lit(seed), F.lit(k)), F.lit(1 << 30)) / F.lit(float(1 << 29)) - 1.0
    d = vertices.join(F.broadcast(diagonal(vertices)))
    return d.select("vid", *[(F.col(k) + r(k) * F.col("diagonal") * magnitude).alias(k) for k in "xyz"])


def edge_lines(mesh: Mesh) -> DataFrame:
    return with_ends(edge_counts(mesh.faces).select("v1", "v2"), mesh.vertices)


def dense_ids(mesh: Mesh) -> Mesh:
    """Compacted ids in the old order, by counts of id ranges (no sort of all rows in one task). Vertices whose ids are 0..n-1 already keep them."""
    ids = mesh.vertices.agg(F.count("*").alias("n"), F.min("vid").alias("lo"), F.max("vid").alias("hi")).first()
    if ids.n and ids.lo == 0 and ids.hi == ids.n - 1:
        ranked = dense_rank(mesh.faces.select("fid", "vs"), "fid")
        return Mesh(mesh.vertices.select("vid", "x", "y", "z"), ranked.select(F.col("rank").alias("fid"), "vs"))
    new = dense_rank(mesh.vertices, "vid")
    at = mesh.faces.select("fid", F.posexplode("vs").alias("pos", "vid")).join(new.select("vid", "rank"), "vid")
    faces = at.groupBy("fid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "rank"))), lambda s: s["rank"]).alias("vs"))
    ranked = dense_rank(faces, "fid")
    return Mesh(new.select(F.col("rank").alias("vid"), "x", "y", "z"), ranked.select(F.col("rank").alias("fid"), "vs"))


def dense_rank(df: DataFrame, key: str, width: int = 1 << 16) -> DataFrame:
    """Adds rank: position from 0 in the order of a unique integer key. Ranges of the key are counted, the counts summed up, and rows ranked inside their range."""
    from pyspark.sql import Window

    ranged = df.withColumn("__range", F.floor(F.col(key) / width))
    sums = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = sums.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(key))
    return ranged.join(before, "__range").withColumn("rank", (F.col("__before") + inside - 1).cast("long")).drop("__range", "__before")


def append(one: Mesh, two: Mesh) -> Mesh:
    """Both meshes, the second's ids after the first's."""
    v = one.vertices.agg(F.coalesce(F.max("vid"), F.lit(-1)).alias("v0"))
    f = one.faces.agg(F.coalesce(F.max("fid"), F.lit(-1)).alias("f0"))
    shift = F.broadcast(v.join(f))
    points = two.vertices.join(shift).select((F.col("vid") + F.col("v0") + 1).alias("vid"), "x", "y", "z")
    faces = two.faces.join(shift).select((F.col("fid") + F.col("f0") + 1).alias("fid"), F.transform("vs", lambda x: x + F.col("v0") + 1).alias("vs"))
    return Mesh(one.vertices.select("vid", "x", "y", "z").unionByName(points), one.faces.select("fid", "vs").unionByName(faces))


def merge_points(mesh: Mesh, tolerance: float = 0.0) -> Mesh:
    """Vertices of one place (one cell of the tolerance's size) become the one with the least id."""
    cell = [F.floor(F.col(k) / tolerance) if tolerance > 0 else F.col(k) for k in "xyz"]
    keyed = mesh.vertices.select("vid", *[c.alias(f"k{i}") for i, c in enumerate(cell)])
    to = keyed.join(keyed.groupBy("k0", "k1", "k2").agg(F.min("vid").alias("to")), ["k0", "k1", "k2"]).select("vid", "to")
    at = mesh.faces.select("fid", F.posexplode("vs").alias("pos", "vid")).join(to, "vid")
    faces = at.groupBy("fid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "to"))), lambda s: s["to"]).alias("vs"))
    kept = mesh.vertices.join(to.select(F.col("to").alias("vid")).distinct(), "vid", "left_semi")
    return Mesh(kept, faces.where(F.size(F.array_distinct("vs")) >= 3))
