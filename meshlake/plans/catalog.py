"""Registered queries of the mesh and voxel engine, each with its SQL where SQL can express it.

Floating results are rounded, ids are BIGINT on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.functions import geometry as g
from meshlake.functions.state import written
from meshlake.operators import clustering, curvature, graph, measures, remesh, volume
from meshlake.operators import mesh as m

from . import fixtures as fx
from .fixtures import grid_sql, point_sql, voxel_sql

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r(c: str | Column, digits: int = 6, name: str | None = None) -> Column:
    """Rounded, without negative zero."""
    own = name or (c if isinstance(c, str) else None)
    col = F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)
    return col.alias(own) if own else col


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[r(c, digits) if t == "double" else (F.col(c).cast("long").alias(c) if t in ("int", "bigint", "tinyint") else F.col(c)) for c, t in df.dtypes])


# Quality and reports


@query(grid_sql("SELECT count(*) AS cells, round(min(area), 6) + 0.0 AS area_min, round(avg(area), 6) + 0.0 AS area_avg, round(min(quality), 6) + 0.0 AS q_min, round(avg(quality), 6) + 0.0 AS q_avg, round(100.0 * CAST(sum(CASE WHEN min_angle < 30 THEN 1 ELSE 0 END) AS DOUBLE) / (3.0 * CAST(count(*) AS DOUBLE)), 6) + 0.0 AS p30 FROM q"))
def triangle_stats(spark, sf):
    return rounded(measures.triangle_stats(fx.grid_mesh(spark, sf)))


@query(grid_sql("SELECT fid, round(area, 6) + 0.0 AS area, round(min_angle, 6) + 0.0 AS min_angle, round(quality, 6) + 0.0 AS quality, round(l1, 6) + 0.0 AS l1, round(l2, 6) + 0.0 AS l2, round(l3, 6) + 0.0 AS l3 FROM q"))
def triangle_table(spark, sf):
    return rounded(measures.triangle_table(fx.grid_mesh(spark, sf)).select("fid", "area", "min_angle", "quality", "l1", "l2", "l3"))


@query(grid_sql("SELECT b.bin, CAST(count(quality) AS BIGINT) AS triangles FROM (SELECT CAST(range AS BIGINT) AS bin FROM range(100)) b LEFT JOIN q ON least(CAST(floor(quality * 100) AS BIGINT), 99) = b.bin GROUP BY b.bin"))
def quality_hist(spark, sf):
    return measures.quality_histogram(fx.grid_mesh(spark, sf))


@query(grid_sql("""SELECT (SELECT count(*) FROM v) AS vertices, (SELECT count(*) FROM f) AS faces, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM e WHERE nf = 1) AS boundary_edges,
    (SELECT count(*) FROM e WHERE nf > 2) AS nonmanifold_edges, (SELECT count(*) FROM v) - (SELECT count(*) FROM e) + (SELECT count(*) FROM f) AS euler,
    (SELECT round(100.0 * avg(CASE WHEN n <> 6 THEN 1.0 ELSE 0.0 END), 6) + 0.0 FROM (SELECT vid, count(*) AS n FROM nb GROUP BY vid)) AS irregular_percent,
    round(lx, 6) + 0.0 AS min_x, round(hx, 6) + 0.0 AS max_x, round(lz, 6) + 0.0 AS min_z, round(hz, 6) + 0.0 AS max_z FROM bb"""))
def mesh_report(spark, sf):
    return rounded(measures.mesh_report(fx.grid_mesh(spark, sf)).select("vertices", "faces", "edges", "boundary_edges", "nonmanifold_edges", "euler", "irregular_percent", "min_x", "max_x", "min_z", "max_z"))


_RAMP = "1.0 - quality * greatest(0.0, least(((0.3 + 0.7 * quality) * 6.0 + {0}) % 6.0, 4.0 - ((0.3 + 0.7 * quality) * 6.0 + {0}) % 6.0, 1.0))"


@query(grid_sql(f"SELECT fid, {', '.join(f'round({_RAMP.format(n)}, 6) + 0.0 AS {c}' for n, c in (('5.0', 'red'), ('3.0', 'green'), ('1.0', 'blue')))} FROM q"))
def colour_ramp(spark, sf):
    """The colours of the faces' qualities."""
    t = measures.triangle_table(fx.grid_mesh(spark, sf))
    return rounded(t.select("fid", *[c.alias(n) for c, n in zip(g.ramp_colour(F.col("quality")), ("red", "green", "blue"), strict=True)]))


# Edges and adjacency


@query(grid_sql("SELECT v1, v2, nf FROM e"))
def edge_table(spark, sf):
    return m.edge_counts(fx.grid_mesh(spark, sf).faces)


@query(grid_sql("SELECT v1, v2, round(sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z)), 6) + 0.0 AS length FROM e JOIN v p ON p.vid = v1 JOIN v q ON q.vid = v2"))
def edge_lengths(spark, sf):
    return rounded(m.edge_lengths(fx.grid_mesh(spark, sf)))


@query(grid_sql("SELECT round(avg(sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z))), 6) + 0.0 AS average FROM e JOIN v p ON p.vid = v1 JOIN v q ON q.vid = v2"))
def avg_edge_length(spark, sf):
    return rounded(measures.average_edge_length(fx.grid_mesh(spark, sf)))


@query(grid_sql("SELECT v1, v2, nf FROM e WHERE nf = 1"))
def boundary_edges(spark, sf):
    return m.boundary_edges(fx.grid_mesh(spark, sf).faces)


@query(grid_sql("SELECT v1, v2, nf FROM e WHERE nf = 2"))
def manifold_edges(spark, sf):
    return m.manifold_edges(fx.grid_mesh(spark, sf).faces)


_FINNED = "fin AS (SELECT * FROM he UNION ALL SELECT -1 - vid, vid, vid + 1 FROM v WHERE i < w - 1 AND j % 16 = 3), e2 AS (SELECT least(src, dst) AS v1, greatest(src, dst) AS v2, count(*) AS nf FROM fin GROUP BY 1, 2)"


def finned_faces(spark, sf):
    """The grid with a third face on the row edges of every sixteenth row."""
    p = fx.grid_points(spark, sf)
    top = F.lit(1 << 40)
    fins = p.where((F.col("i") < F.col("w") - 1) & (F.col("j") % 16 == 3)).select((-1 - F.col("vid")).alias("fid"), F.array(F.col("vid"), F.col("vid") + 1, F.col("vid") + top).alias("vs"))
    return fx.grid_mesh(spark, sf).faces.unionByName(fins)


@query(grid_sql("SELECT v1, v2, nf FROM e2 WHERE nf > 2", _FINNED))
def nonmanifold_edges(spark, sf):
    return m.nonmanifold_edges(finned_faces(spark, sf))


@query(grid_sql("SELECT vid, count(*) AS boundaries FROM (SELECT v1 AS vid FROM e WHERE nf = 1 UNION ALL SELECT v2 FROM e WHERE nf = 1) GROUP BY vid"))
def vertex_boundaries(spark, sf):
    return m.boundary_count(fx.grid_mesh(spark, sf).faces)


@query(grid_sql("SELECT vid, i > 0 AND j > 0 AND i < w - 1 AND j < w - 1 AS manifold FROM v"))
def vertex_manifold(spark, sf):
    return m.vertex_manifold(fx.grid_mesh(spark, sf).faces)


@query(grid_sql("SELECT vid, other FROM nb"))
def vertex_neighbours(spark, sf):
    return m.vertex_neighbours(fx.grid_mesh(spark, sf).faces)


@query(grid_sql("SELECT a AS vid, fid FROM f UNION ALL SELECT b, fid FROM f UNION ALL SELECT c, fid FROM f"))
def vertex_faces(spark, sf):
    return m.vertex_faces(fx.grid_mesh(spark, sf).faces)


_SIDED = "h AS MATERIALIZED (SELECT fid, least(src, dst) AS v1, greatest(src, dst) AS v2 FROM he)"


@query(grid_sql("SELECT p.fid, q.fid AS other, v1, v2 FROM h p JOIN h q USING (v1, v2)", _SIDED))
def face_neighbours(spark, sf):
    return m.face_neighbours(fx.grid_mesh(spark, sf).faces).select("fid", "other", "v1", "v2")


@query(grid_sql("SELECT v1 AS vid FROM e WHERE nf = 1 UNION SELECT v2 FROM e WHERE nf = 1 UNION SELECT nb.other FROM nb JOIN e ON nb.vid IN (e.v1, e.v2) WHERE e.nf = 1"))
def one_ring(spark, sf):
    mesh = fx.grid_mesh(spark, sf)
    rim = m.boundary_edges(mesh.faces).select(F.explode(F.array("v1", "v2")).alias("vid")).distinct()
    return m.one_ring(mesh.faces, rim)


@query(grid_sql("SELECT seed, vid AS item, min(h) AS hops FROM rings GROUP BY seed, vid", "r0 AS (SELECT vid AS seed, vid, 0 AS h FROM v), r1 AS (SELECT seed, other AS vid, 1 AS h FROM r0 JOIN nb USING (vid)), r2 AS (SELECT DISTINCT seed, other AS vid, 2 AS h FROM r1 JOIN nb USING (vid)), r3 AS (SELECT DISTINCT seed, other AS vid, 3 AS h FROM r2 JOIN nb USING (vid)), rings AS (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3)"))
def n_ring(spark, sf):
    mesh = fx.grid_mesh(spark, sf)
    near = m.vertex_neighbours(mesh.faces).withColumnRenamed("vid", "item")
    return graph.n_ring(near, mesh.vertices.select(F.col("vid").alias("item")), 3)


@query(grid_sql("SELECT x.fid, v1, v2, y.fid AS other, f.a + f.b + f.c - v1 - v2 AS third FROM h x JOIN h y USING (v1, v2) JOIN f ON f.fid = y.fid WHERE x.fid <> y.fid", _SIDED))
def across_edges(spark, sf):
    faces = fx.grid_mesh(spark, sf).faces
    return m.across(faces, m.half_edges(faces).select("fid", "v1", "v2"))


@query(grid_sql("SELECT vid, vid + w AS q FROM v WHERE j < w - 1"))
def edge_lookup(spark, sf):
    p = fx.grid_points(spark, sf)
    asked = p.select("vid", F.col("vid").alias("p"), F.explode(F.array(F.col("vid") + F.col("w"), F.col("vid") + F.col("w") + 1)).alias("q"))
    return m.is_edge(fx.grid_mesh(spark, sf).faces, asked).select("vid", "q")


@query(grid_sql("SELECT vid AS p FROM v WHERE i < w - 1 AND j < w - 1"))
def face_lookup(spark, sf):
    p = fx.grid_points(spark, sf)
    asked = p.select(F.col("vid").alias("p"), (F.col("vid") + F.col("w")).alias("q"), (F.col("vid") + 1).alias("r"))
    return m.is_face(fx.grid_mesh(spark, sf).faces, asked).select("p")


@query(grid_sql("SELECT 'side_without_edge' AS kind, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'end_outside_face', CAST(0 AS BIGINT)"))
def structure_check(spark, sf):
    faces = fx.grid_mesh(spark, sf).faces
    return m.structure_errors(faces, m.edges(faces))


@query(grid_sql("SELECT e.v1, e.v2 FROM e JOIN nb x ON x.vid = v1 JOIN nb y ON y.vid = v2 AND y.other = x.other GROUP BY e.v1, e.v2, e.nf HAVING count(*) = e.nf"))
def contractible_edges(spark, sf):
    return m.contractible_edges(fx.grid_mesh(spark, sf))


@query(grid_sql("SELECT vid FROM v WHERE i >= w - 2 AND j >= w - 1"))
def disconnected_vertices(spark, sf):
    p = fx.grid_points(spark, sf)
    last = F.col("w") - 2
    faces = fx.grid_triangles(p).join(p.where((F.col("i") >= last) & (F.col("j") == F.col("w") - 1)).select(F.col("vid").alias("gone")), F.array_contains(F.array("a", "b", "c"), F.col("gone")), "left_anti")
    return m.disconnected_vertices(m.Mesh(p, faces.select("fid", F.array("a", "b", "c").alias("vs"))))


# Areas, normals, valences


@query(grid_sql("SELECT fid, round(area, 6) + 0.0 AS area, round((ax+bx+cx)/3, 6) + 0.0 AS cx, round((ay+by_+cy)/3, 6) + 0.0 AS cy, round((az+bz+cz)/3 + 0.00000012345, 6) + 0.0 AS cz FROM (SELECT fid, area, ax, bx, k_cx AS cx, ay, by_, k_cy AS cy, az, bz, k_cz AS cz FROM (SELECT fid, area, ax, bx, cx AS k_cx, ay, by_, cy AS k_cy, az, bz, cz AS k_cz FROM t))"))
def face_areas(spark, sf):
    # Centres are thirds of seven-digit numbers: the shift keeps them off rounding ties.
    return rounded(measures.face_areas(fx.grid_mesh(spark, sf)).withColumn("cz", F.col("cz") + 0.00000012345))


@query(grid_sql("SELECT vid, round(area, 6) + 0.0 AS area FROM va"))
def vertex_area(spark, sf):
    return rounded(measures.vertex_areas(fx.grid_mesh(spark, sf)))


@query(grid_sql("SELECT fid, round(nx, 6) + 0.0 AS nx, round(ny, 6) + 0.0 AS ny, round(nz, 6) + 0.0 AS nz FROM tn"))
def face_normals(spark, sf):
    return rounded(m.face_normals(fx.grid_mesh(spark, sf)))


@query(grid_sql("SELECT vid, round(sx / n, 6) + 0.0 AS nx, round(sy / n, 6) + 0.0 AS ny, round(sz / n, 6) + 0.0 AS nz FROM (SELECT *, sqrt(sx*sx+sy*sy+sz*sz) AS n FROM (SELECT vid, -sum(rx) AS sx, -sum(ry) AS sy, -sum(rz) AS sz FROM (SELECT a AS vid, rx, ry, rz FROM t UNION ALL SELECT b, rx, ry, rz FROM t UNION ALL SELECT c, rx, ry, rz FROM t) GROUP BY vid))"))
def vertex_normal(spark, sf):
    return rounded(measures.vertex_normals(fx.grid_mesh(spark, sf)))


@query(grid_sql("SELECT vid, x.n AS edges, y.n AS faces FROM (SELECT vid, count(*) AS n FROM nb GROUP BY vid) x JOIN (SELECT vid, count(*) AS n FROM (SELECT a AS vid FROM f UNION ALL SELECT b FROM f UNION ALL SELECT c FROM f) GROUP BY vid) y USING (vid)"))
def valences(spark, sf):
    return measures.valences(fx.grid_mesh(spark, sf).faces)


_VALENCE = "fv AS (SELECT src AS vid, count(*) AS valence FROM he GROUP BY 1), vh AS (SELECT valence, count(*) AS vertices FROM fv GROUP BY 1)"


@query(grid_sql("SELECT valence, vertices FROM vh", _VALENCE))
def valence_hist(spark, sf):
    return measures.valence_histogram(fx.grid_mesh(spark, sf).faces)


@query(grid_sql("SELECT round(-sum(p * log2(p)), 6) + 0.0 AS entropy FROM (SELECT CAST(vertices AS DOUBLE) / (SELECT CAST(sum(vertices) AS DOUBLE) FROM vh) AS p FROM vh)", _VALENCE))
def valence_entropy(spark, sf):
    return rounded(measures.valence_entropy(fx.grid_mesh(spark, sf).faces))


@query(grid_sql("SELECT vid, bool_or(sharp) AS sharp FROM (SELECT unnest([v1, v2]) AS vid, sharp FROM ed) GROUP BY vid", """
    hn AS (SELECT least(src, dst) AS v1, greatest(src, dst) AS v2, fid FROM he),
    fp AS (SELECT v1, v2, min(fid) AS f1, max(fid) AS f2, count(*) AS nf FROM hn GROUP BY 1, 2),
    ed AS (SELECT v1, v2, nf = 1 OR sqrt((p.ny*q.nz-p.nz*q.ny)*(p.ny*q.nz-p.nz*q.ny)+(p.nz*q.nx-p.nx*q.nz)*(p.nz*q.nx-p.nx*q.nz)+(p.nx*q.ny-p.ny*q.nx)*(p.nx*q.ny-p.ny*q.nx)) > 0.9 AS sharp
           FROM fp JOIN tn p ON p.fid = f1 JOIN tn q ON q.fid = f2)"""))
def sharp_vertices(spark, sf):
    return m.sharp_vertices(fx.grid_mesh(spark, sf), 0.9)


# Whole-mesh projections


@query(grid_sql("SELECT vid, round((x-lx)/widest-0.5, 6) + 0.0 AS x, round((y-ly)/widest-0.5, 6) + 0.0 AS y, round((z-lz)/widest-0.5, 6) + 0.0 AS z FROM v, bb"))
def rescale(spark, sf):
    return rounded(m.rescale(fx.grid_mesh(spark, sf).vertices))


_QUANT = "qz AS (SELECT vid, CAST(floor((x-lx)*f+0.5) AS BIGINT) AS qx, CAST(floor((y-ly)*f+0.5) AS BIGINT) AS qy, CAST(floor((z-lz)*f+0.5) AS BIGINT) AS qz, f, lx, ly, lz FROM v, (SELECT *, 1023.0/widest AS f FROM bb))"


@query(grid_sql("SELECT vid, qx, qy, qz FROM qz", _QUANT))
def quantize(spark, sf):
    return m.quantise(fx.grid_mesh(spark, sf).vertices, 10).select("vid", "qx", "qy", "qz")


@query(grid_sql("SELECT vid, round(qx/f+lx, 6) + 0.0 AS x, round(qy/f+ly, 6) + 0.0 AS y, round(qz/f+lz, 6) + 0.0 AS z FROM qz", _QUANT))
def unquantize(spark, sf):
    return rounded(m.unquantise(m.quantise(fx.grid_mesh(spark, sf).vertices, 10)))


@query(grid_sql("SELECT round(sqrt((hx-lx)*(hx-lx)+(hy-ly)*(hy-ly)+(hz-lz)*(hz-lz)), 6) + 0.0 AS diagonal FROM bb"))
def bbox_diagonal(spark, sf):
    return rounded(m.diagonal(fx.grid_mesh(spark, sf).vertices))


@query(grid_sql("SELECT round(sum(area), 4) + 0.0 AS surface, round(sum((ax*(by_*cz-bz*cy)+ay*(bz*cx-bx*cz)+az*(bx*cy-by_*cx))/6.0), 3) + 0.0 AS signed_volume FROM t"))
def signed_volume(spark, sf):
    p = measures.volume_properties(fx.grid_mesh(spark, sf))
    return p.select(r("surface", 4), r("signed_volume", 3))


@query(grid_sql("SELECT e.v1, e.v2, p.x AS px, p.z AS pz, q.x AS qx, q.z AS qz FROM e JOIN v p ON p.vid = v1 JOIN v q ON q.vid = v2"))
def edge_lines(spark, sf):
    return m.edge_lines(fx.grid_mesh(spark, sf)).select("v1", "v2", "px", "pz", "qx", "qz")


@query(grid_sql("SELECT count(*) AS vertices, CAST(0 AS BIGINT) AS outside FROM v"))
def noise(spark, sf):
    """Vertices, and those that noise has moved further than its magnitude allows."""
    v = fx.grid_mesh(spark, sf).vertices
    d = m.diagonal(v)
    j = m.add_noise(v, 0.01).join(v.select("vid", *[F.col(k).alias(f"o{k}") for k in "xyz"]), "vid").join(F.broadcast(d))
    far = F.greatest(*[F.abs(F.col(k) - F.col(f"o{k}")) for k in "xyz"]) > F.col("diagonal") * 0.0100001
    return j.agg(F.count("*").alias("vertices"), F.sum(far.cast("long")).alias("outside"))


@query(grid_sql("SELECT fid, CAST(0 AS BIGINT) AS part, a, b, c FROM f"))
def fan_triangulate(spark, sf):
    return m.triangles(fx.grid_mesh(spark, sf).faces).withColumn("part", F.col("part").cast("long"))


@query(grid_sql("SELECT CAST(floor(vid / w) AS BIGINT) * w + vid % w AS vid, part, a, b, c FROM (SELECT vid, w, CAST(unnest([0, 1]) AS BIGINT) AS part, vid AS a, unnest([vid + 1, vid + w + 1]) AS b, unnest([vid + w + 1, vid + w]) AS c FROM v WHERE i < w - 1 AND j < w - 1)"))
def quad_triangulate(spark, sf):
    p = fx.grid_points(spark, sf).where("i < w - 1 AND j < w - 1")
    quads = p.select(F.col("vid").alias("fid"), F.array(F.col("vid"), F.col("vid") + 1, F.col("vid") + F.col("w") + 1, F.col("vid") + F.col("w")).alias("vs"))
    return m.triangles(quads).select(F.col("fid").alias("vid"), F.col("part").cast("long").alias("part"), "a", "b", "c")


@query(grid_sql("SELECT round(sum(area), 4) + 0.0 AS area FROM t WHERE fid IN (SELECT fid FROM t WHERE ay >= 10 AND by_ >= 10 AND cy >= 10)"))
def halfspace_clip(spark, sf):
    t = m.lengths(m.half_space(fx.grid_mesh(spark, sf), (0, 1, 0), 10.0))
    return t.agg(r(F.sum("area"), 4, "area"))


@query(grid_sql("SELECT vid, rank FROM (SELECT vid, CAST(row_number() OVER (ORDER BY vid) - 1 AS BIGINT) AS rank FROM v WHERE i % 3 <> 1)"))
def dense_ids(spark, sf):
    return m.dense_rank(fx.grid_points(spark, sf).where("i % 3 <> 1"), "vid").select("vid", "rank")


# Running sums, slices, sampling


@query(grid_sql("SELECT fid, round(sum(area) OVER (ORDER BY fid ROWS UNBOUNDED PRECEDING), 4) + 0.0 AS upto FROM t"))
def cumulative_area(spark, sf):
    t = m.lengths(m.corners(m.triangles(fx.grid_mesh(spark, sf).faces), fx.grid_mesh(spark, sf).vertices)).select("fid", "area")
    return measures.cumulative(t, "fid", "area").select("fid", r("upto", 4))


@query(grid_sql("SELECT vid AS item, least(CAST(floor(before / (SELECT CAST(count(*) AS DOUBLE) FROM v) * 8) AS BIGINT), 7) AS slice FROM it JOIN (SELECT bucket, sum(bw) OVER (ORDER BY bucket) - bw AS before FROM bk) USING (bucket)",
    "it AS (SELECT vid, least(CAST(floor(x / (SELECT widest FROM bb) * 10000) AS BIGINT), 9999) AS bucket FROM v), bk AS (SELECT bucket, CAST(count(*) AS DOUBLE) AS bw FROM it GROUP BY bucket)"))
def area_slices(spark, sf):
    items = fx.grid_mesh(spark, sf).vertices.select(F.col("vid").alias("item"), "x", "y", "z", F.lit(1.0).alias("w"))
    return measures.weighted_slices(items, 8).select("item", F.col("slice").cast("long").alias("slice"))


@query(grid_sql("SELECT CAST(5000 AS BIGINT) AS samples, CAST(5000 AS BIGINT) AS distinct_samples, CAST(0 AS BIGINT) AS outside"))
def sample_surface(spark, sf):
    s = measures.sample_surface(fx.grid_mesh(spark, sf), 5000)
    w = fx.grid_points(spark, sf).agg(F.max("x").alias("w"))
    out = (F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") > F.col("w")) | (F.col("y") > F.col("w"))
    return s.join(F.broadcast(w)).agg(F.count("*").alias("samples"), F.countDistinct("sample").alias("distinct_samples"), F.sum(out.cast("long")).alias("outside"))


# Quadrics


_FQ = "fq AS (SELECT fid, a, b, c, 0.5*sqrt(rx*rx+ry*ry+rz*rz) AS ar, nx, ny, nz, -(nx*ax+ny*ay+nz*az) AS d FROM tn)"
_Q10 = ["nx*nx", "nx*ny", "nx*nz", "nx*d", "ny*ny", "ny*nz", "ny*d", "nz*nz", "nz*d", "d*d"]


@query(grid_sql(f"SELECT fid, {', '.join(f'round(ar*{p}, 4) + 0.0 AS q{i}' for i, p in enumerate(_Q10))} FROM fq", _FQ))
def face_quadrics(spark, sf):
    return rounded(measures.face_quadrics(fx.grid_mesh(spark, sf)), 4)


_VQ = _FQ + f", vq AS (SELECT vid, {', '.join(f'sum(ar*{p}) AS q{i}' for i, p in enumerate(_Q10))} FROM (SELECT unnest([a, b, c]) AS vid, ar, nx, ny, nz, d FROM fq) GROUP BY vid)"


@query(grid_sql(f"SELECT vid, {', '.join(f'round(q{i}, 3) + 0.0 AS q{i}' for i in range(10))} FROM vq", _VQ))
def vertex_quadrics(spark, sf):
    return rounded(measures.vertex_quadrics(fx.grid_mesh(spark, sf)), 3)


@query(grid_sql("SELECT v.vid, round(q0*x*x+2*q1*x*y+2*q2*x*(z+1)+2*q3*x+q4*y*y+2*q5*y*(z+1)+2*q6*y+q7*(z+1)*(z+1)+2*q8*(z+1)+q9, 3) + 0.0 AS err FROM vq JOIN v USING (vid)", _VQ))
def quadric_eval(spark, sf):
    """Quadric error one unit above each vertex."""
    mesh = fx.grid_mesh(spark, sf)
    j = measures.vertex_quadrics(mesh).join(mesh.vertices, "vid")
    return j.select("vid", r(g.quadric_value([F.col(q) for q in g.QUADRIC], (F.col("x"), F.col("y"), F.col("z") + 1.0)), 3, "err"))


# Item weights and clusters


@query(grid_sql("SELECT vid AS item, round(least(greatest(area, mean / 2.0), mean * 2.0), 6) + 0.0 AS w FROM va, (SELECT avg(area) AS mean FROM va)"))
def item_weights_clamped(spark, sf):
    return rounded(measures.item_weights(measures.vertex_areas(fx.grid_mesh(spark, sf)), None, 0.0, 2.0))


_BLOCKS = "lab AS (SELECT vid AS item, CAST(floor(j / 8) * 1000 + floor(i / 8) AS BIGINT) AS cluster, area AS w, area*x AS sx, area*y AS sy, area*z AS sz FROM v JOIN va USING (vid)), acc AS (SELECT cluster, count(*) AS n, sum(w) AS w, sum(sx) AS sx, sum(sy) AS sy, sum(sz) AS sz FROM lab GROUP BY cluster)"


def _items(spark, sf):
    mesh = fx.grid_mesh(spark, sf)
    return clustering.place_items(mesh.vertices.withColumnRenamed("vid", "item"), measures.vertex_areas(mesh).select(F.col("vid").alias("item"), F.col("area").alias("w")))


def _pairs(faces):
    return m.vertex_neighbours(faces).withColumnRenamed("vid", "item")


@query(grid_sql("SELECT cluster, n, round(w, 4) + 0.0 AS w, round(sx, 3) + 0.0 AS sx, round(sy, 3) + 0.0 AS sy, round(sz, 4) + 0.0 AS sz FROM acc", _BLOCKS))
def cluster_stats(spark, sf):
    s = clustering.cluster_sums(_items(spark, sf), fx.block_labels(fx.grid_points(spark, sf)), clustering.Isotropic())
    return s.select("cluster", "n", r("w", 4), r("sx", 3), r("sy", 3), r("sz", 4))


@query(grid_sql("SELECT round(sum(-(sx*sx+sy*sy+sz*sz)/w) / 1000.0, 3) + 0.0 AS energy FROM acc", _BLOCKS))
def global_energy(spark, sf):
    return clustering.global_energy(_items(spark, sf), fx.block_labels(fx.grid_points(spark, sf)), clustering.Isotropic()).select(r(F.col("energy") / 1000.0, 3, "energy"))


@query(grid_sql("""SELECT DISTINCT item, a, b, round(-(pa.sx*pa.sx+pa.sy*pa.sy+pa.sz*pa.sz)/pa.w-(pb.sx*pb.sx+pb.sy*pb.sy+pb.sz*pb.sz)/pb.w
    +((pa.sx-i.sx)*(pa.sx-i.sx)+(pa.sy-i.sy)*(pa.sy-i.sy)+(pa.sz-i.sz)*(pa.sz-i.sz))/(pa.w-i.w)+((pb.sx+i.sx)*(pb.sx+i.sx)+(pb.sy+i.sy)*(pb.sy+i.sy)+(pb.sz+i.sz)*(pb.sz+i.sz))/(pb.w+i.w), 3) + 0.0 AS gain
    FROM (SELECT DISTINCT l1.item, l1.cluster AS a, l2.cluster AS b FROM nb JOIN lab l1 ON l1.item = vid JOIN lab l2 ON l2.item = other WHERE l1.cluster <> l2.cluster) mv
    JOIN lab i USING (item) JOIN acc pa ON pa.cluster = a JOIN acc pb ON pb.cluster = b WHERE pa.n > 1""", _BLOCKS))
def boundary_gains(spark, sf):
    mesh = fx.grid_mesh(spark, sf)
    return clustering.move_gains(_items(spark, sf), _pairs(mesh.faces), fx.block_labels(fx.grid_points(spark, sf)), clustering.Isotropic()).select("item", "a", "b", r("gain", 3))


@query(grid_sql("SELECT fid, list_sort(list(DISTINCT cluster)) AS clusters FROM (SELECT fid, cluster FROM (SELECT fid, unnest([a, b, c]) AS item FROM f) JOIN lab USING (item)) GROUP BY fid", _BLOCKS))
def face_clusters(spark, sf):
    at = m.vertex_faces(fx.grid_mesh(spark, sf).faces).withColumnRenamed("vid", "item").join(fx.block_labels(fx.grid_points(spark, sf)), "item")
    return at.groupBy("fid").agg(F.sort_array(F.collect_set("cluster")).alias("clusters"))


# Components


_STRIPS = "sc AS (SELECT vid, CAST(floor(j / 8) AS BIGINT) * 8 * w AS comp, w, j FROM v)"


@query(grid_sql("SELECT vid, comp FROM sc", _STRIPS))
def components(spark, sf):
    mesh = fx.striped_mesh(spark, sf)
    return graph.mesh_components(mesh.vertices, m.edge_counts(mesh.faces))


@query(grid_sql("SELECT comp, count(*) AS size FROM sc GROUP BY comp", _STRIPS))
def component_sizes(spark, sf):
    mesh = fx.striped_mesh(spark, sf)
    return graph.component_sizes(graph.mesh_components(mesh.vertices, m.edge_counts(mesh.faces)))


@query(grid_sql("SELECT vid, comp FROM sc WHERE comp IN (SELECT comp FROM sc GROUP BY comp ORDER BY count(*) DESC, comp LIMIT 3)", _STRIPS))
def biggest_components(spark, sf):
    mesh = fx.striped_mesh(spark, sf)
    return graph.biggest_components(graph.mesh_components(mesh.vertices, m.edge_counts(mesh.faces)), 3)


@query(grid_sql("SELECT fid, a, b, c, false AS flipped FROM f"))
def orientation(spark, sf):
    """Every third face turned over, and propagation turns the mesh back to the first face's side."""
    faces = fx.grid_mesh(spark, sf).faces.select("fid", F.when((F.col("fid") > 0) & (F.col("fid") % 3 == 1), F.reverse("vs")).otherwise(F.col("vs")).alias("vs"))
    back = graph.orient(faces)
    low = F.array_min("vs")
    at = F.array_position("vs", low) - 1
    turn = lambda k: F.element_at("vs", ((at + k) % 3 + 1).cast("int"))
    odd = F.col("fid") % 2 == 1
    # A face's order begins at its least vertex; odd faces of the grid begin at the second.
    first = lambda k: F.when(odd, turn(k)).otherwise(turn(k))
    return back.select("fid", first(0).alias("a"), first(1).alias("b"), first(2).alias("c"), (F.col("flipped") != ((F.col("fid") > 0) & (F.col("fid") % 3 == 1))).alias("flipped"))


# Subdivision and dual


@query(grid_sql("SELECT (SELECT count(*) FROM v) + (SELECT count(*) FROM e) AS vertices, 4 * (SELECT count(*) FROM f) AS faces, (SELECT round(sum(area), 4) + 0.0 FROM t) AS area"))
def subdivide_midpoint(spark, sf):
    fine, _ = remesh.subdivide(fx.grid_mesh(spark, sf))
    area = m.lengths(m.corners(m.triangles(fine.faces), fine.vertices)).agg(F.count("*").alias("faces"), F.sum("area").alias("area"))
    return fine.vertices.agg(F.count("*").alias("vertices")).join(F.broadcast(area)).select("vertices", "faces", r("area", 4))


@query(grid_sql("SELECT v1, v2, (p.x+q.x)/2 AS x, (p.y+q.y)/2 AS y, (p.z+q.z)/2 AS z FROM e JOIN v p ON p.vid = v1 JOIN v q ON q.vid = v2"))
def edge_midpoints(spark, sf):
    return remesh.midpoints(fx.grid_mesh(spark, sf)).select("v1", "v2", "x", "y", "z")


@query(grid_sql("SELECT vid, count(*) AS parts, round(sum(area) / 3, 6) + 0.0 AS area FROM (SELECT unnest([a, b, c]) AS vid, area FROM t UNION ALL SELECT unnest([a, b, c]), 0 FROM t) GROUP BY vid"))
def dual_mesh(spark, sf):
    d, _ = remesh.dual(fx.grid_mesh(spark, sf))
    return m.lengths(d).groupBy("vid").agg(F.count("*").alias("parts"), r(F.sum("area"), 6, "area"))


@query(grid_sql("""SELECT vid, round(CASE WHEN rim THEN 0.75 * z + 0.125 * bz ELSE z * (1 - n * beta) + sz * beta END + 0.000000003, 6) + 0.0 AS z FROM (
    SELECT vid, z, n, sz, bz, bz IS NOT NULL AS rim, (0.625 - (0.375 + cos(2 * pi() / n) / 4) * (0.375 + cos(2 * pi() / n) / 4)) / n AS beta FROM v
    JOIN (SELECT nb.vid, count(*) AS n, sum(o.z) AS sz FROM nb JOIN v o ON o.vid = nb.other GROUP BY nb.vid) USING (vid)
    LEFT JOIN (SELECT b.vid, sum(o.z) AS bz FROM (SELECT v1 AS vid, v2 AS other FROM e WHERE nf = 1 UNION ALL SELECT v2, v1 FROM e WHERE nf = 1) b JOIN v o ON o.vid = b.other GROUP BY b.vid) USING (vid))"""))
def subdivide_loop(spark, sf):
    """Places of the old vertices after one Loop step; the shift keeps eighths of seven-digit numbers off rounding ties."""
    mesh = fx.grid_mesh(spark, sf)
    return rounded(remesh.subdivide_loop(mesh).vertices.join(mesh.vertices.select("vid"), "vid", "left_semi").select("vid", (F.col("z") + 0.000000003).alias("z")))


@query(grid_sql("SELECT (SELECT count(*) FROM v) + (SELECT count(*) FROM e) AS vertices, 4 * (SELECT count(*) FROM f) AS faces"))
def subdivide_butterfly(spark, sf):
    fine = remesh.subdivide_butterfly(fx.grid_mesh(spark, sf))
    return fine.vertices.agg(F.count("*").alias("vertices")).join(F.broadcast(fine.faces.agg(F.count("*").alias("faces"))))


# Differences and nearest items


@query(grid_sql("SELECT count(*) AS vertices, CAST(0 AS BIGINT) AS unmatched, round(max(d), 6) + 0.0 AS max_error, round(avg(d), 6) + 0.0 AS mean_error, max(CASE WHEN vid = (SELECT min(vid) FROM v WHERE vid % 7 = 6) THEN vid END) AS worst FROM (SELECT vid, 0.01 * CAST(vid % 7 AS DOUBLE) AS d FROM v)"))
def mesh_difference(spark, sf):
    v = fx.grid_mesh(spark, sf).vertices
    d = measures.mesh_difference(v.withColumn("z", F.lit(0.0)), v.withColumn("z", 0.01 * (F.col("vid") % 7)))
    return rounded(d.select("vertices", "unmatched", "max_error", "mean_error", "worst"))


@query(point_sql("SELECT cluster, arg_min(item, {'d': d, 'i': item}) AS item, round(min(d), 6) + 0.0 AS distance FROM (SELECT p.*, sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz)) AS d FROM pts p JOIN (SELECT cluster, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM pts GROUP BY cluster) USING (cluster)) GROUP BY cluster"))
def closest_item(spark, sf):
    p = fx.points(spark, sf)
    c = p.groupBy("cluster").agg(*[F.avg(k).alias(f"c{k}") for k in "xyz"])
    return rounded(measures.nearest_in_cluster(p, c))


@query(grid_sql("SELECT count(DISTINCT CAST(floor(x / 2) AS BIGINT) * 1000000 + CAST(floor(y / 2) AS BIGINT)) AS vertices FROM v"))
def merge_points(spark, sf):
    mesh = fx.grid_mesh(spark, sf)
    flat = m.Mesh(mesh.vertices.withColumn("z", F.lit(0.0)), mesh.faces)
    return m.merge_points(flat, 2.0).vertices.agg(F.count("*").alias("vertices"))


@query(grid_sql("SELECT 2 * (SELECT count(*) FROM v) AS vertices, 2 * (SELECT count(*) FROM f) AS faces, 2 * (SELECT count(*) FROM e) AS edges"))
def append_meshes(spark, sf):
    mesh = fx.grid_mesh(spark, sf)
    both = m.append(mesh, mesh)
    e = m.edge_counts(both.faces).agg(F.count("*").alias("edges"))
    return both.vertices.agg(F.count("*").alias("vertices")).join(F.broadcast(both.faces.agg(F.count("*").alias("faces")))).join(F.broadcast(e))


# Voxels


@query(voxel_sql("SELECT x, y, z, v FROM vox WHERE x BETWEEN 2 AND 6 AND y BETWEEN 1 AND 8 AND z BETWEEN 0 AND 5"))
def voxel_crop(spark, sf):
    return volume.crop(fx.voxels(spark, sf), (2, 1, 0), (6, 8, 5))


@query(voxel_sql("SELECT x // 2 AS x, y // 2 AS y, z // 2 AS z, v FROM vox WHERE x % 2 = 0 AND y % 2 = 0 AND z % 2 = 0"))
def voxel_resample(spark, sf):
    return volume.resample(fx.voxels(spark, sf), 2)


@query(voxel_sql("SELECT v, count(*) AS voxels FROM vox GROUP BY v"))
def label_counts(spark, sf):
    return volume.labels(fx.voxels(spark, sf))


@query(voxel_sql("SELECT least(v, ov) AS a, greatest(v, ov) AS b, count(*) AS contacts FROM tc WHERE v <> ov GROUP BY 1, 2", "tc AS (SELECT p.v, q.v AS ov FROM vox p JOIN vox q ON q.x = p.x + 1 AND q.y = p.y AND q.z = p.z UNION ALL SELECT p.v, q.v FROM vox p JOIN vox q ON q.x = p.x AND q.y = p.y + 1 AND q.z = p.z UNION ALL SELECT p.v, q.v FROM vox p JOIN vox q ON q.x = p.x AND q.y = p.y AND q.z = p.z + 1)"))
def voxel_contacts(spark, sf):
    return volume.label_contacts(fx.voxels(spark, sf))


@query(voxel_sql("SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z, min(v) AS min_v, max(v) AS max_v, count(*) AS voxels FROM vox"))
def voxel_extent(spark, sf):
    return volume.extent(fx.voxels(spark, sf))


@query(voxel_sql("SELECT x AS u, z AS w, v FROM vox WHERE y = 4"))
def voxel_slice(spark, sf):
    return volume.slice_at(fx.voxels(spark, sf), "y", 4)


@query(voxel_sql("SELECT y AS x, z AS y, 9 - x AS z, v FROM vox"))
def voxel_permute_flip(spark, sf):
    return volume.permute(volume.flip(fx.voxels(spark, sf), "x", 10), ("y", "z", "x"))


@query(voxel_sql("SELECT x, y, z, CAST(round((v + 1) * 20.0) AS INT) AS scaled, CASE WHEN v >= 2 THEN 1 ELSE 0 END AS inside FROM vox"))
def voxel_scale_threshold(spark, sf):
    return fx.voxels(spark, sf).select("x", "y", "z", g.shift_scale(F.col("v"), 1.0, 20.0, "int").alias("scaled"), g.thresholded(F.col("v"), 2.0).alias("inside"))


@query(voxel_sql("SELECT p.x, p.y, p.z, list_sort(list(q.v))[CAST(floor((count(*) + 1) / 2) AS INT)] AS v FROM vox p JOIN vox q ON abs(p.x - q.x) <= 1 AND abs(p.y - q.y) <= 1 AND abs(p.z - q.z) <= 1 GROUP BY p.x, p.y, p.z"))
def voxel_median(spark, sf):
    return volume.median(fx.voxels(spark, sf))


@query(voxel_sql("""SELECT s.x, s.y, s.z, round(s.v + 0.1 * coalesce(sum(q.v - s.v), 0), 6) + 0.0 AS v FROM (SELECT x, y, z, CAST(v AS DOUBLE) AS v FROM vox) s
    LEFT JOIN (SELECT x, y, z, CAST(v AS DOUBLE) AS v FROM vox) q ON abs(s.x - q.x) + abs(s.y - q.y) + abs(s.z - q.z) = 1 AND abs(q.v - s.v) < 1.5 GROUP BY s.x, s.y, s.z, s.v"""))
def voxel_diffusion(spark, sf):
    return rounded(volume.diffuse(fx.voxels(spark, sf), 1, 1.5, 0.1))


@query("""WITH RECURSIVE vox AS (SELECT CAST(p_partkey % 10 AS BIGINT) AS x, CAST(floor(p_partkey / 10) AS BIGINT) % 10 AS y, CAST(floor(p_partkey / 100) AS BIGINT) AS z, CAST(p_size % 3 AS INT) AS v, CAST(p_partkey AS BIGINT) AS id FROM part),
    ed AS (SELECT p.id AS u, q.id AS w FROM vox p JOIN vox q ON p.v = q.v AND abs(p.x - q.x) + abs(p.y - q.y) + abs(p.z - q.z) = 1),
    reach(id, root) AS (SELECT id, id FROM vox UNION SELECT ed.w, reach.root FROM reach JOIN ed ON ed.u = reach.id WHERE ed.w > reach.root),
    comp AS (SELECT id, min(root) AS comp FROM reach GROUP BY id)
    SELECT comp, v, count(*) AS size FROM comp JOIN vox USING (id) GROUP BY comp, v""")
def voxel_components(spark, sf):
    c = volume.voxel_components(fx.voxels(spark, sf))
    k = F.col("comp")
    number = F.shiftright(k, 42) * 100 + F.shiftright(k, 21).bitwiseAND(F.lit((1 << 21) - 1)) * 10 + k.bitwiseAND(F.lit((1 << 21) - 1))
    return c.groupBy(number.alias("comp"), "v").agg(F.count("*").alias("size"))


@query()
def clean_labels(spark, sf):
    return volume.clean_labels(fx.voxels(spark, sf))


@query(grid_sql("SELECT vid AS item, round(coalesce(greatest(0.1, 1.0 - v * 0.2), 0.1), 6) + 0.0 AS density FROM v LEFT JOIN (SELECT p_partkey % 10 AS vx, CAST(floor(p_partkey / 10) AS BIGINT) % 10 AS vy, CAST(floor(p_partkey / 100) AS BIGINT) AS vz, p_size % 3 AS v FROM part) ON vx = i AND vy = j AND vz = CAST(floor(z + 0.5) AS BIGINT)"))
def density_sample(spark, sf):
    items = fx.grid_mesh(spark, sf).vertices.withColumnRenamed("vid", "item")
    return rounded(volume.density_sample(items, fx.voxels(spark, sf), 0.1, 1.0, 0.2))


@query(grid_sql("SELECT count(*) AS vertices, round(sum(mx), 4) + 0.0 AS sx, round(sum(mz), 4) + 0.0 AS sz FROM (SELECT avg(x) AS mx, avg(z) AS mz FROM v GROUP BY CAST(floor(x / 3) AS BIGINT), CAST(floor(y / 3) AS BIGINT), CAST(floor(z / 3) AS BIGINT))"))
def grid_clustering(spark, sf):
    mesh = fx.grid_mesh(spark, sf)
    p, _ = volume.grid_points(mesh.vertices, mesh.faces, 3.0)
    return p.agg(F.count("*").alias("vertices"), r(F.sum("x"), 4, "sx"), r(F.sum("z"), 4, "sz"))


@query()
def label_surfaces(spark, sf):
    points, faces = volume.label_surfaces(fx.voxels(spark, sf))
    return points.groupBy("label").agg(F.count("*").alias("vertices")).join(faces.groupBy("label").agg(F.count("*").alias("faces")), "label")


@query(voxel_sql("SELECT CAST(v AS INT) AS label, x, y, z, CAST(1 AS INT) AS inside FROM vox"))
def label_masks(spark, sf):
    return volume.masks(fx.voxels(spark, sf))


# Clustering and remeshing (checked by invariants in the tests)


@query()
def cluster_uniform(spark, sf):
    mesh = fx.grid_mesh(spark, sf)
    done = clustering.cluster(written(_items(spark, sf), "items"), written(_pairs(mesh.faces), "pairs"), clustering.Isotropic(), clustering.Options(clusters=60))
    return done.labels


_SETTLED = "SELECT count(*) AS items, CAST(0 AS BIGINT) AS unlabelled, CAST(60 AS BIGINT) AS clusters, CAST(60 AS BIGINT) AS parts, TRUE AS settled, TRUE AS lower_energy FROM "


@query(grid_sql(_SETTLED + "v"))
def cluster_checks(spark, sf):
    """Invariants of the clustering of vertices."""
    items, pairs = written(_items(spark, sf), "items"), written(_pairs(fx.grid_mesh(spark, sf).faces), "pairs")
    o, metric = clustering.Options(clusters=60), clustering.Isotropic()
    start = written(clustering.initial_labels(items, pairs, o), "start")
    return clustering.cluster_checks(items, pairs, start, clustering.cluster(items, pairs, metric, o), metric)


@query(grid_sql(_SETTLED + "f"))
def cluster_faces_checks(spark, sf):
    """Invariants of the clustering of triangles."""
    mesh = fx.grid_mesh(spark, sf)
    items, pairs = written(clustering.face_items(mesh), "items"), written(clustering.face_pairs(mesh.faces), "pairs")
    o, metric = clustering.Options(clusters=60), clustering.Isotropic()
    start = written(clustering.initial_labels(items, pairs, o), "start")
    return clustering.cluster_checks(items, pairs, start, clustering.cluster(items, pairs, metric, o), metric)


@query()
def remesh_uniform(spark, sf):
    out = remesh.remesh(fx.grid_mesh(spark, sf), clustering.Isotropic(), clustering.Options(clusters=60))
    return rounded(out.mesh.vertices)


@query()
def remesh_quadric(spark, sf):
    out = remesh.remesh(fx.grid_mesh(spark, sf), clustering.Isotropic(), clustering.Options(clusters=60), quadric_level=1)
    return rounded(out.mesh.vertices)


@query()
def curvature_fit(spark, sf):
    return curvature.fitted(fx.grid_mesh(spark, sf)).select(F.col("elt"), r("k", 4))


@query()
def curvature_tensor(spark, sf):
    return curvature.tensor(fx.grid_mesh(spark, sf)).select(F.col("elt"), r("k", 4))


@query(grid_sql("SELECT (SELECT count(*) FROM v) AS vertices, (SELECT count(*) FROM f) AS faces, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM e WHERE nf = 1) AS boundary_edges, CAST(0 AS BIGINT) AS bad_edges"))
def delaunay_flip(spark, sf):
    """Flips keep all counts and leave no edge that should be flipped and may be."""
    flipped, _ = remesh.delaunay(fx.grid_mesh(spark, sf))
    e = m.edge_counts(flipped.faces).agg(F.count("*").alias("edges"), F.sum((F.col("nf") == 1).cast("long")).alias("boundary_edges"))
    counts = flipped.vertices.agg(F.count("*").alias("vertices")).join(F.broadcast(flipped.faces.agg(F.count("*").alias("faces")))).join(F.broadcast(e))
    return counts.join(F.broadcast(remesh.bad_edges(flipped).agg(F.count("*").alias("bad_edges"))))


@query(grid_sql("SELECT CAST(floor(count(*) * 0.1) AS BIGINT) AS vertices, CAST(1 AS BIGINT) AS euler, CAST(0 AS BIGINT) AS nonmanifold_edges, TRUE AS box_kept FROM v"))
def simplify_qem(spark, sf):
    """A tenth of the vertices, in one piece without a hole, inside the input's box (by a unit)."""
    mesh = fx.grid_mesh(spark, sf)
    n = int(mesh.vertices.count() * 0.1)
    out = measures.mesh_report(remesh.simplify(mesh, n)).select("vertices", "euler", "nonmanifold_edges", "min_x", "max_x")
    was = mesh.vertices.agg((F.min("x") - 1).alias("lo"), (F.max("x") + 1).alias("hi"))
    return out.join(F.broadcast(was)).select("vertices", "euler", "nonmanifold_edges", ((F.col("min_x") >= F.col("lo")) & (F.col("max_x") <= F.col("hi"))).alias("box_kept"))


@query(voxel_sql("SELECT (SELECT count(*) FROM vox) AS voxels, count(*) AS labels, count(*) AS with_biggest FROM (SELECT DISTINCT v FROM vox)"))
def clean_labels_checks(spark, sf):
    """No voxel is lost, and every label keeps all voxels of its biggest component."""
    vox = written(fx.voxels(spark, sf), "voxels")
    comp = written(volume.voxel_components(vox), "components")
    sizes = comp.groupBy("v", "comp").agg(F.count("*").alias("n"))
    biggest = sizes.groupBy("v").agg(F.max_by("comp", F.struct("n", -F.col("comp"))).alias("comp"), F.max("n").alias("n"))
    now = volume.clean_labels(vox)
    held = comp.join(biggest.select("v", "comp"), ["v", "comp"], "left_semi").join(now.withColumnRenamed("v", "now"), ["x", "y", "z"]).where("v = now").groupBy("v").agg(F.count("*").alias("held"))
    ok = biggest.join(held, "v").where("held = n").agg(F.count("*").alias("with_biggest"))
    return now.agg(F.count("*").alias("voxels"), F.countDistinct("v").alias("labels")).join(F.broadcast(ok))
