"""Registered round trips: a derived mesh, volume or list is written by a sink, read back by a source, and compared with the SQL of what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.functions.state import fresh_path, local_path
from meshlake.operators import graph, measures, volume
from meshlake.operators import mesh as m
from meshlake.operators.mesh import Mesh
from meshlake.sources import lists, meshes, sinks, volumes

from . import fixtures as fx
from .catalog import query, rounded
from .fixtures import grid_sql, voxel_sql

_CORNERS = "SELECT fid, p.x AS ax, p.y AS ay, round(p.z, 7) + 0.0 AS az, q.x AS bx, q.y AS by_, round(q.z, 7) + 0.0 AS bz, r.x AS cx, r.y AS cy, round(r.z, 7) + 0.0 AS cz FROM f JOIN v p ON p.vid = a JOIN v q ON q.vid = b JOIN v r ON r.vid = c"


def _cornered(mesh: Mesh) -> DataFrame:
    t = m.corners(m.triangles(mesh.faces).select("fid", "a", "b", "c"), mesh.vertices)
    return rounded(t.select("fid", "ax", "ay", "az", "bx", F.col("by").alias("by_"), "bz", "cx", "cy", "cz"), 7)


def _again(spark: SparkSession, sf: str, kind: str, read: str | None = None) -> Mesh:
    """The grid written as ``kind`` and read back."""
    path = f"{fresh_path(spark, 'mesh')}.{read or kind}"
    sinks.write_mesh(m.dense_ids(fx.grid_mesh(spark, sf)), path, kind)
    return meshes.read_mesh(spark, path)


def _round_trip(kind: str, read: str | None = None) -> None:
    """Registers file_<kind>: corners of all faces by face, for a format that keeps the faces' order."""

    def run(spark, sf):
        return _cornered(_again(spark, sf, kind, read))

    run.__name__ = f"file_{kind}"
    query(grid_sql(f"SELECT * REPLACE (row_number() OVER (ORDER BY fid) - 1 AS fid) FROM ({_CORNERS})"))(run)


for _kind, _read in (("off", None), ("obj", None), ("ply", None), ("vtk", None), ("vtp", None), ("smf", "obj"), ("iv", "wrl")):
    _round_trip(_kind, _read)


@query(grid_sql("SELECT count(*) AS faces, (SELECT count(*) FROM v) AS vertices, round(sum(area), 3) + 0.0 AS area, round(sum(nz), 3) + 0.0 AS up FROM tn"))
def file_stl(spark, sf):
    """A format without shared vertices: the reader merges equal points."""
    back = _again(spark, sf, "stl")
    t = measures.triangle_table(back).agg(F.count("*").alias("faces"), F.round(F.sum("area"), 3).alias("area"))
    up = m.face_normals(back).agg(F.round(F.sum("nz"), 3).alias("up"))
    return t.join(F.broadcast(up)).join(F.broadcast(back.vertices.agg(F.count("*").alias("vertices")))).select("faces", "vertices", "area", "up")


@query(grid_sql("SELECT count(*) AS faces, CAST(count(*) AS BIGINT) AS agree FROM f"))
def file_oriented(spark, sf):
    """Every third face turned over, oriented again, written and read: all faces agree with the first."""
    mesh = fx.grid_mesh(spark, sf)
    mixed = Mesh(mesh.vertices, mesh.faces.select("fid", F.when(F.col("fid") % 3 == 1, F.reverse("vs")).otherwise(F.col("vs")).alias("vs")))
    path = f"{fresh_path(spark, 'mesh')}.off"
    sinks.write_mesh(Mesh(mixed.vertices, graph.orient(mixed.faces).select("fid", "vs")), path)
    n = m.face_normals(meshes.read_mesh(spark, path))
    return n.agg(F.count("*").alias("faces"), F.greatest(F.sum((F.col("nz") > 0).cast("long")), F.sum((F.col("nz") < 0).cast("long"))).alias("agree"))


@query(grid_sql("SELECT v.vid, x, y, round(z, 7) + 0.0 AS z, string_agg(CAST(other AS VARCHAR), ' ' ORDER BY other) AS neighbours FROM v JOIN nb USING (vid) GROUP BY v.vid, x, y, z"))
def file_adjacency(spark, sf):
    path = fresh_path(spark, "adjacency")
    sinks.write_adjacency(fx.grid_mesh(spark, sf), path)
    return rounded(spark.read.csv(path, header=True, schema="vid long, x double, y double, z double, neighbours string"), 7)


@query(grid_sql("SELECT fid, round(area, 6) + 0.0 AS area, round(quality, 6) + 0.0 AS quality, round(min_angle, 6) + 0.0 AS min_angle FROM q"))
def file_triangle_stats(spark, sf):
    path = fresh_path(spark, "stats")
    sinks.write_triangle_stats(fx.grid_mesh(spark, sf), path)
    out = None
    for name in ("area", "quality", "min_angle"):
        one = spark.read.csv(f"{path}/{name}", header=True, schema=f"fid long, {name} double")
        out = one if out is None else out.join(one, "fid")
    return rounded(out)


@query("SELECT CAST(400 AS BIGINT) AS points, CAST(400 AS BIGINT) AS unit_normals")
def file_points(spark, sf):
    """Samples of the surface with normals, as tab-separated text: their number and the unit length of their normals."""
    path = fresh_path(spark, "points")
    sinks.write_points(measures.sample_surface(fx.grid_mesh(spark, sf), 400), path)
    p = spark.read.csv(path, sep="\t", schema="x double, y double, z double, nx double, ny double, nz double")
    return p.agg(F.count("*").alias("points"), F.sum((F.abs(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2 - 1) < 1e-9).cast("long")).alias("unit_normals"))


# Volumes


def _dims(voxels: DataFrame) -> tuple[int, int, int]:
    r = voxels.agg(*[F.max(k).alias(k) for k in "xyz"]).first()
    return r.x + 1, r.y + 1, r.z + 1


def _folder(spark: SparkSession, name: str) -> str:
    return local_path(fresh_path(spark, name))


_VALUES = "SELECT x, y, z, CAST(v AS DOUBLE) AS v FROM vox"


@query(voxel_sql(_VALUES))
def file_metaimage(spark, sf):
    vox, path = fx.voxels(spark, sf), f"{_folder(spark, 'volume')}/v.mhd"
    sinks.write_metaimage(vox, path, _dims(vox), "i2")
    return volumes.read_volume(spark, path)


@query(voxel_sql(f"SELECT * FROM ({_VALUES}) WHERE x >= 2 AND x < 7 AND y = 4 AND z > 1"))
def file_metaimage_pushdown(spark, sf):
    """Comparisons of x, y and z are pushed to the reader, which opens the slices and rows of the box only."""
    vox, path = fx.voxels(spark, sf), f"{_folder(spark, 'volume')}/v.mhd"
    sinks.write_metaimage(vox, path, _dims(vox), "f4")
    return volumes.read_volume(spark, path).where("x >= 2 AND x < 7 AND y = 4 AND z > 1")


@query(voxel_sql(_VALUES))
def file_nifti(spark, sf):
    vox, path = fx.voxels(spark, sf), f"{_folder(spark, 'volume')}/v.nii"
    sinks.write_nifti(vox, path, _dims(vox), "u1")
    return volumes.read_volume(spark, path)


@query(voxel_sql(_VALUES))
def file_png_stack(spark, sf):
    vox, path = fx.voxels(spark, sf), _folder(spark, "slices")
    sinks.write_png_slices(vox, path, _dims(vox))
    return volumes.read_volume(spark, path)


@query(voxel_sql("SELECT CAST(v AS BIGINT) AS label, 'label ' || v AS name, CAST(0 AS BIGINT) AS boundary_edges, CAST(0 AS BIGINT) AS odd_edges FROM vox GROUP BY v"))
def file_label_meshes(spark, sf):
    """A surface a label, written with meshes.xml; names by the XML, and closed surfaces (the volume is padded by a layer without label)."""
    vox = fx.voxels(spark, sf)
    d = _dims(vox)
    grid = spark.range((d[0] + 2) * (d[1] + 2) * (d[2] + 2))
    x, y, z = F.col("id") % (d[0] + 2) - 1, F.floor(F.col("id") / (d[0] + 2)) % (d[1] + 2) - 1, F.floor(F.col("id") / ((d[0] + 2) * (d[1] + 2))) - 1
    padded = grid.select(x.alias("x"), y.alias("y"), z.alias("z")).join(vox, ["x", "y", "z"], "left").select("x", "y", "z", F.coalesce("v", F.lit(-1)).alias("v"))
    points, faces = volume.label_surfaces(padded)
    path = _folder(spark, "labels")
    names = vox.select(F.col("v").cast("long").alias("label")).distinct().withColumn("name", F.concat(F.lit("label "), F.col("label").cast("string")))
    sinks.write_label_meshes(points.where("label >= 0"), faces.where("label >= 0"), path, names)
    with open(f"{path}/meshes.xml", encoding="utf-8") as f:
        named = lists.label_names(spark, f.read())
    _, back = meshes.read_meshes(spark, *[f"{path}/{r.label}.vtk" for r in named.select("label").collect()])  # one file a label
    label = F.regexp_extract("path", r"(\d+)\.vtk", 1).cast("long")
    sides = back.select(label.alias("label"), F.explode(F.array(*[F.array(F.col("vs")[i], F.col("vs")[(i + 1) % 3]) for i in range(3)])).alias("s"))
    edges = sides.groupBy("label", F.least(F.col("s")[0], F.col("s")[1]).alias("v1"), F.greatest(F.col("s")[0], F.col("s")[1]).alias("v2")).agg(F.count("*").alias("nf"))
    odd = edges.groupBy("label").agg(F.sum((F.col("nf") == 1).cast("long")).alias("boundary_edges"), F.sum((F.col("nf") % 2 == 1).cast("long")).alias("odd_edges"))
    return odd.join(named.select(F.col("label").cast("long").alias("label"), "name"), "label").select("label", "name", "boundary_edges", "odd_edges")


# Lists and saved tables


@query(grid_sql("SELECT DISTINCT vid FROM (SELECT a AS vid FROM f WHERE fid < 40 UNION ALL SELECT b FROM f WHERE fid < 40 UNION ALL SELECT c FROM f WHERE fid < 40)"))
def file_fixed_faces(spark, sf):
    """A list of faces as text: the corners of the listed ones."""
    path, faces = fresh_path(spark, "list"), fx.grid_mesh(spark, sf).faces
    faces.where("fid < 40").select(F.concat_ws(" ", F.col("fid").cast("string"), F.lit("#")).alias("value")).write.text(path)
    return lists.fixed_triangle_vertices(spark, path, faces)


@query(grid_sql("SELECT vid AS item, CAST(floor(j / 8) * 1000 + floor(i / 8) AS BIGINT) AS cluster FROM v"))
def file_clustering(spark, sf):
    """A clustering saved and loaded again."""
    path = fresh_path(spark, "clustering")
    sinks.save_table(fx.block_labels(fx.grid_points(spark, sf)), path)
    return meshes.load_table(spark, path, "item long, cluster long")
