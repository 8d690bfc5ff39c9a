"""Meshes, volumes and point sets derived from the driver's tables, and the same as SQL text.

The grid mesh has a vertex for each order with a key under w * w, w the floor of the root of the number of orders (order keys are 0..n-1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.operators.mesh import Mesh


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vid, w, i, j, x, y, z."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("vid"), (F.col("o_totalprice") / 100000.0).alias("z"))
    w = o.agg(F.floor(F.sqrt(F.count("*").cast("double"))).cast("long").alias("w"))
    g = o.join(F.broadcast(w)).where(F.col("vid") < F.col("w") * F.col("w"))
    return g.withColumns({"i": F.col("vid") % F.col("w"), "j": F.floor(F.col("vid") / F.col("w"))}).select("vid", "w", "i", "j", F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"), "z")


def grid_triangles(points: DataFrame) -> DataFrame:
    """fid, a, b, c: two triangles to each cell."""
    v, w = F.col("vid"), F.col("w")
    two = F.array(F.struct((2 * v).alias("fid"), v.alias("a"), (v + 1).alias("b"), (v + w).alias("c")), F.struct((2 * v + 1).alias("fid"), (v + 1).alias("a"), (v + w + 1).alias("b"), (v + w).alias("c")))
    return points.where((F.col("i") < w - 1) & (F.col("j") < w - 1)).select(F.explode(two).alias("t")).select("t.*")


def grid_mesh(spark: SparkSession, sf_dir: str) -> Mesh:
    p = grid_points(spark, sf_dir)
    return Mesh(p.select("vid", "x", "y", "z"), grid_triangles(p).select("fid", F.array("a", "b", "c").alias("vs")))


def striped_mesh(spark: SparkSession, sf_dir: str, rows: int = 8) -> Mesh:
    """The grid without the faces above every ``rows``-th row: strips that are not connected."""
    p = grid_points(spark, sf_dir)
    whole = p.withColumn("keep", F.col("j") % rows != rows - 1)
    return Mesh(p.select("vid", "x", "y", "z"), grid_triangles(whole.where("keep")).select("fid", F.array("a", "b", "c").alias("vs")))


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y, z, v of ten by ten slices; the label is the part's size modulo 3."""
    k = F.col("p_partkey").cast("long")
    return table(spark, sf_dir, "part").select((k % 10).alias("x"), (F.floor(k / 10) % 10).alias("y"), F.floor(k / 100).alias("z"), (F.col("p_size") % 3).cast("int").alias("v"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, x, y, z, cluster from the embeddings' first components and label."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("item"), *[F.col("embedding")[i].cast("double").alias(k) for i, k in enumerate("xyz")], F.col("label").cast("long").alias("cluster"))


def block_labels(points_: DataFrame, size: int = 8) -> DataFrame:
    """item, cluster: blocks of the grid."""
    return points_.select(F.col("vid").alias("item"), (F.floor(F.col("j") / size) * 1000 + F.floor(F.col("i") / size)).cast("long").alias("cluster"))


GRID = """
o AS (SELECT CAST(o_orderkey AS BIGINT) AS vid, o_totalprice / 100000.0 AS z FROM orders),
wd AS (SELECT CAST(floor(sqrt(CAST(count(*) AS DOUBLE))) AS BIGINT) AS w FROM o),
v AS (SELECT vid, w, vid % w AS i, CAST(floor(vid / w) AS BIGINT) AS j, CAST(vid % w AS DOUBLE) AS x, CAST(floor(vid / w) AS DOUBLE) AS y, z FROM o, wd WHERE vid < w * w),
f AS (SELECT 2 * vid AS fid, vid AS a, vid + 1 AS b, vid + w AS c FROM v WHERE i < w - 1 AND j < w - 1
      UNION ALL SELECT 2 * vid + 1, vid + 1, vid + w + 1, vid + w FROM v WHERE i < w - 1 AND j < w - 1),
he AS (SELECT fid, a AS src, b AS dst FROM f UNION ALL SELECT fid, b, c FROM f UNION ALL SELECT fid, c, a FROM f),
e AS (SELECT least(src, dst) AS v1, greatest(src, dst) AS v2, count(*) AS nf FROM he GROUP BY 1, 2),
nb AS (SELECT v1 AS vid, v2 AS other FROM e UNION ALL SELECT v2, v1 FROM e),
k AS (SELECT f.*, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS by_, q.z AS bz, r.x AS cx, r.y AS cy, r.z AS cz
      FROM f JOIN v p ON p.vid = a JOIN v q ON q.vid = b JOIN v r ON r.vid = c),
l AS (SELECT *, sqrt((ax-bx)*(ax-bx)+(ay-by_)*(ay-by_)+(az-bz)*(az-bz)) AS l1, sqrt((bx-cx)*(bx-cx)+(by_-cy)*(by_-cy)+(bz-cz)*(bz-cz)) AS l2,
             sqrt((ax-cx)*(ax-cx)+(ay-cy)*(ay-cy)+(az-cz)*(az-cz)) AS l3 FROM k),
t AS (SELECT *, 0.25*sqrt(abs(4.0*l1*l1*l3*l3-(l1*l1-l2*l2+l3*l3)*(l1*l1-l2*l2+l3*l3))) AS area,
             (by_-ay)*(cz-az)-(bz-az)*(cy-ay) AS rx, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) AS ry, (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) AS rz FROM l),
tn AS (SELECT *, rx/sqrt(rx*rx+ry*ry+rz*rz) AS nx, ry/sqrt(rx*rx+ry*ry+rz*rz) AS ny, rz/sqrt(rx*rx+ry*ry+rz*rz) AS nz FROM t),
q AS (SELECT *, 12.0/sqrt(3.0)*area/((l1+l2+l3)*greatest(l1,l2,l3)) AS quality,
             degrees(least(acos(greatest(-1.0,least(1.0,(l2*l2+l3*l3-l1*l1)/(2*l2*l3)))), acos(greatest(-1.0,least(1.0,(l1*l1+l3*l3-l2*l2)/(2*l1*l3)))),
                           acos(greatest(-1.0,least(1.0,(l1*l1+l2*l2-l3*l3)/(2*l1*l2)))))) AS min_angle FROM tn),
va AS (SELECT vid, sum(area) / 3 AS area FROM (SELECT a AS vid, area FROM t UNION ALL SELECT b, area FROM t UNION ALL SELECT c, area FROM t) GROUP BY vid),
bb AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz, greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z)) AS widest FROM v)
"""

VOXELS = "vox AS (SELECT CAST(p_partkey % 10 AS BIGINT) AS x, CAST(floor(p_partkey / 10) AS BIGINT) % 10 AS y, CAST(floor(p_partkey / 100) AS BIGINT) AS z, CAST(p_size % 3 AS INT) AS v FROM part)"

POINTS = "pts AS (SELECT vec_id AS item, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(label AS BIGINT) AS cluster FROM embeddings)"


def grid_sql(select: str, more: str = "") -> str:
    return f"WITH {GRID.strip()}{', ' + more if more else ''} {select}"


def voxel_sql(select: str, more: str = "") -> str:
    return f"WITH {VOXELS}{', ' + more if more else ''} {select}"


def point_sql(select: str, more: str = "") -> str:
    return f"WITH {POINTS}{', ' + more if more else ''} {select}"
