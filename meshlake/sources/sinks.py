"""Writers. Text formats are lines with a section and a number; Spark writes them as sorted parts, or as one part if asked to."""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET
import zlib
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlake.functions.state import discard, fresh_path, local_path, written
from meshlake.operators import measures
from meshlake.operators import mesh as m
from meshlake.operators.mesh import Mesh

from .meshes import format_of


def _numbers(*cols: Column) -> Column:
    return F.concat_ws(" ", *[c.cast("string") for c in cols])


def _xyz() -> Column:
    return _numbers(*[F.col(k).cast("double") for k in "xyz"])


def _section(df: DataFrame, number: int, key: str, line: Column) -> DataFrame:
    return df.select(F.lit(number).alias("section"), F.col(key).cast("long").alias("id"), line.alias("value"))


def _heading(mesh: Mesh, number: int, make) -> DataFrame:
    """A line of the counts of vertices (nv), faces (nf) and face corners (nc)."""
    counts = mesh.vertices.agg(F.count("*").alias("nv")).join(F.broadcast(mesh.faces.agg(F.count("*").alias("nf"), F.coalesce(F.sum(F.size("vs")), F.lit(0)).alias("nc"))))
    return counts.select(F.lit(number).alias("section"), F.lit(0).cast("long").alias("id"), make(F.col("nv"), F.col("nf"), F.col("nc")).alias("value"))


def mesh_lines(mesh: Mesh, kind: str) -> DataFrame:
    """section, id, value: the file's lines. Vertex ids must be 0..n-1 (see dense_ids)."""
    v, f = mesh.vertices, mesh.faces
    ids = lambda add=0: F.concat_ws(" ", F.transform("vs", lambda x: (x + add).cast("string")))
    counted = F.concat_ws(" ", F.size("vs").cast("string"), ids())
    c = F.concat
    if kind == "off":
        edges = m.edge_counts(f).agg(F.count("*").alias("ne"))
        head = _heading(mesh, 0, lambda nv, nf, nc: c(F.lit("OFF\n"), _numbers(nv, nf))).join(F.broadcast(edges)).select("section", "id", c("value", F.lit(" "), F.col("ne").cast("string")).alias("value"))
        parts = [head, _section(v, 1, "vid", _xyz()), _section(f, 2, "fid", counted)]
    elif kind == "obj":
        parts = [_section(v, 1, "vid", c(F.lit("v "), _xyz())), _section(f, 2, "fid", c(F.lit("f "), ids(1)))]
    elif kind == "smf":
        parts = [_section(v, 1, "vid", c(F.lit("v "), _xyz())), _section(m.triangles(f), 2, "fid", c(F.lit("f "), _numbers(F.col("a") + 1, F.col("b") + 1, F.col("c") + 1)))]
    elif kind == "ply":
        head = _heading(mesh, 0, lambda nv, nf, nc: c(F.lit("ply\nformat ascii 1.0\nelement vertex "), nv.cast("string"), F.lit("\nproperty double x\nproperty double y\nproperty double z\nelement face "), nf.cast("string"), F.lit("\nproperty list uchar int vertex_indices\nend_header")))
        parts = [head, _section(v, 1, "vid", _xyz()), _section(f, 2, "fid", counted)]
    elif kind == "vtk":
        head = _heading(mesh, 0, lambda nv, nf, nc: c(F.lit("# vtk DataFile Version 3.0\nmesh\nASCII\nDATASET POLYDATA\nPOINTS "), nv.cast("string"), F.lit(" double")))
        mid = _heading(mesh, 2, lambda nv, nf, nc: c(F.lit("POLYGONS "), _numbers(nf, nf + nc)))
        parts = [head, _section(v, 1, "vid", _xyz()), mid, _section(f, 3, "fid", counted)]
    elif kind == "vtp":
        head = _heading(mesh, 0, lambda nv, nf, nc: c(F.lit('<VTKFile type="PolyData" version="0.1" byte_order="LittleEndian"><PolyData><Piece NumberOfPoints="'), nv.cast("string"), F.lit('" NumberOfPolys="'), nf.cast("string"), F.lit('"><Points><DataArray type="Float64" NumberOfComponents="3" format="ascii">')))
        text = lambda n, t: _heading(mesh, n, lambda *_: F.lit(t))
        ends = measures.cumulative(f.select("fid", F.size("vs").alias("n")), "fid", "n")
        parts = [head, _section(v, 1, "vid", _xyz()), text(2, '</DataArray></Points><Polys><DataArray type="Int64" Name="connectivity" format="ascii">'), _section(f, 3, "fid", ids()), text(4, '</DataArray><DataArray type="Int64" Name="offsets" format="ascii">'), _section(ends, 5, "fid", F.col("upto").cast("string")), text(6, "</DataArray></Polys></Piece></PolyData></VTKFile>")]
    elif kind == "stl":
        t = m.corners(m.triangles(f), v)
        from meshlake.functions import geometry as g

        n = g.triangle_normal(g.vec("a"), g.vec("b"), g.vec("c"))
        corner = lambda p: c(F.lit("vertex "), _numbers(*[F.col(f"{p}{k}") for k in "xyz"]), F.lit("\n"))
        parts = [_heading(mesh, 0, lambda *_: F.lit("solid mesh")), _section(t, 1, "fid", c(F.lit("facet normal "), _numbers(*n), F.lit("\nouter loop\n"), corner("a"), corner("b"), corner("c"), F.lit("endloop\nendfacet"))), _heading(mesh, 2, lambda *_: F.lit("endsolid mesh"))]
    elif kind == "iv":
        text = lambda n, t: _heading(mesh, n, lambda *_: F.lit(t))
        parts = [text(0, "#Inventor V2.1 ascii\nSeparator {\nCoordinate3 { point ["), _section(v, 1, "vid", c(_xyz(), F.lit(","))), text(2, "] }\nIndexedFaceSet { coordIndex ["), _section(f, 3, "fid", c(F.concat_ws(",", F.transform("vs", lambda x: x.cast("string"))), F.lit(",-1,"))), text(4, "] }\n}")]
    else:
        raise ValueError(f"no writer for {kind}")
    return reduce(DataFrame.unionByName, parts)


def write_mesh(mesh: Mesh, path: str, kind: str | None = None, single: bool = True) -> None:
    """Text parts under ``path``, in order; one part if ``single``: the sorted parts copied behind each other, so no task formats or sorts all lines. The kind is that of the name if not given."""
    spark = mesh.vertices.sparkSession
    kept = Mesh(written(mesh.vertices.select("vid", "x", "y", "z"), "sink-v"), written(mesh.faces.select("fid", "vs"), "sink-f"))
    lines = mesh_lines(kept, kind or format_of(path)).orderBy("section", "id").select("value")
    if not single:
        lines.write.mode("overwrite").text(path)
        return
    parts = fresh_path(spark, "sink-parts")
    lines.write.text(parts)
    _concatenate(spark, parts, path)
    discard(kept.vertices)
    discard(kept.faces)


def _concatenate(spark, parts: str, path: str) -> None:
    """The parts of a written text in order of their names as the only part under ``path``, which gets its name when it is complete; the parts go."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    source, target = hadoop.fs.Path(parts), hadoop.fs.Path(path)
    own, fs = source.getFileSystem(conf), target.getFileSystem(conf)
    fs.delete(target, True)
    whole = hadoop.fs.Path(target, "_part")
    out = fs.create(whole, True)
    try:
        for name in sorted(s.getPath().getName() for s in own.listStatus(source) if s.getPath().getName().startswith("part-")):
            into = own.open(hadoop.fs.Path(source, name))
            try:
                hadoop.io.IOUtils.copyBytes(into, out, 1 << 20, False)
            finally:
                into.close()
    finally:
        out.close()
    if not fs.rename(whole, hadoop.fs.Path(target, "part-00000.txt")):
        raise OSError(f"{path} could not be written")
    own.delete(source, True)


def convert(spark, source: str, target: str, kind: str | None = None) -> None:
    from .meshes import read_mesh

    write_mesh(read_mesh(spark, source), target, kind)


def write_points(samples: DataFrame, path: str) -> None:
    """Points with normals, tab separated."""
    samples.select("x", "y", "z", "nx", "ny", "nz").write.mode("overwrite").option("sep", "\t").csv(path)


def write_adjacency(mesh: Mesh, path: str) -> None:
    """Coordinates and neighbours of each vertex as csv."""
    near = m.vertex_neighbours(mesh.faces).groupBy("vid").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list("other")), lambda x: x.cast("string"))).alias("neighbours"))
    mesh.vertices.join(near, "vid", "left").select("vid", "x", "y", "z", "neighbours").write.mode("overwrite").csv(path, header=True)


def write_triangle_stats(mesh: Mesh, path: str) -> None:
    """Area, quality and least angle of each triangle, and the faces of each vertex."""
    t = measures.triangle_table(mesh)
    for name in ("area", "quality", "min_angle"):
        t.select("fid", name).write.mode("overwrite").csv(f"{path}/{name}", header=True)
    measures.valences(mesh.faces).write.mode("overwrite").csv(f"{path}/valence", header=True)


def mhd_header(dims: tuple[int, int, int], kind: str, data_file: str, spacing=(1.0, 1.0, 1.0), origin=(0.0, 0.0, 0.0)) -> str:
    line = lambda values: " ".join(f"{v:g}" for v in values)
    return f"ObjectType = Image\nNDims = 3\nBinaryData = True\nBinaryDataByteOrderMSB = False\nDimSize = {line(dims)}\nElementSpacing = {line(spacing)}\nOffset = {line(origin)}\nElementType = {kind}\nElementDataFile = {data_file}\n"


#: Type names of the MetaImage format and type codes and bits of the NIfTI-1 format, by numpy type.
META_NAMES = {"i1": "MET_CHAR", "u1": "MET_UCHAR", "i2": "MET_SHORT", "u2": "MET_USHORT", "i4": "MET_INT", "u4": "MET_UINT", "f4": "MET_FLOAT", "f8": "MET_DOUBLE"}
NIFTI_CODES = {"u1": (2, 8), "i2": (4, 16), "i4": (8, 32), "f4": (16, 32), "f8": (64, 64), "i1": (256, 8), "u2": (512, 16), "u4": (768, 32)}


def slabs(voxels: DataFrame, dims: tuple[int, int, int], dtype: str = "<f4") -> DataFrame:
    """z, data: each slice's values in row order (missing voxels are 0); a slice is gathered, a volume never."""
    import pandas as pd

    def run(key, df: pd.DataFrame) -> pd.DataFrame:
        plane = np.zeros((dims[1], dims[0]), dtype)
        plane[df["y"], df["x"]] = df["v"]
        return pd.DataFrame({"z": [key[0]], "data": [plane.tobytes()]})

    return voxels.select("x", "y", "z", "v").groupBy("z").applyInPandas(run, "z long, data binary")


def _one_file(slices: DataFrame, path: str, dims: tuple[int, int, int], dtype: str, head: bytes) -> None:
    """``head`` and the slices (z, data) in order of z as one file, by one task that holds a slice at a time; missing slices are 0. The file gets its name when it is complete."""
    import os

    target, plane = local_path(path), dims[0] * dims[1] * np.dtype(dtype).itemsize

    def run(batches):
        import pandas as pd

        part = f"{target}.{os.getpid()}.tmp"
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(part, "wb") as f:
            f.write(head)
            f.truncate(len(head) + plane * dims[2])
            for df in batches:
                for z, data in zip(df["z"], df["data"], strict=True):
                    f.seek(len(head) + int(z) * plane)
                    f.write(data)
        os.replace(part, target)
        yield pd.DataFrame({"path": [target]})

    slices.repartition(1).sortWithinPartitions("z").mapInPandas(run, "path string").count()


def write_metaimage(voxels: DataFrame, path: str, dims: tuple[int, int, int], dtype: str = "f4", spacing=(1.0, 1.0, 1.0), origin=(0.0, 0.0, 0.0)) -> None:
    """A header at ``path`` (.mhd, in a folder that all machines can open) and the raw volume beside it."""
    raw = path.rsplit(".", 1)[0] + ".raw"
    _one_file(slabs(voxels, dims, f"<{dtype}"), raw, dims, dtype, b"")
    with open(local_path(path), "w", encoding="ascii") as f:
        f.write(mhd_header(dims, META_NAMES[dtype], raw.rsplit("/", 1)[-1], spacing, origin))


def nifti_header(dims: tuple[int, int, int], dtype: str, spacing=(1.0, 1.0, 1.0), origin=(0.0, 0.0, 0.0)) -> bytes:
    head = bytearray(352)
    code, bits = NIFTI_CODES[dtype]
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *dims, 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, code, bits)
    struct.pack_into("<8f", head, 76, 1, *spacing, 1, 1, 1, 1)
    struct.pack_into("<3f", head, 108, 352, 1, 0)
    struct.pack_into("<2h", head, 252, 0, 1)
    for i in range(3):
        struct.pack_into("<4f", head, 280 + 16 * i, *[spacing[i] if j == i else 0.0 for j in range(3)], origin[i])
    head[344:348] = b"n+1\0"
    return bytes(head)


def write_nifti(voxels: DataFrame, path: str, dims: tuple[int, int, int], dtype: str = "f4", spacing=(1.0, 1.0, 1.0), origin=(0.0, 0.0, 0.0)) -> None:
    """A NIfTI-1 file in a folder that all machines can open."""
    _one_file(slabs(voxels, dims, f"<{dtype}"), path, dims, dtype, nifti_header(dims, dtype, spacing, origin))


def write_png_slices(voxels: DataFrame, path: str, dims: tuple[int, int, int], spacing=(1.0, 1.0, 1.0), origin=(0.0, 0.0, 0.0)) -> None:
    """A PNG a slice, named by its number, and volume.xml with extent, spacing, origin and the range of the values, in a folder that all machines can open."""
    import os

    folder = local_path(path)
    os.makedirs(folder, exist_ok=True)

    def run(batches):
        import pandas as pd

        for df in batches:
            for z, png in zip(df["z"], df["png"], strict=True):
                part = f"{folder}/{int(z):06d}.png.{os.getpid()}.tmp"
                with open(part, "wb") as f:
                    f.write(png)
                os.replace(part, f"{folder}/{int(z):06d}.png")
            yield pd.DataFrame({"n": [len(df)]})

    png_slices(voxels, dims).mapInPandas(run, "n long").count()
    lo, hi = voxels.agg(F.min("v"), F.max("v")).first()
    line = lambda values: " ".join(f"{v:g}" for v in values)
    root = ET.Element("volume", {"dimensions": line(dims), "spacing": line(spacing), "origin": line(origin), "min": f"{lo or 0:g}", "max": f"{hi or 0:g}", "slices": "%06d.png"})
    ET.ElementTree(root).write(f"{folder}/volume.xml", encoding="utf-8", xml_declaration=True)


def encode_png(plane: np.ndarray) -> bytes:
    """An 8-bit grey PNG."""
    h, w = plane.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.c_[np.zeros((h, 1), np.uint8), plane.astype(np.uint8)]
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def png_slices(voxels: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """z, png of each slice, values clamped to bytes."""
    import pandas as pd

    def encoded(data: pd.Series) -> pd.Series:
        return data.map(lambda d: encode_png(np.frombuffer(d, "<f4").reshape(dims[1], dims[0]).clip(0, 255)))

    encoded.__annotations__ = {"data": pd.Series, "return": pd.Series}
    pack = F.pandas_udf(encoded, "binary")
    return slabs(voxels, dims).select("z", pack("data").alias("png"))


def label_manifest(sizes: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """label, file, voxels and, if given, name and color: one row a label, as written beside the per-label meshes."""
    out = sizes.select(F.col("v").cast("int").alias("label"), F.format_string("%d.vtk", F.col("v").cast("int")).alias("file"), "voxels")
    return out if names is None else out.join(names, "label", "left")


def write_label_meshes(points: DataFrame, faces: DataFrame, path: str, names: DataFrame | None = None) -> None:
    """A VTK file a label, each written line by line by the task that gets the label's sorted lines, and meshes.xml with their names and colours (label, name, color), in a folder that all machines can open."""
    import os

    import pandas as pd
    from pyspark.sql import Window

    folder = local_path(path)
    os.makedirs(folder, exist_ok=True)
    label = F.col("label").cast("long").alias("label")
    at = F.row_number().over(Window.partitionBy("label").orderBy("vid")) - 1
    p = written(points.select(label, "vid", *[F.col(k).cast("double").alias(k) for k in "xyz"]).withColumn("at", at.cast("long")), "label-points")
    corners = faces.select(label, "fid", F.posexplode("vs").alias("pos", "vid")).join(p.select("label", "vid", "at"), ["label", "vid"])
    f = written(corners.groupBy("label", "fid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "at"))), lambda s: s["at"]).alias("vs")), "label-faces")
    counts = p.groupBy("label").agg(F.count("*").alias("vertices")).join(f.groupBy("label").agg(F.count("*").alias("faces"), F.sum(F.size("vs") + 1).alias("words")), "label", "left").fillna(0)
    counts = written(counts, "label-counts")
    line = lambda df, section, id, value: df.select("label", F.lit(section).alias("section"), id.alias("id"), value.alias("value"))
    zero = F.lit(0).cast("long")
    lines = line(counts, 0, zero, F.concat(F.lit("# vtk DataFile Version 3.0\nmesh\nASCII\nDATASET POLYDATA\nPOINTS "), F.col("vertices").cast("string"), F.lit(" double")))
    lines = lines.unionByName(line(p, 1, F.col("at"), _xyz())).unionByName(line(counts, 2, zero, F.concat(F.lit("POLYGONS "), _numbers(F.col("faces"), F.col("words")))))
    lines = lines.unionByName(line(f, 3, F.col("fid").cast("long"), F.concat_ws(" ", F.size("vs").cast("string"), F.transform("vs", lambda x: x.cast("string")))))

    def run(batches):
        out, own = None, None
        for df in batches:
            for key, part in df.groupby("label", sort=False):
                if key != own:
                    if out is not None:
                        out.close()
                        os.replace(out.name, f"{folder}/{own}.vtk")
                        yield pd.DataFrame({"label": [own]})
                    out, own = open(f"{folder}/{int(key)}.vtk.{os.getpid()}.tmp", "w", encoding="ascii"), int(key)
                out.write("\n".join(part["value"]) + "\n")
        if out is not None:
            out.close()
            os.replace(out.name, f"{folder}/{own}.vtk")
            yield pd.DataFrame({"label": [own]})

    done = lines.repartition("label").sortWithinPartitions("label", "section", "id").select("label", "value").mapInPandas(run, "label long")
    done = done.join(counts.select("label", F.concat(F.col("label").cast("string"), F.lit(".vtk")).alias("file"), "vertices", "faces"), "label")
    if names is not None:
        done = done.join(names, "label", "left")
    root = ET.Element("meshes")
    for r in sorted(done.collect(), key=lambda r: r.label):  # one row a label
        ET.SubElement(root, "mesh", {k: str(v) for k, v in r.asDict().items() if v is not None})
    ET.ElementTree(root).write(f"{folder}/meshes.xml", encoding="utf-8", xml_declaration=True)


def save_table(df: DataFrame, path: str) -> None:
    """A clustering (item, cluster) or curvature (elt, k, d1, d2), to be loaded again by ``meshes.load_table``."""
    df.write.mode("overwrite").parquet(path)
