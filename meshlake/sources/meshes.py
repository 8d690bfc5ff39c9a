"""Mesh files as tables: OFF, OBJ, PLY, STL, legacy VTK, VTP and VRML.

The format is the first of vtk, vtp, ply, wrl, off, obj, stl that the lower-cased file name holds. Files are read by Spark (any store it can open) and
parsed in the tasks: small ones and binary ones a file to a row, text over ``LARGE`` bytes line by line (see ``mesh_text``). OBJ files can also be read by their lines whatever their size.
"""

from __future__ import annotations

import base64
import re
import struct
import xml.etree.ElementTree as ET
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.operators.mesh import Mesh, dense_rank

from . import mesh_text

#: Text files of more bytes than this are read by their lines, in parallel.
LARGE = 16 << 20
FORMATS = ("vtk", "vtp", "ply", "wrl", "off", "obj", "stl")
Parsed = tuple[np.ndarray, list[list[int]]]


def format_of(name: str) -> str:
    low = name.lower().rsplit("/", 1)[-1]
    for f in FORMATS:
        if f in low:
            return f
    raise ValueError(f"{name}: no known mesh format")


def _counted(flat: list[int]) -> list[list[int]]:
    """Faces of a flat list of counts and ids."""
    out, i = [], 0
    while i < len(flat):
        out.append([int(v) for v in flat[i + 1 : i + 1 + flat[i]]])
        i += 1 + flat[i]
    return out


def parse_off(data: bytes) -> Parsed:
    lines = [line.split(b"#")[0].split() for line in data.splitlines()]
    lines = [x for x in lines if x]
    if not lines or not lines[0][0].endswith(b"OFF"):
        raise ValueError("no OFF header")
    rest = ([lines[0][1:]] if len(lines[0]) > 1 else []) + lines[1:]
    nv, nf = int(rest[0][0]), int(rest[0][1])
    points = np.array([[float(v) for v in x[:3]] for x in rest[1 : 1 + nv]]).reshape(-1, 3)
    return points, [[int(v) for v in x[1 : 1 + int(x[0])]] for x in rest[1 + nv : 1 + nv + nf]]  # colours may follow


def parse_obj(data: bytes) -> Parsed:
    points, faces = [], []
    for line in data.decode("utf-8", "replace").splitlines():
        t = line.split()
        if t[:1] == ["v"]:
            points.append([float(v) for v in t[1:4]])
        elif t[:1] == ["f"]:
            ids = [int(v.split("/")[0]) for v in t[1:]]
            faces.append([i - 1 if i > 0 else len(points) + i for i in ids])
    return np.array(points).reshape(-1, 3), faces


def parse_stl(data: bytes) -> Parsed:
    if len(data) >= 84 and len(data) == 84 + 50 * struct.unpack("<I", data[80:84])[0]:
        rec = np.frombuffer(data, np.dtype([("n", "<f4", 3), ("p", "<f4", (3, 3)), ("a", "<u2")]), offset=84)
        corners = rec["p"].reshape(-1, 3).astype(float)
    else:
        corners = np.array([[float(x) for x in m.split()] for m in re.findall(rb"vertex\s+([^\n\r]+)", data)]).reshape(-1, 3)
    points, inverse = np.unique(corners, axis=0, return_inverse=True)
    return points, inverse.reshape(-1, 3).tolist()


#: Scalar type names of the PLY format.
_PLY = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}


def parse_ply(data: bytes) -> Parsed:
    end = data.index(b"end_header")
    body = data[data.index(b"\n", end) + 1 :]
    kind, elements = "ascii", []
    for line in data[:end].decode("ascii", "replace").splitlines():
        t = line.split()
        if t[:1] == ["format"]:
            kind = t[1]
        elif t[:1] == ["element"]:
            elements.append((t[1], int(t[2]), []))
        elif t[:1] == ["property"]:
            elements[-1][2].append(t[1:])
    points, faces = [], []
    order = "<" if kind == "binary_little_endian" else ">"
    words, at = (body.split() if kind == "ascii" else []), 0

    def take(t: str):
        nonlocal at
        if kind == "ascii":
            at += 1
            return float(words[at - 1])
        d = np.dtype(order + _PLY[t])
        at += d.itemsize
        return np.frombuffer(body, d, 1, at - d.itemsize)[0]

    for name, count, properties in elements:
        for _ in range(count):
            row = {p[-1]: [take(p[2]) for _ in range(int(take(p[1])))] if p[0] == "list" else take(p[0]) for p in properties}
            if name == "vertex":
                points.append([float(row[k]) for k in "xyz"])
            elif name == "face":
                faces.append([int(v) for v in next(v for v in row.values() if isinstance(v, list))])
    return np.array(points).reshape(-1, 3), faces


#: Scalar type names of the legacy VTK format.
_VTK = {"char": "i1", "unsigned_char": "u1", "short": "i2", "unsigned_short": "u2", "int": "i4", "unsigned_int": "u4", "long": "i8", "unsigned_long": "u8", "float": "f4", "double": "f8", "vtkidtype": "i8"}


def parse_vtk(data: bytes) -> Parsed:
    binary = data.split(b"\n", 3)[2].strip().upper() == b"BINARY"
    points, faces = np.zeros((0, 3)), []
    for m in re.finditer(rb"^(POINTS|POLYGONS|TRIANGLE_STRIPS)\s+(\d+)\s+(\S+)[^\n]*\n", data, re.M):
        n, third, at = int(m[2]), m[3].decode().lower(), m.end()
        if m[1] == b"POINTS":
            if binary:
                points = np.frombuffer(data, ">" + _VTK[third], 3 * n, at).astype(float).reshape(-1, 3)
            else:
                points = np.array(data[at:].split(None, 3 * n)[: 3 * n], float).reshape(-1, 3)
        elif m[1] == b"POLYGONS":
            size = int(third)
            flat = np.frombuffer(data, ">i4", size, at) if binary else np.array(data[at:].split(None, size)[:size], int)
            faces = _counted(flat.tolist())
    return points, faces


#: Scalar type names of the VTK XML formats.
_XML = {"Int8": "i1", "UInt8": "u1", "Int16": "i2", "UInt16": "u2", "Int32": "i4", "UInt32": "u4", "Int64": "i8", "UInt64": "u8", "Float32": "f4", "Float64": "f8"}


def _xml_array(node: ET.Element, order: str, head: str, packed: bool) -> np.ndarray:
    kind = order + _XML[node.get("type")]
    text = (node.text or "").strip()
    if node.get("format") == "ascii":
        return np.array(text.split(), np.dtype(kind))
    if node.get("format") != "binary":
        raise ValueError("appended data is not read")
    h = np.dtype(order + _XML[head])
    if not packed:
        raw = base64.b64decode(text)
        return np.frombuffer(raw[h.itemsize : h.itemsize + int(np.frombuffer(raw, h, 1)[0])], kind)
    blocks = int(np.frombuffer(base64.b64decode(text[: -(-h.itemsize // 3) * 4]), h, 1)[0])
    size = -(-(3 + blocks) * h.itemsize // 3) * 4
    sizes = np.frombuffer(base64.b64decode(text[:size]), h)[3 : 3 + blocks]
    raw, out, at = base64.b64decode(text[size:]), b"", 0
    for s in sizes.tolist():
        out += zlib.decompress(raw[at : at + s])
        at += s
    return np.frombuffer(out, kind)


def parse_vtp(data: bytes) -> Parsed:
    root = ET.fromstring(data)
    order = ">" if root.get("byte_order") == "BigEndian" else "<"
    get = lambda n: _xml_array(n, order, root.get("header_type", "UInt32"), bool(root.get("compressor")))
    points, faces = [], []
    for piece in root.iter("Piece"):
        base = sum(len(p) for p in points)
        points.append(get(piece.find("Points/DataArray")).astype(float).reshape(-1, 3))
        polys = {a.get("Name"): get(a) for a in piece.findall("Polys/DataArray")}
        start = 0
        for end in polys.get("offsets", np.zeros(0, int)).tolist():
            faces.append([base + int(v) for v in polys["connectivity"][start:end]])
            start = end
    return (np.concatenate(points) if points else np.zeros((0, 3))), faces


def parse_wrl(data: bytes) -> Parsed:
    """The last indexed face set of a VRML file."""
    text = re.sub(r"#[^\n]*", "", data.decode("utf-8", "replace"))
    sets = re.findall(r"point\s*\[([^\]]*)\].*?coordIndex\s*\[([^\]]*)\]", text, re.S)
    if not sets:
        return np.zeros((0, 3)), []
    points = np.array(sets[-1][0].replace(",", " ").split(), float).reshape(-1, 3)
    faces, face = [], []
    for i in map(int, sets[-1][1].replace(",", " ").split()):
        if i < 0:
            faces.append(face)
            face = []
        else:
            face.append(i)
    return points, [f for f in [*faces, face] if f]


PARSERS = {"vtk": parse_vtk, "vtp": parse_vtp, "ply": parse_ply, "wrl": parse_wrl, "off": parse_off, "obj": parse_obj, "stl": parse_stl}


def kind_of(path: str) -> str:
    """The format of a file; the parts of a written mesh (see ``sinks.write_mesh``) have the kind of their folder."""
    folder, _, name = path.rpartition("/")
    return format_of(folder if name.startswith("part-") else path)


def read_meshes(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """(vertices: path, vid, x, y, z; faces: path, fid, vs) of all files. Faces whose first two ids are equal are inactive and left out."""

    def run(batches):
        for df in batches:
            for path, content in zip(df["path"], df["content"], strict=True):
                points, faces = PARSERS[kind_of(path)](bytes(content))
                yield pd.DataFrame({"path": path, "id": np.arange(len(points)), "x": points[:, 0], "y": points[:, 1], "z": points[:, 2], "vs": None})
                kept = [(i, f) for i, f in enumerate(faces) if len(f) > 1 and f[0] != f[1]]
                yield pd.DataFrame({"path": path, "id": [i for i, _ in kept], "x": None, "y": None, "z": None, "vs": [f for _, f in kept]})

    files = spark.read.format("binaryFile").load(list(paths))
    by_lines = {}
    for r in files.where(F.col("length") > LARGE).select("path").collect():  # one row a large file
        found = mesh_text.by_lines(spark, r.path, kind_of(r.path))
        if found is not None:
            by_lines[r.path] = found
    whole = files.where(~F.col("path").isin(list(by_lines))) if by_lines else files
    rows = whole.select("path", "content").mapInPandas(run, "path string, id long, x double, y double, z double, vs array<long>")
    vertices = rows.where("vs IS NULL").select("path", F.col("id").alias("vid"), "x", "y", "z")
    faces = rows.where("vs IS NOT NULL").select("path", F.col("id").alias("fid"), "vs")
    for path, (v, f) in by_lines.items():
        vertices = vertices.unionByName(v.select(F.lit(path).alias("path"), "vid", "x", "y", "z"))
        faces = faces.unionByName(f.where("size(vs) > 1 AND vs[0] <> vs[1]").select(F.lit(path).alias("path"), "fid", "vs"))
    return vertices, faces


def read_mesh(spark: SparkSession, path: str) -> Mesh:
    v, f = read_meshes(spark, path)
    return Mesh(v.drop("path"), f.drop("path"))


def read_obj_lines(spark: SparkSession, path: str) -> Mesh:
    """A large OBJ file with absolute ids, by its lines in parallel. Lines keep their order by the ids that the scan gives."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.split(F.trim("value"), r"\s+").alias("t"))
    v = dense_rank(lines.where("t[0] = 'v'").select("line", *[F.col("t")[i + 1].cast("double").alias(k) for i, k in enumerate("xyz")]), "line")
    f = dense_rank(lines.where("t[0] = 'f'").select("line", F.transform(F.slice("t", 2, 1 << 30), lambda s: F.substring_index(s, "/", 1).cast("long") - 1).alias("vs")), "line")
    return Mesh(v.select(F.col("rank").alias("vid"), "x", "y", "z"), f.select(F.col("rank").alias("fid"), "vs"))


def load_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``sinks.save_table`` wrote; fails if a column of the schema is missing."""
    found = spark.read.parquet(path)
    return found.select(*[F.col(c).cast(t).alias(c) for c, t in (x.split(None, 1) for x in schema.split(", "))])
