"""Voxel images as tables: MetaImage (mhd/mha) as a Spark data source with slab partitions and box pushdown; NIfTI, PNG and image stacks."""

from __future__ import annotations

import gzip
import os
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from meshlake.functions.state import local_path

#: Scalar type names of the MetaImage format and type codes of the NIfTI-1 format.
META = {"MET_CHAR": "i1", "MET_UCHAR": "u1", "MET_SHORT": "i2", "MET_USHORT": "u2", "MET_INT": "i4", "MET_UINT": "u4", "MET_LONG": "i4", "MET_ULONG": "u4", "MET_LONG_LONG": "i8", "MET_ULONG_LONG": "u8", "MET_FLOAT": "f4", "MET_DOUBLE": "f8"}
NIFTI = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


def meta_header(path: str) -> dict:
    """Fields of a MetaImage header, with dtype, dims, spacing, origin, channels, the data file and the byte at which data begin."""
    fields, at = {}, 0
    with open(path, "rb") as f:
        for line in f:
            at += len(line)
            key, eq, value = line.decode("latin-1").partition("=")
            if not eq:
                break
            fields[key.strip()] = value.strip()
            if key.strip() == "ElementDataFile":
                break
    if "DimSize" not in fields or "ElementType" not in fields:
        raise ValueError(f"{path}: no MetaImage header")
    dims = [int(v) for v in fields["DimSize"].split()]
    big = fields.get("BinaryDataByteOrderMSB", fields.get("ElementByteOrderMSB", "False")).lower() == "true"
    numbers = lambda key, other: [float(v) for v in fields.get(key, other).split()]
    local = fields.get("ElementDataFile", "LOCAL") == "LOCAL"
    return {
        "fields": fields, "dims": (dims + [1, 1])[:3], "dtype": (">" if big else "<") + META[fields["ElementType"]], "channels": int(fields.get("ElementNumberOfChannels", 1)),
        "spacing": numbers("ElementSpacing", fields.get("ElementSize", "1 1 1")), "origin": numbers("Offset", fields.get("Position", "0 0 0")),
        "slope": float(fields.get("RescaleSlope", 1)), "intercept": float(fields.get("RescaleIntercept", 0)), "packed": fields.get("CompressedData", "False").lower() == "true",
        "data": path if local else os.path.join(os.path.dirname(path), fields["ElementDataFile"]), "skip": at if local else int(fields.get("HeaderSize", 0)),
    }


def is_metaimage(path: str) -> bool:
    """By ending and first key."""
    if not path.lower().endswith((".mhd", ".mha")):
        return False
    with open(path, "rb") as f:
        return f.readline().split(b"=")[0].strip() in (b"ObjectType", b"NDims", b"Comment")


class _Slab(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Inflated:
    """Slices of a compressed file in ascending order, inflated as a stream up to the last one asked for; one slice is held at a time."""

    def __init__(self, f, size: int):
        self.f, self.size, self.left, self.z, self.stream = f, size, b"", 0, zlib.decompressobj()

    def slice(self, z: int) -> bytes:
        while True:
            while len(self.left) < self.size and not self.stream.eof:
                data = self.stream.unconsumed_tail or self.f.read(1 << 20)
                if not data:
                    break
                self.left += self.stream.decompress(data, max(self.size, 1 << 20))
            if len(self.left) < self.size:
                raise EOFError(f"the file ends in slice {self.z}")
            out, self.left, self.z = self.left[: self.size], self.left[self.size :], self.z + 1
            if self.z > z:
                return out


class _MetaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = local_path(options["path"])
        self.head = meta_header(self.path)
        dims = self.head["dims"]
        self.box = [(max(0, int(options.get(f"min{k}", 0))), min(d - 1, int(options.get(f"max{k}", d - 1)))) for k, d in zip("xyz", dims, strict=True)]
        self.slab = int(options.get("slab", max(1, (1 << 22) // max(1, dims[0] * dims[1]))))
        self.channel = int(options.get("channel", 0))

    def pushFilters(self, filters):
        """Comparisons of x, y and z with whole numbers narrow the box; all others are left to Spark."""
        for f in filters:
            axis = "xyz".find(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 and len(f.attribute[0]) == 1 else -1
            if axis < 0 or not isinstance(getattr(f, "value", None), int):
                yield f
                continue
            lo, hi = self.box[axis]
            if isinstance(f, EqualTo):
                lo, hi = max(lo, f.value), min(hi, f.value)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                lo = max(lo, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                hi = min(hi, f.value - isinstance(f, LessThan))
            else:
                yield f
                continue
            self.box[axis] = (lo, hi)

    def partitions(self):
        if any(lo > hi for lo, hi in self.box):
            return [_Slab(0, -1)]
        low, high = self.box[2]
        if self.head["packed"]:  # a deflated stream can only be read from its start: by one task, slice by slice
            return [_Slab(low, high)]
        return [_Slab(z, min(high, z + self.slab - 1)) for z in range(low, high + 1, self.slab)]

    def read(self, part):
        h, dims = self.head, self.head["dims"]
        kind = np.dtype(h["dtype"])
        (x0, x1), (y0, y1), _ = self.box
        plane = dims[0] * dims[1] * h["channels"]
        with open(h["data"], "rb") as f:
            if h["packed"]:
                f.seek(h["skip"])
                packed = _Inflated(f, plane * kind.itemsize)
            for z in range(part.low, part.high + 1):
                if h["packed"]:
                    data = np.frombuffer(packed.slice(z), kind)
                else:
                    # Only the rows of the box are read.
                    row = dims[0] * h["channels"]
                    f.seek(h["skip"] + (z * plane + y0 * row) * kind.itemsize)
                    data = np.zeros(plane, kind)
                    data[y0 * row : (y1 + 1) * row] = np.fromfile(f, kind, (y1 - y0 + 1) * row)
                v = data.reshape(dims[1], dims[0], h["channels"])[y0 : y1 + 1, x0 : x1 + 1, self.channel].astype(float) * h["slope"] + h["intercept"]
                y, x = np.mgrid[y0 : y1 + 1, x0 : x1 + 1]
                yield pa.RecordBatch.from_pandas(pd.DataFrame({"x": x.ravel(), "y": y.ravel(), "z": z, "v": v.ravel()}).astype({"x": "int64", "y": "int64", "z": "int64"}), preserve_index=False)


class MetaImage(DataSource):
    """spark.read.format("metaimage").load(path); options minx .. maxz cut a box, as filters on x, y and z do; slab sets the slices of a partition, channel
    the component that is read (the first if not given)."""

    @classmethod
    def name(cls):
        return "metaimage"

    def schema(self):
        return "x long, y long, z long, v double"

    def reader(self, schema):
        return _MetaReader(dict(self.options))


def read_metaimage(spark: SparkSession, path: str, low: tuple[int, int, int] | None = None, high: tuple[int, int, int] | None = None, slab: int | None = None) -> DataFrame:
    """Voxels of a MetaImage file in a folder that all machines can open; the box is applied while reading."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MetaImage)
    r = spark.read.format("metaimage")
    for k, v in zip(("minx", "miny", "minz", "maxx", "maxy", "maxz"), [*(low or (None,) * 3), *(high or (None,) * 3)], strict=True):
        r = r if v is None else r.option(k, v)
    return (r if slab is None else r.option("slab", slab)).load(path)


def parse_nifti(data: bytes) -> tuple[np.ndarray, dict]:
    """Array in z, y, x order with positive axes, and the header. Axes whose direction is negative are flipped; slope and intercept always apply."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    order = "<" if struct.unpack("<i", data[:4])[0] == 348 else ">"
    dims = np.frombuffer(data, order + "i2", 8, 40)
    code = struct.unpack(order + "h", data[70:72])[0]
    pix = np.frombuffer(data, order + "f4", 8, 76)
    offset, slope, inter = struct.unpack(order + "3f", data[108:120])
    qform, sform = struct.unpack(order + "2h", data[252:256])
    nx, ny, nz = (int(d) for d in dims[1:4])
    v = np.frombuffer(data, order + NIFTI[code], nx * ny * nz, int(offset)).reshape(nz, ny, nx).astype(float)
    v = v * (slope or 1.0) + inter
    signs = [1.0, 1.0, 1.0]
    if sform > 0:
        rows = np.frombuffer(data, order + "f4", 12, 280).reshape(3, 4)
        signs = [rows[i, i] or 1.0 for i in range(3)]
    elif qform > 0:
        b, c, d = np.frombuffer(data, order + "f4", 3, 256)
        a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
        signs = [a * a + b * b - c * c - d * d, a * a + c * c - b * b - d * d, (a * a + d * d - b * b - c * c) * (pix[0] or 1.0)]
    for axis, s in zip((2, 1, 0), signs, strict=True):
        if s < 0:
            v = np.flip(v, axis)
    return v, {"spacing": [float(p) for p in pix[1:4]], "dims": (nx, ny, nz), "flipped": [bool(s < 0) for s in signs]}


def _voxel_frame(path: str, v: np.ndarray) -> pd.DataFrame:
    z, y, x = np.indices(v.shape)
    return pd.DataFrame({"path": path, "x": x.ravel(), "y": y.ravel(), "z": z.ravel(), "v": v.ravel().astype(float)})


def read_nifti(spark: SparkSession, *paths: str) -> DataFrame:
    """path, x, y, z, v of NIfTI-1 files."""

    def run(batches):
        for df in batches:
            for path, content in zip(df["path"], df["content"], strict=True):
                yield _voxel_frame(path, parse_nifti(bytes(content))[0])

    return spark.read.format("binaryFile").load(list(paths)).select("path", "content").mapInPandas(run, "path string, x long, y long, z long, v double")


def parse_png(data: bytes) -> np.ndarray:
    """Height, width, channels of a PNG without interlacing, of 8 or 16 bits."""
    at, idat = 8, b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h, bits, colour, _, _, lace = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            idat += body
        at += 12 + size
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    if bits not in (8, 16) or lace:
        raise ValueError("only PNG of 8 or 16 bits without interlacing")
    step = channels * bits // 8
    raw = np.frombuffer(zlib.decompress(idat), np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h, w * step), np.uint8)
    above = np.zeros(w * step, np.uint8)
    for i, line in enumerate(raw):
        kind, cur = line[0], line[1:].copy()
        if kind == 2:
            cur += above
        elif kind in (1, 3, 4):
            for j in range(w * step):
                a = int(cur[j - step]) if j >= step else 0
                b, c = int(above[j]), int(above[j - step]) if j >= step else 0
                if kind == 1:
                    add = a
                elif kind == 3:
                    add = (a + b) // 2
                else:
                    p = a + b - c
                    add = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                cur[j] = (int(cur[j]) + add) & 255
        out[i] = above = cur
    return out.view(">u2").reshape(h, w, channels) if bits == 16 else out.reshape(h, w, channels)


def read_png_stack(spark: SparkSession, *paths: str, channel: int = 0) -> DataFrame:
    """x, y, z, v of one channel of a folder's images; z is the rank of the file name. Images of other sizes than the first keep their own extent."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(list(paths))
    # One short row a file is ranked, without the images.
    ranks = files.select("path").withColumn("z", (F.row_number().over(Window.orderBy("path")) - 1).cast("long"))

    def run(batches):
        for df in batches:
            for z, content in zip(df["z"], df["content"], strict=True):
                yield _voxel_frame("", parse_png(bytes(content))[None, :, :, channel]).assign(z=z).drop(columns="path")

    return files.select("path", "content").join(ranks, "path").select("z", "content").mapInPandas(run, "x long, y long, z long, v double")


def read_volume(spark: SparkSession, path: str, channel: int = 0) -> DataFrame:
    """x, y, z, v of a MetaImage or NIfTI file or a folder of PNG images, told apart by name."""
    name = path.lower().removesuffix(".gz").rstrip("/")
    if name.endswith((".mhd", ".mha")):
        read_metaimage(spark, path)  # registers the source
        return spark.read.format("metaimage").option("channel", channel).load(path)
    if name.endswith(".nii"):
        return read_nifti(spark, path).drop("path")
    return read_png_stack(spark, path, channel=channel)
