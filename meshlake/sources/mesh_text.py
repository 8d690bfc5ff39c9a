"""Large text files of meshes, read by their lines in parallel.

Lines get their number from the counts of the file's blocks, so no task sees the file. The few lines that are not numbers alone (headings, tags, brackets) are looked at by the driver and tell where points and
faces are. A file that has other than one point or face to a line is left to the parser of whole files.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.functions.state import written
from meshlake.operators.mesh import dense_rank
from meshlake.operators.measures import cumulative

Tables = tuple[DataFrame, DataFrame]
HEADINGS = 10_000  # more lines with words than this are not headings


def _head(spark: SparkSession, path: str, size: int = 4096) -> bytes:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def _numbered(spark: SparkSession, path: str, value: Column, kept: Column) -> tuple[DataFrame, int]:
    """line, value of the lines that are kept, in order from 0; and their number."""
    rows = spark.read.text(path).select(F.col("_metadata.file_block_start").alias("start"), value.alias("value")).where(kept).withColumn("at", F.monotonically_increasing_id())
    shifts, n = [], 0
    for r in sorted(rows.groupBy("start").agg(F.min("at").alias("first"), F.count("*").alias("n")).collect()):  # one row a block of the file
        shifts.append((r.start, n - r.first))
        n += r.n
    if not shifts:
        return rows.select(F.lit(0).cast("long").alias("line"), "value"), 0
    shift = F.broadcast(spark.createDataFrame(shifts, "start long, shift long"))
    return rows.join(shift, "start").select((F.col("at") + F.col("shift")).alias("line"), "value"), n


class _Text:
    """A file's lines that are not blank, as words, with the headings among them."""

    def __init__(self, spark: SparkSession, path: str, comment: str | None = None, comma: str = r"\s+"):
        bare = F.col("value") if comment is None else F.regexp_replace("value", f"{comment}.*", "")
        lines, self.n = _numbered(spark, path, F.trim(F.regexp_replace(bare, comma, " ")), F.col("value") != "")
        self.lines = lines.select("line", F.split("value", " ").alias("t"), "value")
        found = self.lines.where((F.col("line") < 2) | F.col("value").rlike(r"[^0-9eE+\-. ]")).select("line", "value").limit(HEADINGS + 1).collect()
        self.first = {r.line: r.value for r in found if r.line < 2}
        self.heads = {r.line: r.value for r in sorted(found) if re.search(r"[^0-9eE+\-. ]", r.value)}
        self.readable = len(found) <= HEADINGS

    def after(self, line: int) -> int:
        """The next heading's line."""
        return min((k for k in self.heads if k > line), default=self.n)

    def section(self, lo: int, n: int) -> DataFrame:
        """id, t of the lines lo to lo + n. Other lines' words are null, so that a cast which Spark moves before the filter does not meet them."""
        inside = (F.col("line") >= lo) & (F.col("line") < lo + n)
        return self.lines.where(inside).select((F.col("line") - lo).alias("id"), F.when(inside, F.col("t")).alias("t"))

    def skeleton(self) -> str:
        """The headings, with @lo:hi for the lines between two of them."""
        out, last = [], 0
        for k in [*self.heads, self.n]:
            if k > last:
                out.append(f"@{last}:{k}")
            if k < self.n:
                out.append(self.heads[k])
            last = k + 1
        return "\n".join(out)


def _all(df: DataFrame, ok: Column) -> bool:
    return df.where(~F.coalesce(ok, F.lit(False))).limit(1).count() == 0


def _points(df: DataFrame, first: int = 0, names: list[int] | None = None) -> DataFrame:
    return df.select(F.col("id").alias("vid"), *[F.col("t")[first + i].cast("double").alias(k) for k, i in zip("xyz", names or range(3), strict=True)])


def _faces(df: DataFrame, ids: Column) -> DataFrame:
    return df.select(F.col("id").alias("fid"), ids.cast("array<long>").alias("vs"))


def _count(at: int = 0) -> Column:
    return F.col("t")[at].cast("double").cast("int")


def _listed(at: int = 0) -> Column:
    """The ids of a list of words that begins with their number."""
    return F.slice("t", at + 2, _count(at))


def _off(spark: SparkSession, path: str) -> Tables | None:
    text = _Text(spark, path, comment="#")
    first = text.first.get(0, "").split()
    if not text.readable or not first or not first[0].endswith("OFF"):
        return None
    counts, lo = (first[1:], 1) if len(first) > 1 else (text.first.get(1, "").split(), 2)
    nv, nf = int(counts[0]), int(counts[1])
    if text.n < lo + nv + nf:
        return None
    return _points(text.section(lo, nv)), _faces(text.section(lo + nv, nf), _listed())


def _obj(spark: SparkSession, path: str) -> Tables | None:
    """Faces that count points from the last one (negative ids) are left to the parser of whole files."""
    words = F.split(F.trim("value"), r"\s+")
    rows = {k: _numbered(spark, path, F.col("value"), F.regexp_like("value", F.lit(rf"^\s*{k}\s")))[0].select(F.col("line").alias("id"), F.slice(words, 2, 1 << 30).alias("t")) for k in "vf"}
    if not _all(rows["f"], ~F.exists("t", lambda s: s.startswith("-"))):
        return None
    return _points(rows["v"]), _faces(rows["f"], F.transform("t", lambda s: F.substring_index(s, "/", 1).cast("long") - 1))


def _ply(spark: SparkSession, path: str) -> Tables | None:
    text = _Text(spark, path)
    end = next((k for k, v in text.heads.items() if v == "end_header"), None)
    head = [v.split() for k, v in text.heads.items() if end is not None and k < end]
    if not text.readable or ["format", "ascii", "1.0"] not in head:
        return None
    lo, found = end + 1, {}
    for i, t in enumerate(head):
        if t[0] == "element":
            own = [p[1:] for p in head[i + 1 : next((j for j in range(i + 1, len(head)) if head[j][0] == "element"), len(head))] if p[0] == "property"]
            found[t[1]] = (text.section(lo, int(t[2])), own)
            lo += int(t[2])
    if lo != text.n or not {"vertex", "face"} <= found.keys():
        return None
    (v, scalars), (f, lists) = found["vertex"], found["face"]
    at = next((i for i, p in enumerate(lists) if p[0] == "list"), None)
    names = [p[-1] for p in scalars]
    if at is None or any(p[0] == "list" for p in scalars) or not {"x", "y", "z"} <= set(names):
        return None
    if not _all(v, F.size("t") == len(names)) or not _all(f, F.size("t") > at + _count(at)):
        return None
    return _points(v, 0, [names.index(k) for k in "xyz"]), _faces(f, F.transform(_listed(at), lambda s: s.cast("double").cast("long")))


def _vtk(spark: SparkSession, path: str) -> Tables | None:
    text = _Text(spark, path)
    if not text.readable:
        return None
    found = {}
    for line, value in text.heads.items():
        t = value.split()
        if t[0] in ("POINTS", "POLYGONS"):
            found[t[0]] = (line + 1, int(t[1]))
    if found.keys() != {"POINTS", "POLYGONS"} or any(text.after(lo - 1) - lo != n for lo, n in found.values()):
        return None
    v, f = text.section(*found["POINTS"]), text.section(*found["POLYGONS"])
    if not _all(v, F.size("t") == 3) or not _all(f, F.size("t") == 1 + _count()):
        return None
    return _points(v), _faces(f, _listed())


def _run(text: str | None) -> tuple[int, int] | None:
    """First line and number of the lines that are all there is in a part of a skeleton."""
    m = re.fullmatch(r"\s*@(\d+):(\d+)\s*", text or "")
    return (int(m[1]), int(m[2]) - int(m[1])) if m else None


def _vtp(spark: SparkSession, path: str) -> Tables | None:
    text = _Text(spark, path)
    if not text.readable:
        return None
    pieces = list(ET.fromstring(text.skeleton()).iter("Piece"))
    if len(pieces) != 1:
        return None
    arrays = {"points": pieces[0].find("Points/DataArray")} | {a.get("Name"): a for a in pieces[0].findall("Polys/DataArray")}
    arrays = {k: arrays.get(k) for k in ("points", "connectivity", "offsets")}
    if any(a is None or a.get("format") != "ascii" or _run(a.text) is None for a in arrays.values()):
        return None
    v, f, ends = (text.section(*_run(a.text)) for a in arrays.values())
    if not _all(v, F.size("t") == 3) or not _all(ends, F.size("t") == 1):
        return None
    # A face to a line: the words up to the end of each line are the offsets.
    upto = cumulative(f.select("id", F.size("t").alias("n")), "id", "n").select("id", F.col("upto").cast("long").alias("n"))
    seen = [df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("id", "n").cast("decimal(38,0)")).alias("h")).first() for df in (upto, ends.select("id", F.col("t")[0].cast("long").alias("n")))]
    return (_points(v), _faces(f, F.col("t"))) if seen[0] == seen[1] else None


def _wrl(spark: SparkSession, path: str) -> Tables | None:
    """The last indexed face set of a VRML file."""
    text = _Text(spark, path, comment="#", comma=r"[\s,]+")
    sets = re.findall(r"point\s*\[([^\]]*)\].*?coordIndex\s*\[([^\]]*)\]", text.skeleton(), re.S) if text.readable else []
    if not sets or any(_run(x) is None for x in sets[-1]):
        return None
    v, f = (text.section(*_run(x)) for x in sets[-1])
    if not _all(v, F.size("t") == 3) or not _all(f, (F.size("t") > 1) & (F.array_position(F.transform("t", lambda s: s.cast("long") < 0), F.lit(True)) == F.size("t"))):
        return None
    return _points(v), _faces(f, F.slice("t", 1, F.size("t") - 1))


def _stl(spark: SparkSession, path: str) -> Tables | None:
    """Corners, three to a face. Points are numbered in order of their places, as by the parser of whole files."""
    rows, n = _numbered(spark, path, F.regexp_replace("value", r"^\s*vertex\s+", ""), F.regexp_like("value", F.lit(r"^-?[0-9.]")))
    at = rows.select("line", F.split(F.trim("value"), r"\s+").alias("t"))
    if not n or n % 3:
        return None
    c = written(at.select((F.floor(F.col("line") / 3)).alias("fid"), (F.col("line") % 3).alias("pos"), *[(F.col("t")[i].cast("double") + 0.0).alias(k) for i, k in enumerate("xyz")]), "stl-corners")
    key = ["x", "y", "z"]
    once = written(c.select(*key).distinct().repartitionByRange(*key).sortWithinPartitions(*key).withColumn("at", F.monotonically_increasing_id()), "stl-points")
    points = dense_rank(once, "at").select(F.col("rank").alias("vid"), *key)
    near = c.join(points, key).groupBy("fid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "vid"))), lambda s: s["vid"]).alias("vs"))
    return points, near


PARSERS = {"off": _off, "obj": _obj, "ply": _ply, "vtk": _vtk, "vtp": _vtp, "wrl": _wrl, "stl": _stl}


def by_lines(spark: SparkSession, path: str, kind: str) -> Tables | None:
    """(vid, x, y, z; fid, vs) in the file's order, or None for what is not text or has not one point or face to a line."""
    if kind not in PARSERS or b"\0" in _head(spark, path):
        return None
    return PARSERS[kind](spark, path)
