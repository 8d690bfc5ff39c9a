"""Voxel tables (x, y, z, v): crops, resampling, contacts, label clean-up, filters, iso-surfaces."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import biggest_per_group, star_components

AXES = ("x", "y", "z")


def crop(voxels: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int]) -> DataFrame:
    """Voxels of the box, both ends included; on parquet the bounds reach the scan."""
    return reduce(lambda df, i: df.where(F.col(AXES[i]).between(low[i], high[i])), range(3), voxels)


def resample(voxels: DataFrame, factor: int) -> DataFrame:
    """Nearest resampling by a whole factor: every factor-th voxel of each axis."""
    keep = reduce(lambda a, b: a & b, [F.col(k) % factor == 0 for k in AXES])
    return voxels.where(keep).select(*[F.floor(F.col(k) / factor).alias(k) for k in AXES], *[c for c in voxels.columns if c not in AXES])


def flip(voxels: DataFrame, axis: str, size: int) -> DataFrame:
    return voxels.withColumn(axis, F.lit(size - 1) - F.col(axis))


def permute(voxels: DataFrame, order: tuple[str, str, str]) -> DataFrame:
    """Axes renamed: order names the old axis that becomes x, y and z."""
    rest = [c for c in voxels.columns if c not in AXES]
    return voxels.select(*[F.col(o).alias(k) for k, o in zip(AXES, order, strict=True)], *rest)


def slice_at(voxels: DataFrame, axis: str, at: int) -> DataFrame:
    """The plane as (u, w, v), the remaining axes in order."""
    u, w = [k for k in AXES if k != axis]
    return voxels.where(F.col(axis) == at).select(F.col(u).alias("u"), F.col(w).alias("w"), "v")


def labels(voxels: DataFrame) -> DataFrame:
    return voxels.groupBy("v").agg(F.count("*").alias("voxels"))


def extent(voxels: DataFrame) -> DataFrame:
    return voxels.agg(*[f(k).alias(f"{n}_{k}") for k in (*AXES, "v") for n, f in (("min", F.min), ("max", F.max))], F.count("*").alias("voxels"))


def neighbour_pairs(voxels: DataFrame) -> DataFrame:
    """Face-adjacent voxels, each pair once: x, y, z, v and the other's ox, oy, oz, ov. One equi-join for the three directions."""
    ahead = F.array(*[F.struct(*[(F.col(k) + (1 if k == d else 0)).alias(f"o{k}") for k in AXES]) for d in AXES])
    want = voxels.select(*AXES, "v", F.explode(ahead).alias("o")).select(*AXES, "v", "o.*")
    return want.join(voxels.select(*[F.col(k).alias(f"o{k}") for k in AXES], F.col("v").alias("ov")), [f"o{k}" for k in AXES])


def label_contacts(voxels: DataFrame) -> DataFrame:
    """a, b, contacts: face contacts between different labels, a < b."""
    p = neighbour_pairs(voxels).where("v <> ov")
    return p.groupBy(F.least("v", "ov").alias("a"), F.greatest("v", "ov").alias("b")).agg(F.count("*").alias("contacts"))


def _cell(prefix: str = "") -> F.Column:
    """One integer for a voxel: 21 bits an axis."""
    x, y, z = (F.col(f"{prefix}{k}").cast("long") for k in AXES)
    return F.shiftleft(z, 42) + F.shiftleft(y, 21) + x


def voxel_components(voxels: DataFrame) -> DataFrame:
    """x, y, z, v, comp: face-connected parts of equal label; comp is the least cell number (z, y, x order)."""
    same = neighbour_pairs(voxels).where("v = ov").select(_cell().alias("u"), _cell("o").alias("v"))
    comp = star_components(same)
    at = voxels.select(*AXES, "v", _cell().alias("node"))
    return at.join(comp, "node", "left").select(*AXES, "v", F.coalesce("label", "node").alias("comp"))


def component_contacts(components: DataFrame) -> DataFrame:
    """comp, label, contacts: for each component, its face contacts with each other label."""
    p = components.select(*AXES, F.col("v").alias("lab"), F.struct("v", "comp").alias("v"))
    pairs = neighbour_pairs(p).select(F.col("v.v").alias("a"), F.col("v.comp").alias("ca"), F.col("ov.v").alias("b"), F.col("ov.comp").alias("cb")).where("a <> b")
    both = pairs.select(F.col("ca").alias("comp"), F.col("b").alias("label")).unionByName(pairs.select(F.col("cb").alias("comp"), F.col("a").alias("label")))
    return both.groupBy("comp", "label").agg(F.count("*").alias("contacts"))


def clean_labels(voxels: DataFrame) -> DataFrame:
    """x, y, z, v: of each label the biggest component stays (the first in scan order on ties); others take the original label they touch most (the least on ties), in one pass."""
    comp = voxel_components(voxels)
    kept = biggest_per_group(comp, "v").select("comp").distinct().withColumn("kept", F.lit(True))
    to = component_contacts(comp).groupBy("comp").agg(F.max_by("label", F.struct("contacts", -F.col("label"))).alias("to"))
    j = comp.join(kept, "comp", "left").join(to, "comp", "left")
    return j.select(*AXES, F.when(F.col("kept") | F.col("to").isNull(), F.col("v")).otherwise(F.col("to")).alias("v"))


def masks(voxels: DataFrame) -> DataFrame:
    """label, x, y, z, inside: a binary mask for each label, as rows of its voxels."""
    return voxels.select(F.col("v").alias("label"), *AXES, F.lit(1).alias("inside"))


def median(voxels: DataFrame, radius: int = 1) -> DataFrame:
    """Median over the cube of the radius, among voxels that exist (the lower middle of an even number)."""
    r = range(-radius, radius + 1)
    cube = F.array(*[F.struct(*[(F.col(k) + d).alias(k) for k, d in zip(AXES, (i, j, l), strict=True)]) for i in r for j in r for l in r])
    sent = voxels.select("v", F.explode(cube).alias("c")).select("v", "c.*")
    got = sent.groupBy(*AXES).agg(F.sort_array(F.collect_list("v")).alias("s"))  # at most (2 r + 1)^3 values
    return got.join(voxels.select(*AXES), list(AXES)).select(*AXES, F.element_at("s", F.floor((F.size("s") + 1) / 2).cast("int")).alias("v"))


def diffuse(voxels: DataFrame, rounds: int, threshold: float, factor: float) -> DataFrame:
    """Anisotropic diffusion: each round adds factor times the differences to face neighbours that differ by less than the threshold."""
    from meshlake.functions.state import written

    state = voxels.select(*AXES, F.col("v").cast("double").alias("v"))
    for i in range(rounds):
        p = neighbour_pairs(state).withColumn("d", F.col("ov") - F.col("v")).where(F.abs("d") < threshold)
        flow = p.select(*AXES, "d").unionByName(p.select(*[F.col(f"o{k}").alias(k) for k in AXES], (-F.col("d")).alias("d")))
        state = state.join(flow.groupBy(*AXES).agg(F.sum("d").alias("d")), list(AXES), "left").select(*AXES, (F.col("v") + factor * F.coalesce("d", F.lit(0.0))).alias("v"))
        if i + 1 < rounds:
            state = written(state, "diffuse")
    return state


def density_sample(items: DataFrame, voxels: DataFrame, low: float = 0.1, high: float = 1.0, factor: float = 0.001, spacing: tuple[float, float, float] = (1, 1, 1), origin: tuple[float, float, float] = (0, 0, 0)) -> DataFrame:
    """item, density: max(low, high - v * factor) of the nearest voxel; items outside get ``low``."""
    ijk = [F.floor((F.col(k) - F.lit(float(o))) / F.lit(float(s)) + 0.5).cast("long").alias(f"i{k}") for k, s, o in zip(AXES, spacing, origin, strict=True)]
    at = items.select("item", *ijk)
    vox = voxels.select(*[F.col(k).cast("long").alias(f"i{k}") for k in AXES], "v")
    return at.join(vox, [f"i{k}" for k in AXES], "left").select("item", F.greatest(F.lit(low), F.coalesce(F.lit(high) - F.col("v") * factor, F.lit(low))).alias("density"))


def grid_points(vertices: DataFrame, faces: DataFrame, cell: float) -> tuple[DataFrame, DataFrame]:
    """Grid clustering: vertices of a cell become their mean; faces that keep three cells stay, once each."""
    key = [F.floor(F.col(k) / cell).alias(f"c{k}") for k in AXES]
    placed = vertices.select("vid", *AXES, *key)
    cells = placed.groupBy("cx", "cy", "cz").agg(F.min("vid").alias("id"), *[F.avg(k).alias(k) for k in AXES])
    to = placed.join(cells.select("cx", "cy", "cz", "id"), ["cx", "cy", "cz"]).select("vid", "id")
    at = faces.select("fid", F.posexplode("vs").alias("pos", "vid")).join(to, "vid")
    new = at.groupBy("fid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda s: s["id"]).alias("vs")).where("size(array_distinct(vs)) = size(vs)")
    once = new.withColumn("k", F.array_sort("vs")).groupBy("k").agg(F.min_by("vs", "fid").alias("vs"), F.min("fid").alias("fid")).select("fid", "vs")
    return cells.select(F.col("id").alias("vid"), *AXES), once


def label_surfaces(voxels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices: label, vid, x, y, z; faces: label, fid, vs): the boundary of each label as triangles, by marching tetrahedra of the cubes between voxel centres.

    Cubes are formed by sending each voxel to the eight cubes that it is a corner of, so labels and cubes spread over all tasks; the
    cutting is done on whole batches of cubes. Vertices are the midpoints of cut lattice edges, named by twice their place."""
    corner = [(i, j, k) for k in (0, 1) for j in (0, 1) for i in (0, 1)]
    sent = voxels.select("v", F.explode(F.array(*[F.struct(*[(F.col(a).cast("long") - d).alias(f"c{a}") for a, d in zip(AXES, c, strict=True)], F.lit(n).alias("corner")) for n, c in enumerate(corner)])).alias("c")).select("v", "c.*")
    cubes = sent.groupBy("cx", "cy", "cz").agg(F.map_from_entries(F.collect_list(F.struct("corner", "v"))).alias("m"))
    absent = F.lit(None).cast("int")
    cubes = cubes.select("cx", "cy", "cz", F.array(*[F.coalesce(F.try_element_at("m", F.lit(n)).cast("int"), absent) for n in range(8)]).alias("labels"))
    cubes = cubes.where("size(array_distinct(labels)) > 1")
    tets = [(0, 1, 3, 7), (0, 3, 2, 7), (0, 2, 6, 7), (0, 6, 4, 7), (0, 4, 5, 7), (0, 5, 1, 7)]
    place = np.array(corner)

    def cut(batches):
        for df in batches:
            base = df[["cx", "cy", "cz"]].to_numpy(np.int64)
            lab = np.array([[np.nan if x is None else x for x in row] for row in df["labels"]], float).reshape(len(df), 8)
            out = []
            for label in np.unique(lab[~np.isnan(lab)]):
                inside = lab == label
                for t in tets:
                    s = inside[:, t]
                    for n_in in (1, 2, 3):
                        rows = np.flatnonzero(s.sum(1) == n_in)
                        if not len(rows):
                            continue
                        order = np.argsort(~s[rows], axis=1, kind="stable")
                        p = place[np.array(t)][order]  # rows, 4 corners (inside first), 3
                        mid = lambda a, b, p=p, rows=rows: 2 * base[rows] + p[:, a] + p[:, b]
                        if n_in == 2:
                            q = [mid(0, 2), mid(0, 3), mid(1, 3), mid(1, 2)]
                            tris = [(q[0], q[1], q[2]), (q[0], q[2], q[3])]
                        else:
                            lone, rest = (0, (1, 2, 3)) if n_in == 1 else (3, (0, 1, 2))
                            tris = [tuple(mid(lone, r) for r in rest)]
                        away = p[:, n_in:].mean(1) - p[:, :n_in].mean(1)  # from the label outwards
                        for a, b, c in tris:
                            turned = (np.cross(b - a, c - a) * away).sum(1) < 0
                            b, c = np.where(turned[:, None], c, b), np.where(turned[:, None], b, c)
                            out.append(np.c_[np.full(len(rows), label), a, b, c])
            rows = np.concatenate(out).astype(np.int64) if out else np.zeros((0, 10), np.int64)
            yield pd.DataFrame(rows, columns=["label", *[f"{c}{k}" for c in "abc" for k in AXES]])

    tri = cubes.mapInPandas(cut, "label long, " + ", ".join(f"{c}{k} long" for c in "abc" for k in AXES))
    name = lambda c: F.shiftleft(F.col(f"{c}z") + (1 << 19), 42) + F.shiftleft(F.col(f"{c}y") + (1 << 19), 21) + F.col(f"{c}x") + (1 << 19)
    faces = tri.select("label", F.array(*[name(c) for c in "abc"]).alias("vs")).select("label", F.xxhash64("label", "vs").alias("fid"), "vs")
    points = tri.select("label", F.explode(F.array(*[F.struct(name(c).alias("vid"), *[(F.col(f"{c}{k}") / 2.0).alias(k) for k in AXES]) for c in "abc"])).alias("p")).select("label", "p.*").distinct()
    return points, faces


def smoothed(vertices: DataFrame, neighbours: DataFrame, rounds: int, inward: float = 0.5, outward: float = -0.53) -> DataFrame:
    """Low-pass smoothing without shrinking: steps towards the neighbours' mean with alternating factors. ``neighbours``: vid, other."""
    from meshlake.functions.state import written

    state = vertices.select("vid", *AXES)
    for i in range(2 * rounds):
        at = state.select(F.col("vid").alias("other"), *[F.col(k).alias(f"o{k}") for k in AXES])
        mean = neighbours.join(at, "other").groupBy("vid").agg(*[F.avg(f"o{k}").alias(f"m{k}") for k in AXES])
        w = inward if i % 2 == 0 else outward
        state = state.join(mean, "vid", "left").select("vid", *[(F.col(k) + w * (F.coalesce(f"m{k}", k) - F.col(k))).alias(k) for k in AXES])
        if i % 4 == 3:
            state = written(state, "smooth")
    return state
