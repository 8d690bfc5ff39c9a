import numpy as np
import pytest

from meshlake.__main__ import arguments
from meshlake.operators import registration


def frame(spark, p):
    return spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "item long, x double, y double, z double")


def test_nearest_and_hausdorff(spark):
    rng = np.random.default_rng(2)
    a, b = rng.uniform(size=(60, 3)), rng.uniform(size=(40, 3)) * 3
    d = np.linalg.norm(a[:, None] - b[None], axis=2)
    got = {r.item: (r.other, r.distance) for r in registration.nearest(frame(spark, a), frame(spark, b), 0.3).collect()}
    assert [got[i][0] for i in range(60)] == d.argmin(1).tolist()
    row = registration.mesh_distance(frame(spark, a), frame(spark, b), 0.5).first()
    assert row.hausdorff == pytest.approx(max(d.min(1).max(), d.min(0).max()))


def test_rigid_from_sums():
    rng = np.random.default_rng(4)
    p = rng.normal(size=(20, 3))
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    turn *= np.sign(np.linalg.det(turn))
    q = p @ turn.T + [1, 2, 3]
    sums = {"n": 20, **{f"p{k}": p[:, i].sum() for i, k in enumerate("xyz")}, **{f"q{k}": q[:, i].sum() for i, k in enumerate("xyz")}, **{f"p{a}q{b}": (p[:, i] * q[:, j]).sum() for i, a in enumerate("xyz") for j, b in enumerate("xyz")}}
    r, s = registration.rigid(sums)
    assert r == pytest.approx(turn) and s == pytest.approx([1, 2, 3])


def test_command_line_parses():
    o = arguments().parse_args(["remesh", "a.ply", "b.ply", "-n", "100", "--gradation", "1.5"])
    assert (o.n, o.gradation, o.quadric) == (100, 1.5, 1)
