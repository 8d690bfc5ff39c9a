import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlake.functions import geometry as g
from meshlake.operators import clustering, curvature, graph, measures, remesh
from meshlake.operators import mesh as m
from meshlake.operators.mesh import Mesh
from meshlake.sources import synthetic as syn


@pytest.fixture(scope="module")
def octahedron(spark):
    return syn.solid(spark, syn.OCTAHEDRON)


@pytest.fixture(scope="module")
def cube(spark):
    return syn.solid(spark, syn.CUBE)


def euler(mesh):
    return mesh.vertices.count() - m.edge_counts(mesh.faces).count() + mesh.faces.count()


def test_octahedron(octahedron):
    assert m.edge_counts(octahedron.faces).count() == 12
    assert m.boundary_edges(octahedron.faces).count() == 0
    assert euler(octahedron) == 2
    assert all(r.manifold for r in m.vertex_manifold(octahedron.faces).collect())
    assert {r.edges for r in measures.valences(octahedron.faces).collect()} == {4}


def test_cube_volume_and_orientation(cube):
    p = measures.volume_properties(measures.ensure_outward(cube)).first()
    assert p.volume == pytest.approx(1) and p.surface == pytest.approx(6) and p.signed_volume > 0
    assert (p.cx, p.cy, p.cz) == pytest.approx((0.5, 0.5, 0.5))
    turned = Mesh(cube.vertices, cube.faces.select("fid", F.when(F.col("fid") % 3 == 1, F.reverse("vs")).otherwise(F.col("vs")).alias("vs")))
    back = graph.orient(turned.faces)
    assert measures.volume_properties(Mesh(cube.vertices, back.select("fid", "vs"))).first().volume == pytest.approx(1)


def test_vertex_areas_sum_to_surface(cube):
    total = measures.vertex_areas(cube).agg(F.sum("area")).first()[0]
    assert total == pytest.approx(6)


def test_square_subdivision(spark):
    for k in (0, 1, 2):
        s = syn.square(spark, k)
        assert s.faces.count() == 2 * 4**k and euler(s) == 1
        assert measures.face_areas(s).agg(F.sum("area")).first()[0] == pytest.approx(1)
    fine, parents = remesh.subdivide(syn.square(spark, 1))
    assert parents.count() == m.edge_counts(syn.square(spark, 1).faces).count()


def test_smooth_subdivisions_keep_topology(octahedron):
    for f in (remesh.subdivide_loop, remesh.subdivide_butterfly):
        fine = f(octahedron)
        assert fine.faces.count() == 32 and euler(fine) == 2


def test_nonmanifold_cleaning(spark, octahedron):
    extra = spark.createDataFrame([(8, [0, 2, 3]), (9, [0, 2, 1])], "fid long, vs array<long>")
    bad = Mesh(octahedron.vertices, octahedron.faces.unionByName(extra))
    assert m.nonmanifold_edges(bad.faces).count() > 0
    clean = remesh.clean(bad)
    assert m.nonmanifold_edges(clean.faces).count() == 0


def test_components_and_isolated(spark, octahedron):
    both = m.append(octahedron, octahedron)
    lone = Mesh(both.vertices.unionByName(spark.createDataFrame([(99, 9.0, 9.0, 9.0)], "vid long, x double, y double, z double")), both.faces)
    comp = graph.mesh_components(lone.vertices, m.edge_counts(lone.faces))
    assert sorted((r.comp, r.size) for r in graph.component_sizes(comp).collect()) == [(0, 6), (6, 6), (99, 1)]
    assert {r.vid for r in m.disconnected_vertices(lone).collect()} == {99}
    links = graph.bridge_components(lone.vertices, m.edge_counts(lone.faces), 1.0)
    joined = m.edge_counts(lone.faces).select("v1", "v2").unionByName(links)
    assert graph.mesh_components(lone.vertices, joined).select("comp").distinct().count() == 1


def test_star_components_of_a_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(200)]
    hub = [(1000, 1001 + i) for i in range(300)]
    got = graph.star_components(spark.createDataFrame(path + hub + [(5, 5), (None, 3)], "u long, v long"))
    assert {(r.label) for r in got.collect()} == {0, 1000} and got.count() == 201 + 301
    assert graph.star_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_quadric_point_of_a_corner():
    q = np.zeros((1, 10))
    for n, d in (((1, 0, 0), -1), ((0, 1, 0), -2), ((0, 0, 1), -3)):
        p = [*n, d]
        q[0] += [p[i] * p[j] for i in range(4) for j in range(i, 4)]
    point, lack = measures.best_points(q, np.zeros((1, 3)))
    assert point[0] == pytest.approx([1, 2, 3]) and lack[0] == 0
    flat, lack = measures.best_points(q * [1, 0, 0, 1, 0, 0, 0, 0, 0, 1], np.array([[5.0, 7.0, 9.0]]))
    assert flat[0] == pytest.approx([1, 7, 9]) and lack[0] == 2


def test_curvature_of_a_sphere():
    rng = np.random.default_rng(0)
    t = rng.uniform(-0.3, 0.3, (40, 2))
    points = np.c_[t, np.sqrt(4 - (t**2).sum(1))]
    k, d1, _ = curvature.fit_one(points, np.array([0, 0, 2.0]), np.array([0, 0, 1.0]))
    assert k == pytest.approx(math.sqrt(2) / 2, rel=0.02)
    assert curvature.fit_one(points[:6], points[0], np.array([0, 0, 1.0]))[0] == 0


def test_delaunay_flips_keep_area_and_topology(spark):
    mesh = syn.triangulation(spark, 150, 0)
    before = measures.face_areas(mesh).agg(F.sum("area")).first()[0]
    flipped, n = remesh.delaunay(mesh)
    assert n > 0 and euler(flipped) == 1
    assert measures.face_areas(flipped).agg(F.sum("area")).first()[0] == pytest.approx(before)
    assert remesh.delaunay(flipped)[1] == 0


@pytest.mark.parametrize("block_items", [40, 1000])
def test_delaunay_flips_settle_in_blocks(spark, monkeypatch, block_items):
    """Edges across blocks are decided by later turns, and no round goes over the whole mesh."""

    def whole(*args):
        raise AssertionError("a round over the whole mesh")

    monkeypatch.setattr(remesh, "_flips_by_joins", whole)
    mesh = syn.triangulation(spark, 150, 0)
    flipped, n = remesh.delaunay(mesh, block_items=block_items)
    assert n > 0 and euler(flipped) == 1 and remesh.bad_edges(flipped).count() == 0
    assert measures.face_areas(flipped).agg(F.sum("area")).first()[0] == pytest.approx(measures.face_areas(mesh).agg(F.sum("area")).first()[0])
    assert {r.fid for r in flipped.faces.collect()} == {r.fid for r in mesh.faces.collect()}


def test_a_block_leaves_other_triangles_alone():
    from meshlake.operators.flips import Flipper

    points, corners = np.array([[0, 0, 0], [4, 0, 0], [2, 1, 0], [2, -1, 0]], float), np.array([[0, 1, 2], [1, 0, 3]])
    for own, made in ((True, 1), (False, 0)):
        x = Flipper(points, corners, np.array([True, own]), np.array([True, True]), 1e-9)
        x.run(10)
        assert x.made == made and x.left_open().tolist() == [not own, False]
    assert x.t.tolist() == corners.tolist()


def test_simplify_keeps_topology(spark):
    mesh, _ = remesh.subdivide(remesh.subdivide(syn.solid(spark, syn.OCTAHEDRON))[0])
    small = remesh.simplify(m.dense_ids(mesh), 40)
    assert small.vertices.count() == 40 and euler(small) == 2


def test_round_limits_are_not_silent(spark, octahedron):
    with pytest.raises(RuntimeError):
        remesh.simplify(octahedron, 4, max_rounds=0)
    with pytest.raises(RuntimeError):
        remesh.delaunay(octahedron, max_rounds=0)


def test_split_long_edges(spark):
    mesh = remesh.split_long_edges(syn.square(spark, 0), 0.6)
    assert measures.face_areas(mesh).agg(F.sum("area")).first()[0] == pytest.approx(1)
    assert m.edge_lengths(mesh).agg(F.max("length")).first()[0] <= 0.6 * (4 + math.sqrt(2)) / 5 + 1e-9


def test_clustering_energy_falls_and_clusters_connect(spark):
    mesh = syn.triangulation(spark, 150, 0)
    items = clustering.place_items(mesh.vertices.withColumnRenamed("vid", "item"), measures.vertex_areas(mesh).select(F.col("vid").alias("item"), F.col("area").alias("w")))
    pairs = m.vertex_neighbours(mesh.faces).withColumnRenamed("vid", "item")
    o = clustering.Options(clusters=8, max_rounds=6)
    start = clustering.initial_labels(items, pairs, o)
    metric = clustering.Isotropic()
    log = []
    end = clustering.minimise(items, pairs, start, metric, o, log)
    e0, e1 = (clustering.global_energy(items, x, metric).first()[0] for x in (start, end))
    assert e1 < e0 and e1 - e0 == pytest.approx(sum(r["energy"] for r in log))
    assert all(r["energy"] <= 0 for r in log)
    done = clustering.cluster(items, pairs, metric, o)
    sizes = done.labels.groupBy("cluster").count().collect()
    assert len(sizes) == 8 and all(r.cluster is not None for r in sizes)
    whole = graph.split_clusters(done.labels, pairs)
    assert whole.where("cluster IS NULL").count() == 0


def line_of_items(spark, n):
    from meshlake.functions.state import written

    p = spark.range(n).selectExpr("id AS item", "double(id) AS x", "0.0D AS y", "0.0D AS z")
    items = written(clustering.place_items(p, p.selectExpr("item", "1.0D AS w")), "items")
    return p, items, written(p.select("item", F.explode(F.expr("array(item - 1, item + 1)")).alias("other")).where(f"other BETWEEN 0 AND {n - 1}"), "pairs")


def test_clusters_settle(spark):
    p, items, pairs = line_of_items(spark, 12)
    start, metric = p.selectExpr("item", "int(item > 2) AS cluster"), clustering.Isotropic()
    end = clustering.minimise(items, pairs, start, metric, clustering.Options(clusters=2))
    assert clustering.move_gains(items, pairs, end, metric).where("gain > 1e-9").count() == 0
    log = []
    clustering.minimise(items, pairs, start, metric, clustering.Options(clusters=2, block_items=5, max_rounds=1), log)
    assert not log[-1]["settled"] and not clustering.Result(end, log).settled


def test_blocks_settle_as_one_block_does(spark):
    """With blocks of few items clusters on two sides of a cut meet in later rounds, until no move gains."""
    p, items, pairs = line_of_items(spark, 60)
    start, metric = p.selectExpr("item", "int(item > 2) + int(item > 5) + int(item > 50) + int(item > 55) AS cluster"), clustering.Isotropic()
    log = []
    end = clustering.minimise(items, pairs, start, metric, clustering.Options(clusters=5, block_items=25), log)
    assert clustering.move_gains(items, pairs, end, metric).where("gain > 1e-9").count() == 0
    e0, e1 = (clustering.global_energy(items, x, metric).first()[0] for x in (start, end))
    assert e1 < e0 and e1 - e0 == pytest.approx(sum(r["energy"] for r in log)) and log[-1]["settled"]


@pytest.mark.parametrize("sampling, clusters", [(-1, 7), (0, 7), (1, 7), (3, 7), (3, 40)])
def test_samplings_give_as_many_clusters(spark, sampling, clusters):
    mesh = syn.triangulation(spark, 150, 0)
    items = clustering.place_items(mesh.vertices.withColumnRenamed("vid", "item"), measures.vertex_areas(mesh).select(F.col("vid").alias("item"), F.col("area").alias("w")))
    pairs = m.vertex_neighbours(mesh.faces).withColumnRenamed("vid", "item")
    labels = clustering.initial_labels(items, pairs, clustering.Options(clusters=clusters, sampling=sampling))
    assert labels.where("cluster IS NULL").count() == 0 and labels.select("cluster").distinct().count() == clusters


def test_kernel_agrees_with_brute_force(spark):
    """Each sweep's gains by energies of whole clusters, for every metric; and clusters stay connected."""
    from meshlake.operators import blocks

    rng, n = np.random.default_rng(5), 64
    xy = np.array([(i % 8, i // 8) for i in range(n)], float)
    edges = [(i, j) for i in range(n) for j in (i - 1, i + 1, i - 8, i + 8, i - 7, i + 7) if 0 <= j < n and abs(i % 8 - j % 8) <= 1]
    near = blocks.Neighbours(n, np.array([i for i, _ in edges]), np.array([j for _, j in edges]))
    p = np.c_[xy, rng.normal(size=n) / 5]
    w = rng.uniform(1, 2, n)
    place = np.c_[w, w[:, None] * p]
    tensor = np.array([w[i] * (np.eye(3) + np.outer(rng.normal(size=3), rng.normal(size=3)) * 0) for i in range(n)])
    t6 = tensor.reshape(n, 9)[:, [0, 1, 2, 4, 5, 8]]
    normal = rng.normal(size=(n, 3)) + [0, 0, 3]
    normal /= np.linalg.norm(normal, axis=1, keepdims=True)
    d = -(normal * p).sum(1)
    a = np.einsum("ni,nj->nij", normal, normal)
    quadric = np.c_[a[:, 0, 0], a[:, 0, 1], a[:, 0, 2], normal[:, 0] * d, a[:, 1, 1], a[:, 1, 2], normal[:, 1] * d, a[:, 2, 2], normal[:, 2] * d]
    start = (xy[:, 0] // 3 + 3 * (xy[:, 1] // 3)).astype(int)
    for metric, stats in ((clustering.Isotropic(), place), (clustering.Normals(), np.c_[w, w[:, None] * normal]), (clustering.Anisotropic(), np.c_[w, np.einsum("nij,nj->ni", tensor, p), t6]), (clustering.Quadric(), np.c_[place, quadric])):
        whole = lambda c, metric=metric, stats=stats: sum(metric.energies(stats[c == k].sum(0, keepdims=True))[0] for k in set(c.tolist()))
        for connected in (False, True):
            end, gain, moves = blocks.improve(stats, start, near, np.zeros(9, bool), metric, 1e-9, connected, False, 10_000)
            assert whole(start) - whole(end) == pytest.approx(gain, rel=1e-6, abs=1e-9) and (moves == 0) == (gain == 0)
            assert set(end.tolist()) == set(range(9))
            for i, j in edges:  # no admissible move is left
                if end[i] != end[j] and (end == end[i]).sum() > 1:
                    other = end.copy()
                    other[i] = end[j]
                    rest = [x for x in near.of(i).tolist() if end[x] == end[i]]
                    if not connected or len(rest) < 2 or near.hangs_together(rest):
                        assert whole(end) - whole(other) <= 1e-6
            if connected:
                for k in range(9):
                    assert near.hangs_together(np.flatnonzero(end == k).tolist())
    fixed = np.zeros(9, bool)
    fixed[4] = True
    end, _, _ = blocks.improve(place, start, near, fixed, clustering.Isotropic(), 1e-9, True, True, 10_000)
    assert ((end == 4) == (start == 4)).all()


def test_face_clusters(spark, cube):
    mesh = remesh._kept(syn.triangulation(spark, 300, 0), "test")
    out = remesh.remesh_faces(mesh, clustering.Isotropic(), clustering.Options(clusters=40))
    report = measures.mesh_report(out.mesh).first()
    assert report.vertices == 40 and report.faces > 30 and report.nonmanifold_edges == 0
    assert all(r.settled for r in [clustering.Result(out.labels, out.log)])
    t = m.lengths(m.corners(m.triangles(out.mesh.faces), out.mesh.vertices)).withColumn("up", g.triangle_normal(g.vec("a"), g.vec("b"), g.vec("c"))[2])
    assert t.where("up <= 0").count() in (0, t.count())
    whole = clustering.face_weights(mesh, mesh.vertices.select(F.col("vid").alias("elt"), F.lit(1.0).alias("k")), 1.5).agg(F.sum("w")).first()[0]
    finer, _ = remesh.subdivide(mesh)
    again = clustering.face_weights(finer, finer.vertices.select(F.col("vid").alias("elt"), F.lit(1.0).alias("k")), 1.5).agg(F.sum("w")).first()[0]
    assert whole == pytest.approx(again) == pytest.approx(1)


def test_least_rows(spark):
    df = spark.range(1000).selectExpr("id", "(id * 37) % 1000 AS c", "id % 3 AS other")
    assert sorted(r.c for r in measures.least_rows(df, ["c"], 17).collect()) == list(range(17))
    assert measures.least_rows(df, ["c"], 5000).count() == 1000 and measures.least_rows(df.limit(0), ["c"], 3).count() == 0


def test_simplify_by_blocks(spark):
    """Small blocks: the same number of vertices, no holes, and every vertex in some round free."""
    mesh = remesh._kept(syn.triangulation(spark, 400, 0), "test")
    small = remesh.simplify(mesh, 120, block_items=150)
    r = measures.mesh_report(small).first()
    assert r.vertices == 120 and r.euler == 1 and r.nonmanifold_edges == 0
    assert m.face_normals(small).where("nz <= 0").count() in (0, r.faces)


def test_orientation_by_blocks(spark):
    """Blocks of a few faces, with their links in one task or by rounds, agree with one block and with the least face."""
    mesh = m.dense_ids(syn.triangulation(spark, 150, 0))
    turned = mesh.faces.select("fid", F.when(F.col("fid") % 3 == 1, F.reverse("vs")).otherwise(F.col("vs")).alias("vs"))
    want = {r.fid: r.flipped for r in graph.orient(turned).collect()}
    assert want == {i: i % 3 == 1 for i in want} and len(want) == mesh.faces.count()
    for links in (500, 0):
        assert {r.fid: r.flipped for r in graph.orient(turned, block_faces=20, task_pairs=links).collect()} == want


def test_tensors_by_slabs_are_those_of_joins(spark, cube):
    """Rings reach over the borders of small slabs; no pair of faces is joined. Slabs narrower than the rings are not taken."""
    mesh = remesh._kept(m.dense_ids(syn.triangulation(spark, 12, 0)), "test")
    x, y = F.col("vid") % 20, F.floor(F.col("vid") / 20)
    v = spark.range(400).withColumnRenamed("id", "vid").select("vid", x.cast("double").alias("x"), y.cast("double").alias("y"), F.sin(F.col("vid") * 1.7).alias("z"))
    two = F.array(F.array("vid", F.col("vid") + 1, F.col("vid") + 20), F.array(F.col("vid") + 1, F.col("vid") + 21, F.col("vid") + 20))
    grid = Mesh(v, v.where("vid % 20 < 19 AND vid < 380").select("vid", F.posexplode(two).alias("i", "vs")).select((2 * F.col("vid") + F.col("i")).alias("fid"), "vs"))
    assert curvature._in_slabs(grid, 3, 200) is not None and curvature._in_slabs(grid, 3, 20) is None
    for one, size in ((grid, 200), (mesh, 10**6), (cube, 1)):
        want = {r.elt: r for r in curvature._by_joins(one, 3).collect()}
        got = {r.elt: r for r in curvature.tensor(one, 3, size).collect()}
        assert got.keys() == want.keys() and all(got[i].k == pytest.approx(want[i].k, abs=1e-9) for i in got)
        assert all(np.outer(got[i].d1, got[i].d1).ravel() == pytest.approx(np.outer(want[i].d1, want[i].d1).ravel(), abs=1e-4) for i in got) or one is cube


def test_collapses_leave_no_vertex_alone():
    """Triangles that hang together at one vertex only: the side away from it may not go, since its end would have no triangle."""
    from meshlake.operators import collapse

    points = np.array([[0, 0, 0], [1, 0, 0], [0.5, 1, 0], [0, 2, 0], [1, 2, 0]], float)
    c = collapse.Collapser(points, np.array([[0, 1, 2], [2, 4, 3]]), np.zeros((5, 10)), np.zeros(5, bool))
    assert c.run(5) == 0 and c.root(1) == 1


def test_collapse_costs_are_those_of_the_columns(spark):
    from meshlake.operators import collapse

    rng = np.random.default_rng(1)
    q, p = rng.normal(size=(6, 10)), rng.normal(size=(6, 3))
    df = spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(q, p, strict=True)], ", ".join(f"{k} double" for k in (*g.QUADRIC, "x", "y", "z")))
    got = [r[0] for r in df.select(g.quadric_value([F.col(k) for k in g.QUADRIC], g.vec())).collect()]
    assert got == pytest.approx(collapse.quadric_values(q, p).tolist())


def test_collapses_turn_nothing_over(spark):
    vertices = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.5, 1.0, 0.0), (3, 0.5, -1.0, 0.0)], "vid long, x double, y double, z double")
    faces = spark.createDataFrame([(0, [0, 1, 2]), (1, [1, 0, 3])], "fid long, vs array<long>")
    at = lambda x, y: spark.createDataFrame([(0, 2, x, y, 0.0)], "v1 long, v2 long, x double, y double, z double")
    assert m.turning_edges(m.Mesh(vertices, faces), at(0.2, 0.5)).count() == 0
    assert m.turning_edges(m.Mesh(vertices, faces), at(3.0, -3.0)).count() == 1


def test_registered_clusterings_are_not_cut(spark, monkeypatch):
    from meshlake.plans import catalog

    class Seen(Exception):
        pass

    def seen(*args, **_):
        raise Seen(next(a for a in args if isinstance(a, clustering.Options)))

    monkeypatch.setattr(clustering, "cluster", seen)
    monkeypatch.setattr(remesh, "remesh", seen)
    for run in (catalog.cluster_uniform, catalog.remesh_uniform, catalog.remesh_quadric):
        with pytest.raises(Seen) as e:
            run(spark, "/root/testdata/sf0.001")
        assert e.value.args[0].max_rounds is None and e.value.args[0].connected


def test_registered_curvatures_use_the_default_ring(spark):
    from meshlake.plans import catalog
    from meshlake.plans import fixtures as fx

    sf = "/root/testdata/sf0.001"
    for run, method in ((catalog.curvature_fit, "fit"), (catalog.curvature_tensor, "tensor")):
        want = {r.elt: r.k for r in curvature.curvature(fx.grid_mesh(spark, sf), method).collect()}
        got = {r.elt: r.k for r in run(spark, sf).collect()}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-4) for i in got)


def test_metrics_agree_with_brute_force(spark):
    """The energy of the anisotropic metric by numpy; the others are in the kernel's test."""
    rng = np.random.default_rng(3)
    p, w = rng.normal(size=(5, 3)), rng.uniform(1, 2, 5)
    t = np.array([w[i] * np.eye(3) + np.outer(p[i], p[i]) for i in range(5)])
    s = (t @ p[:, :, None])[:, :, 0].sum(0)
    c = np.linalg.solve(t.sum(0), s)
    assert clustering.Anisotropic().energies(np.r_[w.sum(), s, t.sum(0)[[0, 0, 0, 1, 1, 2], [0, 1, 2, 1, 2, 2]]][None])[0] == pytest.approx(-(c @ s))
    row = {"w": w.sum(), **dict(zip(("sx", "sy", "sz"), s, strict=True)), **{f"t{i}": t.sum(0)[a] for i, a in enumerate(((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)))}}
    df = spark.createDataFrame([tuple(map(float, row.values()))], ", ".join(f"{k} double" for k in row))
    got = df.select(clustering.Anisotropic().energy(clustering.cols(list(row)))).first()[0]
    assert got == pytest.approx(-(c @ s))


def test_half_space_area(cube):
    t = m.lengths(m.half_space(cube, (0, 0, 1), 0.25))
    assert t.agg(F.sum("area")).first()[0] == pytest.approx(1 + 4 * 0.75)


def test_flood_and_rings(spark):
    pairs = spark.createDataFrame([(i, j) for i in range(9) for j in (i - 1, i + 1) if 0 <= j < 9], "item long, other long")
    labels = spark.createDataFrame([(i, {0: 5, 8: 3}.get(i)) for i in range(10)], "item long, cluster long")
    got = {r.item: r.cluster for r in graph.flood_fill(labels, pairs).collect()}
    assert got == {0: 5, 1: 5, 2: 5, 3: 5, 4: 3, 5: 3, 6: 3, 7: 3, 8: 3, 9: None}
    ring = graph.n_ring(pairs, spark.createDataFrame([(4,)], "item long"), 2)
    assert sorted((r.item, r.hops) for r in ring.collect()) == [(2, 2), (3, 1), (4, 0), (5, 1), (6, 2)]


def test_geometry_degenerates(spark):
    z = F.lit(0.0)
    r = spark.range(1).select(g.quality(z, z, z, z).alias("q"), g.min_angle(z, z, z).alias("a"), g.unit((z, z, z))[0].alias("u")).first()
    assert (r.q, r.a, r.u) == (0, 0, 0)


def test_large_clusters_meet_over_their_borders(spark, monkeypatch):
    """Clusters of more items than a block hold their borders in one: they settle in few rounds and sweeps, with no move left."""
    from meshlake.operators import blocks

    p, items, pairs = line_of_items(spark, 400)
    start, metric = p.selectExpr("item", "int(item > 190) AS cluster"), clustering.Isotropic()
    log = []
    end = clustering.minimise(items, pairs, start, metric, clustering.Options(clusters=2, block_items=20), log)
    assert clustering.move_gains(items, pairs, end, metric).where("gain > 1e-9").count() == 0 and log[-1]["settled"]
    assert sorted(r["count"] for r in end.groupBy("cluster").count().collect()) == [200, 200]
    # Two strips of 200 by 10: the border moves by whole columns in a sweep, not by an item.
    xy = np.array([(i, j) for i in range(200) for j in range(10)], float)
    links = [(a, b) for a in range(2000) for b in ((a + 1) if a % 10 < 9 else -1, a + 10, (a + 11) if a % 10 < 9 else -1) if 0 <= b < 2000]
    near = blocks.Neighbours(2000, np.array([a for a, _ in links] + [b for _, b in links]), np.array([b for _, b in links] + [a for a, _ in links]))
    got, _, moves = blocks.improve(np.c_[np.ones(2000), xy, np.zeros(2000)], (xy[:, 0] > 20).astype(int), near, np.zeros(2, bool), metric, 1e-9, True, False, 300)
    assert moves > 700 and abs((got == 0).sum() - 1000) <= 10


def test_borders_move_far_in_a_round(spark):
    """A border moves over more than two steps in a round, and a round whose last step stays ends the loop."""
    p, items, pairs = line_of_items(spark, 40)
    start, metric = p.selectExpr("item", "int(item > 14) AS cluster"), clustering.Isotropic()
    log = []
    end = clustering.minimise(items, pairs, start, metric, clustering.Options(clusters=2, block_items=25), log)
    assert sorted(r["count"] for r in end.groupBy("cluster").count().collect()) == [20, 20]
    assert len(log) == 1 and log[-1]["settled"] and clustering.move_gains(items, pairs, end, metric).where("gain > 1e-9").count() == 0


def test_parts_by_ranges_are_those_of_rounds(spark, monkeypatch):
    """Ranges of a few items, with their links in one task or by rounds; no round over all pairs if these are few."""
    _, _, pairs = line_of_items(spark, 50)
    labels = spark.range(50).selectExpr("id AS item", "IF(id = 49, NULL, int(id % 20 > 12)) AS cluster")
    want = {i: (int(i % 20 > 12), max(x for x in (0, 13, 20, 33, 40) if x <= i)) for i in range(49)}
    for links in (0, 500):
        if links:
            monkeypatch.setattr(graph, "star_components", None)
        got = graph.cluster_parts(labels, pairs, block_items=9, task_pairs=links).collect()
        assert {r.item: (r.cluster, r.comp) for r in got} == want


def test_flood_in_one_task_equals_rounds(spark, monkeypatch):
    from meshlake.operators import graph

    p, _, pairs = line_of_items(spark, 50)
    pairs = pairs.unionByName(spark.createDataFrame([(7, 30), (30, 7), (90, 91), (91, 90)], "item long, other long"))
    big = (1 << 60) + 1
    start = p.selectExpr("item", f"CASE item WHEN 3 THEN {big} WHEN 49 THEN 5 END AS cluster").unionByName(spark.createDataFrame([(90, None), (91, None)], "item long, cluster long"))
    asked = []
    monkeypatch.setattr(graph, "_flooded", lambda *a, f=graph._flooded: asked.append(1) or f(*a))
    got = {r.item: r.cluster for r in graph.flood_fill(start, pairs).collect()}
    assert asked
    monkeypatch.setattr(graph, "FLOOD_ITEMS", 0)
    assert got == {r.item: r.cluster for r in graph.flood_fill(start, pairs).collect()} and got[20] == big and got[90] is None
