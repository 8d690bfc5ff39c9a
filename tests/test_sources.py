import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlake.operators import measures, volume
from meshlake.operators import mesh as m
from meshlake.sources import lists, meshes, sinks, volumes
from meshlake.sources import synthetic as syn
from meshlake.streaming import events


def part(path):
    return next(p for p in path.iterdir() if p.name.startswith("part-"))


@pytest.mark.parametrize("kind", ["off", "obj", "ply", "vtk", "vtp", "stl"])
def test_round_trip(spark, tmp_path, kind):
    cube = syn.solid(spark, syn.CUBE)
    sinks.write_mesh(cube, str(tmp_path / f"out.{kind}"))
    name = tmp_path / f"cube.{kind}"
    name.write_bytes(part(tmp_path / f"out.{kind}").read_bytes())
    back = meshes.read_mesh(spark, str(name))
    assert back.vertices.count() == 8 and back.faces.count() == 12
    assert measures.volume_properties(back).first().volume == pytest.approx(measures.volume_properties(cube).first().volume)


def test_other_writers_and_dispatch(spark):
    cube = syn.solid(spark, syn.CUBE)
    assert sinks.mesh_lines(cube, "iv").count() == 8 + 12 + 3 and sinks.mesh_lines(cube, "smf").count() == 20
    assert meshes.format_of("/a/B.VTK.gz") == "vtk"
    with pytest.raises(ValueError):
        meshes.format_of("x.bin")


def test_binary_formats():
    points = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0]], "<f4")
    head = b"ply\nformat binary_little_endian 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    v, f = meshes.parse_ply(head + points.tobytes() + struct.pack("<B3i", 3, 0, 1, 2))
    assert v.tolist() == points.tolist() and f == [[0, 1, 2]]
    stl = b"\0" * 80 + struct.pack("<I", 1) + np.r_[[0, 0, 1], points.ravel()].astype("<f4").tobytes() + b"\0\0"
    assert len(meshes.parse_stl(stl)[1]) == 1
    vtk = b"# vtk DataFile Version 3.0\nx\nBINARY\nDATASET POLYDATA\nPOINTS 3 float\n" + points.astype(">f4").tobytes() + b"\nPOLYGONS 1 4\n" + np.array([3, 0, 1, 2], ">i4").tobytes() + b"\n"
    assert meshes.parse_vtk(vtk)[1] == [[0, 1, 2]]
    wrl = b"#VRML V2.0\nCoordinate { point [ 0 0 0, 1 0 0, 0 1 0 ] } coordIndex [ 0, 1, 2, -1 ]"
    assert meshes.parse_wrl(wrl)[1] == [[0, 1, 2]]
    assert meshes.parse_off(b"COFF\n3 1 0\n0 0 0\n1 0 0\n0 1 0\n3 0 1 2 255 0 0 255\n")[1] == [[0, 1, 2]]


def test_obj_lines(spark, tmp_path):
    (tmp_path / "a.obj").write_text("# c\nv 0 0 0\nv 1 0 0\nv 0 1 0\nv 1 1 0\nf 1/1 2/2 3/3\nf 2 4 3\n")
    mesh = meshes.read_obj_lines(spark, str(tmp_path / "a.obj"))
    assert [r.vs for r in mesh.faces.orderBy("fid").collect()] == [[0, 1, 2], [1, 3, 2]]


def test_metaimage_box_and_order(spark, tmp_path):
    data = np.arange(60, dtype=">i2")
    (tmp_path / "v.raw").write_bytes(data.tobytes())
    head = sinks.mhd_header((5, 4, 3), "MET_SHORT", "v.raw").replace("MSB = False", "MSB = True").replace("ElementType", "RescaleSlope = 2\nElementType")
    (tmp_path / "v.mhd").write_text(head)
    assert volumes.is_metaimage(str(tmp_path / "v.mhd"))
    got = {(r.x, r.y, r.z): r.v for r in volumes.read_metaimage(spark, str(tmp_path / "v.mhd"), (1, 1, 1), (3, 2, 2), slab=1).collect()}
    assert got == {(x, y, z): 2.0 * (x + 5 * y + 20 * z) for x in (1, 2, 3) for y in (1, 2) for z in (1, 2)}


def test_nifti_flip_and_slope():
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, 3, 2, 1, 1, 1, 1, 1)
    struct.pack_into("<hh", head, 70, 4, 16)
    struct.pack_into("<8f", head, 76, 1, 1, 1, 1, 1, 1, 1, 1)
    struct.pack_into("<3f", head, 108, 352, 2, 1)
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, -1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0)
    v, h = volumes.parse_nifti(bytes(head) + np.arange(6, dtype="<i2").tobytes())
    assert v[0].tolist() == [[5, 3, 1], [11, 9, 7]] and h["flipped"] == [True, False, False]


def test_png_stack(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"s{i}.png").write_bytes(sinks.encode_png(np.arange(6).reshape(2, 3) + 10 * i))
    got = {(r.x, r.y, r.z): r.v for r in volumes.read_png_stack(spark, str(tmp_path)).collect()}
    assert got[(2, 1, 1)] == 15 and len(got) == 12
    vox = spark.createDataFrame([(x, y, z, float(v)) for (x, y, z), v in got.items()], "x long, y long, z long, v double")
    back = {r.z: volumes.parse_png(bytes(r.png))[:, :, 0].tolist() for r in sinks.png_slices(vox, (3, 2, 2)).collect()}
    assert back == {0: [[0, 1, 2], [3, 4, 5]], 1: [[10, 11, 12], [13, 14, 15]]}


def test_command_line(spark, tmp_path, capsys):
    from meshlake import __main__ as cli

    cube, path = syn.solid(spark, syn.CUBE), str(tmp_path / "cube.off")
    sinks.write_mesh(cube, path)
    cli.main(["report", path])
    cli.main(["difference", path, path])
    said = capsys.readouterr().out
    assert "'components': 1" in said and "'hausdorff': 0.0" in said
    open_box = str(tmp_path / "open.off")
    sinks.write_mesh(measures.Mesh(cube.vertices, m.dense_ids(measures.Mesh(cube.vertices, cube.faces.where("fid > 1"))).faces), open_box)
    cli.main(["fill", open_box, str(tmp_path / "whole.off")])
    whole = meshes.read_mesh(spark, str(tmp_path / "whole.off"))
    assert whole.vertices.count() == 9 and m.boundary_edges(whole.faces).count() == 0
    assert measures.volume_properties(whole).first().volume == pytest.approx(1)
    vox = spark.createDataFrame([(x, y, z, int(x > 1)) for x in range(4) for y in range(3) for z in range(2)], "x long, y long, z long, v int")
    sinks.write_metaimage(vox, str(tmp_path / "v.mhd"), (4, 3, 2), "u1")
    cli.main(["crop", str(tmp_path / "v.mhd"), str(tmp_path / "c.nii"), "--low", "1", "0", "0", "--high", "3", "1", "1", "--type", "u1"])
    got = {(r.x, r.y, r.z): r.v for r in volumes.read_volume(spark, str(tmp_path / "c.nii")).collect()}
    assert got == {(x, y, z): float(x > 0) for x in range(3) for y in range(2) for z in range(2)}
    cli.main(["slices", str(tmp_path / "v.mhd"), str(tmp_path / "slices")])
    assert (tmp_path / "slices" / "volume.xml").exists() and volumes.read_volume(spark, str(tmp_path / "slices")).count() == 24


def test_metaimage_compressed_and_pushdown(spark, tmp_path):
    data = np.arange(4 * 3 * 5, dtype="<u2")
    (tmp_path / "v.zraw").write_bytes(zlib.compress(data.tobytes()))
    head = sinks.mhd_header((4, 3, 5), "MET_USHORT", "v.zraw").replace("ElementType", "CompressedData = True\nElementType")
    (tmp_path / "v.mhd").write_text(head)
    got = volumes.read_metaimage(spark, str(tmp_path / "v.mhd")).where("z >= 2 AND z < 4 AND x = 3 AND y <= 1 AND v > 0")
    assert sorted((r.x, r.y, r.z, r.v) for r in got.collect()) == sorted((3, y, z, float(3 + 4 * y + 12 * z)) for y in (0, 1) for z in (2, 3))
    assert volumes.read_metaimage(spark, str(tmp_path / "v.mhd")).where("z > 9").count() == 0


def test_lists(spark, tmp_path):
    (tmp_path / "p.txt").write_text("a.ply b.ply\n\nc.ply  d.ply\n")
    (tmp_path / "i.txt").write_text("3 5\nx 5\n")
    assert lists.mesh_pairs(spark, str(tmp_path / "p.txt")).count() == 2
    assert {r.vid for r in lists.ids(spark, str(tmp_path / "i.txt")).collect()} == {3, 5}
    assert [r.value for r in lists.numbers(spark.createDataFrame([("1, x,2.5,NaN",)], "t string"), "t").collect()] == [1.0, 2.5]
    assert lists.label_names(spark, '<l><c label="2" name="n" color="red"/></l>').first().name == "n"


def test_label_surface_of_one_voxel(spark):
    vox = spark.createDataFrame([(x, y, z, int((x, y, z) == (1, 1, 1))) for x in range(3) for y in range(3) for z in range(3)], "x long, y long, z long, v int")
    points, faces = volume.label_surfaces(vox)
    one = measures.volume_properties(measures.Mesh(points.where("label = 1"), faces.where("label = 1"))).first()
    assert 0 < one.signed_volume < 1
    assert volume.clean_labels(vox).where("v = 1").count() == 1


def test_synthetic_kinds(spark):
    for kind in range(8):
        mesh = syn.triangulation(spark, 40, kind)
        assert mesh.vertices.count() >= 25 and measures.face_areas(mesh).agg(F.min("area")).first()[0] >= 0


def test_events_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(300)
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = events.windowed(stream).writeStream.outputMode("complete").format("memory").queryName("win").start()
    q.processAllAvailable()
    q.stop()
    batch = events.windowed(spark.read.parquet(str(tmp_path / "in")))
    assert sorted((r.start, r.event_type, r.n) for r in spark.sql("SELECT * FROM win").collect()) == sorted((r.start, r.event_type, r.n) for r in batch.collect())


@pytest.mark.parametrize("kind", ["off", "obj", "ply", "vtk", "vtp", "iv", "stl"])
def test_large_text_is_read_by_lines(spark, tmp_path, monkeypatch, kind):
    """Lines dealt over many blocks give what the parser of whole files gives, and a large file is never a row."""
    mesh = syn.triangulation(spark, 300, 2)
    name = tmp_path / f"mesh.{'wrl' if kind == 'iv' else kind}"
    sinks.write_mesh(m.dense_ids(mesh), str(tmp_path / f"out.{kind}"), kind)
    name.write_bytes(b"".join(p.read_bytes() for p in [part(tmp_path / f"out.{kind}")]))
    rows = lambda mesh: ({(r.vid, r.x, r.y, r.z) for r in mesh.vertices.collect()}, {(r.fid, *r.vs) for r in mesh.faces.collect()})
    want = rows(meshes.read_mesh(spark, str(name)))
    monkeypatch.setattr(meshes, "LARGE", 0)
    monkeypatch.setitem(meshes.PARSERS, meshes.format_of(name.name), None)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert rows(meshes.read_mesh(spark, str(name))) == want and len(want[1]) > 100
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_large_text_of_other_layout(spark, tmp_path, monkeypatch):
    """Several points to a line, and comments, are read too."""
    (tmp_path / "a.vtk").write_text("# vtk DataFile Version 3.0\nx\nASCII\nDATASET POLYDATA\nPOINTS 4 float\n0 0 0 1 0 0\n0 1 0 1 1 0\nPOLYGONS 2 8\n3 0 1 2\n3 1 3 2\n")
    (tmp_path / "b.off").write_text("OFF\n# c\n4 2 0\n0 0 0\n1 0 0 # d\n\n0 1 0\n1 1 0\n3 0 1 2\n3 1 3 2\n")
    (tmp_path / "c.obj").write_text("v 0 0 0\nv 1 0 0\nv 0 1 0\nf -3 -2 -1\nv 1 1 0\nf 2 4 3\n")
    monkeypatch.setattr(meshes, "LARGE", 0)
    for name in ("a.vtk", "b.off", "c.obj"):
        back = meshes.read_mesh(spark, str(tmp_path / name))
        assert [r.vs for r in back.faces.orderBy("fid").collect()] == [[0, 1, 2], [1, 3, 2]] and back.vertices.count() == 4


def test_label_meshes_stream(spark, tmp_path, monkeypatch):
    """A label's mesh is written line by line, not gathered as one frame."""
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", None)
    points = spark.createDataFrame([(1, 10, 0.0, 0.0, 0.0), (1, 30, 1.0, 0.0, 0.0), (1, 20, 0.0, 1.0, 0.0), (2, 10, 5.0, 0.0, 0.0), (2, 11, 6.0, 0.0, 0.0), (2, 12, 5.0, 1.0, 0.5)], "label int, vid long, x double, y double, z double")
    faces = spark.createDataFrame([(1, 7, [10, 30, 20]), (2, 8, [12, 10, 11])], "label int, fid long, vs array<long>")
    sinks.write_label_meshes(points, faces, str(tmp_path / "labels"))
    v, f = meshes.parse_vtk((tmp_path / "labels/1.vtk").read_bytes())
    assert v.tolist() == [[0, 0, 0], [0, 1, 0], [1, 0, 0]] and f == [[0, 2, 1]]
    assert meshes.parse_vtk((tmp_path / "labels/2.vtk").read_bytes())[1] == [[2, 0, 1]]
    assert (tmp_path / "labels/meshes.xml").read_text().count("<mesh ") == 2
