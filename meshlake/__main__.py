"""Command line: python -m meshlake COMMAND ... (see --help)."""

from __future__ import annotations

import argparse


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="meshlake")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *more: tuple, target: bool = True):
        p = sub.add_parser(name)
        p.add_argument("source")
        if target:
            p.add_argument("target")
        for flags, options in more:
            p.add_argument(*flags, **options)

    command("convert")
    command("orient")
    command("fill")
    command("clip", (("--normal",), {"type": float, "nargs": 3, "required": True}), (("--offset",), {"type": float, "default": 0.0}))
    command("difference", (("other",), {}), (("--cell",), {"type": float, "default": 1.0}), target=False)
    command("align", (("other",), {}), (("--cell",), {"type": float, "default": 1.0}), (("--rounds",), {"type": int, "default": 20}))
    command("crop", (("--low",), {"type": int, "nargs": 3, "required": True}), (("--high",), {"type": int, "nargs": 3, "required": True}), (("--type",), {"default": "f4"}))
    command("slices", (("--type",), {"default": "f4"}))
    command("median", (("--radius",), {"type": int, "default": 1}), (("--type",), {"default": "f4"}))
    command("labels", (("--names",), {}), (("--clean",), {"action": "store_true"}))
    command("report", target=False)
    command("clean")
    command("subdivide", (("-k",), {"type": int, "default": 1}), (("--kind",), {"choices": ["linear", "loop", "butterfly"], "default": "linear"}))
    command("simplify", (("-n",), {"type": int, "required": True}))
    command("components", (("-n",), {"type": int, "default": 1}))
    command("sample", (("-n",), {"type": int, "required": True}))
    command("curvature", (("--method",), {"choices": ["fit", "tensor"], "default": "fit"}), (("--ring",), {"type": int, "default": 3}))
    command("remesh", (("-n",), {"type": int, "required": True}), (("--gradation",), {"type": float, "default": 0.0}), (("-s", "--subsampling"), {"type": float, "default": 10.0}), (("-l", "--split"), {"type": float, "default": 0.0}), (("-q", "--quadric"), {"type": int, "default": 1}), (("-m", "--manifold"), {"type": int, "default": 0}), (("-b", "--boundary"), {"action": "store_true"}), (("--metric",), {"choices": ["isotropic", "quadric", "anisotropic"], "default": "isotropic"}), (("--items",), {"choices": ["vertices", "faces"], "default": "vertices"}),
            (("--init",), {"type": int, "choices": [-1, 0, 1, 3], "default": 3}), (("--unconstrained-start",), {"action": "store_true"}))
    return top


def volume_command(spark, o: argparse.Namespace) -> None:
    from pyspark.sql import functions as F

    from meshlake.operators import volume
    from meshlake.sources import lists, sinks, volumes

    vox = volumes.read_volume(spark, o.source)
    if o.command == "crop":
        vox = volume.crop(vox, tuple(o.low), tuple(o.high)).select(*[(F.col(k) - low).alias(k) for k, low in zip("xyz", o.low, strict=True)], "v")
    elif o.command == "median":
        vox = volume.median(vox, o.radius)
    elif o.command == "labels":
        vox = vox.withColumn("v", F.col("v").cast("int"))
        points, faces = volume.label_surfaces(volume.clean_labels(vox) if o.clean else vox)
        names = None
        if o.names:
            with open(o.names, encoding="utf-8") as f:
                names = lists.label_names(spark, f.read()).withColumn("label", F.col("label").cast("long"))
        sinks.write_label_meshes(points, faces, o.target, names)
        return
    r = vox.agg(*[F.max(k).alias(k) for k in "xyz"]).first()
    dims = (r.x + 1, r.y + 1, r.z + 1)
    if o.command == "slices":
        sinks.write_png_slices(vox, o.target, dims)
    elif o.target.endswith(".nii"):
        sinks.write_nifti(vox, o.target, dims, o.type)
    else:
        sinks.write_metaimage(vox, o.target, dims, o.type)


def main(argv: list[str] | None = None) -> None:
    o = arguments().parse_args(argv)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from meshlake.operators import clustering, curvature, graph, measures, registration, remesh
    from meshlake.operators import mesh as m
    from meshlake.sources import meshes, sinks

    spark = SparkSession.builder.appName("meshlake").getOrCreate()
    if o.command in ("crop", "slices", "median", "labels"):
        volume_command(spark, o)
        return
    mesh = meshes.read_mesh(spark, o.source)
    if o.command == "report":
        print(measures.full_report(mesh).first().asDict())
        return
    if o.command == "difference":
        other = meshes.read_mesh(spark, o.other)
        print(registration.mesh_distance(*(x.vertices.withColumnRenamed("vid", "item") for x in (mesh, other)), o.cell).first().asDict())
        return
    if o.command == "clip":
        m.half_space(mesh, tuple(o.normal), o.offset).write.mode("overwrite").parquet(o.target)
        return
    if o.command == "sample":
        sinks.write_points(measures.sample_surface(mesh, o.n), o.target)
        return
    if o.command == "curvature":
        curvature.curvature(mesh, o.method, o.ring).write.mode("overwrite").parquet(o.target)
        return
    if o.command == "clean":
        mesh = remesh.clean(mesh)
    elif o.command == "orient":
        mesh = m.Mesh(mesh.vertices, graph.orient(mesh.faces).select("fid", "vs"))
    elif o.command == "fill":
        mesh = remesh.fill_holes(mesh)
    elif o.command == "align":
        other = meshes.read_mesh(spark, o.other)
        moved, _, _ = registration.align(mesh.vertices.withColumnRenamed("vid", "item"), other.vertices.withColumnRenamed("vid", "item"), o.cell, o.rounds)
        mesh = m.Mesh(moved.withColumnRenamed("item", "vid"), mesh.faces)
    elif o.command == "subdivide":
        for _ in range(o.k):
            mesh = {"linear": lambda x: remesh.subdivide(x)[0], "loop": remesh.subdivide_loop, "butterfly": remesh.subdivide_butterfly}[o.kind](mesh)
            mesh = m.dense_ids(mesh)
    elif o.command == "simplify":
        mesh = remesh.simplify(mesh, o.n)
    elif o.command == "components":
        kept = graph.biggest_components(graph.mesh_components(mesh.vertices, m.edge_counts(mesh.faces)), o.n)
        mesh = remesh.delete_vertices(mesh, mesh.vertices.join(kept.select("vid"), "vid", "left_anti").select("vid"))
    elif o.command == "remesh":
        if o.split:
            mesh = remesh.split_long_edges(mesh, o.split)
        mesh = remesh.subsample_guard(mesh, o.n, o.subsampling)
        bent = measures.normalised_indicator(curvature.fitted(mesh), "k") if o.gradation else None
        options = clustering.Options(clusters=o.n, sampling=o.init, unconstrained_start=o.unconstrained_start)
        if o.items == "faces":
            flat = mesh.vertices.select(F.col("vid").alias("elt"), F.lit(1.0).alias("k"))
            mesh = remesh.remesh_faces(mesh, clustering.Isotropic(), options, clustering.face_weights(mesh, flat if bent is None else bent, o.gradation)).mesh
        else:
            weights = measures.item_weights(measures.vertex_areas(mesh), bent, o.gradation, 1e5)
            items = clustering.place_items(mesh.vertices.select(F.col("vid").alias("item"), "x", "y", "z"), weights)
            metric = {"isotropic": clustering.Isotropic, "quadric": clustering.Quadric, "anisotropic": clustering.Anisotropic}[o.metric]()
            if o.metric == "quadric":
                items = items.join(measures.vertex_quadrics(mesh).withColumnRenamed("vid", "item"), "item")
            elif o.metric == "anisotropic":
                items = clustering.tensor_items(mesh.vertices.select(F.col("vid").alias("item"), "x", "y", "z"), weights, curvature.curvature(mesh, "fit"))
            mesh = remesh.remesh(mesh, metric, options, items, o.quadric, boundary=o.boundary, manifold_rounds=o.manifold).mesh
    sinks.write_mesh(m.dense_ids(mesh), o.target)


if __name__ == "__main__":
    main()
