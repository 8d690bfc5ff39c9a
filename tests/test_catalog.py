import duckdb
import pytest

import __spark_entry__ as entry
from meshlake.plans import catalog, files  # noqa: F401

SF = "/root/testdata/sf0.001"
NAMES = ["triangle_stats", "quality_hist", "mesh_report", "vertex_area", "vertex_manifold", "face_neighbours", "across_edges", "one_ring", "n_ring", "boundary_gains", "components", "orientation", "voxel_contacts", "voxel_components", "cumulative_area", "subdivide_loop"]


def rows(pairs):
    return sorted(tuple(tuple(v) if hasattr(v, "__iter__") and not isinstance(v, str) else v for _, v in sorted(p.items())) for p in pairs)


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "part", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(catalog.oracle_sql()[name]).df().to_dict("records")
    got = entry.queries()[name](spark, SF).toPandas().to_dict("records")
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
