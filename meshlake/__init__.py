"""Mesh, graph and voxel analytics on PySpark DataFrames."""
