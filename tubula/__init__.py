"""Tubular-structure analytics on voxel grids, centreline graphs and paths, as Spark DataFrame operators."""
