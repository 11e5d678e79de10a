"""Relational operators over geometry: spatial joins, aggregates, meshes, voxels."""
