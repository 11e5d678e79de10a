"""All registered geometry queries."""

from .plans import bounds_and_points, composites, kernels, measures_and_meshes, motion_and_pairs  # noqa: F401
from .plans.registry import QUERIES, oracle_sql

__all__ = ["QUERIES", "oracle_sql"]
