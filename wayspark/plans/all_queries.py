"""All queries of the library itself."""

from wayspark.plans import build_queries, corridor_queries, feature_queries, merge_queries, more_queries, road_queries, search_queries, sketch_queries, tile_queries  # noqa: F401
from wayspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
