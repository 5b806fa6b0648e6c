"""Queries over whole graph builds."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayspark.config import GraphOptions
from wayspark.functions import geo
from wayspark.operators import surgery as X
from wayspark.plans.registry import query
from wayspark.plans.road_queries import _connected, _points, _r


@query()
def road_merge_graph(spark, sf):
    return X.merge_roads(_connected(spark, sf)).edges.select("eid", "way_id", "u", "v", *_r(3, length=geo.dist("ax", "ay", "bx", "by_")))


@query()
def prune_graph(spark, sf):
    return X.prune(_connected(spark, sf)).edges.select("eid", "way_id", "u", "v", *_r(3, length=geo.dist("ax", "ay", "bx", "by_")))


@query()
def graph_build(spark, sf):
    """The edges of the whole build, each with the places of its ends and the ways it stands for."""
    e = X.build(_points(spark, sf), GraphOptions()).edges
    return e.select("eid", "way_id", "u", "v", *_r(3, ax="ax", ay="ay", bx="bx", by_="by_"), F.array_join(F.col("way_ids").cast("array<string>"), ",").alias("way_ids"))
