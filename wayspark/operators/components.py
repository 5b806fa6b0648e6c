"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayspark.storage import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours on one side, tied to its smallest neighbour. The minima are partial sums before
    they are shuffled, and the join that hands them back is one AQE can split where a hub is hot."""
    if large:
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        ends = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = ends.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
    tied = ends.join(least, ends["a"] == least["node"])
    if large:
        out = tied.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of ``edges(a, b)``; component is the smallest node reachable.

    Nulls in a or b are no edges; self-loops make a component of one; an empty table gives none. Each round
    is written to the shared folder, so nothing is kept on one executor and lineage stays short; rounds end when nothing changes.
    """
    edges = written(edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull()).distinct(), "edges")
    alone = edges.where(F.col("a") == F.col("b")).select(F.col("a").alias("node"))
    edges = edges.where(F.col("a") != F.col("b"))
    mark = None
    while True:
        edges = written(_stars(_stars(edges, True), False), "stars")
        row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (row[0], row[1]) == mark:
            break
        mark = (row[0], row[1])
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    linked = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
    lone = alone.join(linked, "node", "left_anti").select("node", F.col("node").alias("component"))
    return linked.unionByName(lone)
