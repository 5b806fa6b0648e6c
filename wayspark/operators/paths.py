"""Shortest paths in bulk: every request relaxes its own frontier, a few steps a round."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayspark.functions import geo
from wayspark.operators.components import components
from wayspark.operators.graph import least_edges
from wayspark.storage import written

#: Steps between two writes.
STEPS = 4


def contracted(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """(u, v, w, hops, x, y) both ways round: chains whose inner nodes have two edges and are not in ``keep(id)`` become
    one edge each, of the chain's length; of parallel ones the shortest stays, then that of fewer hops. x, y is v's
    place. Rounds over the result are as many as there are choices on the way, not vertices. Edges that lie on one another are one."""
    w = least_edges(edges).select("eid", "u", "v", "ax", "ay", "bx", "by_", F.expr(geo.dist("ax", "ay", "bx", "by_")).alias("w")).where("u <> v")
    ends = written(w.select("eid", "w", F.inline(F.array(F.struct(F.col("u").alias("id"), F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("v").alias("id"), F.col("bx").alias("x"), F.col("by_").alias("y"))))), "ends")
    inner = ends.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("eid").alias("a"), F.max("eid").alias("b")).where("n = 2").join(keep, "id", "left_anti")
    inner = written(inner, "inner")
    chain = components(inner.select("a", "b")).select(F.col("node").alias("eid"), "component")
    own = ends.join(chain, "eid", "left").withColumn("chain", F.coalesce("component", "eid"))
    size = own.select("chain", "eid", "w").distinct().groupBy("chain").agg(F.sum("w").alias("w"), F.count(F.lit(1)).cast("int").alias("hops"))
    # a chain has two outer nodes; one that comes back to its only one, or has none, leads nowhere
    outer = own.join(inner.select("id"), "id", "left_anti").groupBy("chain").agg(F.min(F.struct("id", "x", "y")).alias("p"), F.max(F.struct("id", "x", "y")).alias("q"))
    both = outer.where("p.id <> q.id").join(size, "chain").select("w", "hops", F.explode(F.array(F.struct(F.col("p").alias("u"), F.col("q").alias("v")), F.struct(F.col("q").alias("u"), F.col("p").alias("v")))).alias("e"))
    best = both.groupBy(F.col("e.u.id").alias("u"), F.col("e.v.id").alias("v")).agg(F.min(F.struct("w", "hops")).alias("m"), F.first("e.v.x").alias("x"), F.first("e.v.y").alias("y"))
    return best.select("u", "v", "m.w", F.col("m.hops").alias("step"), "x", "y")


def shortest(requests: DataFrame, edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """``requests(.., src, dst)`` with length and hops of the shortest path; null where there is none.

    Chains without a choice are one step (``contracted``). A round takes the frontier ``STEPS`` steps on and writes what became shorter. A node is left out of the frontier
    if its length and the straight way to the target are no less than the best known there. Ties fall to fewer hops.
    Rounds go on until no frontier is left; where ``max_rounds`` are given and do not suffice, an error is raised.
    """
    nodes = requests.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    steps = written(contracted(edges, nodes), "steps")
    place = steps.groupBy(F.col("v").alias("dst")).agg(F.first("x").alias("tx"), F.first("y").alias("ty"))
    ask = requests.select("src", "dst").distinct().join(place, "dst", "left").select("src", "dst", "tx", "ty")
    seen = written(ask.select("*", F.col("src").alias("at"), F.lit(0.0).alias("length"), F.lit(0).alias("hops"), F.lit(True).alias("new")), "seen")
    key = ["src", "dst", "tx", "ty", "at"]
    for k in count():
        goal = seen.where("at = dst").select("src", "dst", F.col("length").alias("cap"))
        front = seen.where("new").join(goal, ["src", "dst"], "left")
        if front.isEmpty():
            break
        if k == max_rounds:
            raise RuntimeError(f"shortest paths did not settle in {max_rounds} rounds")
        layers = []
        for step in range(STEPS):
            grown = front.join(steps, front["at"] == steps["u"]).select("src", "dst", "tx", "ty", F.col("v").alias("at"), (F.col("length") + F.col("w")).alias("length"), (F.col("hops") + F.col("step")).alias("hops"), "cap", F.expr(geo.dist("x", "y", "tx", "ty")).alias("rest"))
            grown = grown.where("cap is null or at = dst or length + coalesce(rest, 0) < cap")
            best = grown.groupBy(*key).agg(F.min(F.struct("length", "hops")).alias("m"), F.first("cap").alias("cap"))
            front = best.select(*key, "m.length", "m.hops", "cap")
            layers.append(front.select(*key, "length", "hops", F.lit(step == STEPS - 1).alias("new")))
        every = seen.withColumn("new", F.lit(False))
        for layer in layers:
            every = every.unionByName(layer)
        # known lengths win ties, as false comes first
        settled = every.groupBy(*key).agg(F.min(F.struct("length", "hops", "new")).alias("m")).select(*key, "m.length", "m.hops", "m.new")
        seen = written(settled, "seen")
    found = seen.where("at = dst").select("src", "dst", "length", "hops")
    return requests.join(found, ["src", "dst"], "left")
