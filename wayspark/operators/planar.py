"""The planar graph of sketches: strokes cut where they cross, and ends and cuts that lie on one spot made one vertex.

All sketches are worked on at once. Their points are sorted by x, then by y, and parted where a step is too wide for one spot; only among points
that no such step parts does the order count, and each of these runs is an ordered fold of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayspark.functions import geo
from wayspark.operators.sketch import stroke_segments
from wayspark.storage import written

#: The least step between cuts of a segment, and how near points are one vertex.
CUT_STEP, SAME_SPOT = 1e-10, 1e-6


def spaced(cuts: Column, step: float = CUT_STEP) -> Column:
    """Sorted numbers of an array, without those that lie no more than ``step`` after the last one kept."""
    kept = lambda acc, t: F.when((F.size(acc) > 0) & (t - F.element_at(acc, -1) <= step), acc).otherwise(F.concat(acc, F.array(t)))
    return F.aggregate(F.array_sort(cuts), F.array().cast("array<double>"), kept)


def crossing_cuts(segments: DataFrame, by: str) -> DataFrame:
    """(<by>, stroke_id, i, cuts): where other segments of its sketch cross inside a segment, as spaced shares of its length.

    Neighbours in one stroke aren't crossed. The join is on the sketch, whose size is bounded by its limits.
    """
    cols = ("stroke_id", "i", "ax", "ay", "bx", "by_")
    a, b = (segments.select(by, *(F.col(c).alias(f"{p}_{c}") for c in cols)) for p in "ab")
    t, u = geo.crossing(("a_ax", "a_ay", "a_bx", "a_by_"), ("b_ax", "b_ay", "b_bx", "b_by_"))
    apart = "least(a_ax, a_bx) <= greatest(b_ax, b_bx) and least(b_ax, b_bx) <= greatest(a_ax, a_bx) and least(a_ay, a_by_) <= greatest(b_ay, b_by_) and least(b_ay, b_by_) <= greatest(a_ay, a_by_)"
    met = a.join(b.hint("merge"), by).where("(a_stroke_id < b_stroke_id or a_stroke_id = b_stroke_id and a_i + 1 < b_i)").where(apart).withColumns({"t": F.expr(t), "u": F.expr(u)})
    met = met.where(f"t between -{CUT_STEP} and 1e0 + {CUT_STEP} and u between -{CUT_STEP} and 1e0 + {CUT_STEP}")
    cut = lambda p, c: F.struct(F.col(f"{p}_stroke_id").alias("stroke_id"), F.col(f"{p}_i").alias("i"), F.col(c).alias("at"))
    each = met.select(by, F.inline(F.array(cut("a", "t"), cut("b", "u")))).where(f"at > {CUT_STEP} and at < 1e0 - {CUT_STEP}")
    return each.groupBy(by, "stroke_id", "i").agg(spaced(F.collect_list("at")).alias("cuts"))


def merged_spots(points: DataFrame, near: float = SAME_SPOT) -> DataFrame:
    """(group, k, vertex, x, y) for ``points(group, k, x, y)``, in the order of k: a point becomes the first vertex of its group that lies nearer than
    ``near`` in x and in y, or a new one, named by its k. Points without coordinates go; k is unique in a group.

    A point and one that it becomes are near in x and in y, so a gap of ``near`` or more between neighbours by one of these parts a group; points on the very
    same spot are one from the start, as whatever takes the first takes the others. All of it is windows and groupings over ``group``, so points that
    are dealt by group are not shuffled again.
    """
    points, run = points.select("group", "k", "x", "y").where("x + y is not null"), ["group"]
    for n, c in enumerate(("x", "y", "x", "y")):
        w = W.partitionBy(*run).orderBy(c)
        points = points.withColumn("gap", F.when(F.col(c) - F.lag(c).over(w) >= near, 1).otherwise(0))
        points = points.withColumn(f"run{n}", F.sum("gap").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("gap")
        run.append(f"run{n}")
    spots = points.groupBy(*run, "x", "y").agg(F.min("k").alias("k"), F.collect_list("k").alias("ks"))
    lists = spots.groupBy(*run).agg(F.array_sort(F.collect_list(F.struct("k", "x", "y", "ks"))).alias("p"))
    spot = lambda p: F.struct(p["k"].alias("k"), p["x"].alias("x"), p["y"].alias("y"))
    lists = lists.select("group", "p", F.transform("p", spot).alias("s"))
    shape = lists.schema["s"].dataType

    def step(acc: Column, p: Column) -> Column:
        hit = F.get(F.filter(acc["made"], lambda v: (F.abs(v["x"] - p["x"]) < near) & (F.abs(v["y"] - p["y"]) < near)), F.lit(0))
        made = F.when(hit.isNull(), F.concat(acc["made"], F.array(p))).otherwise(acc["made"])
        return F.struct(made.alias("made"), F.concat(acc["to"], F.array(F.coalesce(hit, p))).alias("to"))

    to = F.aggregate("s", F.struct(F.array().cast(shape).alias("made"), F.array().cast(shape).alias("to")), step)["to"]
    to = F.when(F.size("s") == 1, F.col("s")).otherwise(to)
    each = lists.select("group", F.inline(F.zip_with("p", to, lambda p, v: F.struct(p["ks"].alias("ks"), v["k"].alias("vertex"), v["x"].alias("x"), v["y"].alias("y")))))
    return each.select("group", F.explode("ks").alias("k"), "vertex", "x", "y")


def planar_edges(points: DataFrame, by: str = "sketch_id") -> DataFrame:
    """(<by>, stroke_id, i, part, u, v, ux, uy, vx, vy, weight) of ``points(<by>, stroke_id, i, x, y)``: the parts of each segment between its cuts. A vertex is
    named by the (stroke_id, i, k) of the point that made it; parts that lost their length go, parallel ones stay."""
    segments = written(stroke_segments(points, by).select(F.col(by).alias("group"), "stroke_id", "i", "ax", "ay", "bx", "by_"), "segments")
    # dealt by sketch while cuts are but numbers, and not by the size of these, as what follows is many times larger
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = segments.join(crossing_cuts(segments, "group"), ["group", "stroke_id", "i"], "left").repartition(n, "group")
    at = F.transform(F.coalesce("cuts", F.array().cast("array<double>")), lambda t: F.struct((F.col("ax") + t * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + t * (F.col("by_") - F.col("ay"))).alias("y")))
    stops = F.concat(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y"))), at, F.array(F.struct(F.col("bx").alias("x"), F.col("by_").alias("y"))))
    each = s.select("group", "stroke_id", "i", F.posexplode(stops).alias("n", "p"))
    k = F.struct(F.col("stroke_id").cast("long").alias("stroke_id"), F.col("i").cast("long").alias("i"), F.col("n").cast("long").alias("n"))
    spots = merged_spots(each.select("group", k.alias("k"), "p.x", "p.y"))
    w = W.partitionBy("group", "k.stroke_id", "k.i").orderBy("k.n")
    e = spots.select("group", "k", F.col("vertex").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"), *(F.lead(c).over(w).alias(n) for c, n in (("vertex", "v"), ("x", "vx"), ("y", "vy"))))
    name = lambda c: F.concat_ws(":", f"{c}.stroke_id", f"{c}.i", f"{c}.n").alias(c)
    e = e.where("v is not null and u <> v").withColumn("weight", F.expr(geo.dist("ux", "uy", "vx", "vy"))).where(F.col("weight") >= SAME_SPOT)
    return e.select(F.col("group").alias(by), "k.stroke_id", "k.i", F.col("k.n").alias("part"), name("u"), name("v"), "ux", "uy", "vx", "vy", "weight")
