"""Road graphs as pairs of DataFrames.

nodes(id, x, y, osm_ids, is_end, merged_snap, merged_osm), edges(eid, way_id, highway, u, v, ax, ay, bx, by_).
Each step takes a graph and returns a new one; ids are strings and compared as such.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayspark.functions import geo
from wayspark.operators.components import components
from wayspark.sources.roads import LAT0, LON0
from wayspark.storage import written


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame


def native(points: DataFrame, lon0: str = LON0, lat0: str = LAT0) -> Graph:
    """One node for each vertex of each way, one edge for each pair of consecutive vertices."""
    last = F.max("pos").over(W.partitionBy("way_id"))
    nodes = points.select(
        "way_id", "pos", "node_id", "highway", F.format_string("native:%d:%d", "way_id", "pos").alias("id"),
        F.expr(geo.to_x("lon", lon0, lat0)).alias("x"), F.expr(geo.to_y("lat", lat0)).alias("y"),
        ((F.col("pos") == 0) | (F.col("pos") == last)).alias("is_end"),
    )
    w = W.partitionBy("way_id").orderBy("pos")
    edges = nodes.select(
        F.format_string("e:%d:%d", "way_id", "pos").alias("eid"), "way_id", "highway", F.col("id").alias("u"), F.lead("id").over(w).alias("v"),
        F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by_"), "pos",
    ).where("v is not null")
    return Graph(nodes.select("id", "x", "y", F.array("node_id").alias("osm_ids"), "is_end", F.lit(False).alias("merged_snap"), F.lit(False).alias("merged_osm"), "way_id", "pos"), edges)


def remap(graph: Graph, canon: DataFrame, flag: str) -> Graph:
    """Collapses nodes by ``canon(id, root)``: mean place, union of sources, or of flags; edges follow, those
    that lost their length go, parallel edges stay. Nodes that ``canon`` doesn't name stay alone."""
    n = graph.nodes.join(canon, "id", "left").withColumn("root", F.coalesce("root", "id"))
    merged = F.count(F.lit(1)) > 1
    flags = [(F.bool_or(c) | merged if c == flag else F.bool_or(c)).alias(c) for c in ("merged_snap", "merged_osm")]
    nodes = n.groupBy(F.col("root").alias("id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("osm_ids")))).alias("osm_ids"), F.bool_or("is_end").alias("is_end"), *flags)
    to = n.select(F.col("id").alias("old"), F.col("root").alias("new"))
    at = nodes.select("id", "x", "y")
    e = graph.edges.select("eid", "way_id", "highway", "u", "v")
    for end, x, y in (("u", "ax", "ay"), ("v", "bx", "by_")):
        e = e.join(to, e[end] == to["old"]).drop("old", end).withColumnRenamed("new", end)
        e = e.join(at.select(F.col("id").alias(end), F.col("x").alias(x), F.col("y").alias(y)), end)
    return Graph(nodes, e.where("u <> v"))


def osm_roots(nodes: DataFrame) -> DataFrame:
    """(id, root) of nodes that share an OSM id. A native node has one id, so one grouping is enough."""
    each = nodes.select("id", F.explode("osm_ids").alias("osm"))
    return each.join(each.groupBy("osm").agg(F.min("id").alias("root")), "osm").select("id", "root")


def connect(graph: Graph) -> Graph:
    return remap(graph, osm_roots(graph.nodes), "merged_osm")


def cells(df: DataFrame, size: float, x0: str, y0: str, x1: str, y1: str, grow: float) -> DataFrame:
    """A row for each grid cell that a box, grown on all sides, touches: columns cx, cy."""
    span = lambda a, b: F.sequence(F.floor((F.expr(f"least({a}, {b})") - grow) / size), F.floor((F.expr(f"greatest({a}, {b})") + grow) / size))
    return df.select("*", F.explode(span(x0, x1)).alias("cx")).select("*", F.explode(span(y0, y1)).alias("cy"))


def near_points(nodes: DataFrame, radius: float) -> DataFrame:
    """Pairs (a, b), a < b, of nodes at most ``radius`` apart, by an equi-join on cells: one side is in its own
    cell, the other in all it can reach."""
    cols = ["id", "x", "y", "is_end"]
    left = nodes.select(*(F.col(c).alias(f"a_{c}") for c in cols), F.floor(F.col("x") / radius).alias("cx"), F.floor(F.col("y") / radius).alias("cy"))
    right = cells(nodes.select(*(F.col(c).alias(f"b_{c}") for c in cols)), radius, "b_x", "b_y", "b_x", "b_y", radius)
    d = F.expr(geo.dist("a_x", "a_y", "b_x", "b_y"))
    return left.join(right, ["cx", "cy"]).where((F.col("a_id") < F.col("b_id")) & (d <= radius)).withColumn("d", d).drop("cx", "cy")


def snap_pairs(graph: Graph, epsilon: float) -> DataFrame:
    """Pairs of nodes within epsilon of which one ends a way and that are not the two ends of one edge."""
    direct = graph.edges.select(F.least("u", "v").alias("a_id"), F.greatest("u", "v").alias("b_id")).distinct()
    return near_points(graph.nodes, epsilon).where("a_is_end or b_is_end").join(direct, ["a_id", "b_id"], "left_anti")


def snap(graph: Graph, epsilon: float) -> Graph:
    pairs = snap_pairs(graph, epsilon).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return remap(graph, components(pairs).select(F.col("node").alias("id"), F.col("component").alias("root")), "merged_snap")


def incidence(edges: DataFrame) -> DataFrame:
    """(id, eid): both ends of each edge; a loop counts twice."""
    return edges.select("eid", "way_id", F.explode(F.array("u", "v")).alias("id"))


def degrees(graph: Graph) -> DataFrame:
    n = incidence(graph.edges).groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.countDistinct("way_id").alias("ways"), F.count_if(F.col("way_id").isNull()).alias("no_way"))
    return graph.nodes.join(n, "id", "left").fillna(0, ["degree", "ways", "no_way"])


def roles(graph: Graph) -> DataFrame:
    """inline, or junction: a node whose degree isn't two, that ends a way, has several ids or joins two ways."""
    junction = (F.col("degree") != 2) | F.col("is_end") | (F.size("osm_ids") != 1) | (F.col("ways") > 1)
    return degrees(graph).select("id", "degree", F.when(junction, "junction").otherwise("inline").alias("role"))


A, B = ("a_ax", "a_ay", "a_bx", "a_by_"), ("b_ax", "b_ay", "b_bx", "b_by_")
#: What two edges that lie on each other share.
SAME = ("u", "v", "ax", "ay", "bx", "by_")


def segment_pairs(edges: DataFrame, reach: float, size: float, more: tuple[str, ...] = (), sectors: int = 1) -> DataFrame:
    """Each pair of edges (a_eid < b_eid) of which boxes grown by half the reach share a cell; columns a_*, b_*.

    With three sectors or more, the half turn is cut into so many and pairs are met only in the same or neighbouring
    ones: one side stands in its own, the other in three, so a pair is met once."""
    cols = ["eid", "way_id", "u", "v", "ax", "ay", "bx", "by_", *more]
    side = lambda p: cells(edges.select(*(F.col(c).alias(f"{p}_{c}") for c in cols)), size, f"{p}_ax", f"{p}_ay", f"{p}_bx", f"{p}_by_", reach / 2)
    left, right, keys = side("a"), side("b"), ["cx", "cy"]
    if sectors >= 3:
        own = lambda p: F.least(F.floor(F.pmod(F.expr(f"atan2({p}_by_ - {p}_ay, {p}_bx - {p}_ax)"), F.pi()) / F.pi() * sectors), F.lit(sectors - 1).cast("long"))
        left = left.withColumn("sector", own("a"))
        right = right.withColumn("sector", F.explode(F.transform(F.array(*(F.lit(k) for k in (-1, 0, 1))), lambda k: F.pmod(own("b") + k, F.lit(sectors)))))
        keys.append("sector")
    # rows by cell are many times the edges, so a plan made by the size of these must not broadcast them to a few tasks
    pairs = left.join(right.hint("merge"), keys).drop("sector").where("a_eid < b_eid")
    # a pair that shares several cells is taken in the least of them
    low = lambda p, x, y: F.floor((F.expr(f"least({p}_{x}, {p}_{y})") - reach / 2) / size)
    return pairs.where((F.col("cx") == F.greatest(low("a", "ax", "bx"), low("b", "ax", "bx"))) & (F.col("cy") == F.greatest(low("a", "ay", "by_"), low("b", "ay", "by_")))).drop("cx", "cy")


def alike(edges: DataFrame) -> DataFrame:
    """eid, way_id, ends and places of edges, with ``shape``: the least edge of the same ends and places."""
    return edges.select("eid", "way_id", *SAME, F.min("eid").over(W.partitionBy(*SAME)).alias("shape"))


def least_edges(edges: DataFrame) -> DataFrame:
    """eid, ends and places: of edges that join the same nodes in the same places, whichever way, the least; other edges stay."""
    turn = lambda a, b: F.when(F.col("u") > F.col("v"), F.col(b)).otherwise(F.col(a))
    both = [c.alias(n) for a, b in (("u", "v"), ("ax", "bx"), ("ay", "by_")) for c, n in ((turn(a, b), a), (turn(b, a), b))]
    return edges.select("eid", *both).groupBy(*SAME).agg(F.min("eid").alias("eid"))


def blocks(members: DataFrame, key: list[str], some: int = 256) -> DataFrame:
    """(<key>, edges): the ``members(<key>, eid, way_id, ..)`` of each key as arrays of so many at most, so that pairs of keys become pairs of edges where
    they are met, and no pair of edges is shuffled."""
    n = F.row_number().over(W.partitionBy(*key).orderBy("eid"))
    rest = [c for c in members.columns if c not in key]
    return members.withColumn("block", F.floor((n - 1) / some)).groupBy(*key, "block").agg(F.collect_list(F.struct(*rest)).alias("edges")).drop("block")


def of_edges(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``pairs(a_eid, b_eid, ..)`` of shapes, each once, handed out to the edges of ``members(eid, way_id, shape)``: a row for each pair of
    edges, columns x_eid, x_way_id, y_eid, y_way_id, and ``turned`` if the second comes first."""
    held = written(blocks(members.select("shape", "eid", "way_id"), ["shape"]), "blocks")
    for s, e in (("a", "one"), ("b", "other")):
        # merges, as the arrays are much larger than their files
        pairs = pairs.join(held.select(F.col("shape").alias(f"{s}_eid"), F.col("edges").alias(e)).hint("merge"), f"{s}_eid")
    each = pairs.withColumn("one", F.explode("one")).withColumn("other", F.explode("other")).where("a_eid <> b_eid or one.eid < other.eid")
    ids = {f"{n}_{c}": F.col(f"{e}.{c}") for n, e in (("x", "one"), ("y", "other")) for c in ("eid", "way_id")}
    return each.withColumns(ids).drop("one", "other").withColumn("turned", F.col("y_eid") < F.col("x_eid"))


def road_pairs(edges: DataFrame, distance: float, angle: float, more: tuple[Column, ...] = ()) -> DataFrame:
    """Pairs of edges of different ways within the distance whose chords differ by no more than the angle:
    distance, angle, overlap, lengths and score. Shapes are compared, their edges get the results. ``more`` are columns over these, the same
    whichever edge comes first, that are worked out for shapes."""
    e = written(alike(edges), "alike")
    near = near_shapes(e, distance, angle)
    shapes = written(near.select("*", *more), "shape-pairs")
    each = of_edges(shapes, e).where("x_way_id <> y_way_id")
    pick = lambda p, q, n: F.when(F.col("turned"), F.col(q)).otherwise(F.col(p)).alias(n)
    ids = [pick(f"{p}_{c}", f"{q}_{c}", f"{n}_{c}") for p, q, n in (("x", "y", "a"), ("y", "x", "b")) for c in ("eid", "way_id")]
    places = [pick(f"{p}_{c}", f"{q}_{c}", f"{p}_{c}") for p, q in (("a", "b"), ("b", "a")) for c in SAME]
    return each.select(*ids, *places, pick("la", "lb", "la"), pick("lb", "la", "lb"), "d", "lap", "deg", "score", *shapes.columns[len(near.columns) :])


def near_shapes(members: DataFrame, distance: float, angle: float) -> DataFrame:
    """``road_pairs`` of the shapes of ``alike``, whatever their ways; each shape also with itself."""
    edges = members.where("eid = shape")
    e = edges.withColumn("dx", F.col("bx") - F.col("ax")).withColumn("dy", F.col("by_") - F.col("ay"))
    e = e.withColumn("len", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).where("len >= 1e-6")
    sectors = int(180 / (angle + 0.01)) if angle < 60 else 1
    pairs = segment_pairs(e, distance, max(distance, 1.0), ("dx", "dy", "len"), sectors)
    pairs = pairs.unionByName(e.select(*(F.col(c[2:]).alias(c) for c in pairs.columns)))
    # what costs least goes first: boxes, then angles, then distances
    gap = lambda c, d: F.greatest(F.least(f"a_{c}", f"a_{d}"), F.least(f"b_{c}", f"b_{d}")) - F.least(F.greatest(f"a_{c}", f"a_{d}"), F.greatest(f"b_{c}", f"b_{d}")) <= distance
    # angles first by products alone, with room for rounding; what is left is written, as in one step with the join
    # the generated code is too long for the JVM to compile
    slope = math.tan(math.radians(min(angle, 89.9))) * (1 + 1e-9)
    level = F.lit(True) if angle >= 89.9 else F.expr(f"abs(a_dx * b_dy - a_dy * b_dx) <= {slope!r}D * abs(a_dx * b_dx + a_dy * b_dy)")
    pairs = written(pairs.where(gap("ax", "bx") & gap("ay", "by_") & level), "near")
    turn = F.expr("abs(atan2(a_dx * b_dy - a_dy * b_dx, a_dx * b_dx + a_dy * b_dy))")
    pairs = pairs.withColumn("deg", F.degrees(F.least(turn, F.pi() - turn))).where(F.col("deg") <= angle)

    def end(q: str, x: str, y: str, s: str) -> Column:
        """The distance of an end of q to segment s, of which the direction and length are columns."""
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.expr(f"(({q}_{x} - {s}_ax) * {s}_dx + ({q}_{y} - {s}_ay) * {s}_dy) / ({s}_len * {s}_len)")))
        return F.sqrt(F.pow(F.col(f"{q}_{x}") - F.col(f"{s}_ax") - t * F.col(f"{s}_dx"), 2) + F.pow(F.col(f"{q}_{y}") - F.col(f"{s}_ay") - t * F.col(f"{s}_dy"), 2))

    def lap(q: str, s: str) -> Column:
        """How much of s the projection of q covers."""
        p0, p1 = (F.expr(f"(({q}_{x} - {s}_ax) * {s}_dx + ({q}_{y} - {s}_ay) * {s}_dy) / {s}_len") for x, y in (("ax", "ay"), ("bx", "by_")))
        return F.greatest(F.lit(0.0), F.least(F.col(f"{s}_len"), F.greatest(p0, p1)) - F.greatest(F.lit(0.0), F.least(p0, p1)))

    d = F.least(end("a", "ax", "ay", "b"), end("a", "bx", "by_", "b"), end("b", "ax", "ay", "a"), end("b", "bx", "by_", "a"))
    pairs = pairs.withColumn("d", d).where(F.col("d") <= distance)
    pairs = pairs.withColumn("lap", F.least(lap("a", "b"), lap("b", "a"))).withColumnRenamed("a_len", "la").withColumnRenamed("b_len", "lb")
    return pairs.drop("a_dx", "a_dy", "b_dx", "b_dy").withColumn("score", F.col("lap") - 3.0 * F.col("d") - 0.5 * F.col("deg"))


def way_pairs(pairs: DataFrame) -> DataFrame:
    """Sums of the pairs of edges over each pair of ways."""
    return pairs.groupBy(F.least("a_way_id", "b_way_id").alias("way_a"), F.greatest("a_way_id", "b_way_id").alias("way_b")).agg(F.sum("score").alias("score"), F.min("d").alias("d"), F.max("deg").alias("deg"), F.sum("lap").alias("lap"))


def ways_ok(edges: DataFrame, agg: DataFrame, min_overlap: float, ratio: float, angle: float) -> DataFrame:
    """The pairs of ways that overlap enough in all and whose angles stay within the limit and six degrees."""
    length = edges.groupBy("way_id").agg(F.sum(F.expr(geo.dist("ax", "ay", "bx", "by_"))).alias("len"))
    a, b = (length.select(F.col("way_id").alias(f"way_{s}"), F.col("len").alias(f"len_{s}")) for s in "ab")
    need = F.greatest(F.lit(min_overlap), ratio * F.least("len_a", "len_b"))
    return agg.join(a, "way_a").join(b, "way_b").where((F.col("lap") >= need) & (F.col("deg") <= angle + 6.0))


def shared_node_ok(angle: float) -> Column:
    """For a pair of edges: at every node they share, they leave it within the angle (and a twentieth)."""
    ok = F.lit(True)
    for p, px, py, qx, qy in (("u", "ax", "ay", "bx", "by_"), ("v", "bx", "by_", "ax", "ay")):
        for s, sx, sy, tx, ty in (("u", "ax", "ay", "bx", "by_"), ("v", "bx", "by_", "ax", "ay")):
            la, lb = geo.dist(f"a_{px}", f"a_{py}", f"a_{qx}", f"a_{qy}"), geo.dist(f"b_{sx}", f"b_{sy}", f"b_{tx}", f"b_{ty}")
            dot = f"((a_{qx}-a_{px})*(b_{tx}-b_{sx}) + (a_{qy}-a_{py})*(b_{ty}-b_{sy})) / ({la} * {lb})"
            deg = F.expr(f"degrees(acos(greatest(-1e0, least(1e0, {dot}))))")
            good = F.expr(f"{la} >= 1e-9 and {lb} >= 1e-9") & (F.least(deg, 180.0 - deg) <= angle + 0.05)
            ok = ok & ((F.col(f"a_{p}") != F.col(f"b_{s}")) | good)
    return ok


def merge_components(pairs: DataFrame, ok_ways: DataFrame, angle: float) -> DataFrame:
    """(node, component) of edges that are one road: pairs of accepted ways, true at shared nodes."""
    keep = pairs.withColumn("way_a", F.least("a_way_id", "b_way_id")).withColumn("way_b", F.greatest("a_way_id", "b_way_id")).join(ok_ways.select("way_a", "way_b"), ["way_a", "way_b"], "left_semi")
    keep = keep.where(shared_node_ok(angle) & (F.col("deg") <= angle + 0.05))
    return components(keep.select(F.col("a_eid").alias("a"), F.col("b_eid").alias("b")))


def crossings(edges: DataFrame, digits: tuple[int, int] | None = None) -> DataFrame:
    """Pairs of edges that cross inside both, with the place on each (t, s) and the point. Shapes are crossed, their edges get the results.
    ``digits`` rounds places and points."""
    e = written(alike(edges), "alike")
    shapes = crossed_shapes(e)
    if digits:
        shapes = shapes.withColumns({c: F.round(c, digits[c not in ("t", "s")]) for c in ("t", "s", "x", "y", "x2", "y2")})
    each = of_edges(written(shapes, "crossed"), e)
    pick = lambda p, q, n: F.when(F.col("turned"), F.col(q)).otherwise(F.col(p)).alias(n)
    return each.select(*(pick(*n) for n in (("x_eid", "y_eid", "a_eid"), ("y_eid", "x_eid", "b_eid"), ("t", "s", "t"), ("s", "t", "s"), ("x", "x2", "x"), ("y", "y2", "y"))))


def crossed_shapes(members: DataFrame) -> DataFrame:
    """(a_eid, b_eid, t, s, x, y, x2, y2): shapes of ``alike`` that cross inside both; the point as it lies on each."""
    t, s = geo.crossing(A, B)
    pairs = segment_pairs(members.where("eid = shape"), 0.0, 100.0).select("*", F.expr(t).alias("t"), F.expr(s).alias("s"))
    inner = lambda c: (F.col(c) > 1e-9) & (F.col(c) < 1 - 1e-9)
    at = lambda e, c, a, b: F.col(f"{e}_{a}") + F.col(c) * (F.col(f"{e}_{b}") - F.col(f"{e}_{a}"))
    points = [at(e, c, a, b).alias(n) for e, c, k in (("a", "t", ""), ("b", "s", "2")) for a, b, n in (("ax", "bx", f"x{k}"), ("ay", "by_", f"y{k}"))]
    return pairs.where(inner("t") & inner("s")).select("a_eid", "b_eid", "t", "s", *points)


def split(graph: Graph, clear: float = 0.15) -> Graph:
    """All edges cut at all crossings at once; a crossing nearer than ``clear`` to an end cuts nothing."""
    c = crossings(graph.edges).withColumn("joint", F.concat(F.lit("synth:"), "a_eid", F.lit("|"), "b_eid"))
    e = graph.edges.withColumn("len", F.expr(geo.dist("ax", "ay", "bx", "by_")))
    cut = c.select(F.col("a_eid").alias("eid"), "t", "x", "y", "joint").unionByName(c.select(F.col("b_eid").alias("eid"), F.col("s").alias("t"), "x", "y", "joint"))
    cut = cut.join(e.select("eid", "len"), "eid").where((F.col("t") * F.col("len") > clear) & ((1 - F.col("t")) * F.col("len") > clear))
    cuts = cut.groupBy("joint").agg(F.count(F.lit(1)).alias("k")).where("k = 2").join(cut, "joint")
    ends = e.select("eid", F.lit(0.0).alias("t"), F.col("ax").alias("x"), F.col("ay").alias("y"), F.col("u").alias("id")).unionByName(e.select("eid", F.lit(1.0).alias("t"), F.col("bx").alias("x"), F.col("by_").alias("y"), F.col("v").alias("id")))
    stops = ends.unionByName(cuts.select("eid", "t", "x", "y", F.col("joint").alias("id")))
    w = W.partitionBy("eid").orderBy("t", "id")
    parts = stops.select("eid", F.row_number().over(w).alias("k"), F.col("id").alias("u"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("id").over(w).alias("v"), F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by_"), F.count(F.lit(1)).over(W.partitionBy("eid")).alias("n")).where("v is not null")
    more = [c for c in ("way_ids",) if c in graph.edges.columns]
    edges = parts.join(graph.edges.select("eid", "way_id", "highway", *more), "eid").select(F.when(F.col("n") > 2, F.concat_ws(":", "eid", F.lit("S"), F.col("k").cast("string"))).otherwise(F.col("eid")).alias("eid"), "way_id", "highway", "u", "v", "ax", "ay", "bx", "by_", *more)
    new = cuts.groupBy(F.col("joint").alias("id")).agg(F.first("x").alias("x"), F.first("y").alias("y")).select("id", "x", "y", F.array().cast("array<bigint>").alias("osm_ids"), F.lit(False).alias("is_end"), F.lit(False).alias("merged_snap"), F.lit(False).alias("merged_osm"))
    return Graph(graph.nodes.select(new.columns).unionByName(new), edges)


def split_parts(edges: DataFrame, clear: float = 0.15) -> DataFrame:
    """(eid, parts, length): into how many edges ``split`` cuts each one, without the cuts, which grow with the square of edges that lie on
    one another: a shape is cut once for each edge of each shape that it crosses."""
    e = written(alike(edges).withColumn("length", F.expr(geo.dist("ax", "ay", "bx", "by_"))), "alike")
    c = crossed_shapes(e).select("a_eid", "b_eid", "t", "s")
    a, b = (e.where("eid = shape").select(F.col("eid").alias(f"{p}_eid"), F.col("length").alias(f"{p}_length")) for p in "ab")
    within = lambda t, n: (F.col(t) * F.col(n) > clear) & ((1 - F.col(t)) * F.col(n) > clear)
    c = written(c.join(a, "a_eid").join(b, "b_eid").where(within("t", "a_length") & within("s", "b_length")).select("a_eid", "b_eid"), "crossed")
    both = c.select(F.col("a_eid").alias("shape"), F.col("b_eid").alias("other")).unionByName(c.select(F.col("b_eid").alias("shape"), F.col("a_eid").alias("other")))
    n = e.groupBy(F.col("shape").alias("other")).agg(F.count(F.lit(1)).alias("n"))
    cuts = both.join(n, "other").groupBy("shape").agg(F.sum("n").alias("cuts"))
    return e.join(cuts, "shape", "left").select("eid", (1 + F.coalesce("cuts", F.lit(0))).cast("long").alias("parts"), "length")


def bounds(nodes: DataFrame) -> DataFrame:
    """One row: x0, y0, x1, y1 (0, 0, 1, 1 where there are no nodes), centre and diagonal (1 at least)."""
    b = nodes.agg(*(F.coalesce(f(c), F.lit(d)).alias(n) for f, c, n, d in ((F.min, "x", "x0", 0.0), (F.min, "y", "y0", 0.0), (F.max, "x", "x1", 1.0), (F.max, "y", "y1", 1.0))))
    return b.select("*", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), F.greatest(F.lit(1.0), F.expr(geo.dist("x0", "y0", "x1", "y1"))).alias("diagonal"))


def _atan2(y: pa.Array, x: pa.Array) -> pa.Array:
    return pa.array([math.atan2(*p) for p in zip(y.to_pylist(), x.to_pylist())], pa.float64())


def turns(nodes: DataFrame) -> DataFrame:
    """The signed turn at each inner vertex of each way, in radians. The arc tangent is the C library's, as the JVM's differs from it in the
    last bit, and sums of turns on a grid meet a limit so exactly that this decides."""
    w = W.partitionBy("way_id").orderBy("pos")
    n = nodes.select("way_id", "pos", "x", "y", *(f(c).over(w).alias(p + c) for p, f in (("p", F.lag), ("n", F.lead)) for c in ("x", "y")))
    ux, uy, vx, vy = F.col("x") - F.col("px"), F.col("y") - F.col("py"), F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    short = F.expr(f"{geo.dist('px', 'py', 'x', 'y')} < 1e-9 or {geo.dist('x', 'y', 'nx', 'ny')} < 1e-9")
    turn = F.when(short, 0.0).otherwise(F.arrow_udf(_atan2, "double")(ux * vy - uy * vx, ux * vx + uy * vy))
    return n.where("px is not null and nx is not null").select("way_id", "pos", turn.alias("turn"))


def prune_keep(turned: DataFrame, degrees_: float) -> DataFrame:
    """The inner vertices kept when a way is thinned: turns add up, and where their sum reaches the limit the
    vertex stays and the sum is cut back by the limit's multiples. An ordered fold over each way's vertices."""
    limit = F.radians(F.lit(float(degrees_)))
    rows = turned.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "turn"))).alias("p"))
    zero = F.struct(F.lit(0.0).alias("acc"), F.array().cast("array<bigint>").alias("kept"))

    def step(a: Column, x: Column) -> Column:
        total = a["acc"] + x["turn"]
        hit = F.abs(total) >= limit - 1e-15
        rest = total - F.signum(total) * F.floor(F.abs(total) / limit + 1e-12) * limit
        return F.struct(F.when(hit, rest).otherwise(total).alias("acc"), F.when(hit, F.concat(a["kept"], F.array(x["pos"]))).otherwise(a["kept"]).alias("kept"))

    return rows.select("way_id", F.explode(F.aggregate("p", zero, step)["kept"]).alias("pos"))
