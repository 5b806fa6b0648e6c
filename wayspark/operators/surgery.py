"""Road merge and chain pruning as graph rewrites on DataFrames.

Merging: each component of duplicate roads becomes its primary way (the longest, then the smallest id); ends of its other
edges move to their nearest point on that way, where the first anchor within reach is taken or a new one is made, edges follow,
and the way is cut at its anchors. Components that share no node are rewritten side by side, others in their order.
Pruning: a vertex at which two edges of one way end goes if the turns since the last kept vertex stay small.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayspark.config import GraphOptions
from wayspark.functions import geo
from wayspark.operators import alike, islands
from wayspark.operators import graph as G
from wayspark.operators.chains import first_anchors, ordered_nodes, ranked, thinned
from wayspark.operators.graph import Graph
from wayspark.storage import written


def _columns(graph: Graph) -> Graph:
    """The columns of a cleaned graph; ``way_ids`` are the ways that an edge stands for, at first its own."""
    ids = F.col("way_ids") if "way_ids" in graph.edges.columns else F.array_compact(F.array("way_id")).alias("way_ids")
    return Graph(graph.nodes.select("id", "x", "y", "osm_ids", "is_end", "merged_snap", "merged_osm"), graph.edges.select("eid", "way_id", "highway", "u", "v", "ax", "ay", "bx", "by_", ids))


def _saved(graph: Graph) -> Graph:
    """Both tables written, as each is read many times below."""
    g = _columns(graph)
    return Graph(written(g.nodes, "nodes"), written(g.edges, "edges"))


def primary_ways(edges: DataFrame, member: DataFrame) -> DataFrame:
    """(component, way): of each component the way of greatest length, on ties the smallest id."""
    own = member.join(edges, member["node"] == edges["eid"]).groupBy("component", "way_id").agg(F.round(F.sum(F.expr(geo.dist("ax", "ay", "bx", "by_"))), 6).alias("len"))
    return own.groupBy("component").agg(F.max(F.struct("len", (-F.col("way_id")).alias("w"))).alias("m")).select("component", (-F.col("m.w")).alias("way"))


def _targets(held: DataFrame, o: GraphOptions) -> DataFrame:
    """(component, pos, id, x, y): the line that each component is merged on, from its primary way's edges.

    Of several edges, their nodes in order, if they are one chain; a branch or a cycle refuses the component. A single edge is taken if it's
    long enough for the span of the sources' ends."""
    mine = held.where("way_id = way")
    n = mine.groupBy("component").agg(F.count(F.lit(1)).alias("n_target"))
    mine = mine.join(n, "component")
    places = mine.select("component", F.inline(F.array(F.struct(F.col("u").alias("id"), F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("v").alias("id"), F.col("bx").alias("x"), F.col("by_").alias("y"))))).dropDuplicates(["component", "id"])
    chain = ordered_nodes(mine.where("n_target > 1").select(F.col("component").alias("group"), "eid", "u", "v")).withColumnRenamed("group", "component")
    single = mine.where("n_target = 1")
    span = endpoint_span(held.where("way_id <> way").join(single.select("component"), "component", "left_semi"))
    need = F.when(F.col("span") > 1e-6, F.greatest(F.lit(o.merge_min_overlap_m), o.merge_min_overlap_ratio * F.col("span"))).otherwise(F.lit(o.merge_min_overlap_m))
    single = single.join(span, "component").where(F.expr(geo.dist("ax", "ay", "bx", "by_")) + 1e-9 >= need)
    ends = single.select("component", F.inline(F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.col("u").alias("id")), F.struct(F.lit(1).cast("long").alias("pos"), F.col("v").alias("id")))))
    return chain.select("component", "pos", "id").unionByName(ends).join(places, ["component", "id"]).select("component", "pos", "id", "x", "y")


def _fitting(held: DataFrame, o: GraphOptions) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the components of ``held(component, way, <edge>)``: their lines with measures, the nearest places of their sources' ends on
    them, and those components that can be merged as things stand."""
    limit = o.merge_max_anchor_offset_m if o.merge_max_anchor_offset_m > 0 else max(2 * o.merge_distance_m, 50.0)
    line = written(_targets(held, o), "line")
    w = W.partitionBy("component").orderBy("pos")
    step = F.coalesce(F.expr(geo.dist("x", "y", "px", "py")), F.lit(0.0))
    line = line.withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w)}).withColumn("measure", F.sum(step).over(w.rowsBetween(W.unboundedPreceding, 0)))
    segments = line.where("px is not null").select("component", "pos", F.col("px").alias("ax"), F.col("py").alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by_"), (F.col("measure") - F.expr(geo.dist("x", "y", "px", "py"))).alias("start"))
    # the ends of the sources in the order of their edges
    end = lambda k, i, x, y: F.struct(F.struct(F.col("eid").alias("e"), F.lit(k).alias("k")).alias("o"), F.col(i).alias("id"), F.col(x).alias("qx"), F.col(y).alias("qy"))
    ends = held.where("way_id <> way").select("component", F.inline(F.array(end(0, "u", "ax", "ay"), end(1, "v", "bx", "by_"))))
    ends = ends.groupBy("component", "id").agg(F.min("o").alias("o"), F.first("qx").alias("qx"), F.first("qy").alias("qy"))
    ends = written(ends.withColumn("k", F.row_number().over(W.partitionBy("component").orderBy("o")).cast("long")).drop("o"), "ends")
    # an end must lie within the limit of the line, so only segments in reach are met
    t = F.expr(geo.along("qx", "qy", "ax", "ay", "bx", "by_"))
    cell = lambda c: F.floor(F.col(c) / limit)
    met = ends.withColumns({"cx": cell("qx"), "cy": cell("qy")}).join(G.cells(segments, limit, "ax", "ay", "bx", "by_", limit * (1 + 1e-9)), ["component", "cx", "cy"]).withColumn("t", t)
    met = met.withColumns({"px": F.expr("ax + t * (bx - ax)"), "py": F.expr("ay + t * (by_ - ay)")}).withColumn("d", F.expr(geo.dist("qx", "qy", "px", "py"))).where(F.col("d") <= limit + 1e-9)
    along = F.col("start") + F.col("t") * F.expr(geo.dist("ax", "ay", "bx", "by_"))
    near = written(met.groupBy("component", "id", "k").agg(F.min(F.struct(F.round("d", 9).alias("d"), "pos", along.alias("measure"), "px", "py")).alias("m")).select("component", "id", "k", "m.measure", "m.px", "m.py"), "near")
    lost = ends.join(near, ["component", "id"], "left_anti").select("component").distinct()
    fits = written(line.select("component").distinct().join(ends.select("component").distinct(), "component", "left_semi").join(lost, "component", "left_anti"), "fits")
    return line, near, fits


def _merged(graph: Graph, held: DataFrame, line: DataFrame, near: DataFrame, o: GraphOptions) -> Graph:
    """``graph`` with the components of ``held`` merged, no two of which share a node."""
    to = written(first_anchors(line.select(F.col("component").alias("group"), "pos", "id", "x", "y"), near.select(F.col("component").alias("group"), "k", "id", "px", "py"), o.merge_anchor_delta_m).withColumnRenamed("group", "component"), "anchors")
    made = to.where("made").join(near, ["component", "id"]).select("component", F.col("anchor").alias("id"), F.col("px").alias("x"), F.col("py").alias("y"), "measure")
    stops = line.select("component", "id", "x", "y", "measure").unionByName(made)
    w = W.partitionBy("component").orderBy("measure", "id")
    parts = stops.select("component", F.row_number().over(w).alias("i"), F.col("id").alias("u"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("id").over(w).alias("v"), F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by_")).where("v is not null and u <> v")
    about = held.groupBy("component").agg(F.first("way").alias("way_id"), F.min(F.when(F.col("way_id") == F.col("way"), F.struct("eid", "highway"))).alias("m"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("way_ids")))).alias("way_ids"))
    new = parts.join(about, "component").select(F.concat_ws(":", F.lit("roadmerge"), "component", F.col("i").cast("string")).alias("eid"), "way_id", F.col("m.highway").alias("highway"), "u", "v", "ax", "ay", "bx", "by_", "way_ids")
    rest = graph.edges.join(held.select("eid"), "eid", "left_anti")
    spots = stops.select("component", F.col("id").alias("anchor"), "x", "y")
    moved = to.join(spots, ["component", "anchor"]).select(F.col("id").alias("old"), "anchor", F.col("x").alias("nx"), F.col("y").alias("ny"))
    for side, x, y in (("u", "ax", "ay"), ("v", "bx", "by_")):
        rest = rest.join(moved, rest[side] == moved["old"], "left").withColumns({side: F.coalesce("anchor", side), x: F.coalesce("nx", x), y: F.coalesce("ny", y)}).drop("old", "anchor", "nx", "ny")
    # only edges that were moved can have lost their length
    edges = written(rest.where("u <> v").select(graph.edges.columns).unionByName(new.select(graph.edges.columns)), "merged")
    used = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    gone = to.select("id").join(used, "id", "left_anti")
    nodes = graph.nodes.unionByName(made.select("id", "x", "y", F.array().cast("array<bigint>").alias("osm_ids"), F.lit(False).alias("is_end"), F.lit(False).alias("merged_snap"), F.lit(False).alias("merged_osm")))
    return Graph(written(nodes.join(gone, "id", "left_anti"), "nodes"), edges)


def merge_roads(graph: Graph, o: GraphOptions = GraphOptions()) -> Graph:
    """Duplicate roads folded onto their primary way; ``way_ids`` of what is rewritten are those of all the component's edges.

    Components are settled in the order of their smallest edge: one waits while an earlier one that may be merged yet holds a node of it,
    and all that don't wait are rewritten at once. Refused, and left as they are, are components whose primary way is no single chain or, of one edge, too
    short, and those with an end farther from it than the offset allows (twice the merge distance, 50 m at least, unless set).
    """
    graph = _saved(graph)
    c = alike.courses(graph.edges, o.merge_distance_m, o.merge_angle_deg)
    ok = alike.ok(c, o.merge_min_overlap_m, o.merge_min_overlap_ratio, o.merge_angle_deg)
    todo = written(alike.merge_components(c, ok), "members")
    return merge_in_order(graph, todo, o)


def merge_in_order(graph: Graph, member: DataFrame, o: GraphOptions, most: int = islands.MOST) -> Graph:
    """``merge_roads`` for given components ``member(node, component)`` of edges. Components that hang together by nodes are settled in one task, unless they
    have more than ``most`` shapes; these go in rounds."""
    held = written(member.join(graph.edges, member["node"] == graph.edges["eid"]).drop("node"), "held")
    units = written(islands.units(held), "islands")
    size = units.groupBy("island").agg(F.count(F.lit(1)).alias("n"))
    large = written(size.where(F.col("n") > most).select("island"), "large")
    alone = large.isEmpty()
    small = units if alone else units.join(large, "island", "left_anti")
    out = islands.settled(small, o)
    of = lambda kind: out.where(F.col("kind") == kind)
    done, moved = of("done").select("component"), of("move").select(F.col("u").alias("old"), F.col("v").alias("new"), F.col("bx").alias("nx"), F.col("by_").alias("ny"))
    gone = held.join(done, "component", "left_semi")
    rest = graph.edges.join(gone.select("eid"), "eid", "left_anti")
    for side, x, y in (("u", "ax", "ay"), ("v", "bx", "by_")):
        rest = rest.join(moved, rest[side] == moved["old"], "left").withColumns({side: F.coalesce("new", side), x: F.coalesce("nx", x), y: F.coalesce("ny", y)}).drop("old", "new", "nx", "ny")
    about = gone.groupBy("component").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("way_ids")))).alias("way_ids"))
    new = of("edge").join(about, "component").select(F.concat_ws(":", F.lit("roadmerge"), "component", F.col("i").cast("string")).alias("eid"), "way_id", "highway", "u", "v", "ax", "ay", "bx", "by_", "way_ids")
    edges = written(rest.where("u <> v").select(graph.edges.columns).unionByName(new.select(graph.edges.columns)), "merged")
    made = of("made").select(F.col("u").alias("id"), F.col("ax").alias("x"), F.col("ay").alias("y"), F.array().cast("array<bigint>").alias("osm_ids"), *(F.lit(False).alias(c) for c in ("is_end", "merged_snap", "merged_osm")))
    nodes = graph.nodes.join(of("gone").select(F.col("u").alias("id")), "id", "left_anti").unionByName(made)
    graph = Graph(written(nodes, "nodes"), edges)
    if alone:
        return graph
    left = units.join(large, "island", "left_semi").select("component").distinct()
    return merge_in_rounds(graph, member.join(left, "component", "left_semi"), o)


def merge_in_rounds(graph: Graph, member: DataFrame, o: GraphOptions) -> Graph:
    """``merge_in_order`` over tables: all components that wait for no other are rewritten at once, round by round."""
    todo = member
    while True:
        held = written(todo.join(graph.edges, todo["node"] == graph.edges["eid"]).drop("node").join(primary_ways(graph.edges, todo), "component"), "held")
        line, near, fits = _fitting(held, o)
        at = held.select("component", F.explode(F.array("u", "v")).alias("id")).distinct()
        pairs = at.withColumnRenamed("component", "lo").join(at.withColumnRenamed("component", "hi"), "id").where("lo < hi").select("lo", "hi").distinct()
        pairs, live, n = written(pairs, "shared"), fits, -1
        # what can be merged, and what stands after such in a row of shared nodes, may change others yet
        while (now := live.count()) != n:
            n, live = now, written(live.unionByName(pairs.join(live, pairs["lo"] == live["component"]).select(F.col("hi").alias("component"))).distinct(), "live")
        waits = written(pairs.join(live, pairs["lo"] == live["component"]).select(F.col("hi").alias("component")).distinct(), "waits")
        go = written(fits.join(waits, "component", "left_anti"), "go")
        if go.isEmpty():
            return graph
        graph = _merged(graph, *(x.join(go, "component", "left_semi") for x in (held, line, near)), o)
        todo = written(todo.join(waits, "component", "left_semi"), "members")


def prune(graph: Graph, degrees: float = 10.0) -> Graph:
    """Chains thinned until nothing changes: a vertex at which two edges of one way end goes if the turns since the last kept vertex stay small,
    and each gap becomes one edge, which keeps the way ids of all it replaces. Chains are found by adjacency, whatever their edges'
    numbers; closed chains without an end stay as they are."""
    graph = _saved(graph)
    inner = G.degrees(graph).where("degree = 2 and ways = 1 and no_way = 0").select("id")
    # edges whose ends both stay are no one's business
    near = graph.edges.select("eid", F.explode(F.array("u", "v")).alias("id")).join(inner, "id", "left_semi").select("eid").distinct()
    chain = ranked(graph.edges.join(near, "eid", "left_semi"), inner).where("n > 1").join(graph.edges, "eid")
    way = lambda x, y, a, b: F.when(F.col("forward"), F.col(x)).otherwise(F.col(a)).alias(y)
    rows = chain.select("chain", F.struct("rank", "eid", "highway", "way_id", "way_ids", "a", "b", way("ax", "sx", "bx", ""), way("ay", "sy", "by_", ""), way("bx", "tx", "ax", ""), way("by_", "ty", "ay", "")).alias("e"))
    lists = rows.groupBy("chain").agg(F.array_sort(F.collect_list("e")).alias("edges"))
    point = lambda i, x, y, k: F.struct(i.alias("id"), x.alias("x"), y.alias("y"), k.cast("int").alias("k"))
    head = F.get("edges", F.lit(0))
    points = F.concat(F.array(point(head["a"], head["sx"], head["sy"], F.lit(0))), F.transform("edges", lambda e: point(e["b"], e["tx"], e["ty"], e["rank"] + 1)))
    lists = written(lists.withColumn("points", points), "chains")
    kept = thinned(lists.select("chain", "points"), math.radians(degrees))
    gaps = F.transform(F.sequence(F.lit(1), F.size("kept") - 1), lambda i: F.struct(F.get("kept", i - 1).alias("p"), F.get("kept", i).alias("q")))
    spans = kept.select("chain", F.col("points").alias("kept")).withColumn("gap", F.explode(gaps)).select("chain", "gap.p", "gap.q").join(lists.select("chain", "edges"), "chain")
    lo = F.least("p.k", "q.k")
    spans = spans.where(F.abs(F.col("p.k") - F.col("q.k")) > 1).withColumn("over", F.slice("edges", lo + 1, F.abs(F.col("p.k") - F.col("q.k"))))
    new = spans.select(
        F.concat_ws(":", F.lit("prune"), F.get("over", F.lit(0))["eid"]).alias("eid"), F.get("over", F.lit(0))["way_id"].alias("way_id"), F.get("over", F.lit(0))["highway"].alias("highway"),
        F.col("p.id").alias("u"), F.col("q.id").alias("v"), F.col("p.x").alias("ax"), F.col("p.y").alias("ay"), F.col("q.x").alias("bx"), F.col("q.y").alias("by_"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("over", lambda e: e["way_ids"])))).alias("way_ids"), F.transform("over", lambda e: e["eid"]).alias("gone"), F.transform("over", lambda e: e["b"]).alias("mid"),
    )
    new = written(new, "spans")
    edges = graph.edges.join(new.select(F.explode("gone").alias("eid")), "eid", "left_anti").unionByName(new.select(graph.edges.columns))
    # of a gap's edges all but the last end at vertices that go
    dropped = new.select(F.explode(F.slice("mid", 1, F.size("mid") - 1)).alias("id")).distinct()
    return Graph(graph.nodes.join(dropped, "id", "left_anti"), edges)


def build(points: DataFrame, o: GraphOptions = GraphOptions()) -> Graph:
    """Ways to a cleaned graph: connect, snap, merge, split, prune, each if it is on."""
    g = G.native(points)
    g = G.connect(g) if o.connect_by_osm_id else g
    g = G.snap(g, o.snap_epsilon_m) if o.snap_endpoints else g
    g = merge_roads(g, o) if o.merge_roads else g
    g = G.split(g) if o.split_crossings else g
    return prune(g, o.prune_angle_deg) if o.prune_chains else _columns(g)


def sources_and_targets(edges: DataFrame, member: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each component: the edges that would move, and those of its primary way."""
    held = member.join(edges, member["node"] == edges["eid"]).drop("node").join(primary_ways(edges, member), "component")
    return held.where("way_id <> way").drop("way"), held.where("way_id = way").drop("way")


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select("component", F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("v").alias("id"), F.col("bx").alias("x"), F.col("by_").alias("y")))).alias("p")).select("component", "p.*")


def endpoint_span(sources: DataFrame) -> DataFrame:
    """(component, span): the greatest distance between two ends of its sources. It lies between two points of which each
    is the outermost in some direction, so points well inside the component's diamond are left out of the pairs."""
    ends = _ends(sources).dropDuplicates(["component", "id"])
    w = W.partitionBy("component")
    wide = ends.select("*", *(f(F.expr(e)).over(w).alias(n) for n, f, e in (("p0", F.min, "x + y"), ("p1", F.max, "x + y"), ("m0", F.min, "x - y"), ("m1", F.max, "x - y"), ("x0", F.min, "x"), ("x1", F.max, "x"), ("y0", F.min, "y"), ("y1", F.max, "y"))))
    reach = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), (F.col("p1") - F.col("p0")) / F.sqrt(F.lit(2.0)), (F.col("m1") - F.col("m0")) / F.sqrt(F.lit(2.0)))
    # the span is at least ``reach``; a point from which no corner of the box is as far can't be an end of it
    far = F.sqrt(F.pow(F.greatest(F.col("x") - F.col("x0"), F.col("x1") - F.col("x")), 2) + F.pow(F.greatest(F.col("y") - F.col("y0"), F.col("y1") - F.col("y")), 2))
    outer = wide.where(far >= reach - 1e-6).select("component", "x", "y")
    other = outer.select("component", F.col("x").alias("ox"), F.col("y").alias("oy"))
    return outer.join(other, "component").groupBy("component").agg(F.max(F.expr(geo.dist("x", "y", "ox", "oy"))).alias("span"))


def best_target(sources: DataFrame, targets: DataFrame, least: float, ratio: float) -> DataFrame:
    """(component, eid, cost, far): of the primary way's edges that are long enough for the sources' span, the one
    nearest to all their ends by the sum of squares, then by the greatest distance, then by id."""
    need = F.when(F.col("span") > 1e-6, F.greatest(F.lit(least), ratio * F.col("span"))).otherwise(F.lit(least))
    long = targets.join(endpoint_span(sources), "component").where(F.expr(geo.dist("ax", "ay", "bx", "by_")) + 1e-9 >= need)
    d = F.expr(geo.point_segment("x", "y", "ax", "ay", "bx", "by_"))
    # ends of many edges in one place are measured once
    ends = _ends(sources).groupBy("component", "id", "x", "y").agg(F.count(F.lit(1)).alias("n_ends"))
    cost = ends.join(long, "component").groupBy("component", "eid").agg(F.round(F.sum(d * d * F.col("n_ends")), 4).alias("cost"), F.round(F.max(d), 6).alias("far"))
    return cost.groupBy("component").agg(F.min(F.struct("cost", "far", "eid")).alias("m")).select("component", "m.eid", "m.cost", "m.far")


def provenance(edges: DataFrame, member: DataFrame) -> DataFrame:
    """(component, way_ids): the ways whose edges it holds, each once, in order."""
    return member.join(edges, member["node"] == edges["eid"]).groupBy("component").agg(F.array_sort(F.collect_set("way_id")).alias("way_ids"))
