"""Queries over serialisation, display and the smaller geometric rules."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayspark.config import INCLUDED_HIGHWAYS
from wayspark.functions import geo
from wayspark.operators import graph as G
from wayspark.plans.registry import query
from wayspark.plans.road_queries import _connected, _native, _r
from wayspark.plans.sketch_queries import _sketches
from wayspark.sources import roads
from wayspark.sources.roads import LAT0, LON0, SQL


@query(SQL + f"select c.id, round({geo.to_lon('c.x', LON0, LAT0)}, 7) as lon, round({geo.to_lat('c.y', LAT0)}, 7) as lat, count(e.id) as degree, c.members > 1 as merged from canon c left join (select u as id from cedge union all select v from cedge) e on c.id = e.id group by c.id, c.x, c.y, c.members")
def graph_geojson(spark, sf):
    """Nodes as GeoJSON points, written and read back."""
    n = G.degrees(_connected(spark, sf)).select("id", *_r(7, lon=geo.to_lon("x", LON0, LAT0), lat=geo.to_lat("y", LAT0)), "degree", "merged_osm")
    text = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct("id", "degree", F.col("merged_osm").alias("merged")).alias("properties")))
    back = n.select(F.from_json(text, "geometry struct<coordinates:array<double>>, properties struct<id:string,degree:bigint,merged:boolean>").alias("f"))
    return back.select("f.properties.id", F.get("f.geometry.coordinates", 0).alias("lon"), F.get("f.geometry.coordinates", 1).alias("lat"), "f.properties.degree", "f.properties.merged")


@query(SQL + "select run_id, restart_index, count(*) as points, round(min(lon), 9) as west, round(max(lat), 9) as north from (select cast(floor(way_id / 5) as bigint) as run_id, way_id % 5 as restart_index, lon, lat from inc) group by 1, 2")
def candidate_geojson(spark, sf):
    """A line feature for each candidate, from points in order; read back for its box."""
    p = roads.included(roads.way_points(spark, sf))
    lines = roads.to_geojson(p).select(F.expr("cast(floor(way_id / 5) as bigint)").alias("run_id"), F.expr("way_id % 5").alias("restart_index"), F.from_json("feature", "geometry struct<coordinates:array<array<double>>>").alias("f"))
    c = F.col("f.geometry.coordinates")
    return lines.select("run_id", "restart_index", F.size(c).cast("bigint").alias("points"), F.round(F.array_min(F.transform(c, lambda x: x[0])), 9).alias("west"), F.round(F.array_max(F.transform(c, lambda x: x[1])), 9).alias("north"))


@query(SQL + "select way_id, pos, sum(case when starts then 1 else 0 end) over (partition by way_id order by pos) as visit, again from (select way_id, pos, node_id, pos = 0 or lag(node_id) over w = lead(node_id) over w as starts, count(*) over (partition by way_id, node_id order by pos) as again from nat window w as (partition by way_id order by pos))")
def visit_order(spark, sf):
    w = W.partitionBy("way_id").orderBy("pos")
    n = _native(spark, sf).nodes.withColumn("node", F.get("osm_ids", 0))
    n = n.select("way_id", "pos", ((F.col("pos") == 0) | F.coalesce(F.lag("node").over(w) == F.lead("node").over(w), F.lit(False))).alias("starts"), F.count(F.lit(1)).over(W.partitionBy("way_id", "node").orderBy("pos")).alias("again"))
    return n.select("way_id", "pos", F.sum(F.col("starts").cast("long")).over(w).alias("visit"), "again")


PROGRESS = "case when t <= 5 then 15e-2 * t / 5e0 when t <= 8 then 15e-2 + 1e-1 * (t - 5e0) / 3e0 else least(97e-2, 25e-2 + 72e-2 * (1e0 - exp(-25e-1 * (t - 8e0) / 20e0))) end"


@query(f"select event_id, round({PROGRESS}, 9) as progress from (select event_id, (event_id % 400) / 1e1 as t from events)")
def progress_curve(spark, sf):
    return roads.table(spark, sf, "events").selectExpr("event_id", "(event_id % 400) / 1e1 as t").select("event_id", *_r(9, progress=PROGRESS))


@query(SQL + ", d as (select id, count(*) as k from (select u as id from cedge union all select v from cedge) group by id) select id, k from d where k % 2 = 1")
def odd_vertices(spark, sf):
    return G.degrees(_connected(spark, sf)).where("degree % 2 = 1").select("id", F.col("degree").alias("k"))


@query(SQL + "select cast(floor(x / 5e-2) as bigint) as cx, cast(floor(y / 5e-2) as bigint) as cy, count(*) as points, min(stroke_id * 32 + i) as keeper from st group by 1, 2")
def merge_points(spark, sf):
    s = roads.strokes(spark, sf)
    return s.groupBy(F.floor(F.col("x") / 0.05).alias("cx"), F.floor(F.col("y") / 0.05).alias("cy")).agg(F.count(F.lit(1)).alias("points"), F.min(F.expr("stroke_id * 32 + i")).alias("keeper"))


@query(SQL + f"select way_id, pos, node_id % 3 as ref, round({geo.wrap_abs('pos * 7e-1', 'way_id * 3e-1')}, 9) as wrapped, round({geo.rotation_penalty('pos * 7e-1')}, 9) as rotation, greatest(15e-2, least(8e0, pos / 5e0)) as scale, greatest(-500e0, least(500e0, x)) = x as inside from nat")
def scalar_geometry(spark, sf):
    n = _native(spark, sf).nodes
    return n.select("way_id", "pos", (F.get("osm_ids", 0) % 3).alias("ref"), *_r(9, wrapped=geo.wrap_abs("pos * 7e-1", "way_id * 3e-1"), rotation=geo.rotation_penalty("pos * 7e-1")), F.expr("greatest(15e-2, least(8e0, pos / 5e0))").alias("scale"), F.expr("greatest(-500e0, least(500e0, x)) = x").alias("inside"))


@query(SQL + ", p as (select way_id, x as px, y as py from nat where is_end), e as (select a.way_id as w, a.px, a.py, b.way_id as v, b.ax, b.ay, b.bx, b.by_ from p a join cedge b on b.way_id = a.way_id + 8), d as (select w, v, px, py, min(" + geo.point_segment("px", "py", "ax", "ay", "bx", "by_") + ") as d from e group by 1, 2, 3, 4) select w, v, round(max(d), 4) as far, round(sum(d * d), 1) as cost, max(d) <= 50e0 + 1e-9 as fits from d group by 1, 2")
def merge_anchor_preflight(spark, sf):
    """How far the ends of a way lie from the way eight ids on: the largest distance and the sum of squares."""
    p = _native(spark, sf).nodes.where("is_end").select(F.col("way_id").alias("w"), F.col("x").alias("px"), F.col("y").alias("py"), (F.col("way_id") + 8).alias("v"))
    e = _connected(spark, sf).edges.select(F.col("way_id").alias("v"), "ax", "ay", "bx", "by_")
    d = p.join(e, "v").groupBy("w", "v", "px", "py").agg(F.min(F.expr(geo.point_segment("px", "py", "ax", "ay", "bx", "by_"))).alias("d"))
    return d.groupBy("w", "v").agg(F.round(F.max("d"), 4).alias("far"), F.round(F.sum(F.col("d") * F.col("d")), 1).alias("cost"), (F.max("d") <= 50.0 + 1e-9).alias("fits"))


@query(SQL + "select way_id, min(node_id) filter (pos = 0) as first_node, case when count(*) >= 2 then arg_max(node_id, pos) end as last_node, count(*) as refs, count(*) filter (node_id % 5 <> 0) as known_refs from inc group by way_id")
def way_properties(spark, sf):
    p = roads.included(roads.way_points(spark, sf))
    own = p.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id"))).alias("p"))
    ids = F.transform("p", lambda x: x["node_id"])
    return own.select("way_id", F.element_at(ids, 1).alias("first_node"), F.when(F.size(ids) >= 2, F.element_at(ids, -1)).alias("last_node"), F.size(ids).cast("bigint").alias("refs"), F.size(F.filter(ids, lambda i: i % 5 != 0)).cast("bigint").alias("known_refs"))


@query(SQL + ", x as (select run_id, restart_index, count(*) as steps, sum(accepted)::bigint as accepted, round(min(score_total), 6) as best, arg_min(step_index, score_total * 1e6 + step_index / 1e6) as best_step from trace group by 1, 2) select run_id, count(*) as restarts, sum(steps)::bigint as steps, sum(accepted)::bigint as accepted, min(best) as best, arg_min(restart_index, best * 1e6 + restart_index / 1e3) as best_restart from x group by run_id")
def restart_summary(spark, sf):
    t = roads.trace(spark, sf).groupBy("run_id", "restart_index").agg(F.count(F.lit(1)).alias("steps"), F.sum("accepted").alias("accepted"), F.round(F.min("score_total"), 6).alias("best"))
    best = F.min(F.struct("best", "restart_index"))
    return t.groupBy("run_id").agg(F.count(F.lit(1)).alias("restarts"), F.sum("steps").alias("steps"), F.sum("accepted").alias("accepted"), best.alias("m")).select("run_id", "restarts", "steps", "accepted", F.col("m.best").alias("best"), F.col("m.restart_index").alias("best_restart"))


@query(SQL + ", s as (select cast(floor(stroke_id / 3) as bigint) as sketch_id, stroke_id, sum(d) as arc from (select stroke_id, sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2)) as d from st window w as (partition by stroke_id order by i)) group by 1, 2) select sketch_id, stroke_id, round(arc, 5) as arc, round(arc / sum(arc) over (partition by sketch_id), 6) as weight, round(sum(arc) over (partition by sketch_id) / 1000e0, 6) as total_km from s")
def component_totals(spark, sf):
    w = W.partitionBy("stroke_id").orderBy("i")
    s = _sketches(spark, sf).select("sketch_id", "stroke_id", F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2)).alias("d"))
    a = s.groupBy("sketch_id", "stroke_id").agg(F.sum("d").alias("arc"))
    whole = F.sum("arc").over(W.partitionBy("sketch_id"))
    return a.select("sketch_id", "stroke_id", F.round("arc", 5).alias("arc"), F.round(F.col("arc") / whole, 6).alias("weight"), F.round(whole / 1000, 6).alias("total_km"))


BOX = SQL + "select way_id, round(min(lon), 9) as west, round(min(lat), 9) as south, round(max(lon), 9) as east, round(max(lat), 9) as north, round((min(lon) + max(lon)) / 2, 9) as mid_lon, round((min(lat) + max(lat)) / 2, 9) as mid_lat from inc group by way_id"


@query(BOX)
def collection_bounds(spark, sf):
    p = roads.included(roads.way_points(spark, sf)).groupBy("way_id").agg(F.min("lon").alias("w"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.max("lat").alias("n"))
    return p.select("way_id", *_r(9, west="w", south="s", east="e", north="n", mid_lon="(w + e) / 2", mid_lat="(s + n) / 2"))


BOXES = SQL + ", b as (select way_id, min(lon) as w, min(lat) as s, max(lon) as e, max(lat) as n from inc group by way_id) "


@query(BOXES + """select way_id, '[out:json][timeout:25];' || chr(10) || '(' || chr(10) || '  way["highway"~"^(""" + "|".join(INCLUDED_HIGHWAYS) + """)$"](' || printf('%.5f,%.5f,%.5f,%.5f', s, w, n, e) || ');' || chr(10) || ');' || chr(10) || 'out body;' || chr(10) || '>;' || chr(10) || 'out skel qt;' || chr(10) as request from b""")
def overpass_ql_text(spark, sf):
    """The request that would fetch each way's box."""
    b = roads.included(roads.way_points(spark, sf)).groupBy("way_id").agg(F.min("lat").alias("s"), F.min("lon").alias("w"), F.max("lat").alias("n"), F.max("lon").alias("e"))
    return b.select("way_id", roads.overpass_query(F.col("s"), F.col("w"), F.col("n"), F.col("e"), INCLUDED_HIGHWAYS).alias("request"))


@query(SQL + "select way_id, min(highway) as highway, count(*) filter (pos % 7 <> 3) as points, count(*) filter (pos % 7 <> 3 and pos % 5 <> 2) as ids, round(sum(lon) filter (pos % 7 <> 3), 5) as lon from inc group by way_id having count(*) filter (pos % 7 <> 3) >= 2")
def inline_geometry_ways(spark, sf):
    """Ways as elements that hold their points, some without a place or a reference."""
    p = roads.included(roads.way_points(spark, sf))
    point = F.struct("pos", F.when(F.col("pos") % 7 != 3, F.col("lat")).alias("lat"), "lon", F.when(F.col("pos") % 5 != 2, F.col("node_id")).alias("ref"))
    e = p.groupBy("way_id").agg(F.min("highway").alias("h"), F.array_sort(F.collect_list(point)).alias("geometry"))
    e = e.select(F.lit("way").alias("type"), F.col("way_id").alias("id"), F.create_map(F.lit("highway"), F.col("h")).alias("tags"), "geometry")
    lon = F.aggregate("coordinates", F.lit(0.0), lambda a, c: a + c[0])
    return roads.inline_ways(e).select("way_id", "highway", F.size("coordinates").cast("long").alias("points"), F.size("node_ids").cast("long").alias("ids"), F.round(lon, 5).alias("lon"))
