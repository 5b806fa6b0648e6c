"""Queries over features: written as GeoJSON, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayspark.functions import geo
from wayspark.operators import candidates as C
from wayspark.operators import features as X
from wayspark.plans.merge_queries import STEPS_SQL, _steps
from wayspark.plans.registry import query
from wayspark.plans.road_queries import _connected, _native, _r
from wayspark.sources.roads import LAT0, LON0, SQL

DEGREES = SQL + f""", d as (select id, count(*) as k, count(distinct way_id) as ways from (select u as id, way_id from cedge union all select v, way_id from cedge) group by id),
  q as (select node_id, id, is_end, members, {geo.to_lon('x', LON0, LAT0)} as lon, {geo.to_lat('y', LAT0)} as lat from canon)"""


@query(DEGREES + " select q.id, node_id, round(lon, 7) as lon, round(lat, 7) as lat, coalesce(k, 0) as degree, case when coalesce(k, 0) = 2 and not is_end and ways = 1 then 'inline' else 'junction' end as role, count(*) over (partition by round(lon, 5), round(lat, 5)) as pile, members > 1 as merged_osm, false as merged_snap, false as synthetic from q left join d on q.id = d.id")
def graph_node_features(spark, sf):
    props = "properties struct<internal_node_id:string,source_osm_node_ids:array<bigint>,synthetic:boolean,graph_degree:bigint,vertex_role:string,pile_count:bigint,highlight_osm_merge:boolean,highlight_snap_merge:boolean>"
    f = X.node_features(_connected(spark, sf)).select(F.from_json("feature", f"{X.PLACE}, {props}").alias("f")).select("f.geometry", "f.properties.*")
    at = lambda i: F.round(F.get("geometry.coordinates", F.lit(i)), 7)
    return f.select(F.col("internal_node_id").alias("id"), F.get("source_osm_node_ids", F.lit(0)).alias("node_id"), at(0).alias("lon"), at(1).alias("lat"), F.col("graph_degree").alias("degree"), F.col("vertex_role").alias("role"), F.col("pile_count").alias("pile"), F.col("highlight_osm_merge").alias("merged_osm"), F.col("highlight_snap_merge").alias("merged_snap"), "synthetic")


@query(SQL + f"select eid, way_id, cast(way_id as varchar) as way_ids, highway, u, v, round({geo.to_lon('ax', LON0, LAT0)}, 7) as lon0, round({geo.to_lat('ay', LAT0)}, 7) as lat0, round({geo.to_lon('bx', LON0, LAT0)}, 7) as lon1, round({geo.to_lat('by_', LAT0)}, 7) as lat1 from cedge")
def graph_edge_features(spark, sf):
    props = "properties struct<internal_edge_id:string,osm_way_id:bigint,merged_osm_way_ids:array<string>,highway:string,u:string,v:string>"
    f = X.edge_features(_connected(spark, sf)).select(F.from_json("feature", f"{X.LINE}, {props}").alias("f")).select("f.geometry", "f.properties.*")
    at = lambda p, i: F.round(F.get(F.get("geometry.coordinates", F.lit(p)), F.lit(i)), 7)
    return f.select(F.col("internal_edge_id").alias("eid"), F.col("osm_way_id").alias("way_id"), F.array_join("merged_osm_way_ids", ",").alias("way_ids"), "highway", "u", "v", at(0, 0).alias("lon0"), at(0, 1).alias("lat0"), at(1, 0).alias("lon1"), at(1, 1).alias("lat1"))


# Backwards, the first edge lies as it is, and the line turns at its end.
@query(SQL + """, m as (select way_id, count(*) as m from nat group by way_id having count(*) > 1), k as (select way_id, m, unnest(range(0, m + 1)) as pos from m),
  s as (select way_id, pos, case when way_id % 3 = 0 then pos when pos = 0 then m - 2 else m - pos end as at from k where case when way_id % 3 = 0 or m = 2 then pos < m else true end)
  select way_id, s.pos, round(x, 6) as x, round(y, 6) as y from s join nat using (way_id) where nat.pos = s.at""")
def route_lines(spark, sf):
    """The edges of each way as a route, of two ways in three from the last to the first."""
    e = _native(spark, sf).edges
    routes = e.select("way_id", F.when(F.col("way_id") % 3 == 0, F.col("pos")).otherwise(-F.col("pos")).alias("i"), "eid")
    return X.route_points(routes, ["way_id"], e).select("way_id", F.col("pos").cast("long").alias("pos"), *_r(6, x="x", y="y"))


@query(STEPS_SQL + """, fe as (select run_id, restart_index, step_index, score_total, tx, scale, case when len(parts) > 1 then list_filter(list_transform(range(0, len(parts)), lambda i: {'i': i, 'ids': parts[i + 1]}), lambda s: len(s.ids) > 0) else [{'i': -1, 'ids': ids}] end as fs from cnd),
  pa as (select run_id, restart_index, step_index, score_total, tx, scale, unnest(fs) as p from fe), r as (select run_id, restart_index, step_index, p.i as i, unnest(p.ids) as eid from pa),
  l as (select run_id, restart_index, step_index, i, count(*) as n, sum(sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))) as len from r join nedge using (eid) group by all)
  select pa.run_id, pa.restart_index, pa.step_index, case when p.i >= 0 then p.i::integer end as part, round(score_total, 6) as score, coalesce(l.n + 1, 0)::bigint as points, round(coalesce(len, 0), 4) as length_m, case when p.i < 0 then len(p.ids) > 0 end as reachable, case when p.i < 0 then round(scale, 6) end as scale
  from pa left join l on pa.run_id = l.run_id and pa.restart_index = l.restart_index and pa.step_index = l.step_index and p.i = l.i""")
def candidate_part_features(spark, sf):
    key = ["run_id", "restart_index", "step_index"]
    c = C.from_steps(_steps(spark, sf))
    props = "properties struct<score_total:double,length_m:double,reachable:boolean,transform:struct<tx_m:double,scale:double>>"
    f = X.candidate_features(c, key, _native(spark, sf).edges).select(*key, F.col("component_index").alias("part"), F.from_json("feature", f"{X.LINE}, {props}").alias("f"))
    return f.select(*key, "part", *_r(6, score="f.properties.score_total"), F.size("f.geometry.coordinates").cast("long").alias("points"), *_r(4, length_m="f.properties.length_m"), "f.properties.reachable", *_r(6, scale="f.properties.transform.scale"))
