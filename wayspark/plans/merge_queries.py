"""Queries over road merges, candidates with routes, and their serialisers."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayspark.functions import geo
from wayspark.operators import alike
from wayspark.operators import candidates as C
from wayspark.operators import graph as G
from wayspark.operators import surgery as X
from wayspark.plans.registry import query
from wayspark.plans.road_queries import ANG, DIST, MERGED, REACH, ROAD, _connected, _merge_components, _r
from wayspark.sources import roads
from wayspark.sources.roads import SQL

PARTS = (
    REACH.format(body=MERGED.removeprefix("with"))
    + f""", pw as (select c, way_id, round(sum({geo.dist('ax', 'ay', 'bx', 'by_')}), 6) as len from lab join cedge on n = eid group by 1, 2),
  pm as (select c, way_id as way from (select *, row_number() over (partition by c order by len desc, way_id) as k from pw) where k = 1),
  src as (select c, cedge.* from lab join cedge on n = eid join pm using (c) where way_id <> way), tgt as (select c, cedge.* from lab join cedge on n = eid join pm using (c) where way_id = way),
  ends as (select c, u as id, ax as x, ay as y from src union all select c, v, bx, by_ from src),
  span as (select a.c, max({geo.dist('a.x', 'a.y', 'b.x', 'b.y')}) as span from (select distinct * from ends) a join (select distinct * from ends) b using (c) group by 1)"""
)


@query(ROAD + " select least(wa, wb) as way_a, greatest(wa, wb) as way_b, a_eid, b_eid, row_number() over (partition by least(wa, wb), greatest(wa, wb) order by -round(score, 6), a_eid, b_eid) as rank from rd")
def road_pair_rank(spark, sf):
    """Pairs of edges of each two ways, the best score first; rank 1 is the pair of ways' best."""
    return alike.ranked(_connected(spark, sf).edges, DIST, ANG)


@query(PARTS + "select c as component, round(span, 4) as span from span")
def endpoint_span(spark, sf):
    return X.endpoint_span(X.sources_and_targets(*_merge_components(spark, sf))[0]).select("component", *_r(4, span="span"))


COST = geo.point_segment("x", "y", "ax", "ay", "bx", "by_")


@query(PARTS + f""", ct as (select c, eid, round(sum(({COST}) * ({COST})), 4) as cost, round(max({COST}), 6) as far from ends join tgt using (c) join span using (c)
  where {geo.dist('ax', 'ay', 'bx', 'by_')} + 1e-9 >= case when span > 1e-6 then greatest(30e0, 1e-2 * span) else 30e0 end group by 1, 2)
  select c as component, eid, round(cost, 1) as cost, round(far, 4) as far from (select *, row_number() over (partition by c order by cost, far, eid) as k from ct) where k = 1""")
def best_target_edge(spark, sf):
    return X.best_target(*X.sources_and_targets(*_merge_components(spark, sf)), 30.0, 0.01).select("component", "eid", *_r(1, cost="cost"), *_r(4, far="far"))


@query(REACH.format(body=MERGED.removeprefix("with")) + "select c as component, array_to_string(list_sort(list(distinct way_id)), ',') as way_ids from lab join cedge on n = eid group by c")
def merge_provenance(spark, sf):
    return X.provenance(*_merge_components(spark, sf)).select("component", F.array_join(F.col("way_ids").cast("array<string>"), ",").alias("way_ids"))


#: Steps with edges, some of them in parts, some without a transform or terms.
STEPS_SQL = SQL + """, stp as (select run_id, restart_index, step_index, score_total, case when step_index % 11 <> 4 then unreachable end as unreachable,
    case when step_index % 6 <> 1 then (step_index % 10) / 1e1 end as fallback, case when step_index % 9 <> 2 then tx end as tx, case when step_index % 9 <> 2 then scale end as scale,
    case when step_index % 5 = 0 then [] else list_transform(range(0, step_index % 3), lambda k: list_transform(range(0, (step_index + k) % 3), lambda j: 'e:' || way_id || ':' || (step_index + j))) end as parts,
    case when step_index % 7 = 0 then [] else ['e:' || way_id || ':' || step_index] end as ids from trace),
cnd as (select run_id, restart_index, step_index, score_total, coalesce(unreachable, 0e0) as unreachable, coalesce(fallback, 0e0) as fallback, coalesce(tx, 0e0) as tx, coalesce(scale, 1e0) as scale, parts,
    case when len(ids) = 0 and len(parts) > 0 then parts[1] else ids end as ids from stp)"""


def _steps(spark, sf):
    t = roads.trace(spark, sf)
    edge = lambda n: F.concat(F.lit("e:"), F.col("way_id").cast("string"), F.lit(":"), n.cast("string"))
    upto = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0), F.when(n > 0, n - 1).otherwise(0).cast("int")), f))
    step = F.col("step_index")
    parts = upto(step % 3, lambda k: F.coalesce(upto((step + k) % 3, lambda j: edge(step + j)), F.array().cast("array<string>")))
    return t.select(
        "run_id", "restart_index", "step_index", "score_total", F.when(step % 11 != 4, F.col("unreachable")).alias("unreachable"), F.when(step % 6 != 1, (step % 10) / 10.0).alias("fallback"),
        F.when(step % 9 != 2, F.col("tx")).alias("tx"), F.lit(0.0).alias("ty"), F.lit(None).cast("double").alias("theta"), F.when(step % 9 != 2, F.col("scale")).alias("scale"),
        F.when(step % 5 != 0, parts).alias("edge_ids_per_component"), F.when(step % 7 != 0, F.array(edge(step))).alias("edge_ids"),
    )


@query(STEPS_SQL + " select run_id, restart_index, step_index, round(fallback, 3) as fallback, round(tx, 3) as tx, round(scale, 6) as scale, array_to_string(ids, ',') as edge_ids, case when len(parts) > 0 then len(list_filter(parts, lambda p: len(p) > 0)) > 0 else len(ids) > 0 end as has_route from cnd")
def step_candidates(spark, sf):
    c = C.from_steps(_steps(spark, sf))
    route = C.has_route(F.col("edge_ids_per_component"), F.col("edge_ids"))
    return c.select("run_id", "restart_index", "step_index", *_r(3, fallback="fallback", tx="tx"), *_r(6, scale="scale"), F.array_join("edge_ids", ",").alias("edge_ids"), route.alias("has_route"))


@query(STEPS_SQL + """ select run_id, restart_index, step_index, round(score_total, 6) as score from (select *, min(score_total) over (partition by run_id) as best from cnd)
  where unreachable < 5e-1 and fallback <= 8e-1 and score_total <= best + 15e-3 and case when len(parts) > 0 then len(list_filter(parts, lambda p: len(p) > 0)) > 0 else len(ids) > 0 end""")
def routed_candidates(spark, sf):
    return C.routed(C.from_steps(_steps(spark, sf)), 0.015).select("run_id", "restart_index", "step_index", *_r(6, score="score_total"))


@query(SQL + """, m as (select *, coalesce(score_total < min(score_total) over (partition by run_id, restart_index order by step_index rows between unbounded preceding and 1 preceding), true) as b from trace),
  gr as (select *, sum(case when b then 1 else 0 end) over (partition by run_id, restart_index order by step_index) as grp from m), s as (select *, row_number() over (partition by run_id, restart_index, grp order by step_index) - 1 as since from gr)
  select run_id, count_if(since >= 10 and since % 10 = 0) as escape_triggers, count_if(since >= 10 and since % 10 < 4) as reheat_steps_used from s group by run_id""")
def escape_totals(spark, sf):
    e = C.escapes(roads.trace(spark, sf), 10, 4)
    return e.groupBy("run_id").agg(F.sum("triggers").alias("escape_triggers"), F.sum("reheats").alias("reheat_steps_used"))


@query(STEPS_SQL + " select run_id, restart_index, step_index, round(score_total, 6) as score, round(tx, 3) as tx, len(ids) as n_edges, case when len(parts) > 0 then len(parts) end as n_parts from cnd")
def trace_step_json(spark, sf):
    """Steps as JSON, in which empty parts are left out, read back."""
    c = C.from_steps(_steps(spark, sf))
    parts = F.when(F.size("edge_ids_per_component") > 0, F.col("edge_ids_per_component")).alias("edge_ids_per_component")
    transform = F.struct(F.col("tx").alias("tx_m"), F.col("ty").alias("ty_m"), F.col("theta").alias("theta_rad"), "scale").alias("transform")
    text = F.to_json(F.struct("step_index", "score_total", transform, "edge_ids", parts))
    f = F.from_json(text, "score_total double, transform struct<tx_m:double>, edge_ids array<string>, edge_ids_per_component array<array<string>>").alias("f")
    return c.select("run_id", "restart_index", "step_index", f).select("run_id", "restart_index", "step_index", F.round("f.score_total", 6).alias("score"), F.round("f.transform.tx_m", 3).alias("tx"), F.size("f.edge_ids").cast("long").alias("n_edges"), F.when(F.col("f.edge_ids_per_component").isNotNull(), F.size("f.edge_ids_per_component").cast("long")).alias("n_parts"))


@query(SQL + """, r as (select run_id, restart_index, min(score_total) as best, sum(accepted)::bigint as moves, count(*) as steps, count(*) * 125e-1 as len from trace group by 1, 2)
  select run_id, count(*) as restarts, round(min(best), 6) as best_score, arg_min(restart_index, best * 1e6 + restart_index) as best_restart_index, round(arg_min(len, best * 1e6 + restart_index) / 1000e0, 6) as route_length_km, 1::bigint as components, sum(moves)::bigint as moves from r group by run_id""")
def single_response(spark, sf):
    """One response for each run, with its restarts and the one component, as JSON read back."""
    t = roads.trace(spark, sf).groupBy("run_id", "restart_index").agg(F.min("score_total").alias("best_score"), F.sum("accepted").alias("accepted_moves"), F.count(F.lit(1)).alias("iterations_completed"))
    t = t.withColumn("route_length_m", F.col("iterations_completed") * 12.5)
    one = F.struct("restart_index", "best_score", "route_length_m", F.round(F.col("route_length_m") / 1000, 6).alias("route_length_km"), "iterations_completed", "accepted_moves", (F.col("accepted_moves") / F.col("iterations_completed")).alias("acceptance_rate"))
    runs = t.groupBy("run_id").agg(F.array_sort(F.collect_list(one)).alias("restarts"), F.min(F.struct("best_score", "restart_index", "route_length_m")).alias("b"))
    km = F.round(F.col("b.route_length_m") / 1000, 6).alias("route_length_km")
    part = F.struct(F.lit(0).alias("component_index"), F.col("b.best_score").alias("best_score"), F.col("b.route_length_m").alias("route_length_m"), km)
    text = F.to_json(F.struct(F.col("b.best_score").alias("best_score"), F.col("b.restart_index").alias("best_restart_index"), F.col("b.route_length_m").alias("route_length_m"), km, "restarts", F.array(part).alias("components")))
    f = F.from_json(text, "best_score double, best_restart_index bigint, route_length_km double, restarts array<struct<accepted_moves:bigint>>, components array<struct<component_index:int,best_score:double>>").alias("f")
    moves = F.aggregate("f.restarts", F.lit(0).cast("long"), lambda a, r: a + r["accepted_moves"])
    return runs.select("run_id", f).select("run_id", F.size("f.restarts").cast("long").alias("restarts"), F.round("f.best_score", 6).alias("best_score"), "f.best_restart_index", "f.route_length_km", F.size("f.components").cast("long").alias("components"), moves.alias("moves"))


@query(STEPS_SQL + """, ft as (select run_id, restart_index, step_index, 1 as n from cnd where step_index % 3 = 0), eg as (select eid from nedge where pos % 11 <> 5),
  rb as (select run_id, restart_index, step_index, unnest(case when len(parts) > 1 then flatten(parts) else ids end) as eid from cnd where step_index % 4 <> 1), rn as (select run_id, restart_index, step_index, count(*) as n from rb join eg using (eid) group by 1, 2, 3)
  select c.run_id, c.restart_index, c.step_index, case when ft.n is not null then 'features' when c.step_index % 4 <> 1 then 'rebuilt' end as source, coalesce(ft.n, case when c.step_index % 4 <> 1 then coalesce(rn.n, 0) end)::bigint as n
  from cnd c left join ft using (run_id, restart_index, step_index) left join rn using (run_id, restart_index, step_index)""")
def overlay_fallback(spark, sf):
    """A candidate's own features; without any, its edges found again; without a candidate, nothing."""
    key = ["run_id", "restart_index", "step_index"]
    c = C.from_steps(_steps(spark, sf))
    features = c.where("step_index % 3 = 0").select(*key, F.lit(1).cast("long").alias("own"))
    listed = c.where("step_index % 4 <> 1").select(*key, F.when(F.size("edge_ids_per_component") > 1, F.flatten("edge_ids_per_component")).otherwise(F.col("edge_ids")).alias("ids"))
    edges = G.native(roads.included(roads.way_points(spark, sf))).edges.where("pos % 11 <> 5").select("eid")
    rebuilt = listed.select(*key, F.explode_outer("ids").alias("eid")).join(edges.withColumn("hit", F.lit(1)), "eid", "left").groupBy(*key).agg(F.count("hit").alias("again"))
    met = c.select(*key).join(features, key, "left").join(rebuilt, key, "left")
    return met.select(*key, F.when(F.col("own").isNotNull(), "features").when(F.col("again").isNotNull(), "rebuilt").alias("source"), F.coalesce("own", "again").alias("n"))
