"""Queries over search traces, transforms and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayspark.config import PRESETS
from wayspark.functions import geo
from wayspark.operators import candidates as C
from wayspark.operators import graph as G
from wayspark.operators import polylines as P
from wayspark.plans.registry import query
from wayspark.plans.road_queries import _connected, _native, _r
from wayspark.sources import roads
from wayspark.sources.roads import SQL

SPAN = 500.0
TDIST = geo.transform_distance(("a.tx", "a.ty", "a.theta", "a.scale"), ("b.tx", "b.ty", "b.theta", "b.scale"), f"{SPAN}e0", f"{SPAN}e0")
POOL = SQL + ", pool as (select *, min(score_total) over (partition by run_id) as pool_best from trace), via as (select * from pool where unreachable < 5e-1 and score_total <= pool_best + 15e-3)"
GREEDY = "with recursive" + POOL.removeprefix("with") + f""", o as (select *, row_number() over (partition by run_id order by score_total, restart_index, step_index) as k from via),
  gs(run_id, k, chosen) as (select run_id, k, [struct_pack(tx := tx, ty := ty, theta := theta, scale := scale, s := score_total, r := restart_index, t := step_index)] from o where k = 1
    union all select o.run_id, o.k, case when len(gs.chosen) < 5 and list_min(list_transform(gs.chosen, lambda b: {TDIST.replace('a.', 'o.')})) >= 12e-2
      then list_append(gs.chosen, struct_pack(tx := o.tx, ty := o.ty, theta := o.theta, scale := o.scale, s := o.score_total, r := o.restart_index, t := o.step_index)) else gs.chosen end
    from gs join o on o.run_id = gs.run_id and o.k = gs.k + 1),
  fin as (select run_id, chosen from gs qualify row_number() over (partition by run_id order by k desc) = 1),
  rk as (select run_id, unnest(range(1, len(chosen) + 1)) as rank, chosen from fin),
  sel as (select run_id, cast(rank as int) as rank, chosen[rank].s as score, chosen[rank].r as restart_index, chosen[rank].t as step_index from rk)"""


def _trace(spark, sf):
    return roads.trace(spark, sf)


@query(SQL + "select run_id, restart_index, count(*) as steps, sum(accepted)::bigint as accepted, round(sum(accepted) / count(*), 6) as rate from trace group by 1, 2")
def acceptance_stats(spark, sf):
    return _trace(spark, sf).groupBy("run_id", "restart_index").agg(F.count(F.lit(1)).alias("steps"), F.sum("accepted").alias("accepted"), F.round(F.avg("accepted"), 6).alias("rate"))


@query(SQL + "select run_id, restart_index, step_index, round(score_total, 6) as score from trace qualify row_number() over (partition by run_id, restart_index order by score_total, step_index) = 1")
def best_trace(spark, sf):
    best = _trace(spark, sf).groupBy("run_id", "restart_index").agg(F.min(F.struct("score_total", "step_index")).alias("m"))
    return best.select("run_id", "restart_index", "m.step_index", F.round("m.score_total", 6).alias("score"))


@query(SQL + "select run_id, restart_index, round(score, 6) as score from (select run_id, restart_index, min(score_total) as score from trace group by 1, 2) qualify row_number() over (partition by run_id order by score, restart_index) = 1")
def best_restart(spark, sf):
    per = _trace(spark, sf).groupBy("run_id", "restart_index").agg(F.min("score_total").alias("score"))
    return per.groupBy("run_id").agg(F.min(F.struct("score", "restart_index")).alias("m")).select("run_id", "m.restart_index", F.round("m.score", 6).alias("score"))


@query(SQL + ", s as (select way_id, step_index, 5e-2 * power(1e-3 / 5e-2, step_index / 249e0) as t, step_index from trace) select way_id, step_index, round(t, 9) as temperature, round(greatest(3e-2, least(1e0, t / 5e-2)), 9) as step_scale, round(case when step_index % 40 < 12 then greatest(t, 35e-2 * 5e-2) else t end, 9) as accept_at from s")
def temperature_schedule(spark, sf):
    t = _trace(spark, sf).select("way_id", "step_index", F.expr("5e-2 * power(1e-3 / 5e-2, step_index / 249e0)").alias("t"))
    return t.select("way_id", "step_index", *_r(9, temperature="t", step_scale="greatest(3e-2, least(1e0, t / 5e-2))", accept_at="if(step_index % 40 < 12, greatest(t, 35e-2 * 5e-2), t)"))


ESC = "sum(case when b then 1 else 0 end) over (partition by run_id, restart_index order by step_index)"


@query(SQL + ", m as (select *, coalesce(score_total < min(score_total) over (partition by run_id, restart_index order by step_index rows between unbounded preceding and 1 preceding), true) as b from trace), gr as (select *, " + ESC + " as grp from m), s as (select *, row_number() over (partition by run_id, restart_index, grp order by step_index) - 1 as since from gr) select run_id, restart_index, step_index, cast(since as bigint) as since_best, since >= greatest(40, greatest(30, cast(floor(400 / 5) as bigint))) as stagnant from s")
def stagnation(spark, sf):
    from pyspark.sql import Window as W

    w = W.partitionBy("run_id", "restart_index").orderBy("step_index")
    before = F.min("score_total").over(w.rowsBetween(W.unboundedPreceding, -1))
    m = _trace(spark, sf).withColumn("b", F.coalesce(F.col("score_total") < before, F.lit(True)))
    g = m.withColumn("grp", F.sum(F.col("b").cast("int")).over(w))
    since = F.row_number().over(W.partitionBy("run_id", "restart_index", "grp").orderBy("step_index")) - 1
    return g.select("run_id", "restart_index", "step_index", since.cast("bigint").alias("since_best")).withColumn("stagnant", F.col("since_best") >= 80)


@query(SQL + "select run_id, restart_index, step_index, round(score_total, 6) as score from trace where restart_index <> 4 union all select run_id, restart_index, -1, round(min(score_total), 6) from trace where restart_index = 4 group by 1, 2")
def candidate_pool(spark, sf):
    t = _trace(spark, sf)
    traced = t.where("restart_index <> 4").select("run_id", "restart_index", "step_index", "score_total")
    whole = t.groupBy("run_id", "restart_index").agg(F.lit(-1).cast("bigint").alias("step_index"), F.min("score_total").alias("score_total"))
    rest = whole.join(traced.select("run_id", "restart_index").distinct(), ["run_id", "restart_index"], "left_anti")
    return traced.unionByName(rest).select("run_id", "restart_index", "step_index", *_r(6, score="score_total"))


@query(POOL + "select run_id, restart_index, step_index, round(score_total, 6) as score from via")
def viable_candidates(spark, sf):
    return C.viable(_trace(spark, sf), 0.015).select("run_id", "restart_index", "step_index", *_r(6, score="score_total"))


@query(GREEDY + "select run_id, rank, restart_index, step_index, round(score, 6) as score from sel")
def diverse_candidates(spark, sf):
    return C.diverse(C.viable(_trace(spark, sf), 0.015), 5, 0.12, SPAN, SPAN).select("run_id", "rank", "restart_index", "step_index", *_r(6, score="score_total"))


@query(GREEDY + """, ln as (select floor(way_id / 5)::bigint as run_id, way_id % 5 as restart_index, sum(sqrt((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay))) as route_length_m from nedge group by 1, 2),
  j as (select sel.*, coalesce(route_length_m, 0e0) as len from sel left join ln on sel.run_id = ln.run_id and sel.restart_index = ln.restart_index),
  x as (select *, min(len) over (partition by run_id) as lo, max(len) over (partition by run_id) as hi, count(*) over (partition by run_id) as n, first_value(score) over (partition by run_id order by rank) as best from j)
  select run_id, rank, 'r' || restart_index || '_s' || step_index as candidate_id, round(score - best, 6) as delta, case when rank = 1 then 'best' else 'included' end as tier,
    case when n >= 2 and lo >= 1e-9 and hi / greatest(lo, 1e-9) >= 115e-2 then case when abs(len - lo) <= 1e-6 * greatest(len, lo) then 'compact' when abs(len - hi) <= 1e-6 * greatest(len, hi) then 'large' end end as label, round(len / 1000e0, 6) as route_length_km from x""")
def ranked_candidates(spark, sf):
    e = _native(spark, sf).edges
    lengths = e.groupBy(F.expr("cast(floor(way_id / 5) as bigint)").alias("run_id"), F.expr("way_id % 5").alias("restart_index")).agg(F.sum(F.expr(geo.dist("ax", "ay", "bx", "by_"))).alias("route_length_m"))
    r = C.ranked(C.diverse(C.viable(_trace(spark, sf), 0.015), 5, 0.12, SPAN, SPAN), lengths)
    return r.select("run_id", "rank", "candidate_id", *_r(6, delta="delta"), "tier", "label", *_r(6, route_length_km="route_length_m / 1000e0"))


@query(SQL + f", n as (select *, row_number() over (partition by run_id order by restart_index, step_index) as k from trace) select a.run_id, a.k, round({TDIST}, 9) as d from n a join n b on a.run_id = b.run_id and b.k = a.k + 1")
def transform_distance(spark, sf):
    from pyspark.sql import Window as W

    w = W.partitionBy("run_id").orderBy("restart_index", "step_index")
    t = F.struct("tx", "ty", "theta", "scale")
    n = _trace(spark, sf).select("run_id", F.row_number().over(w).alias("k"), t.alias("a"), F.lead(t).over(w).alias("b")).where("b is not null")
    return n.select("run_id", "k", F.round(C.distance(F.col("a"), F.col("b"), SPAN, SPAN), 9).alias("d"))


@query()
def maximin_seeds(spark, sf):
    return C.maximin(C.viable(_trace(spark, sf), 0.05), 4, SPAN, SPAN).select("run_id", "rank", "restart_index", "step_index", *_r(6, score="score_total"))


@query(f"with {C.AXES_SQL} select n, round(theta, 9) as theta, round(tx, 6) as tx, round(ty, 6) as ty, round(scale, 9) as scale from ({C.grid('500e0', '400e0')})")
def grid_transforms(spark, sf):
    axis = lambda n, k: spark.range(k).select(F.col("id").cast("int").alias(n))
    axes = axis("a", 3).join(axis("i", 4)).join(axis("j", 4)).join(axis("s", 3))
    g = axes.selectExpr(C.grid("500e0", "400e0").removeprefix("select ").removesuffix(" from axes").split(" as n, ")[0] + " as n", "(a - 1) * radians(45e0) as theta", "500e0 * 5e-1 * (-1e0 + 2e0 * i / 3e0) as tx", "400e0 * 5e-1 * (-1e0 + 2e0 * j / 3e0) as ty", "exp(ln(15e-2) + (ln(8e0) - ln(15e-2)) * s / 2e0) as scale")
    return g.select("n", *_r(9, theta="theta", scale="scale"), *_r(6, tx="tx", ty="ty"))


@query(SQL + ", o as (select *, row_number() over (partition by run_id order by score_total, restart_index, step_index) as k, min(score_total) over (partition by run_id) as best, count(*) over (partition by run_id) as n from trace), q as (select *, sum(case when score_total <= best + 5e-1 then 1 else 0 end) over (partition by run_id) as good from o) select run_id, restart_index, step_index, round(score_total, 6) as score from q where case when good >= 3 then score_total <= best + 5e-1 when n > 1 then k <= greatest(3, cast(floor(n / 2) as bigint)) else true end")
def grid_quality_filter(spark, sf):
    return C.good(_trace(spark, sf), 3).select("run_id", "restart_index", "step_index", *_r(6, score="score_total"))


@query("select 'fast' as preset, 5 as seconds, 2 as restarts, 300 as iterations union all select 'normal', 10, 3, 400 union all select 'thorough', 20, 5, 550")
def speed_presets(spark, sf):
    return spark.createDataFrame([(k, *v) for k, v in PRESETS.items()], "preset string, seconds int, restarts int, iterations int")


TERMS = f"{geo.rotation_penalty('theta')}"
SCORE = "38e-2 * rot + 2e-2 * abs(ln(greatest(scale, 1e-9))) + case when unreachable >= 5e-1 then 1e4 + 1e6 + 3e-1 else score_total end + 2e0 * out_of_graph"


@query(SQL + f", s as (select *, {TERMS} as rot, sqrt(greatest(0e0, abs(tx) - 150e0) * greatest(0e0, abs(tx) - 150e0) + greatest(0e0, abs(ty) - 150e0) * greatest(0e0, abs(ty) - 150e0)) / 500e0 as out_of_graph from trace) select run_id, restart_index, step_index, round(rot, 6) as rotation, round(abs(ln(greatest(scale, 1e-9))), 6) as size, round(out_of_graph, 6) as outside, round({SCORE}, 4) as total from s")
def score_terms(spark, sf):
    s = _trace(spark, sf).select("*", F.expr(TERMS).alias("rot"), F.expr("sqrt(pow(greatest(0e0, abs(tx) - 150e0), 2) + pow(greatest(0e0, abs(ty) - 150e0), 2)) / 500e0").alias("out_of_graph"))
    return s.select("run_id", "restart_index", "step_index", *_r(6, rotation="rot", size="abs(ln(greatest(scale, 1e-9)))", outside="out_of_graph"), *_r(4, total=SCORE))


OUT = SQL + ", b as (select way_id, x, y from nat), bb as (select min(x) + 200e0 as x0, max(x) - 200e0 as x1, min(y) + 200e0 as y0, max(y) - 200e0 as y1 from nat) "


@query(OUT + "select way_id, round(avg(sqrt(power(greatest(0e0, x0 - x, x - x1), 2) + power(greatest(0e0, y0 - y, y - y1), 2))) / greatest(1e0, sqrt(power(any_value(x1 - x0), 2) + power(any_value(y1 - y0), 2))), 6) as outside from b, bb group by way_id")
def out_of_graph(spark, sf):
    n = _native(spark, sf).nodes
    box = n.agg((F.min("x") + 200.0).alias("x0"), (F.max("x") - 200.0).alias("x1"), (F.min("y") + 200.0).alias("y0"), (F.max("y") - 200.0).alias("y1"))
    d = F.expr("sqrt(pow(greatest(0e0, x0 - x, x - x1), 2) + pow(greatest(0e0, y0 - y, y - y1), 2))")
    diagonal = F.expr("greatest(1e0, sqrt(pow(any_value(x1 - x0), 2) + pow(any_value(y1 - y0), 2)))")
    return n.join(F.broadcast(box)).groupBy("way_id").agg(F.round(F.avg(d) / diagonal, 6).alias("outside"))


def _samples(src: str, name: str) -> str:
    return f"""{name}g as (select line, pos, x as ax, y as ay, lead(x) over (partition by line order by pos) as bx, lead(y) over (partition by line order by pos) as by_ from {src}),
  {name}s as (select *, sqrt((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)) as len from {name}g where bx is not null),
  {name}a as (select *, sum(len) over (partition by line order by pos) - len as acc, sum(len) over (partition by line) as total, row_number() over (partition by line order by pos desc) as back from {name}s),
  {name}t as (select line, max(total) as total, unnest(range(0, 16)) as i from {name}a group by line),
  {name}r as (select t.line, t.i, ax + (bx - ax) * least(1e0, greatest(0e0, (t.total * t.i / 15e0 - acc) / len)) as x, ay + (by_ - ay) * least(1e0, greatest(0e0, (t.total * t.i / 15e0 - acc) / len)) as y
    from {name}t t join {name}a a on t.line = a.line and len > 0 and ((t.total * t.i / 15e0 >= acc and t.total * t.i / 15e0 < acc + len) or (back = 1 and t.i = 15)) qualify row_number() over (partition by t.line, t.i order by pos desc) = 1)"""


MSQ = "(select line, avg(d * d) as m from (select q.line, q.i, min({d}) as d from {q} q join {s} s on q.line = s.line group by 1, 2) group by line)"
SEG = geo.point_segment("q.x", "q.y", "s.ax", "s.ay", "s.bx", "s.by_")


@query(
    SQL + f""", ta as (select way_id as line, pos, x, y from nat), rb as (select line, pos, x + 5e0 + pos % 3 as x, y - 3e0 as y from ta),
  {_samples('ta', 'm')}, {_samples('rb', 'n')}, o as (select mr.line, avg((mr.x-nr.x)*(mr.x-nr.x)+(mr.y-nr.y)*(mr.y-nr.y)) as o from mr join nr on mr.line = nr.line and mr.i = nr.i group by 1)
  select o.line as way_id, round(sqrt(o) / 1000e0 + 35e-2 * sqrt((m1.m + m2.m) / 2e0) / 1000e0, 7) as loss
  from o join {MSQ.format(d=SEG, q='mr', s='ns')} m1 on o.line = m1.line join {MSQ.format(d=SEG, q='nr', s='ms')} m2 on o.line = m2.line"""
)
def shape_loss(spark, sf):
    t = _native(spark, sf).nodes.select(F.col("way_id").alias("line"), "pos", "x", "y")
    route = t.select("line", "pos", F.expr("x + 5e0 + pos % 3").alias("x"), F.expr("y - 3e0").alias("y"))
    return P.shape_loss(t, route, 1000.0).select(F.col("line").alias("way_id"), *_r(7, loss="loss"))


PTS = "cast(floor(case when s <= 0 then 100e0 when s <= 3e-2 then 100e0 - 5e0 * s / 3e-2 when s <= 4e-2 then 95e0 - 10e0 * (s - 3e-2) / 1e-2 when s <= 5e-2 then 85e0 - 15e0 * (s - 4e-2) / 1e-2 when s < 10e-2 then 70e0 - 70e0 * (s - 5e-2) / 5e-2 else 0e0 end + 5e-1) as int)"


@query(SQL + f", p as (select run_id, restart_index, step_index, {PTS} as points from (select *, score_total as s from trace)) select *, case when points >= 90 then 'a' when points >= 80 then 'b' when points >= 65 then 'c' else 'd' end as bucket from p")
def display_points(spark, sf):
    p = _trace(spark, sf).withColumn("s", F.col("score_total")).select("run_id", "restart_index", "step_index", F.expr(PTS).alias("points"))
    pt = F.col("points")
    return p.withColumn("bucket", F.when(pt >= 90, "a").when(pt >= 80, "b").when(pt >= 65, "c").otherwise("d"))


@query(SQL + ", c as (select way_id, lon, lat from inc where pos = 0), i as (select unnest(range(0, 65)) as i) select way_id, cast(i as int) as i, round(lon + degrees(2000e0 * cos(2e0 * pi() * i / 64e0) / (6371000e0 * cos(radians(lat)))), 9) as lon, round(lat + degrees(2000e0 * sin(2e0 * pi() * i / 64e0) / 6371000e0), 9) as lat from c, i")
def circle_polygon(spark, sf):
    c = roads.included(roads.way_points(spark, sf)).where("pos = 0").select("way_id", "lon", "lat", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i"))
    return c.select("way_id", "i", *_r(9, lon="lon + degrees(2000e0 * cos(2e0 * pi() * i / 64e0) / (6371000e0 * cos(radians(lat))))", lat="lat + degrees(2000e0 * sin(2e0 * pi() * i / 64e0) / 6371000e0)"))


@query(SQL + "select way_id, round(sum(sqrt((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay))) filter (pos % 7 <> 3), 4) as length, count(*) filter (pos % 7 <> 3) as known from nedge group by way_id")
def route_length(spark, sf):
    e = _native(spark, sf).edges
    route = e.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "eid"))).alias("r"))
    ids = route.select("way_id", F.explode("r.eid").alias("eid"))
    known = e.where("pos % 7 <> 3").select("eid", F.expr(geo.dist("ax", "ay", "bx", "by_")).alias("len"))
    return ids.join(known, "eid", "left").groupBy("way_id").agg(F.round(F.sum("len"), 4).alias("length"), F.count("len").alias("known"))


@query(SQL + ", s as (select run_id, restart_index, step_index, cast(floor(step_index / 3) as bigint) % 4 as edge from trace) select run_id, restart_index, step_index, edge from s qualify coalesce(edge <> lag(edge) over (partition by run_id, restart_index order by step_index), true)")
def route_dedup_edges(spark, sf):
    from pyspark.sql import Window as W

    w = W.partitionBy("run_id", "restart_index").orderBy("step_index")
    s = _trace(spark, sf).select("run_id", "restart_index", "step_index", F.expr("cast(floor(step_index / 3) as bigint) % 4").alias("edge"))
    return s.withColumn("last", F.lag("edge").over(w)).where("last is null or last <> edge").drop("last")


@query(SQL + ", e as (select way_id, pos, eid, ax, ay, bx, by_ from nedge where pos % 11 <> 5) select t.run_id, t.restart_index, t.step_index, count(e.eid) as edges, round(sum(ax), 3) as sum_x from trace t left join e on e.way_id = t.way_id and e.pos between t.step_index and t.step_index + 3 group by 1, 2, 3")
def trace_overlay(spark, sf):
    t = _trace(spark, sf).select("run_id", "restart_index", "step_index", "way_id", F.explode(F.expr("sequence(step_index, step_index + 3)")).alias("pos"))
    e = _native(spark, sf).edges.where("pos % 11 <> 5").select("way_id", "pos", "eid", "ax")
    return t.join(e, ["way_id", "pos"], "left").groupBy("run_id", "restart_index", "step_index").agg(F.count("eid").alias("edges"), F.round(F.sum("ax"), 3).alias("sum_x"))


@query(SQL + ", c as (select run_id, restart_index, step_index + 2 as want from trace), l as (select run_id, restart_index, max(step_index) as last from trace group by 1, 2) select c.run_id, c.restart_index, want, coalesce(t.step_index, last) as step_index from c left join trace t on t.run_id = c.run_id and t.restart_index = c.restart_index and t.step_index = want join l on l.run_id = c.run_id and l.restart_index = c.restart_index")
def candidate_overlay(spark, sf):
    t = _trace(spark, sf).select("run_id", "restart_index", "step_index")
    c = t.select("run_id", "restart_index", (F.col("step_index") + 2).alias("want"))
    last = t.groupBy("run_id", "restart_index").agg(F.max("step_index").alias("last"))
    met = c.join(t.withColumn("want", F.col("step_index")), ["run_id", "restart_index", "want"], "left").join(last, ["run_id", "restart_index"])
    return met.select("run_id", "restart_index", "want", F.coalesce("step_index", "last").alias("step_index"))


@query(SQL + ", l as (select run_id, restart_index, sum(exp(theta)) as w, min(score_total) as s, avg(abs(tx)) as o from trace where unreachable < 5e-1 group by 1, 2) select run_id, round(sum(w * s) / sum(w) + 5e-1 * sum(o) / 1000e0, 6) as joint, round(sum(w), 4) as weight from l group by run_id")
def joint_score(spark, sf):
    p = _trace(spark, sf).where("unreachable < 5e-1").groupBy("run_id", "restart_index").agg(F.sum(F.exp("theta")).alias("w"), F.min("score_total").alias("s"), F.avg(F.abs("tx")).alias("o"))
    return p.groupBy("run_id").agg(F.round(F.sum(F.col("w") * F.col("s")) / F.sum("w") + 0.5 * F.sum("o") / 1000.0, 6).alias("joint"), F.round(F.sum("w"), 4).alias("weight"))


@query(SQL + ", s as (select way_id, pos, node_id as a, lead(node_id) over (partition by way_id order by pos) as b from nat) select least(a, b) as lo, greatest(a, b) as hi, count_if(a < b) as forward, count_if(a > b) as backward from s where b is not null and a <> b group by 1, 2")
def segment_directions(spark, sf):
    e = _native(spark, sf).edges.join(_native(spark, sf).nodes.select(F.col("id").alias("u"), F.get("osm_ids", 0).alias("a")), "u").join(_native(spark, sf).nodes.select(F.col("id").alias("v"), F.get("osm_ids", 0).alias("b")), "v")
    return e.where("a <> b").groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.count_if(F.expr("a < b")).alias("forward"), F.count_if(F.expr("a > b")).alias("backward"))


@query("select event_id, replace(replace(replace(replace(props, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') as html from events")
def html_escape(spark, sf):
    h = F.col("props")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        h = F.replace(h, F.lit(a), F.lit(b))
    return roads.table(spark, sf, "events").select("event_id", h.alias("html"))


@query(SQL + "select way_id, case when length(j) > 60 then substr(j, 1, 60) || '…' else j end as preview from (select way_id, '{\"id\":' || way_id || ',\"nodes\":' || count(*) || ',\"highway\":\"' || min(highway) || '\"}' as j from inc group by way_id)")
def raw_preview(spark, sf):
    w = roads.included(roads.way_points(spark, sf)).groupBy("way_id").agg(F.count(F.lit(1)).alias("nodes"), F.min("highway").alias("highway"))
    j = F.to_json(F.struct(F.col("way_id").alias("id"), "nodes", "highway"))
    return w.select("way_id", j.alias("j")).select("way_id", F.when(F.length("j") > 60, F.concat(F.substring("j", 1, 60), F.lit("…"))).otherwise(F.col("j")).alias("preview"))


@query("select event_id, case event_id % 4 when 0 then null when 1 then cast(event_id as varchar) when 2 then 'n' else 'w' || event_id end as way_ref from events")
def way_id_coerce(spark, sf):
    raw = F.expr("case event_id % 4 when 0 then '' when 1 then cast(event_id as string) when 2 then 'n' else concat('w', event_id) end")
    number = raw.try_cast("bigint")
    return roads.table(spark, sf, "events").select("event_id", F.when(number.isNotNull(), number.cast("string")).when(raw != "", raw).alias("way_ref"))


@query()
def shortest_path_lengths(spark, sf):
    """Hops and metres from each way's first node to its last over the connected graph, by relaxing edges."""
    from wayspark.operators.paths import shortest

    g = _connected(spark, sf)
    ends = g.edges.groupBy("way_id").agg(F.min(F.struct("eid", "u")).alias("a"), F.max(F.struct("eid", "v")).alias("b")).select("way_id", F.col("a.u").alias("src"), F.col("b.v").alias("dst"))
    return shortest(ends, g.edges).select("way_id", *_r(4, length="length"), "hops")

