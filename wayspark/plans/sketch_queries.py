"""Queries over sketches: fitting, joining and thinning strokes."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayspark.functions import geo
from wayspark.operators import planar
from wayspark.operators import sketch as S
from wayspark.plans.registry import query
from wayspark.plans.road_queries import _r
from wayspark.sources import roads
from wayspark.sources.roads import SQL

BOX = (0.0, 0.0, 4000.0, 3000.0)
FIT = "2000e0 + (x - (lx + hx) / 2e0) * s as bx, 1500e0 - (y - (ly + hy) / 2e0) * s as by_"
FITS = SQL + """, sk as (select *, cast(floor(stroke_id / 3) as bigint) as sketch_id from st), bb as (select {by} as k, min(x) as lx, max(x) as hx, min(y) as ly, max(y) as hy from sk group by 1),
  sc as (select *, least(4000e0 * (1e0 - 2e0 * 6e-2) / greatest(hx - lx, 1e-9), 3000e0 * (1e0 - 2e0 * 6e-2) / greatest(hy - ly, 1e-9)) as s from bb)
  select stroke_id, cast(i as int) as i, round(bx, 4) as bx, round(by_, 4) as by_ from (select stroke_id, i, """ + FIT + " from sk join sc on sk.{by} = sc.k)"


def _sketches(spark, sf):
    return roads.strokes(spark, sf).withColumn("sketch_id", F.expr("cast(floor(stroke_id / 3) as bigint)"))


@query(FITS.format(by="stroke_id"))
def base_polyline(spark, sf):
    return S.fitted(_sketches(spark, sf), "stroke_id", BOX).select("stroke_id", "i", *_r(4, bx="bx", by_="by_"))


@query(FITS.format(by="sketch_id"))
def base_polyline_shared(spark, sf):
    return S.fitted(_sketches(spark, sf), "sketch_id", BOX).select("stroke_id", "i", *_r(4, bx="bx", by_="by_"))


@query(SQL + "select cast(floor(stroke_id / 3) as bigint) as sketch_id, count(*) as points, count(distinct stroke_id) as parts, count(*) between 2 and 150 and count(distinct stroke_id) <= 10 as accepted from st group by 1")
def sketch_limits(spark, sf):
    return _sketches(spark, sf).groupBy("sketch_id").agg(F.count(F.lit(1)).alias("points"), F.countDistinct("stroke_id").alias("parts")).withColumn("accepted", F.col("points").between(2, 150) & (F.col("parts") <= 10))


T, U = geo.crossing(("a.ax", "a.ay", "a.bx", "a.by_"), ("b.ax", "b.ay", "b.bx", "b.by_"))
TOUCH = SQL + f""", sk as (select *, cast(floor(stroke_id / 3) as bigint) as sketch_id from st), sg as (select * from (select sketch_id, stroke_id, i, x as ax, y as ay, lead(x) over w as bx, lead(y) over w as by_ from sk window w as (partition by stroke_id order by i)) where bx is not null),
  cr as (select a.sketch_id, a.stroke_id as a, b.stroke_id as b, a.i as ai, b.i as bi, {T} as t, {U} as u from sg a join sg b on a.sketch_id = b.sketch_id and (a.stroke_id < b.stroke_id))"""


@query(TOUCH + "select distinct sketch_id, a, b from cr where t between -1e-10 and 1e0 + 1e-10 and u between -1e-10 and 1e0 + 1e-10")
def stroke_touch(spark, sf):
    return S.touching(_sketches(spark, sf))


@query("with recursive" + TOUCH.removeprefix("with") + """, pr as (select distinct a, b from cr where t between -1e-10 and 1e0 + 1e-10 and u between -1e-10 and 1e0 + 1e-10),
  reach(n, m) as (select a, b from pr union select b, a from pr union select r.n, e.m from reach r join (select a as n, b as m from pr union all select b, a from pr) e on r.m = e.n)
  select stroke_id, least(stroke_id, coalesce(min(m), stroke_id)) as component from (select distinct stroke_id from sk) left join reach on n = stroke_id group by stroke_id""")
def stroke_components(spark, sf):
    return S.stroke_groups(_sketches(spark, sf))


@query(TOUCH + "select a, b, cast(ai as int) as ai, cast(bi as int) as bi, round(t, 6) as t, round(u, 6) as u from cr where t > 1e-10 and t < 1e0 - 1e-10 and u > 1e-10 and u < 1e0 - 1e-10")
def sketch_split_points(spark, sf):
    s = S.stroke_segments(_sketches(spark, sf))
    a, b = (s.select("sketch_id", *(F.col(c).alias(f"{p}_{c}") for c in ("stroke_id", "i", "ax", "ay", "bx", "by_"))) for p in "ab")
    t, u = (x.replace("a.", "a_").replace("b.", "b_") for x in (T, U))
    m = a.join(b, "sketch_id").where("a_stroke_id < b_stroke_id").select(F.col("a_stroke_id").alias("a"), F.col("b_stroke_id").alias("b"), F.col("a_i").alias("ai"), F.col("b_i").alias("bi"), F.expr(t).alias("t"), F.expr(u).alias("u"))
    return m.where("t > 1e-10 and t < 1e0 - 1e-10 and u > 1e-10 and u < 1e0 - 1e-10").select("a", "b", "ai", "bi", *_r(6, t="t", u="u"))


@query("with recursive" + SQL.removeprefix("with") + """, f(stroke_id, i, lx, ly, keep) as (select stroke_id, i, x, y, true from st where i = 0
    union all select s.stroke_id, s.i, case when sqrt((s.x-lx)*(s.x-lx)+(s.y-ly)*(s.y-ly)) >= 2e-1 then s.x else lx end, case when sqrt((s.x-lx)*(s.x-lx)+(s.y-ly)*(s.y-ly)) >= 2e-1 then s.y else ly end, sqrt((s.x-lx)*(s.x-lx)+(s.y-ly)*(s.y-ly)) >= 2e-1
    from f join st s on s.stroke_id = f.stroke_id and s.i = f.i + 1) select stroke_id, cast(i as int) as i from f where keep""")
def min_distance_filter(spark, sf):
    return S.thinned(roads.strokes(spark, sf), 0.2).select("stroke_id", "i")


@query(SQL + ", p as (select a.stroke_id, a.i, b.i as j, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) as d from st a join st b on a.stroke_id = b.stroke_id and b.i < a.i - 2 where sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) <= 1e-1) select stroke_id, cast(i as int) as i, cast(j as int) as snap_to, round(d, 6) as d from p qualify row_number() over (partition by stroke_id, i order by d, j) = 1")
def pen_snap(spark, sf):
    s = roads.strokes(spark, sf)
    old = s.select("stroke_id", F.col("i").alias("j"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    d = F.expr(geo.dist("x", "y", "ox", "oy"))
    near = s.join(old, "stroke_id").where("j < i - 2").where(d <= 0.1).groupBy("stroke_id", "i").agg(F.min(F.struct(d.alias("d"), "j")).alias("m"))
    return near.select("stroke_id", "i", F.col("m.j").alias("snap_to"), F.round("m.d", 6).alias("d"))


@query(SQL + ", c as (select stroke_id, max(case when i = 0 then x end) as x0, max(case when i = 0 then y end) as y0, max(case when i = 1 then x end) as x1, max(case when i = 1 then y end) as y1, max(case when i = 2 then x end) as x2, max(case when i = 2 then y end) as y2 from st group by 1), k as (select unnest(range(1, 13)) as k) select stroke_id, cast(k as int) as k, round(power(1 - k / 12e0, 2) * x0 + 2 * (1 - k / 12e0) * k / 12e0 * x1 + power(k / 12e0, 2) * x2, 6) as x, round(power(1 - k / 12e0, 2) * y0 + 2 * (1 - k / 12e0) * k / 12e0 * y1 + power(k / 12e0, 2) * y2, 6) as y from c, k")
def bezier_samples(spark, sf):
    c = roads.strokes(spark, sf).where("i < 3").groupBy("stroke_id").pivot("i", [0, 1, 2]).agg(F.first("x").alias("x"), F.first("y").alias("y"))
    k = c.select("*", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("k")).withColumn("t", F.col("k") / 12.0)
    at = lambda v: f"pow(1 - t, 2) * `0_{v}` + 2 * (1 - t) * t * `1_{v}` + pow(t, 2) * `2_{v}`"
    return k.select("stroke_id", "k", *_r(6, x=at("x"), y=at("y")))


@query()
def rdp_simplify(spark, sf):
    return S.simplified(roads.strokes(spark, sf), 0.1).select("stroke_id", "i", *_r(6, x="x", y="y"))


@query()
def single_path(spark, sf):
    points = _sketches(spark, sf)
    return S.single_paths(points, S.stroke_groups(points)).select("component", "i", *_r(6, x="x", y="y"))


@query()
def sketch_graph(spark, sf):
    """The edges of all sketches' planar graphs. Which spot comes first is a fold, so there is no SQL; the tests hold it against plain loops."""
    e = planar.planar_edges(_sketches(spark, sf))
    return e.select("sketch_id", "stroke_id", "i", "part", "u", "v", *_r(6, weight="weight"))
