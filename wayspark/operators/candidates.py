"""From search traces to a few good, different candidates.

A pool has run_id, restart_index, step_index, score_total, unreachable, tx, ty, theta, scale. Ties in score fall
to the smaller restart, then step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


ORDER = ["score_total", "restart_index", "step_index"]


def viable(pool: DataFrame, margin: float) -> DataFrame:
    """Reachable candidates whose score is within the margin of their run's best."""
    best = F.min("score_total").over(W.partitionBy("run_id"))
    return pool.withColumn("pool_best", best).where((F.col("unreachable") < 0.5) & (F.col("score_total") <= F.col("pool_best") + margin))


def good(pool: DataFrame, least: int, margin: float = 0.5) -> DataFrame:
    """Candidates near their run's best, if there are ``least`` of them; else the better half, ``least`` at least."""
    w = W.partitionBy("run_id")
    near = F.col("score_total") <= F.min("score_total").over(w) + margin
    row, n, k = pool.columns, F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(*ORDER))
    o = pool.select("*", near.alias("_near"), n.alias("_n"), k.alias("_k")).withColumn("_good", F.count_if("_near").over(w))
    half = F.greatest(F.lit(least), F.floor(F.col("_n") / 2))
    return o.where(F.when(F.col("_good") >= least, F.col("_near")).when(F.col("_n") > 1, F.col("_k") <= half).otherwise(True)).select(row)


def distance(a: Column, b: Column, span_x: float, span_y: float) -> Column:
    raw = F.abs(a["theta"] - b["theta"])
    turn = F.least(raw, 2 * F.pi() - raw) / F.pi()
    size = F.abs(F.ln(F.greatest(a["scale"], F.lit(1e-12))) - F.ln(F.greatest(b["scale"], F.lit(1e-12)))) / (F.ln(F.lit(8.0)) - F.ln(F.lit(0.15)))
    dx, dy = ((a[c] - b[c]) / F.greatest(F.lit(2.0 * s), F.lit(1.0)) for c, s in (("tx", span_x), ("ty", span_y)))
    return F.sqrt(turn * turn + size * size + dx * dx + dy * dy)


def diverse(candidates: DataFrame, most: int, apart: float, span_x: float, span_y: float) -> DataFrame:
    """The best candidate of each run, then each next one at least ``apart`` from all chosen, ``most`` in all.
    A fold over a run's candidates in order of score; the state holds at most ``most`` rows."""
    row = F.struct(*ORDER, "tx", "ty", "theta", "scale")
    runs = candidates.groupBy("run_id").agg(F.array_sort(F.collect_list(row)).alias("c"))
    none = F.filter("c", lambda x: F.lit(False))
    far = lambda chosen, x: F.forall(chosen, lambda s: distance(x, s, span_x, span_y) >= apart)
    chosen = F.aggregate("c", none, lambda acc, x: F.when((F.size(acc) < most) & far(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return runs.select("run_id", F.posexplode(chosen).alias("pos", "s")).select("run_id", (F.col("pos") + 1).alias("rank"), "s.*")


def maximin(candidates: DataFrame, most: int, span_x: float, span_y: float) -> DataFrame:
    """The best candidate of each run, then again and again the one farthest from all chosen (the first in
    order of score on ties, to a billionth)."""
    row = F.struct(*ORDER, "tx", "ty", "theta", "scale")
    runs = candidates.groupBy("run_id").agg(F.array_sort(F.collect_list(row)).alias("c"))

    def add(chosen: Column, k: Column) -> Column:
        reach = F.transform("c", lambda x, i: F.struct(F.round(F.array_min(F.transform(chosen, lambda s: distance(x, s, span_x, span_y))), 9).alias("d"), (-i).alias("i")))
        return F.when(F.size("c") > F.size(chosen), F.concat(chosen, F.array(F.get("c", -F.array_max(reach)["i"])))).otherwise(chosen)

    start = F.slice("c", 1, 1)
    chosen = F.aggregate(F.sequence(F.lit(2), F.lit(most)), start, add) if most > 1 else start
    return runs.select("run_id", F.posexplode(chosen).alias("pos", "s")).select("run_id", (F.col("pos") + 1).alias("rank"), "s.*")


def ranked(chosen: DataFrame, lengths: DataFrame) -> DataFrame:
    """Ids, distance from the best score, tiers, and labels of the shortest and longest where they differ by
    15 percent or more."""
    c = chosen.join(lengths, ["run_id", "restart_index"], "left").fillna(0.0, ["route_length_m"])
    w = W.partitionBy("run_id")
    c = c.withColumn("lo", F.min("route_length_m").over(w)).withColumn("hi", F.max("route_length_m").over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    differ = (F.col("n") >= 2) & (F.col("lo") >= 1e-9) & (F.col("hi") / F.greatest("lo", F.lit(1e-9)) >= 1.15)
    is_at = lambda e: F.abs(F.col("route_length_m") - F.col(e)) <= 1e-6 * F.greatest("route_length_m", e)
    label = F.when(differ & is_at("lo"), "compact").when(differ & is_at("hi"), "large")
    first = F.first("score_total").over(w.orderBy("rank"))
    return c.select("run_id", "rank", F.format_string("r%d_s%d", "restart_index", "step_index").alias("candidate_id"), (F.col("score_total") - first).alias("delta"), F.when(F.col("rank") == 1, "best").otherwise("included").alias("tier"), label.alias("label"), "route_length_m")


def grid(span_x: str, span_y: str) -> str:
    """SQL for the coarse grid: three turns, sixteen places nearest the middle first, three sizes, numbered."""
    place = lambda c, s: f"(({s}) * 5e-1 * (-1e0 + 2e0 * {c} / 3e0))"
    return (
        f"select row_number() over (order by a, abs(i - 15e-1) + abs(j - 15e-1), i, j, s) as n, (a - 1) * radians(45e0) as theta, {place('i', span_x)} as tx, {place('j', span_y)} as ty,"
        " exp(ln(15e-2) + (ln(8e0) - ln(15e-2)) * s / 2e0) as scale from axes"
    )


AXES = "(select 0 as {c} union all select 1 union all select 2{more})"
AXES_SQL = f"axes as (select * from {AXES.format(c='a', more='')} ta cross join {AXES.format(c='i', more=' union all select 3')} ti cross join {AXES.format(c='j', more=' union all select 3')} tj cross join {AXES.format(c='s', more='')} ts)"


def has_route(components: Column, edge_ids: Column) -> Column:
    """Whether any part has edges; without parts, whether there are edges at all."""
    return F.when(F.size(components) > 0, F.exists(components, lambda c: F.size(c) > 0)).otherwise(F.size(edge_ids) > 0)


def from_steps(steps: DataFrame) -> DataFrame:
    """Trace steps as candidates: missing terms are 0, a missing transform leaves all as it is, and where no edges are
    listed those of the first part are."""
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("unreachable", "fallback", "tx", "ty", "theta")}
    parts = F.coalesce("edge_ids_per_component", F.array().cast("array<array<string>>"))
    ids = F.coalesce("edge_ids", F.array().cast("array<string>"))
    out = steps.withColumns({**zero, "scale": F.coalesce("scale", F.lit(1.0)), "edge_ids_per_component": parts, "edge_ids": ids})
    first = F.when((F.size("edge_ids") == 0) & (F.size("edge_ids_per_component") > 0), F.get("edge_ids_per_component", 0)).otherwise(F.col("edge_ids"))
    return out.withColumn("edge_ids", first)


def routed(pool: DataFrame, margin: float, most_fallback: float = 0.8) -> DataFrame:
    """``viable`` candidates that have a route and fall back to shortest paths no more than allowed."""
    near = viable(pool, margin)
    return near.where(has_route(F.col("edge_ids_per_component"), F.col("edge_ids")) & (F.col("fallback") <= most_fallback))


def escapes(trace: DataFrame, threshold: int, reheat: int) -> DataFrame:
    """(run_id, restart_index, triggers, reheats): how often a restart had gone ``threshold`` steps, or a multiple of
    them, without a new best, and the steps it then spent reheated."""
    w = W.partitionBy("run_id", "restart_index").orderBy("step_index")
    before = F.min("score_total").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = trace.withColumn("best", F.coalesce(F.col("score_total") < before, F.lit(True)).cast("int")).withColumn("grp", F.sum("best").over(w))
    since = F.row_number().over(W.partitionBy("run_id", "restart_index", "grp").orderBy("step_index")) - 1
    late = marked.withColumn("since", since).where(F.col("since") >= threshold)
    some = late.groupBy("run_id", "restart_index").agg(F.count_if(F.col("since") % threshold == 0).alias("triggers"), F.count_if(F.col("since") % threshold < reheat).alias("reheats"))
    return trace.select("run_id", "restart_index").distinct().join(some, ["run_id", "restart_index"], "left").fillna(0, ["triggers", "reheats"])
