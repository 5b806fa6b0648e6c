"""Sketches: strokes as rows (stroke_id, i, x, y)."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayspark.functions import geo
from wayspark.operators.components import components


def fitted(points: DataFrame, by: str, box: tuple[float, float, float, float], margin: float = 0.06) -> DataFrame:
    """Points fitted into a graph's box with a margin: one scale for each ``by``, the y axis turned over."""
    x0, y0, x1, y1 = box
    gw, gh = max(x1 - x0, 1.0) * (1 - 2 * margin), max(y1 - y0, 1.0) * (1 - 2 * margin)
    w = W.partitionBy(by)
    p = points.select("*", *(f(c).over(w).alias(n) for f, c, n in ((F.min, "x", "lx"), (F.max, "x", "hx"), (F.min, "y", "ly"), (F.max, "y", "hy"))))
    s = F.least(gw / F.greatest(F.col("hx") - F.col("lx"), F.lit(1e-9)), gh / F.greatest(F.col("hy") - F.col("ly"), F.lit(1e-9)))
    bx = (x0 + x1) / 2 + (F.col("x") - (F.col("lx") + F.col("hx")) / 2) * s
    by_ = (y0 + y1) / 2 - (F.col("y") - (F.col("ly") + F.col("hy")) / 2) * s
    return p.withColumn("bx", bx).withColumn("by_", by_).drop("lx", "hx", "ly", "hy")


def stroke_segments(points: DataFrame, by: str = "sketch_id") -> DataFrame:
    w = W.partitionBy("stroke_id").orderBy("i")
    return points.select(by, "stroke_id", "i", F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by_")).where("bx is not null")


def touching(points: DataFrame, by: str = "sketch_id") -> DataFrame:
    """Pairs of strokes of one sketch, a < b, of which two segments meet: an equi-join on the sketch, whose
    size is bounded by the limits of a sketch."""
    s = stroke_segments(points, by)
    a, b = (s.select(by, *(F.col(c).alias(f"{p}_{c}") for c in ("stroke_id", "ax", "ay", "bx", "by_"))) for p in "ab")
    t, u = geo.crossing(("a_ax", "a_ay", "a_bx", "a_by_"), ("b_ax", "b_ay", "b_bx", "b_by_"))
    pairs = a.join(b, by).where("a_stroke_id < b_stroke_id").where(F.expr(f"({t}) between -1e-10 and 1e0 + 1e-10 and ({u}) between -1e-10 and 1e0 + 1e-10"))
    return pairs.select(by, F.col("a_stroke_id").alias("a"), F.col("b_stroke_id").alias("b")).distinct()


def stroke_groups(points: DataFrame, by: str = "sketch_id") -> DataFrame:
    """(stroke_id, component): strokes that touch, and strokes on their own."""
    linked = components(touching(points, by).select("a", "b"))
    every = points.select("stroke_id").distinct()
    return every.join(linked, every["stroke_id"] == linked["node"], "left").select("stroke_id", F.coalesce("component", "stroke_id").alias("component"))


def thinned(points: DataFrame, least: float) -> DataFrame:
    """Points at least so far from the last point kept: an ordered fold over each stroke."""
    rows = points.groupBy("stroke_id").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("p"))

    def step(kept: Column, x: Column) -> Column:
        last = F.element_at(kept, -1)
        far = F.sqrt((x["x"] - last["x"]) * (x["x"] - last["x"]) + (x["y"] - last["y"]) * (x["y"] - last["y"])) >= least
        return F.when(far, F.concat(kept, F.array(x))).otherwise(kept)

    return rows.select("stroke_id", F.inline(F.aggregate(F.slice("p", 2, F.size("p")), F.slice("p", 1, 1), step)))


def _simplify(rows: pd.DataFrame, epsilon: float) -> pd.DataFrame:
    p = rows.sort_values("i")
    xy, keep, todo = p[["x", "y"]].to_numpy(), np.zeros(len(p), dtype=bool), [(0, len(p) - 1)]
    keep[[0, -1]] = True
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        q, d = xy[a + 1 : b] - xy[a], xy[b] - xy[a]
        t = np.clip(q @ d / max(d @ d, 1e-18), 0, 1)
        far = np.hypot(*(q - t[:, None] * d).T)
        if far.max() > epsilon:
            k = a + 1 + int(far.argmax())
            keep[k] = True
            todo += [(a, k), (k, b)]
    return p[keep]


def simplified(points: DataFrame, epsilon: float) -> DataFrame:
    """Ramer-Douglas-Peucker on each stroke (a stroke is bounded by the sketch limits)."""
    return points.select("stroke_id", "i", "x", "y").groupBy("stroke_id").applyInPandas(lambda r: _simplify(r, epsilon), "stroke_id long, i int, x double, y double")


def trail(edges: list[tuple[int, int]], start: int) -> list[int]:
    """Vertices along a walk that uses every edge once (Hierholzer), smaller edge numbers first."""
    at: dict[int, list[tuple[int, int]]] = {}
    for k, (u, v) in enumerate(edges):
        at.setdefault(u, []).append((k, v))
        at.setdefault(v, []).append((k, u))
    used, stack, out = set(), [start], []
    cursor = dict.fromkeys(at, 0)
    while stack:
        u = stack[-1]
        while cursor.get(u, 0) < len(at.get(u, ())) and at[u][cursor[u]][0] in used:
            cursor[u] += 1
        if cursor.get(u, 0) == len(at.get(u, ())):
            out.append(stack.pop())
        else:
            k, v = at[u][cursor[u]]
            used.add(k)
            stack.append(v)
    return out[::-1]


def _ways_from(start: int, near: dict[int, list[tuple[int, float]]]) -> tuple[dict[int, float], dict[int, int]]:
    """Distances from one vertex, and the vertex before each on the way there."""
    d, before, todo = {start: 0.0}, {}, [(0.0, start)]
    while todo:
        far, u = heapq.heappop(todo)
        if far > d[u]:
            continue
        for v, w in near[u]:
            if far + w < d.get(v, np.inf) - 1e-12:
                d[v], before[v] = far + w, u
                heapq.heappush(todo, (far + w, v))
    return d, before


def _matched(odd: list[int], d: dict[tuple[int, int], float], free: int) -> tuple[float, list[tuple[int, int]]]:
    """The cheapest pairing of odd vertices that leaves ``free`` of them (0 or 2) alone; by subsets up to
    twenty, else the nearest pairs first."""
    k = len(odd)
    if k > 20:
        pairs, left = [], set(range(k))
        for c, i, j in sorted((d[odd[i], odd[j]], i, j) for i in range(k) for j in range(i + 1, k)):
            if i in left and j in left and len(left) > free:
                left -= {i, j}
                pairs.append((odd[i], odd[j]))
        return sum(d[a, b] for a, b in pairs), pairs
    best: dict[tuple[int, int], tuple[float, list[tuple[int, int]]]] = {(0, free): (0.0, [])}
    full = (1 << k) - 1
    for mask in range(full):
        for f in (free, free - 1, free - 2):
            if (mask, f) not in best or f < 0:
                continue
            cost, pairs = best[mask, f]
            i = next(b for b in range(k) if not mask >> b & 1)
            nexts = [(mask | 1 << i, f - 1, cost, pairs)] if f else []
            nexts += [(mask | 1 << i | 1 << j, f, cost + d[odd[i], odd[j]], [*pairs, (odd[i], odd[j])]) for j in range(i + 1, k) if not mask >> j & 1]
            for m, g, c, p in nexts:
                if (m, g) not in best or c < best[m, g][0] - 1e-12:
                    best[m, g] = c, p
    return best.get((full, 0), (np.inf, []))


def _one_path(rows: pd.DataFrame) -> pd.DataFrame:
    """One walk over all strokes of a connected sketch part: cut at crossings, odd vertices joined again by the
    shortest ways (as a path if that is no dearer than as a round), then a trail over every edge."""
    component, lines = int(rows["component"].iloc[0]), [g.sort_values("i")[["x", "y"]].to_numpy() for _, g in rows.groupby("stroke_id")]
    first, last = (np.concatenate([line[k] for line in lines]) for k in (slice(None, -1), slice(1, None)))
    along = last - first
    cuts: list[list[float]] = [[0.0, 1.0] for _ in first]
    for i, (a, r) in enumerate(zip(first, along)):  # each segment with all later ones at once
        q, c = along[i + 1 :], first[i + 1 :] - a
        den = r[0] * q[:, 1] - r[1] * q[:, 0]
        met = np.flatnonzero(np.abs(den) > 1e-10)
        q, c, den = q[met], c[met], den[met]
        t, u = (c[:, 0] * q[:, 1] - c[:, 1] * q[:, 0]) / den, (c[:, 0] * r[1] - c[:, 1] * r[0]) / den
        for k in np.flatnonzero((t >= -1e-10) & (t <= 1 + 1e-10) & (u >= -1e-10) & (u <= 1 + 1e-10)):
            cuts[i].append(min(1.0, max(0.0, float(t[k]))))
            cuts[i + 1 + met[k]].append(min(1.0, max(0.0, float(u[k]))))
    where: dict[tuple[int, int], int] = {}
    xy: list[np.ndarray] = []
    edges = []
    for a, r, ts in zip(first, along, cuts):
        places, stops = a + np.array(sorted(set(ts)))[:, None] * r, []
        for key, p in zip(map(tuple, np.round(places / 1e-6).astype(np.int64).tolist()), places):
            if key not in where:
                where[key] = len(xy)
                xy.append(p)
            stops.append(where[key])
        edges += [(u, v) for u, v in zip(stops[:-1], stops[1:]) if u != v]
    if not edges:
        return pd.DataFrame({"component": [component], "i": [0], "x": [lines[0][0][0]], "y": [lines[0][0][1]]})
    degree = np.bincount(np.array(edges).ravel(), minlength=len(xy))
    odd = [int(v) for v in np.flatnonzero(degree % 2)]
    start = odd[0] if odd else edges[0][0]
    if len(odd) > 2:
        near: dict[int, list[tuple[int, float]]] = {}
        places = np.array(xy)
        for (u, v), w in zip(edges, np.hypot(*np.subtract(*places[np.array(edges).T]).T).tolist()):
            near.setdefault(u, []).append((v, w))
            near.setdefault(v, []).append((u, w))
        ways = {v: _ways_from(v, near) for v in odd}
        d = {(u, v): ways[u][0].get(v, np.inf) for u in odd for v in odd}
        (path, p), (round_, q) = _matched(odd, d, 2), _matched(odd, d, 0)
        pairs = p if path <= round_ + 1e-12 else q
        paired = {v for pair in pairs for v in pair}
        start = next((v for v in odd if v not in paired), odd[0])
        for u, v in pairs:
            while u != v:
                w = ways[u][1][v]
                edges.append((w, v))
                v = w
    walk = np.array(xy)[trail(edges, start)]
    return pd.DataFrame({"component": component, "i": range(len(walk)), "x": walk[:, 0], "y": walk[:, 1]})


def single_paths(points: DataFrame, groups: DataFrame) -> DataFrame:
    """(component, i, x, y): each group of touching strokes as one path. A group is bounded by the limits of a
    sketch (150 points), which callers check."""
    return points.join(groups, "stroke_id").groupBy("component").applyInPandas(_one_path, "component long, i int, x double, y double")
