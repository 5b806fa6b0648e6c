"""Planar graphs of sketches against plain loops."""

import math
import random
import time

import pandas as pd
from pyspark.sql import functions as F

from wayspark.operators import planar
from wayspark.operators.sketch import _one_path


def plain_spots(points, near):
    made, to = [], []
    for k, x, y in sorted(points):
        hit = next((v for v in made if abs(v[1] - x) < near and abs(v[2] - y) < near), None)
        if hit is None:
            hit = (k, x, y)
            made.append(hit)
        to.append((k, *hit))
    return to


def test_spots_are_those_of_a_plain_loop(spark):
    r = random.Random(4)
    near, rows = 0.1, []
    for g in range(30):
        # dense chains across the borders of cells, equal points, negative places, and points on their own
        base = [(r.uniform(-1.3, 1.3), r.choice([0.0, 1.0, -1.0]) + r.uniform(-0.12, 0.12)) for _ in range(40)]
        base += [r.choice(base) for _ in range(10)] + [(r.uniform(5, 90), r.uniform(5, 90)) for _ in range(5)]
        rows += [(g, k, x, y) for k, (x, y) in zip(r.sample(range(1000), len(base)), base)]
    got = planar.merged_spots(spark.createDataFrame([*rows, (1, 5000, None, 0.0)], "group long, k long, x double, y double"), near).collect()
    want = sorted((g, *t) for g in range(30) for t in plain_spots([p[1:] for p in rows if p[0] == g], near))
    assert sorted(tuple(x) for x in got) == want
    assert len({(g, v) for g, _, v, _, _ in want}) < len(want) * 0.9


def test_cuts_keep_their_step(spark):
    r = random.Random(6)
    lists = [[r.choice([0.1, 0.2, 0.5]) + r.randint(0, 4) * 0.4e-10 for _ in range(r.randint(0, 12))] for _ in range(60)]
    for row in spark.createDataFrame([(x,) for x in lists], "c array<double>").select("c", planar.spaced(F.col("c")).alias("s")).collect():
        want = []
        for t in sorted(row.c):
            if not want or t - want[-1] > 1e-10:
                want.append(t)
        assert row.s == want


def plain_graph(strokes):
    segs = [(s, i, p, q) for s, line in strokes for i, (p, q) in enumerate(zip(line, line[1:]))]
    cuts = [[] for _ in segs]
    for i, (sa, ia, a0, a1) in enumerate(segs):
        for j in range(i + 1, len(segs)):
            sb, ib, b0, b1 = segs[j]
            if sa == sb and abs(ia - ib) == 1:
                continue
            rx, ry, qx, qy = a1[0] - a0[0], a1[1] - a0[1], b1[0] - b0[0], b1[1] - b0[1]
            den = rx * qy - ry * qx
            if abs(den) < 1e-10:
                continue
            t, u = ((b0[0] - a0[0]) * qy - (b0[1] - a0[1]) * qx) / den, ((b0[0] - a0[0]) * ry - (b0[1] - a0[1]) * rx) / den
            if -1e-10 <= t <= 1 + 1e-10 and -1e-10 <= u <= 1 + 1e-10:
                cuts[i] += [t] if 1e-10 < t < 1 - 1e-10 else []
                cuts[j] += [u] if 1e-10 < u < 1 - 1e-10 else []
    stops = []
    for (s, i, p, q), ts in zip(segs, cuts):
        kept = []
        for t in sorted(ts):
            if not kept or t - kept[-1] > 1e-10:
                kept.append(t)
        stops += [((s, i, n), *xy) for n, xy in enumerate([p, *((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])) for t in kept), q])]
    to = {k: v for k, v, _, _ in plain_spots(stops, 1e-6)}
    return sorted((*k, to[k], to[(*k[:2], k[2] + 1)]) for k in to if (*k[:2], k[2] + 1) in to and to[k] != to[(*k[:2], k[2] + 1)])


def test_graphs_are_those_of_plain_loops(spark):
    r = random.Random(8)
    sketches, rows = {}, []
    for g in range(25):
        grid = g % 2 == 0  # on a grid, ends meet segments, vertices and one another
        pick = lambda: (float(r.randint(0, 4)), float(r.randint(0, 4))) if grid else (r.random(), r.random())
        sketches[g] = [(g * 10 + s, [pick() for _ in range(r.randint(2, 9))]) for s in range(3)]
        rows += [(g, s, i, *p) for s, line in sketches[g] for i, p in enumerate(line)]
    got = {g: [] for g in sketches}
    for e in planar.planar_edges(spark.createDataFrame(rows, "sketch_id long, stroke_id long, i int, x double, y double")).collect():
        got[e.sketch_id].append((e.stroke_id, e.i, e.part, tuple(map(int, e.u.split(":"))), tuple(map(int, e.v.split(":")))))
        assert abs(e.weight - math.dist((e.ux, e.uy), (e.vx, e.vy))) < 1e-12
    assert {g: sorted(x) for g, x in got.items()} == {g: plain_graph(s) for g, s in sketches.items()}
    assert planar.planar_edges(spark.createDataFrame([], "sketch_id long, stroke_id long, i int, x double, y double")).count() == 0


def test_points_dealt_by_group_stay_where_they_are(spark):
    rows = spark.createDataFrame([(g, k, k / 7, g / 3) for g in range(4) for k in range(9)], "group long, k long, x double, y double")
    plan = planar.merged_spots(rows.repartition(3, "group"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_long_lines_are_cut_without_a_loop_over_pairs():
    n = 1500
    line = pd.DataFrame({"component": 1, "stroke_id": 1, "i": range(n), "x": [float(k) for k in range(n)], "y": [float(k % 2) for k in range(n)]})
    across = pd.DataFrame({"component": 1, "stroke_id": 2, "i": [0, 1], "x": [-0.5, n - 0.5], "y": [0.5, 0.5]})
    start = time.perf_counter()
    assert len(_one_path(line)) == n
    assert time.perf_counter() - start < 2.5
    walk = _one_path(pd.concat([line.head(40), across.assign(x=[-0.5, 39.5])]))
    assert {(k + 0.5, 0.5) for k in range(39)} <= set(zip(walk["x"], walk["y"]))
