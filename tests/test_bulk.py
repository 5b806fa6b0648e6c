"""Nearest segments, shortest paths and road pairs against plain versions, far points and long paths among them."""

import heapq
import inspect
import math
import random

import pytest
from pyspark.sql import functions as F

from wayspark.operators import graph, nearest, paths
from wayspark.plans import search_queries

EDGES = "eid string, way_id long, u string, v string, ax double, ay double, bx double, by_ double"


def edges(spark, xy, pairs):
    return spark.createDataFrame([(f"e{k}", k % 7, u, v, *xy[u], *xy[v]) for k, (u, v) in enumerate(pairs)], EDGES)


def plain_lengths(xy, pairs, src):
    near = {}
    for u, v in pairs:
        w = math.dist(xy[u], xy[v])
        near.setdefault(u, []).append((v, w))
        near.setdefault(v, []).append((u, w))
    d, todo = {src: 0.0}, [(0.0, src)]
    while todo:
        a, u = heapq.heappop(todo)
        for v, w in near.get(u, ()):
            if a + w < d.get(v, math.inf):
                d[v] = a + w
                heapq.heappush(todo, (d[v], v))
    return d


def test_shortest_paths_are_dijkstras(spark):
    r = random.Random(4)
    xy = {f"n{i:03}": (r.uniform(0, 100), r.uniform(0, 100)) for i in range(60)}
    names = sorted(xy)
    pairs = [(u, v) for u, v in (r.sample(names[:40], 2) for _ in range(55))] + list(zip(names[38:], names[39:])) + [(names[0], names[0]), (names[1], names[2]), (names[1], names[2])]
    ask = [tuple(r.sample(names, 2)) for _ in range(40)] + [(names[3], names[3]), ("n000", "nowhere")]
    got = {(x.src, x.dst): x.length for x in paths.shortest(spark.createDataFrame(ask, "src string, dst string"), edges(spark, xy, pairs)).collect()}
    for s, t in ask:
        want = plain_lengths(xy, pairs, s).get(t)
        assert got[s, t] == (pytest.approx(want, abs=1e-9) if want is not None else None), (s, t)


def test_a_path_of_many_edges_and_one_of_many_choices(spark):
    xy = {f"a{i:04}": (float(i), 0.0) for i in range(260)} | {f"b{i:04}": (float(i), 1.0) for i in range(40)}
    a, b = sorted(k for k in xy if k[0] == "a"), sorted(k for k in xy if k[0] == "b")
    pairs = list(zip(a, a[1:])) + list(zip(b, b[1:])) + list(zip(a, b))
    ask = spark.createDataFrame([("a0000", "a0259"), ("b0000", "a0030"), ("a0000", "c")], "src string, dst string")
    got = {x.dst: (x.length, x.hops) for x in paths.shortest(ask, edges(spark, xy, pairs)).collect()}
    assert got == {"a0259": (259.0, 259), "a0030": (31.0, 31), "c": (None, None)}
    assert inspect.signature(paths.shortest).parameters["max_rounds"].default is None
    with pytest.raises(RuntimeError):
        paths.shortest(ask, edges(spark, xy, pairs), max_rounds=1)


def test_every_way_has_its_path(spark, monkeypatch):
    asked, sf = [], "/root/testdata/sf0.001"
    monkeypatch.setattr(paths, "shortest", lambda ask, e: asked.append(ask.count()) or ask.withColumns({"length": F.lit(1.0), "hops": F.lit(1)}))
    n = search_queries.shortest_path_lengths(spark, sf).count()
    assert asked == [n] == [search_queries._connected(spark, sf).edges.select("way_id").distinct().count()]


def segment_distance(q, a, b):
    l2 = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
    t = max(0.0, min(1.0, ((q[0] - a[0]) * (b[0] - a[0]) + (q[1] - a[1]) * (b[1] - a[1])) / l2)) if l2 else 0.0
    return math.dist(q, (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))


def test_nearest_of_far_points_too(spark):
    r = random.Random(7)
    xy = {f"n{i}": (r.uniform(-300, 300), r.uniform(-300, 300)) for i in range(80)}
    pairs = [tuple(r.sample(sorted(xy), 2)) for _ in range(60)]
    points = [(r.uniform(-400, 400), r.uniform(-400, 400)) for _ in range(60)] + [(1900.0, -40.0), (-70.0, 5300.0), (40_000.0, 40_000.0)]
    ask = spark.createDataFrame([(i, *p) for i, p in enumerate(points)] + [(99, None, 1.0)], "q long, qx double, qy double")
    got = {x.q: (x.eid, x.d) for x in nearest.nearest_segments(ask, edges(spark, xy, pairs)).collect()}
    assert set(got) == set(range(len(points)))
    for i, p in enumerate(points):
        d, k = min((round(segment_distance(p, xy[u], xy[v]), 6), f"e{k}") for k, (u, v) in enumerate(pairs))
        assert got[i][0] == k and got[i][1] == pytest.approx(d, abs=1e-6)
    assert nearest.nearest_segments(ask, edges(spark, xy, pairs).limit(0)).count() == 0


@pytest.mark.parametrize("angle", [22.0, 70.0])
def test_road_pairs_are_all_pairs(spark, angle):
    r = random.Random(3)
    xy = {}
    for i in range(90):
        x, y, t = r.uniform(0, 120), r.uniform(0, 120), r.choice([0.0, 0.3, 1.5708, 3.1, r.uniform(0, 6.3)])
        xy[f"s{i:02}"], xy[f"t{i:02}"] = (x, y), (x + 30 * math.cos(t), y + 30 * math.sin(t))
    pairs = [(f"s{i:02}", f"t{i:02}") for i in range(90)]
    e = edges(spark, xy, pairs)
    got = {(x.a_eid, x.b_eid) for x in graph.road_pairs(e, 20.0, angle).collect()}
    want = set()
    for i in range(90):
        for j in range(90):
            (a, b), (c, d) = (tuple(xy[n] for n in pairs[k]) for k in (i, j))
            turn = abs(math.remainder(math.atan2(b[1] - a[1], b[0] - a[0]) - math.atan2(d[1] - c[1], d[0] - c[0]), math.pi))
            far = min(segment_distance(a, c, d), segment_distance(b, c, d), segment_distance(c, a, b), segment_distance(d, a, b))
            if f"e{i}" < f"e{j}" and i % 7 != j % 7 and math.degrees(turn) <= angle and far <= 20:
                want.add((f"e{i}", f"e{j}"))
    assert got == want and want


def test_boxes_of_all_sizes_hold_their_points(spark):
    r = random.Random(6)
    at = [(k, r.uniform(-3000, 3000), r.uniform(-3000, 3000)) for k in range(300)] + [(300, 100.0, -200.0), (301, None, 0.0)]
    boxes = [(k, x, y, x + r.choice([0, 50, 99, 100, 800, 6000]), y + r.choice([0, 100, 300, 5000])) for k, x, y in ((k, r.uniform(-3000, 3000), r.uniform(-3000, 3000)) for k in range(60))]
    boxes += [(60, 100.0, -200.0, 100.0, -200.0), (61, 0.0, None, 5.0, 5.0), (62, -1e6, -1e6, 1e6, 1e6)]
    b, p = spark.createDataFrame(boxes, "box long, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(at, "id long, x double, y double")
    got = sorted((x.box, x.id) for x in nearest.in_boxes(b, p).collect())
    assert got == [(k, i) for k, x0, y0, x1, y1 in boxes if y0 is not None for i, x, y in at if x is not None and x0 <= x <= x1 and y0 <= y <= y1]
    assert nearest.in_boxes(b.where("box < 0"), p).count() == 0


def test_copies_of_a_chain_are_one_step(spark):
    """Five edges in each place, some turned: the chain has no choice, so it is one step."""
    from wayspark.operators.paths import contracted

    cut = [(f"e{k}:{i}", *((i, i + 1) if (k + i) % 2 else (i + 1, i))) for k in range(5) for i in range(6)]
    edges = spark.createDataFrame([(e, f"n{a}", f"n{b}", 3.0 * a, 4.0 * a, 3.0 * b, 4.0 * b) for e, a, b in cut], "eid string, u string, v string, ax double, ay double, bx double, by_ double")
    steps = contracted(edges, spark.createDataFrame([("n0",), ("n6",)], "id string")).collect()
    assert sorted((x.u, x.v, x.w, x.step) for x in steps) == [("n0", "n6", 30.0, 6), ("n6", "n0", 30.0, 6)]
