"""Road merge and pruning against plain sequential versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.test_chains import plain_order, plain_thin
from tests.test_roads import points
from wayspark.config import GraphOptions
from wayspark.operators import graph as G
from wayspark.operators import surgery as X

OPTIONS = GraphOptions(merge_distance_m=8.0, merge_min_overlap_m=10.0, merge_anchor_delta_m=1.0)


def dist(a, b):
    return math.sqrt((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2)


def nearest(q, line):
    """(distance, measure, point) of the nearest point of a line; the first of equals."""
    best, start = None, 0.0
    for a, b in zip(line, line[1:]):
        l2 = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
        t = 0.0 if l2 < 1e-18 else max(0.0, min(1.0, ((q[0] - a[0]) * (b[0] - a[0]) + (q[1] - a[1]) * (b[1] - a[1])) / l2))
        h = (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
        if best is None or round(dist(q, h), 9) < round(best[0], 9):
            best = (dist(q, h), start + t * dist(a, b), h)
        start += dist(a, b)
    return best


def plain_merge(nodes, edges, comps, o):
    """nodes {id: (x, y)}, edges {eid: (way, u, v, ways)}; components one after another, in order."""
    limit = o.merge_max_anchor_offset_m or max(2 * o.merge_distance_m, 50.0)
    nodes, edges, length = dict(nodes), dict(edges), lambda e: dist(nodes[e[1]], nodes[e[2]])
    for c in sorted(comps):
        mine = {k: edges[k] for k in sorted(comps[c]) if k in edges}
        ways = {e[0] for e in mine.values()}
        if len(ways) < 2:
            continue
        way = min(ways, key=lambda w: (-round(sum(length(e) for e in mine.values() if e[0] == w), 6), w))
        target, source = ({k: e for k, e in mine.items() if (e[0] == way) == own} for own in (True, False))
        if len(target) > 1:
            order = plain_order([e[1:3] for e in target.values()])
        else:
            (only,) = target.values()
            ends = [nodes[n] for e in source.values() for n in e[1:3]]
            span = max(dist(p, q) for p in ends for q in ends)
            order = list(only[1:3]) if length(only) + 1e-9 >= max(o.merge_min_overlap_m, o.merge_min_overlap_ratio * span) else None
        if order is None:
            continue
        line = [nodes[n] for n in order]
        found = {n: nearest(nodes[n], line) for e in source.values() for n in e[1:3]}
        if any(f[0] > limit + 1e-9 for f in found.values()):
            continue
        anchors, at = [], 0.0
        for i, n in enumerate(order):
            at += dist(line[i - 1], line[i]) if i else 0.0
            anchors.append((at, n))
        to = {}
        for n, (_, measure, h) in found.items():
            to[n] = next((a for _, a in anchors if dist(h, nodes[a]) <= o.merge_anchor_delta_m), None)
            if to[n] is None:
                to[n] = f"roadmerge:{n}"
                nodes[to[n]] = h
                anchors.append((measure, to[n]))
        every = sorted({w for e in mine.values() for w in e[3]})
        edges = {k: (e[0], to.get(e[1], e[1]), to.get(e[2], e[2]), e[3]) for k, e in edges.items() if k not in mine}
        edges = {k: e for k, e in edges.items() if e[1] != e[2]}
        anchors.sort()
        edges |= {f"new:{c}:{i}": (way, a[1], b[1], every) for i, (a, b) in enumerate(zip(anchors, anchors[1:]))}
        used = {n for e in edges.values() for n in e[1:3]}
        nodes = {n: p for n, p in nodes.items() if n in used or n not in to}
    return nodes, edges


def held(g):
    nodes = {r.id: (r.x, r.y) for r in g.nodes.collect()}
    ids = g.edges.columns
    return nodes, {r.eid: (r.way_id, r.u, r.v, list(r.way_ids) if "way_ids" in ids else [r.way_id]) for r in g.edges.collect()}


def shape(edges):
    return sorted((w, *sorted((u, v)), ways) for w, u, v, ways in edges.values())


def random_ways(r, n):
    """Bundles of nearly parallel roads that share nodes here and there, with branches, rings and short pieces."""
    ways, node = {}, 1
    for b in range(n):
        x0, y0, length = 400 * (b % 4), 150 * (b // 4), r.choice([60, 120, 200])
        for k in range(r.choice([1, 2, 2, 3])):
            steps, y = r.choice([1, 2, 4, 7]), y0 + 4 * k + r.uniform(0, 2)
            p = [(x0 + length * i / steps + r.uniform(-3, 3) * (0 < i < steps), y + r.uniform(-1, 1), node + i) for i in range(steps + 1)]
            node += steps + 1
            ways[len(ways) + 1] = p
            if r.random() < 0.5:
                i = r.randrange(len(p))
                ways[len(ways) + 1] = [p[i], (p[i][0] + 2, y0 + 60, node)]
                node += 1
        if b % 4 and r.random() < 0.6:  # two bundles hang together at a node
            w = ways[r.choice(list(ways)[-2:])]
            w[0] = ways[r.randrange(1, len(ways))][-1]
    return ways


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_is_the_sequential_one(spark, seed):
    r = random.Random(seed)
    g = X._saved(G.connect(G.native(points(spark, random_ways(r, 16)))))
    pairs = G.road_pairs(g.edges, OPTIONS.merge_distance_m, OPTIONS.merge_angle_deg)
    ok = G.ways_ok(g.edges, G.way_pairs(pairs), OPTIONS.merge_min_overlap_m, OPTIONS.merge_min_overlap_ratio, OPTIONS.merge_angle_deg)
    comps = {}
    for x in G.merge_components(pairs, ok, OPTIONS.merge_angle_deg).collect():
        comps.setdefault(x.component, set()).add(x.node)
    nodes, edges = held(g)
    want_nodes, want = plain_merge(nodes, edges, comps, OPTIONS)
    got_nodes, got = held(X.merge_roads(g, OPTIONS))
    assert len(comps) > 5 and shape(want) != shape(edges)
    assert shape(got) == shape(want)
    assert got_nodes.keys() == want_nodes.keys() and all(dist(got_nodes[n], want_nodes[n]) < 1e-6 for n in want_nodes)


def test_components_that_share_nodes_go_in_order(spark):
    """Given components, chained by shared nodes: later ones see what earlier ones moved."""
    ways = {w: [(100 * i, 5 * w, 100 * w + i) for i in range(4)] for w in range(1, 7)}
    for w in range(2, 7):
        ways[w][w % 4] = ways[w - 1][w % 4]
    g = X._saved(G.connect(G.native(points(spark, ways))))
    nodes, edges = held(g)
    comps = {c: {k for k, e in edges.items() if e[0] in (a, b)} for c, a, b in (("c1", 1, 2), ("c2", 3, 4), ("c3", 5, 6))}
    member = spark.createDataFrame([(e, c) for c, es in comps.items() for e in es], "node string, component string")
    o = GraphOptions(merge_min_overlap_m=10.0, merge_anchor_delta_m=7.0)
    want_nodes, want = plain_merge(nodes, edges, comps, o)
    got_nodes, got = held(X.merge_in_order(g, member, o))
    assert shape(got) == shape(want) and got_nodes.keys() == want_nodes.keys()


def test_refusals(spark):
    """Too far an end, and a primary way that branches, leave all as it is; a side road follows to the anchor."""
    far = G.connect(G.native(points(spark, {1: [(0, 0, 1), (100, 0, 2)], 2: [(0, 8, 3), (100, 8, 4)]})))
    tight = GraphOptions(merge_distance_m=15.0, merge_min_overlap_m=10.0, merge_max_anchor_offset_m=5.0)
    assert shape(held(X.merge_roads(far, tight))[1]) == shape(held(far)[1])
    side = G.connect(G.native(points(spark, {1: [(0, 0, 1), (50, 0, 2), (100, 0, 3)], 2: [(0, 5, 4), (55, 5, 5), (100, 5, 6)], 3: [(55, 5, 5), (55, 35, 7)]})))
    nodes, edges = held(X.merge_roads(side, OPTIONS))
    (road,) = [e for e in edges.values() if e[0] == 3]
    assert road[3] == [3] and any(n.startswith("roadmerge:") and dist(nodes[n], (55, 0)) < 1 for n in road[1:3])
    assert {tuple(e[3]) for e in edges.values()} == {(3,), (1, 2)}


def test_prune_is_the_sequential_one(spark):
    r, ways, node = random.Random(5), {}, 1
    for w in range(1, 25):
        x, y, heading, p = 1000.0 * w, 0.0, 0.0, []
        for _ in range(r.choice([2, 3, 12, 40])):
            p.append((x, y, node))
            node += 1
            heading += r.choice([0.0, 0.02, -0.03, r.gauss(0, 0.2)])
            x, y = x + 30 * math.cos(heading), y + 30 * math.sin(heading)
        ways[w] = p
        if w % 3 == 0:
            ways[100 + w] = [p[len(p) // 2], (x, y + 500, node)]
            node += 1
    ways[900] = [(0, 0, 9001), (30, 1, 9002), (60, 0, 9003), (30, -400, 9004), (0, 0, 9001)]  # a ring without an end
    g = X._saved(G.connect(G.native(points(spark, ways))))
    # edges whose numbers say nothing of their order
    g = G.Graph(g.nodes, g.edges.withColumn("eid", F.md5("eid")).withColumn("way_ids", F.array(F.col("way_id"), F.lit(7).cast("long"))))
    nodes, edges = held(g)
    at = {}
    for k, (w, u, v, _) in edges.items():
        at.setdefault(u, []).append((w, k))
        at.setdefault(v, []).append((w, k))
    inner = {n for n, e in at.items() if len(e) == 2 and e[0][0] == e[1][0]}
    want, seen = {k: e for k, e in edges.items() if not {e[1], e[2]} & inner}, set()
    for n in set(at) - inner:
        for w, k in at[n]:
            if k in seen or not {edges[k][1], edges[k][2]} & inner:
                continue
            line, cur = [n], n
            while True:
                seen.add(k)
                cur = edges[k][2] if edges[k][1] == cur else edges[k][1]
                line.append(cur)
                if cur not in inner:
                    break
                k = next(x for _, x in at[cur] if x != k)
            kept = [p[0] for p in plain_thin([(i, *nodes[i]) for i in line], math.radians(10))]
            want |= {(line[1], line[-2], n, i): (w, a, b, sorted({7, w})) for i, (a, b) in enumerate(zip(kept, kept[1:]))}
    want |= {k: e for k, e in edges.items() if e[0] == 900}
    got_nodes, got = held(X.prune(g, 10.0))
    norm = lambda es: sorted((w, *sorted((u, v)), sorted(set(ways))) for w, u, v, ways in es.values())
    assert norm(got) == norm(want) and len(got) < len(edges)
    assert got_nodes.keys() == {n for e in got.values() for n in e[1:3]}
