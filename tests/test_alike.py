"""Roads that lie on one another: pairs of shapes and courses against pairs of all edges, and their number."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from wayspark.operators import alike, graph

SCHEMA = "eid string, way_id long, highway string, u string, v string, ax double, ay double, bx double, by_ double"


def edges(spark, ways):
    """Edges of ``ways(way_id -> points)``; a point is a node."""
    rows = []
    for w, points in ways.items():
        for i, (p, q) in enumerate(zip(points, points[1:])):
            rows.append((f"e:{w}:{i}", w, "service", f"n{p}", f"n{q}", *map(float, p), *map(float, q)))
    return spark.createDataFrame(rows, SCHEMA)


def laid(seed=None, copies=4):
    """Lanes on top of and beside each other, some of them shorter, turned round or bent away."""
    r, ways = random.Random(seed), {}
    for w in range(3 * copies):
        points = [(50 * i, r.choice((0, 0, 6)) if w % 5 == 4 else 9 * (w % 3)) for i in range(r.choice((4, 4, 6, 7)))]
        ways[w + 1] = points[::-1] if r.random() < 0.2 else points
    return ways


@pytest.mark.parametrize("seed", [1, 2])
def test_courses_say_what_pairs_of_edges_say(spark, seed):
    e = edges(spark, laid(seed)).cache()
    c, pairs = alike.courses(e, 20.0, 22.0), graph.road_pairs(e, 20.0, 22.0).cache()
    rounded = lambda rows: sorted((r.way_a, r.way_b, round(r.score, 6), round(r.d, 6), round(r.deg, 6), round(r.lap, 6)) for r in rows)
    sums = graph.way_pairs(pairs)
    assert rounded(alike.of_ways(c, c.sums).collect()) == rounded(sums.collect()) != []
    plain, mine = graph.ways_ok(e, sums, 100.0, 0.25, 22.0), alike.ok(c, 100.0, 0.25, 22.0)
    key = lambda df: sorted((r.way_a, r.way_b) for r in df.select("way_a", "way_b").collect())
    assert key(alike.of_ways(c, mine.select("way_a", "way_b"))) == key(plain) != []
    assert sorted(alike.merge_components(c, mine).collect()) == sorted(graph.merge_components(pairs, plain, 22.0).collect()) != []


def test_what_is_compared_does_not_grow_with_copies(spark):
    """Thirty ways on one another, and thirty across them: pairs of edges in hundreds, pairs of shapes as for one way of each."""
    lane, across = [(0, 0), (60, 0), (120, 0), (180, 0)], [(30, -40), (30, 40)]
    counts = []
    for n in (1, 30):
        e = edges(spark, {w + 1: lane if w % 2 == 0 else across for w in range(2 * n)})
        c = alike.courses(e, 20.0, 22.0)
        counts.append((c.pairs.count(), c.units.count(), graph.crossed_shapes(graph.alike(e)).count()))
        assert graph.crossings(e).count() == n * n
        parts = {r.eid: r.parts for r in graph.split_parts(e).collect()}
        assert parts == {r.eid: 1 + n * (not r.eid.endswith((":1", ":2"))) for r in e.select("eid").collect()}
    assert counts[0] == counts[1]
    got = {r.node: r.component for r in alike.merge_components(c, alike.ok(c, 100.0, 0.25, 22.0)).collect()}
    assert len(got) == 90 and len(set(got.values())) == 1


def test_crossings_of_copies_as_seen_by_each_edge(spark):
    ways = {w: [(0, 0), (10, 10)] if w % 2 else [(0, 7), (10, 2)] for w in (3, 12, 21, 110)}
    flat = {r.eid: r for r in edges(spark, ways).collect()}
    got = {(r.a_eid, r.b_eid): r for r in graph.crossings(edges(spark, ways)).collect()}
    want = {(a, b) for a, b in combinations(sorted(flat), 2) if flat[a].v != flat[b].v}
    assert set(got) == want
    for (a, b), r in got.items():
        assert (r.t, r.s) == (pytest.approx(7 / 15),) * 2 and r.x == flat[a].ax + r.t * (flat[a].bx - flat[a].ax) and r.y == flat[a].ay + r.t * (flat[a].by_ - flat[a].ay)


def plan_of(df):
    """The plan above the edges' hand-out: what runs on rows for pairs of edges."""
    return df._jdf.queryExecution().executedPlan().toString().split("Generate", 1)[0]


@pytest.mark.parametrize("named", [False, True])
def test_links_and_ranks_are_those_of_pairs_of_edges(spark, named):
    """Also where ids of ways' edges run into one another, so that either way's edge may come first."""
    e = edges(spark, laid(3))
    e = (e.withColumn("eid", F.expr("case when way_id % 3 = 0 then md5(eid) else eid end")) if named else e).cache()
    c, pairs = alike.courses(e, 20.0, 22.0), graph.road_pairs(e, 20.0, 22.0).cache()
    ok = alike.ok(c, 100.0, 0.25, 22.0)
    passed = {(r.way_a, r.way_b) for r in alike.of_ways(c, ok.select("way_a", "way_b")).collect()}
    keep = pairs.where(graph.shared_node_ok(22.0) & (F.col("deg") <= 22.05)).collect()
    links = alike.links(c, ok)
    assert sorted(map(tuple, links.collect())) == sorted((r.a_eid, r.b_eid) for r in keep if tuple(sorted((r.a_way_id, r.b_way_id))) in passed) != []
    want, by = [], {}
    for r in pairs.collect():
        by.setdefault(tuple(sorted((r.a_way_id, r.b_way_id))), []).append((-round(r.score, 6), r.a_eid, r.b_eid))
    for ways, rows in by.items():
        want += [(*ways, a, b, k + 1) for k, (_, a, b) in enumerate(sorted(rows))]
    ranked = alike.ranked(e, 20.0, 22.0)
    assert sorted(map(tuple, ranked.collect())) == sorted(want) != []
    if not named:
        # no row for a pair of edges is shuffled or sorted
        assert not any(word in plan_of(df) for df in (links, ranked, graph.road_pairs(e, 20.0, 22.0)) for word in ("Exchange", "Sort", "Window"))
