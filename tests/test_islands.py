"""Merging island by island against the sequential version and against rounds."""

import random

import pytest

from tests.test_roads import points
from tests.test_surgery import held, plain_merge, shape
from wayspark.config import GraphOptions
from wayspark.operators import graph as G
from wayspark.operators import surgery as X


def crossed(r, n):
    """Rows and columns of copies that meet at nodes, so that each merge moves what others are made of; some copies lie aside."""
    ways = {}
    for k in range(n):
        for c in range(r.choice([1, 2, 3])):
            aside, first, last = r.choice([0, 0, 4]), r.choice([0, 1]), n - r.choice([0, 1])
            for turn in (0, 1):
                p = [(100.0 * i, 100.0 * k + aside, 1000 * aside + 10 * (n * k + i if not turn else n * i + k)) for i in range(first, last)]
                if turn:
                    p = [(y, x, node) for x, y, node in p]
                ways[len(ways) + 1] = p
    return ways


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_islands_are_the_sequential_merge(spark, seed):
    r = random.Random(seed)
    g = X._saved(G.connect(G.native(points(spark, crossed(r, 5)))))
    nodes, edges = held(g)
    comps = {}
    for e, (w, u, v, _) in edges.items():
        (ux, uy), (vx, vy) = nodes[u], nodes[v]
        lane = ("x", round(uy / 100)) if abs(ux - vx) > abs(uy - vy) else ("y", round(ux / 100))
        comps.setdefault(lane, set()).add(e)
    comps = {min(es): es for es in comps.values()}
    member = spark.createDataFrame([(e, c) for c, es in comps.items() for e in es], "node string, component string")
    o = GraphOptions(merge_min_overlap_m=10.0, merge_anchor_delta_m=r.choice([1.0, 7.0]))
    want_nodes, want = plain_merge(nodes, edges, comps, o)
    got = X.merge_in_order(g, member, o)
    got_nodes, got_edges = held(got)
    assert shape(want) != shape(edges)
    assert shape(got_edges) == shape(want) and got_nodes.keys() == want_nodes.keys()
    if seed == 1:
        # too large for a task, an island goes in rounds, with the same result to the names of new edges
        rounds = held(X.merge_in_order(g, member, o, most=1))
        assert rounds[1] == got_edges and rounds[0].keys() == got_nodes.keys()


def test_no_job_for_each_dependent_merge(spark):
    """Rows of copies tied one to the next: as many merges that wait for one another, in no more jobs than one of them takes."""
    def jobs(n):
        ways = {}
        for k in range(n):
            for c in range(2):
                ways[2 * k + c + 1] = [(100.0 * i, 500.0 * k + 3 * c, 100 * k + 10 * c + i) for i in range(4)]
            if k:
                ways[2 * k + 1][1] = (100.0, 500.0 * k, 100 * (k - 1) + 2)
        g = X._saved(G.connect(G.native(points(spark, ways))))
        member = spark.createDataFrame([(r.eid, f"c{(r.way_id - 1) // 2:02}") for r in g.edges.select("eid", "way_id").collect()], "node string, component string")
        spark.sparkContext.setJobGroup(f"islands-{n}", "")
        X.merge_in_order(g, member, GraphOptions(merge_min_overlap_m=10.0, merge_max_anchor_offset_m=2000.0))
        out = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"islands-{n}"))
        spark.sparkContext.setJobGroup("", "")
        return out

    few, many = jobs(2), jobs(8)
    assert many < 2 * few
