"""Road graph, sketch and candidate operators on tiny inputs with known results."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from wayspark.config import GraphOptions, SearchOptions
from wayspark.functions import geo
from wayspark.operators import candidates as C
from wayspark.operators import graph as G
from wayspark.operators import polylines as P
from wayspark.operators import sketch as S
from wayspark.operators import surgery as X
from wayspark.operators.components import components
from wayspark.operators.nearest import nearest_segments
from wayspark.operators.paths import shortest
from wayspark.sources import roads

SF = "/root/testdata/sf0.001"


def points(spark, ways):
    """ways: {way_id: [(x, y, node_id)]} in metres."""
    c = 6371000 * math.cos(math.radians(35.6812))
    rows = [(w, i, n, 139.7671 + math.degrees(x / c), 35.6812 + math.degrees(y / 6371000), "primary") for w, p in ways.items() for i, (x, y, n) in enumerate(p)]
    return spark.createDataFrame(rows, "way_id long, pos long, node_id long, lon double, lat double, highway string")


def sql(expression):
    return duckdb.sql(f"select {expression}").fetchall()[0][0]


def test_scalar_geometry():
    assert sql(geo.point_segment("0e0", "1e0", "-1e0", "0e0", "1e0", "0e0")) == pytest.approx(1)
    assert sql(geo.overlap(("0e0", "0e0", "10e0", "0e0"), ("5e0", "1e0", "20e0", "1e0"))) == pytest.approx(5)
    assert sql(geo.acute_deg(("0e0", "0e0", "1e0", "0e0"), ("0e0", "0e0", "-1e0", "1e0"))) == pytest.approx(45)
    assert sql(geo.rotation_penalty("radians(180e0)")) == pytest.approx(0.9)
    assert sql(geo.rotation_penalty("radians(45e0)")) == pytest.approx(0, abs=1e-9)


def test_native_and_connect(spark):
    g = G.native(points(spark, {1: [(0, 0, 100), (50, 0, 200)], 2: [(50, 0, 200), (50, 50, 300)]}))
    assert (g.nodes.count(), g.edges.count()) == (4, 2)
    c = G.connect(g)
    assert c.nodes.count() == 3 and c.nodes.where("merged_osm").count() == 1
    assert {r.role for r in G.roles(c).collect()} == {"junction"}


def test_snap_and_split(spark):
    near = G.snap(G.native(points(spark, {1: [(0, 0, 1), (50, 0, 2)], 2: [(52, 0, 3), (100, 0, 4)]})), 5.0)
    assert near.nodes.count() == 3
    one = G.snap(G.native(points(spark, {1: [(0, 0, 1), (1, 0, 2)]})), 5.0)
    assert one.nodes.count() == 2
    cross = G.split(G.native(points(spark, {1: [(-50, 0, 1), (50, 0, 2)], 2: [(0, -50, 3), (0, 50, 4)]})))
    assert (cross.nodes.count(), cross.edges.count()) == (5, 4)


def test_prune(spark):
    line = G.connect(G.native(points(spark, {1: [(i * 20, 0, i) for i in range(5)]})))
    p = X.prune(line)
    assert (p.nodes.count(), p.edges.count()) == (2, 1)
    corner = X.prune(G.connect(G.native(points(spark, {1: [(0, 0, 1), (50, 0, 2), (50, 50, 3)]}))))
    assert (corner.nodes.count(), corner.edges.count()) == (3, 2)


def test_merge_parallel_roads(spark):
    ways = {1: [(x, 0, 100 + x) for x in range(0, 301, 50)], 2: [(x, 5, 500 + x) for x in range(0, 301, 50)], 3: [(150, 5, 650), (150, 200, 999)]}
    g = X.merge_roads(G.connect(G.native(points(spark, ways))), GraphOptions())
    left = {r.way_id for r in g.edges.collect()}
    assert 3 in left and len(left & {1, 2}) == 1
    used = g.edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    assert used.join(g.nodes, "id", "left_anti").count() == 0


def test_components_long_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(100, 101), (None, 1)], "a long, b long"))
    found = components(edges).groupBy("component").count().orderBy("component").collect()
    assert [(r[0], r[1]) for r in found] == [(0, 61), (100, 2)]
    assert components(edges.limit(0)).count() == 0


def test_nearest_far_points(spark):
    g = G.native(points(spark, {1: [(0, 0, 1), (50, 0, 2)]}))
    q = spark.createDataFrame([(1, 10.0, 5.0), (2, 9000.0, 0.0)], "q long, qx double, qy double")
    got = {r.q: r for r in nearest_segments(q, g.edges).collect()}
    assert got[1].d == pytest.approx(5, abs=1e-6) and got[2].d == pytest.approx(8950, abs=1e-3)


def test_resample_and_paths(spark):
    line = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 10.0, 0.0), (2, 0, 3.0, 3.0), (2, 1, 3.0, 3.0)], "line long, pos long, x double, y double")
    got = {(r.line, r.i): (r.x, r.y) for r in P.resample(line, 5).collect()}
    assert len(got) == 10 and got[1, 1] == (2.5, 0.0) and got[2, 4] == (3.0, 3.0)
    g = G.connect(G.native(points(spark, {1: [(0, 0, 1), (100, 0, 2), (200, 0, 3)]})))
    ask = spark.createDataFrame([("native:1:0", "native:1:2"), ("native:1:0", "gone")], "src string, dst string")
    got = {r.dst: r for r in shortest(ask, g.edges).collect()}
    assert got["native:1:2"].length == pytest.approx(200, abs=1e-6) and got["native:1:2"].hops == 2 and got["gone"].length is None


def test_geojson_skips_invalid(spark):
    good = '{"type":"Feature","geometry":{"type":"LineString","coordinates":[[1,2],[3,4]]},"properties":{"osm_way_id":7,"highway":"primary","osm_node_ids":[1,2]}}'
    bad = [good.replace("LineString", "Point"), good.replace("[1,2]}", "[1]}"), good.replace("7", '"x"'), "{}", None]
    df = spark.createDataFrame([(x,) for x in [good, *bad]], "feature string")
    assert [(r.way_id, r.pos, r.node_id, r.lon) for r in roads.from_features(df).orderBy("pos").collect()] == [(7, 0, 1, 1.0), (7, 1, 2, 3.0)]


def test_overpass_reader(spark, tmp_path):
    f = tmp_path / "a.json"
    f.write_text('{"elements":[{"type":"node","id":1,"lat":1.0,"lon":2.0},{"type":"node","id":2,"lat":1.5,"lon":2.5},{"type":"way","id":9,"nodes":[1,2],"tags":{"highway":"primary"}},{"type":"way","id":8,"nodes":[1,5],"tags":{}}]}')
    assert [(r.way_id, r.pos) for r in roads.read_overpass(spark, str(f)).orderBy("pos").collect()] == [(9, 0), (9, 1)]


def test_diverse_and_maximin(spark):
    rows = [(1, 0, i, s, 0.0, tx, 0.0, 0.0, 1.0) for i, (s, tx) in enumerate([(0.1, 0.0), (0.11, 1.0), (0.12, 400.0), (0.3, -400.0)])]
    pool = spark.createDataFrame(rows, "run_id long, restart_index int, step_index int, score_total double, unreachable double, tx double, ty double, theta double, scale double")
    assert [r.step_index for r in C.diverse(C.viable(pool, 0.05), 5, 0.12, 500, 500).orderBy("rank").collect()] == [0, 2]
    assert [r.step_index for r in C.maximin(pool, 3, 500, 500).orderBy("rank").collect()] == [0, 2, 3]


def test_sketch_paths(spark):
    cross = [(1, i, float(i), 1.0) for i in range(3)] + [(2, i, 1.0, float(i)) for i in range(3)] + [(3, 0, 50.0, 50.0), (3, 1, 51.0, 50.0)]
    p = spark.createDataFrame([(1, *r) for r in cross], "sketch_id long, stroke_id long, i int, x double, y double")
    groups = S.stroke_groups(p)
    assert {(r.stroke_id, r.component) for r in groups.collect()} == {(1, 1), (2, 1), (3, 3)}
    walk = [(r.x, r.y) for r in S.single_paths(p, groups).where("component = 1").orderBy("i").collect()]
    legs = {frozenset(x) for x in zip(walk[:-1], walk[1:])}
    assert {frozenset({(0.0, 1.0), (1.0, 1.0)}), frozenset({(1.0, 0.0), (1.0, 1.0)})} <= legs and len(walk) >= 5
    flat = spark.createDataFrame([(1, i, float(i), 0.01 * (i % 2)) for i in range(9)], "stroke_id long, i int, x double, y double")
    assert S.simplified(flat, 0.5).count() == 2
    assert [r.i for r in S.thinned(flat, 2.5).orderBy("i").collect()] == [0, 3, 6]


def test_requests_and_inline_ways(spark):
    q = spark.range(1).select(roads.overpass_query(*map(F.lit, (1.0, 2.0, 3.0, 4.0)), ("a.b", "c")).alias("q"), roads.overpass_query(*map(F.lit, (1.0, 2.0, 3.0, 4.0))).alias("all")).first()
    assert 'way["highway"~"^(a\\.b|c)$"](1.00000,2.00000,3.00000,4.00000);' in q.q and 'way["highway"](1.0' in q.all
    e = spark.createDataFrame([("way", 1, {"highway": "x"}, [(1.0, 2.0, 5), (None, 2.0, 6), (3.0, 4.0, None)]), ("way", 2, None, [(1.0, 2.0, 5)]), ("node", 3, None, None)], "type string, id long, tags map<string,string>, geometry array<struct<lat:double,lon:double,ref:bigint>>")
    assert [tuple(r) for r in roads.inline_ways(e).collect()] == [(1, "x", [[2.0, 1.0], [4.0, 3.0]], [5])]


def test_options():
    assert GraphOptions.from_dict({"snap_endpoints": True, "unknown": 1}).snap_endpoints
    with pytest.raises(ValueError):
        SearchOptions(restarts=0)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_queries_match_sql(spark):
    """Every sixth query with SQL, so that the suite stays short; the driver compares all of them."""
    from wayspark.plans.all_queries import ORACLES, QUERIES

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    norm = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    for name in sorted(ORACLES)[::6]:
        df = QUERIES[name](spark, SF)
        cols = sorted(df.columns)
        mine = sorted((tuple(map(norm, r)) for r in df.select(*cols).collect()), key=str)
        theirs = sorted((tuple(map(norm, r)) for r in con.sql(ORACLES[name]).project(", ".join(f'"{c}"' for c in cols)).fetchall()), key=str)
        assert mine == theirs, name
