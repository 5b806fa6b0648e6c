"""The store of tiles: hits, expiry, renewal, pruning, broken-off writes."""

import math
import random
import re

from wayspark.sources.tiles import TileStore, cut, tiled

SCHEMA = "way_id long, pos long, node_id long, lon double, lat double, highway string"
ASK = "lon double, lat double, radius_m double"


def ways(spark, n=60, seed=1):
    r, rows = random.Random(seed), []
    for w in range(n):
        x, y = 139.7 + r.random() / 5, 35.6 + r.random() / 5
        rows += [(w, p, w * 100 + p, x + p * 0.002, y + p * 0.001, "service") for p in range(r.randint(1, 6))]
    return spark.createDataFrame([*rows, (999, 0, 1, None, 35.6, "service")], SCHEMA), rows


def plain(rows, lon, lat, radius):
    x, y, m = round(lon, 2), round(lat, 2), math.ceil(radius / 500) * 500
    d = m / 111320
    e = d / math.cos(math.radians(y))
    ids = {r[0] for r in rows if x - e <= r[3] <= x + e and y - d <= r[4] <= y + d}
    return f"{x:.2f}_{y:.2f}_{m}", {(r[0], r[1]) for r in rows if r[0] in ids}


def held(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.tile, []).append((r.way_id, r.pos))
    assert all(len(v) == len(set(v)) for v in out.values())
    return {k: set(v) for k, v in out.items()}


def test_tiles_hold_what_their_boxes_meet(spark, tmp_path):
    points, rows = ways(spark)
    r = random.Random(2)
    asked = [(139.7 + r.random() / 5, 35.6 + r.random() / 5, r.choice([1.0, 500.0, 1700.0, 9000.0])) for _ in range(25)] + [(10.0, 10.0, 600.0)]
    want = dict(plain(rows, *a) for a in asked)
    store = TileStore(str(tmp_path / "t"))
    requests = spark.createDataFrame([*asked, *asked[:3], (None, 35.6, 500.0)], ASK)
    assert held(store.fetch(requests, points, 50.0)) == {k: v for k, v in want.items() if v}
    # nothing is cut again, not even for tiles that hold nothing
    assert store.live(spark, 60.0).count() == len(want)
    assert held(store.fetch(requests, points.limit(0), 60.0)) == {k: v for k, v in want.items() if v}
    assert spark.read.parquet(str(tmp_path / "t" / "index")).select("at").distinct().count() == 1


def test_expiry_renewal_and_vacuum(spark, tmp_path):
    points, rows = ways(spark)
    a, b = (139.8, 35.7, 3000.0), (139.75, 35.65, 3000.0)
    (ka, va), (kb, vb) = plain(rows, *a), plain(rows, *b)
    store = TileStore(str(tmp_path / "t"), ttl_s=300)
    both = spark.createDataFrame([a, b], ASK)
    store.fetch(both, points, 1000.0)
    # one tile is written anew, the other stays
    few = points.where("way_id % 2 = 0")
    one = tiled(both.limit(1))
    store.put(one, cut(one, few), 1100.0)
    assert held(store.points(tiled(both), 1200.0)) == {ka: {x for x in va if x[0] % 2 == 0}, kb: vb}
    # at the end of its time a tile is no hit, and is cut anew
    assert {r.tile for r in store.live(spark, 1300.0).collect()} == {ka}
    assert held(store.fetch(both, few, 1300.0)) == {ka: {x for x in va if x[0] % 2 == 0}, kb: {x for x in vb if x[0] % 2 == 0}}
    assert store.live(spark, 1600.0).count() == 0
    assert store.vacuum(spark, 1650.0) == 2 and held(store.points(tiled(both), 1350.0))
    assert store.vacuum(spark, 5000.0) == 4 and store.vacuum(spark, 5000.0) == 0
    assert held(store.fetch(both, points, 5000.0)) == {ka: va, kb: vb}


def test_folders_are_pruned(spark, tmp_path):
    points, _ = ways(spark)
    store = TileStore(str(tmp_path / "t"))
    asked = spark.createDataFrame([(139.7 + i / 50, 35.6 + j / 50, 900.0) for i in range(6) for j in range(6)], ASK)
    store.fetch(asked, points, 10.0)
    found = store.points(tiled(asked.limit(1)), 20.0)
    plan = found._jdf.queryExecution().toString()
    filters = [line for line in plan.split("\n") if "PartitionFilters: [" in line and "/points]" in line]
    assert filters and all(re.search(r"at#\d+L > -280000", f) and "dynamicpruning" in f for f in filters)


def test_a_limit_keeps_the_smallest_ids(spark):
    points, rows = ways(spark)
    one = tiled(spark.createDataFrame([(139.8, 35.7, 12000.0)], ASK))
    (_, all_), got = plain(rows, 139.8, 35.7, 12000.0), {r.way_id for r in cut(one, points, 5).collect()}
    assert got == set(sorted({w for w, _ in all_})[:5])


def test_what_the_index_does_not_name_is_not_read(spark, tmp_path):
    points, rows = ways(spark)
    store, one = TileStore(str(tmp_path / "t")), tiled(spark.createDataFrame([(139.8, 35.7, 3000.0)], ASK))
    broken = cut(one, points).selectExpr("*", "'x' as batch", "5000L as at")
    broken.write.partitionBy("at", "tile").mode("append").parquet(str(tmp_path / "t" / "points"))
    assert store.points(one, 6.0).count() == 0
    assert held(store.fetch(one, points, 5.0)) == dict([plain(rows, 139.8, 35.7, 3000.0)])


def test_queries_cut_tiles_without_a_limit_of_ways(spark):
    from wayspark.plans import tile_queries
    from wayspark.sources.tiles import cut, tiled

    assert tile_queries._store(spark).max_ways is None
    points = spark.createDataFrame([(w, p, 10 * w + p, 0.001 * p, 0.0, "service") for w in range(5) for p in range(2)], "way_id long, pos long, node_id long, lon double, lat double, highway string")
    tiles = tiled(spark.createDataFrame([(0.0, 0.0, 400)], "lon double, lat double, radius_m int"))
    assert {r.way_id for r in cut(tiles, points, 3).collect()} == {0, 1, 2} and {r.way_id for r in cut(tiles, points, None).collect()} == set(range(5))
