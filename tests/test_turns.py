"""Turns to the last bit, as sums of them meet a limit exactly on a grid."""

import math
import random

from wayspark.operators import graph


def test_turns_are_those_of_the_c_library(spark):
    r = random.Random(1)
    xy = [(40.0 * i + r.randint(-3, 3) + r.random() * 1e-9, float(r.randint(-3, 3))) for i in range(3000)]
    nodes = spark.createDataFrame([(1, i, *p) for i, p in enumerate(xy)], "way_id long, pos long, x double, y double")
    got = {t.pos: t.turn for t in graph.turns(nodes).collect()}
    for i in range(1, len(xy) - 1):
        (px, py), (x, y), (nx, ny) = xy[i - 1 : i + 2]
        ux, uy, vx, vy = x - px, y - py, nx - x, ny - y
        assert got[i] == math.atan2(ux * vy - uy * vx, ux * vx + uy * vy)
    still = nodes.where("pos < 3").selectExpr("way_id", "pos", "1e0 as x", "2e0 as y")
    assert [t.turn for t in graph.turns(still).collect()] == [0.0]
