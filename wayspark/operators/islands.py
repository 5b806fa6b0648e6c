"""Duplicate roads merged one after another where they hang together.

Components that share nodes, and those that share nodes with these, are an island. What is merged first moves the ends of what comes
later, so an island is one sequence; it's settled in one task that holds each component's shapes, not their copies: edges of the same ends and
places are one shape, and of ways of the same shapes the one of smallest id stands for all, as only that can be the primary way.
Islands share no node, so all go at once.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayspark.config import GraphOptions
from wayspark.operators.components import components
from wayspark.operators.graph import SAME
from wayspark.storage import written

#: Shapes, one for each way that stands for others, of an island that one task holds; larger islands go in rounds over tables.
MOST = 500_000
OUT = "kind string, component string, i long, way_id long, highway string, u string, v string, ax double, ay double, bx double, by_ double"


def units(held: DataFrame) -> DataFrame:
    """(island, component, way_id, k, eid, other, highway, u, v, ax, ay, bx, by_) of ``held(component, <edge>)``: for each way that stands for others its
    shapes, each k times, with the least edge of its own and of the others."""
    own = held.groupBy("component", "way_id", *SAME).agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("eid", "highway")).alias("m"))
    own = written(own.withColumn("shape", F.min("m.eid").over(W.partitionBy("component", *SAME))), "own")
    ways = own.groupBy("component", "way_id").agg(F.array_sort(F.collect_list(F.struct("shape", "k"))).alias("course"))
    ways = ways.select("component", "way_id", F.min("way_id").over(W.partitionBy("component", "course")).alias("first"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    each = own.join(ways.withColumnsRenamed({"component": "c", "way_id": "w"}), (F.col("component") == F.col("c")) & same("way_id", "w")).drop("c", "w")
    mine = F.when(same("way_id", "first"), F.col("m"))
    out = each.groupBy("component", "first", "shape", *SAME).agg(F.max("k").alias("k"), F.max(mine).alias("m"), F.min(F.when(~same("way_id", "first"), F.col("m.eid"))).alias("other"))
    out = written(out.select("component", F.col("first").alias("way_id"), "k", "m.eid", "other", "m.highway", *SAME), "units")
    at = written(out.select("component", F.explode(F.array("u", "v")).alias("id")).distinct(), "at")
    links = at.join(at.groupBy("id").agg(F.min("component").alias("least")), "id").select(F.col("component").alias("a"), F.col("least").alias("b"))
    return out.join(components(links).select(F.col("node").alias("component"), F.col("component").alias("island")), "component")


def _hull(points: list) -> list:
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(p):
        out = []
        for q in p:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) < 0:
                out.pop()
            out.append(q)
        return out

    return list(set(half(points) + half(points[::-1])))


def _dist(p, q) -> float:
    return math.sqrt((p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]))


def _path(links: dict) -> list | None:
    """The nodes of links {(a, b): how many}, a < b, in order, as ``chains.ordered_nodes`` has them; None if they are no single chain."""
    at, many = {}, {}
    for (a, b), m in links.items():
        for p, q in ((a, b), (b, a)):
            at.setdefault(p, []).append(q)
            many[p] = many.get(p, 0) + m
    if not links or len(links) != len(at) - 1 or any(len(n) > 2 for n in at.values()):
        return None
    start, end = sorted((many[n] > 1, n) for n, to in at.items() if len(to) == 1)[:2]
    if start[0] and end[0] and min(at) not in (start[1], end[1]):
        return None
    out, last = [start[1]], None
    while (step := [n for n in at[out[-1]] if n != last]) and len(out) < len(at):
        last = out[-1]
        out.append(step[0])
    return out if len(out) == len(at) else None


class _Line:
    """A polyline's segments by cell of a side, so that a point looks only at those that may be in reach."""

    def __init__(self, places: list, reach: float):
        self.reach, self.cells, self.segments, at = reach, {}, [], 0.0
        self.measures = [0.0]
        for k, (a, b) in enumerate(zip(places, places[1:])):
            at += _dist(a, b)
            self.measures.append(at)
            self.segments.append((*a, *b, at - _dist(a, b)))
            low, high = ([math.floor((f(a[c], b[c]) + s * reach * (1 + 1e-9)) / reach) for c in (0, 1)] for f, s in ((min, -1), (max, 1)))
            for x in range(low[0], high[0] + 1):
                for y in range(low[1], high[1] + 1):
                    self.cells.setdefault((x, y), []).append(k)

    def nearest(self, qx: float, qy: float):
        """(measure, x, y) of the nearest point within reach, the first segment's of equals; or None."""
        best = None
        for k in self.cells.get((math.floor(qx / self.reach), math.floor(qy / self.reach)), ()):
            ax, ay, bx, by, start = self.segments[k]
            dx, dy = bx - ax, by - ay
            l2 = dx * dx + dy * dy
            t = 0.0 if l2 < 1e-18 else max(0.0, min(1.0, ((qx - ax) * dx + (qy - ay) * dy) / l2))
            x, y = ax + t * dx, ay + t * dy
            d = math.sqrt((qx - x) * (qx - x) + (qy - y) * (qy - y))
            if d <= self.reach + 1e-9 and (best is None or (round(d, 9), k) < best[:2]):
                best = (round(d, 9), k, start + t * math.sqrt(l2), x, y)
        return best and best[2:]


class _Anchors:
    """Places by cells of the reach; the first of those within it is found."""

    def __init__(self, delta: float):
        self.delta, self.size, self.cells = delta, max(delta, 1e-6), {}

    def add(self, order: tuple, x: float, y: float, name) -> None:
        self.cells.setdefault((math.floor(x / self.size), math.floor(y / self.size)), []).append((order, x, y, name))

    def first(self, x: float, y: float):
        cx, cy = math.floor(x / self.size), math.floor(y / self.size)
        near = (a for i in (-1, 0, 1) for j in (-1, 0, 1) for a in self.cells.get((cx + i, cy + j), ()) if _dist(a[1:3], (x, y)) <= self.delta)
        return min(near, key=lambda a: a[0], default=None)


class _Island:
    """Nodes are numbers; one that was moved leads to another, so what hung on it follows. A node that was moved and is a stop of
    the merged road still is a new number of the same name."""

    def __init__(self, o: GraphOptions):
        self.o, self.limit = o, o.merge_max_anchor_offset_m if o.merge_max_anchor_offset_m > 0 else max(2 * o.merge_distance_m, 50.0)
        self.names, self.places, self.to, self.first = [], [], [], {}
        self.edges, self.made, self.gone, self.done = [], {}, set(), []

    def node(self, name: str, x: float, y: float) -> int:
        self.names.append(name)
        self.places.append((x, y))
        self.to.append(len(self.to))
        return len(self.to) - 1

    def given(self, name: str, x: float, y: float) -> int:
        if name not in self.first:
            self.first[name] = self.node(name, x, y)
        return self.first[name]

    def at(self, n: int) -> int:
        while self.to[n] != n:
            self.to[n] = n = self.to[self.to[n]]
        return n

    def merge(self, component: str, shapes: list) -> None:
        """``shapes``: (way, k, eid, other, highway, u, v)."""
        o = self.o
        now = [(*s[:5], self.at(s[5]), self.at(s[6])) for s in shapes]
        now = [s for s in now if s[5] != s[6]]
        lengths: dict = {}
        for way, k, *_, u, v in now:
            lengths.setdefault(way, []).append(k * _dist(self.places[u], self.places[v]))
        if not lengths:
            return
        way = min(lengths, key=lambda w: (-round(math.fsum(lengths[w]), 6), w is None, w or 0))
        if way is None:
            return
        target = [s for s in now if s[0] == way]
        # the ends of the others, in the order of their edges
        ends: dict = {}
        for s in now:
            eid = s[3] if s[0] == way else s[2] if s[3] is None else min(s[2], s[3])
            if eid is not None and s[0] is not None:
                for side, n in enumerate(s[5:]):
                    ends[n] = min(ends.get(n, (eid, side)), (eid, side))
        if not ends:
            return
        if sum(s[1] for s in target) == 1:
            order = list(target[0][5:])
            hull = _hull([self.places[n] for n in ends])
            span = max(_dist(p, q) for p in hull for q in hull)
            need = max(o.merge_min_overlap_m, o.merge_min_overlap_ratio * span) if span > 1e-6 else o.merge_min_overlap_m
            if _dist(self.places[order[0]], self.places[order[1]]) + 1e-9 < need:
                return
        else:
            links: dict = {}
            number = {self.names[n]: n for s in target for n in s[5:]}
            for s in target:
                link = tuple(sorted((self.names[s[5]], self.names[s[6]])))
                links[link] = links.get(link, 0) + s[1]
            path = _path(links)
            if path is None:
                return
            order = [number[n] for n in path]
        line = _Line([self.places[n] for n in order], self.limit)
        found = {n: line.nearest(*self.places[n]) for n in ends}
        if any(f is None for f in found.values()):
            return
        anchors, stops, to = _Anchors(o.merge_anchor_delta_m), [], {}
        for i, n in enumerate(order):
            anchors.add((0, i), *self.places[n], n)
            stops.append((line.measures[i], self.names[n], n))
        for i, n in enumerate(sorted(ends, key=ends.get)):
            measure, x, y = found[n]
            hit = anchors.first(x, y)
            if hit is None:
                name = f"roadmerge:{self.names[n]}"
                hit = ((1, i), x, y, self.node(name, x, y))
                anchors.add(*hit)
                stops.append((measure, name, hit[3]))
                self.made[name] = (x, y)
            to[n] = hit[3]
        still = {n for *_, n in stops}
        for n in to:
            if n not in still:
                if self.made.pop(self.names[n], None) is None:
                    self.gone.add(self.names[n])
        again = {n: self.node(self.names[n], *self.places[n]) for n in to if n in still and to[n] != n}
        stop = lambda n: again.get(n, n)
        for n, a in to.items():
            if n != a:
                self.to[n] = stop(a)
        highway = min((s[2], s[4] or "", s[4]) for s in target)[2]
        stops.sort()
        self.edges += [(component, i + 1, way, highway, stop(p[2]), stop(q[2])) for i, (p, q) in enumerate(zip(stops, stops[1:])) if p[1] != q[1]]
        self.done.append(component)

    def rows(self):
        none = (None,) * 11
        for c, i, way, highway, u, v in self.edges:
            u, v = self.at(u), self.at(v)
            if u != v:
                yield ("edge", c, i, way, highway, self.names[u], self.names[v], *self.places[u], *self.places[v])
        for name, n in self.first.items():
            n = self.at(n)
            if self.names[n] != name:
                yield ("move", *none[:4], name, self.names[n], None, None, *self.places[n])
        for name, place in self.made.items():
            yield ("made", *none[:4], name, None, *place, None, None)
        for name in self.gone:
            yield ("gone", *none[:4], name, *none[:5])
        for c in self.done:
            yield ("done", c, *none[:9])


TYPES = pa.schema([("kind", pa.string()), ("component", pa.string()), ("i", pa.int64()), ("way_id", pa.int64()), ("highway", pa.string()), ("u", pa.string()), ("v", pa.string()), *((c, pa.float64()) for c in ("ax", "ay", "bx", "by_"))])


def settled(units_: DataFrame, o: GraphOptions) -> DataFrame:
    """What becomes of the islands of ``units``: rows of ``OUT`` for new edges, nodes that moved (u to v), that were made or went, and components that were merged."""

    def settle(table: pa.Table) -> pa.Table:
        island, parts = _Island(o), {}
        cols = [table.column(c).to_pylist() for c in ("component", "way_id", "k", "eid", "other", "highway", *SAME)]
        for c, way, k, eid, other, highway, u, v, ax, ay, bx, by in zip(*cols):
            parts.setdefault(c, []).append((way, k, eid, other, highway, island.given(u, ax, ay), island.given(v, bx, by)))
        for c in sorted(parts):
            island.merge(c, parts.pop(c))
        rows = list(island.rows())
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), TYPES)], schema=TYPES) if rows else TYPES.empty_table()

    return written(units_.groupBy("island").applyInArrow(settle, OUT), "settled")
