"""Road ways, sketches and search traces as DataFrames.

The driver's tables hold no roads: one user of ``events`` is a way, that user's n-th event its n-th vertex, on a
40 m lattice with a fixed jitter; ``embeddings`` give strokes of 32 points. GeoJSON and Overpass documents are
read into the same shapes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayspark.config import INCLUDED_HIGHWAYS, MAX_WAYS
from wayspark.functions import geo

LON0, LAT0 = "139.7671e0", "35.6812e0"
FEATURES = "type string, features array<struct<type:string,geometry:struct<type:string,coordinates:array<array<double>>>,properties:struct<osm_way_id:string,highway:string,osm_node_ids:array<string>>>>"
ELEMENTS = "elements array<struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,tags:map<string,string>,geometry:array<struct<lat:double,lon:double,ref:bigint>>>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def way_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(way_id, pos, node_id, lon, lat, highway): every vertex of every way."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    ev = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("way_id"), (F.row_number().over(order) - 1).cast("bigint").alias("pos"))
    half = "(cast(floor(way_id / 2) as bigint) * 7) % 61"
    g = ev.select("way_id", "pos", F.expr(f"if(way_id % 2 = 0, pos, {half})").alias("col"), F.expr(f"if(way_id % 2 = 0, {half}, pos)").alias("rw"), F.expr("cast(if(way_id % 10 = 4, 1, 0) as bigint)").alias("par"))
    g = g.withColumn("px", F.expr("40e0 * col + ((rw * 31 + col * 17) % 7 - 3) * 1e0")).withColumn("py", F.expr("40e0 * rw + ((rw * 13 + col * 29) % 7 - 3) * 1e0 + par * 6e0"))
    kinds = F.array(*(F.lit(k) for k in ("primary", "residential", "service", "footway", "tertiary", "unclassified", "motorway", "secondary")))
    return g.select(
        "way_id", "pos", F.expr("par * 1000000 + rw * 1000 + col").alias("node_id"),
        F.expr(f"{LON0} + degrees(px / ({geo.R} * cos(radians({LAT0}))))").alias("lon"),
        F.expr(f"{LAT0} + degrees(py / {geo.R})").alias("lat"),
        F.get(kinds, (F.col("way_id") % 8).cast("int")).alias("highway"),
    )


def included(points: DataFrame) -> DataFrame:
    return points.where(F.col("highway").isin(*INCLUDED_HIGHWAYS))


def first_ways(points: DataFrame, limit: int = MAX_WAYS) -> DataFrame:
    """Points of the ``limit`` ways of smallest id: the limit is placed before coordinates are looked at."""
    ids = points.select("way_id").distinct().orderBy("way_id").limit(limit)
    return points.join(ids, "way_id", "left_semi")


def to_geojson(points: DataFrame) -> DataFrame:
    """(way_id, feature): each way as a GeoJSON LineString feature."""
    own = points.groupBy("way_id").agg(F.first("highway").alias("highway"), F.array_sort(F.collect_list(F.struct("pos", "node_id", "lon", "lat"))).alias("p"))
    geometry = F.struct(F.lit("LineString").alias("type"), F.transform("p", lambda x: F.array(x["lon"], x["lat"])).alias("coordinates"))
    props = F.struct(F.col("way_id").alias("osm_way_id"), "highway", F.transform("p", lambda x: x["node_id"]).alias("osm_node_ids"))
    return own.select("way_id", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties"))).alias("feature"))


def from_features(texts: DataFrame, column: str = "feature") -> DataFrame:
    """Way points of GeoJSON features. Only lines of two or more coordinates with an integer way id and as many
    integer node ids are ways; other features are skipped."""
    schema = FEATURES.split("features array<", 1)[1][:-1].removeprefix("struct<")[:-1]
    f = texts.select(F.from_json(column, f"struct<{schema}>").alias("f"))
    coords = F.filter("f.geometry.coordinates", lambda c: F.size(c) >= 2)
    ids = F.transform("f.properties.osm_node_ids", lambda i: i.try_cast("bigint"))
    rows = f.where(F.col("f.geometry.type") == "LineString").select(F.col("f.properties.osm_way_id").try_cast("bigint").alias("way_id"), F.col("f.properties.highway").alias("highway"), coords.alias("c"), ids.alias("ids"))
    rows = rows.where(F.col("way_id").isNotNull() & (F.size("c") >= 2) & (F.size("c") == F.size("ids")) & ~F.exists("ids", lambda i: i.isNull()))
    each = rows.select("way_id", "highway", F.posexplode(F.arrays_zip("c", "ids")).alias("pos", "z"))
    return each.select("way_id", F.col("pos").cast("bigint").alias("pos"), F.col("z.ids").alias("node_id"), F.get("z.c", 0).alias("lon"), F.get("z.c", 1).alias("lat"), "highway")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Way points of the feature collections in GeoJSON files."""
    docs = spark.read.schema(FEATURES).json(path, multiLine=True)
    return from_features(docs.select(F.explode("features").alias("f")).select(F.to_json("f").alias("feature")))


def read_overpass(spark: SparkSession, path: str, limit_ways: int | None = None) -> DataFrame:
    """Way points of saved Overpass responses (JSON files): nodes by id, ways that resolve whole."""
    each = spark.read.schema(ELEMENTS).json(path, multiLine=True).select(F.inline("elements"))
    ways = each.where("type = 'way' and size(nodes) >= 2").select(F.col("id").alias("way_id"), "nodes", F.element_at("tags", "highway").alias("highway"))
    if limit_ways is not None:
        ways = ways.orderBy("way_id").limit(limit_ways)
    refs = ways.select("way_id", "highway", F.posexplode("nodes").alias("pos", "node_id"))
    nodes = each.where("type = 'node' and lat is not null and lon is not null").select(F.col("id").alias("node_id"), "lon", "lat").dropDuplicates(["node_id"])
    return resolved(refs, nodes)


def resolved(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Coordinates for ``refs(way_id, pos, node_id)``; a way with a reference that resolves to no node goes."""
    found = refs.join(nodes, "node_id", "left")
    broken = found.where(F.col("lon").isNull()).select("way_id").distinct()
    return found.join(broken, "way_id", "left_anti")


def strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stroke_id, i, x, y): one vector is one stroke of 32 points."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("stroke_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i"))
    return e.select("stroke_id", "i", F.get("embedding", 2 * F.col("i")).cast("double").alias("x"), F.get("embedding", 2 * F.col("i") + 1).cast("double").alias("y"))


def overpass_query(south: Column, west: Column, north: Column, east: Column, highways: tuple[str, ...] | None = None, timeout_s: int = 25) -> Column:
    """The request for all ways with a highway tag, or with one of ``highways``, in a box, and for their nodes."""
    one_of = "" if highways is None else '~"^(' + "|".join(re.escape(h) for h in highways) + ')$"'
    box = F.concat_ws(",", *(F.format_string("%.5f", c) for c in (south, west, north, east)))
    return F.concat(F.lit(f'[out:json][timeout:{timeout_s}];\n(\n  way["highway"{one_of}]('), box, F.lit(");\n);\nout body;\n>;\nout skel qt;\n"))


def inline_ways(elements: DataFrame) -> DataFrame:
    """Ways of ``elements(type, id, tags, geometry)`` whose points stand in them: way_id, highway, coordinates
    and node_ids. Points without a place go, and ways with fewer than two; a point without a reference keeps
    its place, so there may be fewer ids than points."""
    points = F.filter("geometry", lambda g: g["lat"].isNotNull() & g["lon"].isNotNull())
    ways = elements.where("type = 'way'").select(F.col("id").alias("way_id"), F.element_at("tags", "highway").alias("highway"), points.alias("p")).where(F.size("p") >= 2)
    refs = F.filter(F.transform("p", lambda g: g["ref"]), lambda r: r.isNotNull())
    return ways.select("way_id", "highway", F.transform("p", lambda g: F.array(g["lon"], g["lat"])).alias("coordinates"), refs.alias("node_ids"))


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of annealing restarts, five restarts to a run."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", (F.row_number().over(order) - 1).cast("bigint").alias("step_index"))
    return ev.selectExpr(
        "cast(floor(user_id / 5) as bigint) as run_id", "user_id % 5 as restart_index", "step_index", "user_id as way_id",
        "if(event_type in ('view', 'click'), 1, 0) as accepted", "if(event_type = 'error', 1e0, 0e0) as unreachable",
        "if(event_type = 'error', 1010000e0, 1e-2 + ((event_id * 7919) % 1000) / 1e4) as score_total",
        "((event_id * 31) % 401 - 200) * 1e0 as tx", "((event_id * 17) % 401 - 200) * 1e0 as ty",
        "((event_id * 13) % 629 - 314) / 1e2 as theta", "exp(((event_id * 7) % 396 - 189) / 1e2) as scale",
    )


#: The same inputs as SQL, for the other engine.
SQL = """with
ev as (select event_id, user_id, event_type, row_number() over (partition by user_id order by ts, event_id) - 1 as pos from events),
g as (select user_id as way_id, pos,
  case when user_id % 2 = 0 then pos else (cast(floor(user_id / 2) as bigint) * 7) % 61 end as col,
  case when user_id % 2 = 0 then (cast(floor(user_id / 2) as bigint) * 7) % 61 else pos end as rw,
  case when user_id % 10 = 4 then 1 else 0 end as par from ev),
v as (select way_id, pos, par * 1000000 + rw * 1000 + col as node_id,
  40.0e0 * col + ((rw * 31 + col * 17) % 7 - 3) * 1.0e0 as px,
  40.0e0 * rw + ((rw * 13 + col * 29) % 7 - 3) * 1.0e0 + par * 6.0e0 as py, par from g),
ways as (select way_id, pos, node_id,
  139.7671e0 + degrees(px / (6371000.0e0 * cos(radians(35.6812e0)))) as lon,
  35.6812e0 + degrees(py / 6371000.0e0) as lat,
  case way_id % 8 when 0 then 'primary' when 1 then 'residential' when 2 then 'service' when 3 then 'footway' when 4 then 'tertiary' when 5 then 'unclassified' when 6 then 'motorway' else 'secondary' end as highway from v),
inc as (select * from ways where highway in ('trunk','primary','secondary','tertiary','unclassified','residential','service')),
nat as (select *, 'native:' || way_id || ':' || pos as nid, 6371000.0e0 * cos(radians(35.6812e0)) * radians(lon - 139.7671e0) as x,
  6371000.0e0 * radians(lat - 35.6812e0) as y,
  (pos = 0 or pos = max(pos) over (partition by way_id)) as is_end from inc),
nedge as (select * from (select way_id, pos, 'e:' || way_id || ':' || pos as eid, highway, nid as u, lead(nid) over w as v, node_id as ou, lead(node_id) over w as ov,
  x as ax, y as ay, lead(x) over w as bx, lead(y) over w as by_ from nat window w as (partition by way_id order by pos)) where v is not null),
canon as (select node_id, min(nid) as id, avg(x) as x, avg(y) as y, count(*) as members, bool_or(is_end) as is_end from nat group by node_id),
cedge as (select e.eid, e.way_id, e.highway, a.id as u, b.id as v, a.x as ax, a.y as ay, b.x as bx, b.y as by_
  from nedge e join canon a on e.ou = a.node_id join canon b on e.ov = b.node_id where a.id <> b.id),
st as (select vec_id as stroke_id, i, cast(embedding[2*i+1] as double) as x, cast(embedding[2*i+2] as double) as y
  from (select vec_id, embedding, unnest(range(0, 32)) as i from embeddings)),
trace as (select cast(floor(user_id / 5) as bigint) as run_id, user_id % 5 as restart_index, pos as step_index, user_id as way_id,
  case when event_type in ('view', 'click') then 1 else 0 end as accepted,
  case when event_type = 'error' then 1e0 else 0e0 end as unreachable,
  case when event_type = 'error' then 1010000e0 else 1e-2 + ((event_id * 7919) % 1000) / 1e4 end as score_total,
  ((event_id * 31) % 401 - 200) * 1e0 as tx, ((event_id * 17) % 401 - 200) * 1e0 as ty,
  ((event_id * 13) % 629 - 314) / 1e2 as theta, exp(((event_id * 7) % 396 - 189) / 1e2) as scale from ev)
"""
