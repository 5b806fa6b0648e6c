"""Way points by tile, kept for a while in a Parquet store: what was asked for lately isn't cut from the source again.

A request is a centre and a radius; its tile has both rounded, and is cut by the box of the rounded values, so requests that lie
close share one. The store is laid out by write time, then tile: the time is a filter on the outer folders, the tiles that
are asked for prune the inner ones as the query runs, and what has expired goes by whole folders. Points are written before the
index names them, so a write that breaks off is never read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayspark.config import MAX_WAYS
from wayspark.operators.graph import cells
from wayspark.storage import written

#: Digits of a tile's centre, step of its radius in metres, metres a degree, seconds that a tile is kept.
CENTRE_DIGITS, RADIUS_STEP_M, METRES_A_DEGREE, TTL_S = 2, 500, 111320.0, 300
POINTS = "way_id long, pos long, node_id long, lon double, lat double, highway string, batch string, at long, tile string"
INDEX = "tile string, batch string, n_ways long, n_points long, at long"


def tiled(requests: DataFrame) -> DataFrame:
    """``requests(lon, lat, radius_m, ..)`` with lon_key, lat_key, radius_key and tile, their text; null where one of them is."""
    keys = {"lon_key": F.round("lon", CENTRE_DIGITS), "lat_key": F.round("lat", CENTRE_DIGITS), "radius_key": F.ceil(F.col("radius_m") / RADIUS_STEP_M) * RADIUS_STEP_M}
    text = F.concat_ws("_", *(F.format_string(f, F.col(c)) for f, c in ((f"%.{CENTRE_DIGITS}f", "lon_key"), (f"%.{CENTRE_DIGITS}f", "lat_key"), ("%d", "radius_key"))))
    return requests.withColumns(keys).withColumn("tile", F.when(F.expr("lon_key + lat_key + radius_key is not null"), text))


def boxes(tiles: DataFrame) -> DataFrame:
    """(tile, south, west, north, east) of each different tile, by its rounded centre and radius."""
    keys = tiles.where("tile is not null").select("tile", "lon_key", "lat_key", (F.col("radius_key") / METRES_A_DEGREE).alias("d")).distinct()
    wide = F.col("d") / F.cos(F.radians("lat_key"))
    return keys.select("tile", (F.col("lat_key") - F.col("d")).alias("south"), (F.col("lon_key") - wide).alias("west"), (F.col("lat_key") + F.col("d")).alias("north"), (F.col("lon_key") + wide).alias("east"))


def cut(tiles: DataFrame, points: DataFrame, max_ways: int | None = MAX_WAYS, cell: float = 0.05) -> DataFrame:
    """(tile, <points>) for ``tiles(tile, lon_key, lat_key, radius_key)``: the ways with a point in its box, whole; of more than ``max_ways`` those
    of smallest id; all if it is None. Points meet boxes by cells of ``cell`` degrees, with the exact test after it."""
    at = [F.floor(F.col(c) / cell).alias(k) for c, k in (("lon", "cx"), ("lat", "cy"))]
    met = points.where("lon + lat is not null").select("way_id", "lon", "lat", *at).join(cells(boxes(tiles), cell, "west", "south", "east", "north", 0.0), ["cx", "cy"])
    ways = met.where("lon between west and east and lat between south and north").select("tile", "way_id").distinct()
    if max_ways is not None:
        ways = ways.withColumn("k", F.row_number().over(W.partitionBy("tile").orderBy("way_id"))).where(F.col("k") <= max_ways).drop("k")
    return points.select("way_id", "pos", "node_id", "lon", "lat", "highway").join(ways, "way_id")


@dataclass(frozen=True)
class TileStore:
    """A store of tiles under ``path``, a folder that all executors share. Times are seconds, given by the caller."""

    path: str
    ttl_s: int = TTL_S
    #: of each tile that is cut from the source; None: all
    max_ways: int | None = MAX_WAYS

    def _read(self, spark: SparkSession, what: str, schema: str, now: float) -> DataFrame:
        # an append of nothing makes the folder of a new store
        at = f"{self.path}/{what}"
        spark.createDataFrame([], schema).write.partitionBy("at").mode("append").parquet(at)
        return spark.read.schema(schema).parquet(at).where(F.col("at") > int((now - self.ttl_s) * 1000))

    def live(self, spark: SparkSession, now: float) -> DataFrame:
        """(tile, at, batch, n_ways, n_points): of each tile that has not expired the latest write."""
        last = self._read(spark, "index", INDEX, now).groupBy("tile").agg(F.max(F.struct("at", "batch", "n_ways", "n_points")).alias("m"))
        return last.select("tile", "m.*")

    def points(self, tiles: DataFrame, now: float) -> DataFrame:
        """(tile, <points>) of those of ``tiles(tile)`` that are live; each tile once, however often it is asked for."""
        spark = tiles.sparkSession
        asked = self.live(spark, now).select("tile", "at", "batch").join(tiles.select("tile"), "tile", "left_semi")
        return self._read(spark, "points", POINTS, now).join(asked, ["tile", "at", "batch"]).drop("at", "batch")

    def put(self, tiles: DataFrame, points: DataFrame, now: float) -> None:
        """Writes ``points(tile, ..)`` as the tiles of ``tiles(tile)``, in place of earlier writes; tiles without points are kept as empty ones."""
        stamp = {"at": F.lit(int(now * 1000)), "batch": F.lit(uuid.uuid4().hex)}
        tiles = tiles.where("tile is not null").select("tile").distinct()
        rows = written(points.join(tiles, "tile", "left_semi").withColumns(stamp), "tile-points")
        # a tile's rows go to few files, a large tile's to several
        rows.hint("rebalance", "tile").write.partitionBy("at", "tile").mode("append").parquet(f"{self.path}/points")
        sums = rows.groupBy("tile").agg(F.countDistinct("way_id").alias("n_ways"), F.count(F.lit(1)).alias("n_points"))
        index = tiles.join(sums, "tile", "left").fillna(0, ["n_ways", "n_points"]).withColumns(stamp)
        index.write.partitionBy("at").mode("append").parquet(f"{self.path}/index")

    def fetch(self, requests: DataFrame, source: DataFrame, now: float) -> DataFrame:
        """(tile, <points>) of all tiles of ``requests(lon, lat, radius_m)``: live ones from the store, others cut from
        ``source`` and stored. Requests with nulls have no tile."""
        tiles = written(tiled(requests).where("tile is not null").select("tile", "lon_key", "lat_key", "radius_key").distinct(), "tiles")
        missed = written(tiles.join(self.live(tiles.sparkSession, now), "tile", "left_anti"), "missed")
        if not missed.isEmpty():
            self.put(missed, cut(missed, source, self.max_ways), now)
        return self.points(tiles, now)

    def vacuum(self, spark: SparkSession, now: float) -> int:
        """Removes the folders of writes that have expired, twice over so that no reader holds them; their number. The index goes first."""
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        before, n = int((now - 2 * self.ttl_s) * 1000), 0
        for what in ("index", "points"):
            root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")
            fs = root.getFileSystem(conf)
            # one folder for each batch that was written
            for entry in fs.listStatus(root) if fs.exists(root) else []:
                name = entry.getPath().getName()
                if name.startswith("at=") and int(name[3:]) < before:
                    n += bool(fs.delete(entry.getPath(), True))
        return n
