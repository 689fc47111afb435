"""Coordinates, and the nearest-place join behind a grid of cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM, CAP_KM = 6371.0, 60.0
#: A cell is as high as the cap; a point looks in its own and the cells around it.
CELL = math.degrees(CAP_KM / EARTH_KM) * 1.0001


def degrees(parts: Column) -> Column:
    """Degrees, minutes, seconds as an array, or decimal degrees alone."""
    at = lambda k: F.coalesce(F.get(parts, F.lit(k)), F.lit(0.0))
    return F.when(F.size(parts) > 0, at(0) + at(1) / 60 + at(2) / 3600)


def gps_from_exif(lat_ref: Column, lat: Column, lon_ref: Column, lon: Column) -> Column:
    """struct(lat, lon), null unless both are numbers within bounds and not (0, 0)."""
    y = F.when(F.upper(lat_ref) == "S", -degrees(lat)).otherwise(degrees(lat))
    x = F.when(F.upper(lon_ref) == "W", -degrees(lon)).otherwise(degrees(lon))
    ok = ~F.isnan(y) & ~F.isnan(x) & (F.abs(y) <= 90) & (F.abs(x) <= 180) & ~((y == 0) & (x == 0))
    return F.when(F.coalesce(ok, F.lit(False)), F.struct(y.alias("lat"), x.alias("lon")))


def cosine_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Dot product of the unit vectors of two places."""
    a, b, c, d = (F.radians(x) for x in (lat1, lon1, lat2, lon2))
    return F.cos(a) * F.cos(b) * F.cos(c) * F.cos(d) + F.cos(a) * F.sin(b) * F.cos(c) * F.sin(d) + F.sin(a) * F.sin(c)


def _row_cells(row: Column) -> Column:
    """Number of cells around the globe in a row of cells: each at least CELL wide where the row is narrowest."""
    edge = F.greatest(F.abs(row * CELL), F.abs((row + 1) * CELL))
    return F.greatest(F.floor(F.lit(360.0 / CELL) * F.cos(F.radians(F.least(edge, F.lit(90.0))))), F.lit(1)).cast("long")


def nearest_place(points: DataFrame, places: DataFrame, cap_km: float = CAP_KM) -> DataFrame:
    """points: id, lat, lon.  Adds name, state, country of the nearest place within the cap (the first by ``place_id`` on ties), else null.

    places: place_id, name, state, country, lat, lon.  Both sides are dealt to cells, so only neighbours meet."""
    row = lambda lat: F.floor(lat / CELL).cast("long")
    column = lambda lon, n: F.pmod(F.floor((lon + 180.0) / 360.0 * n).cast("long"), n)
    p = places.withColumn("row", row(F.col("lat"))).withColumn("n", _row_cells(F.col("row"))).withColumn("col", column(F.col("lon"), F.col("n")))
    p = p.select("place_id", "name", "state", "country", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), "row", "col")
    around = points.select("id", "lat", "lon", F.explode(F.array(*[row(F.col("lat")) + k for k in (-1, 0, 1)])).alias("row"))
    around = around.withColumn("n", _row_cells(F.col("row"))).withColumn("mid", column(F.col("lon"), F.col("n")))
    cells = F.array_distinct(F.array(*[F.pmod(F.col("mid") + k, F.col("n")) for k in (-1, 0, 1)]))
    around = around.select("id", "lat", "lon", "row", F.explode(cells).alias("col"))
    near = around.join(p, ["row", "col"]).withColumn("dot", cosine_distance(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon"))).where(F.col("dot") >= math.cos(cap_km / EARTH_KM))
    best = near.groupBy("id").agg(F.max_by(F.struct("place_id", "name", "state", "country"), F.struct("dot", -F.col("place_id"))).alias("p"))
    return points.join(best, "id", "left").select(points["*"], F.col("p.name").alias("name"), F.col("p.state").alias("state"), F.col("p.country").alias("country"))
