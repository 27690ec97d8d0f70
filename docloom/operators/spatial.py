"""Coordinates: boxes, centroids, points in polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Degrees of latitude of a band; an area's edges and points meet only within a band.
BAND = 0.05


def valid(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))


def dms_to_decimal(degrees: Column, minutes: Column, seconds: Column, hemisphere: Column) -> Column:
    size = degrees + F.coalesce(minutes, F.lit(0)) / 60.0 + F.coalesce(seconds, F.lit(0)) / 3600.0
    return F.round(F.when(F.upper(hemisphere).isin("S", "W"), -size).otherwise(size), 7)


def admin_level_score(level: Column) -> Column:
    return F.greatest(F.lit(0.2), 1 - 0.06 * level)


def edges(polygons: DataFrame) -> DataFrame:
    """polygons (area, ring of (lat, lon) structs) -> area, lat1, lon1, lat2, lon2; rings close themselves."""
    n = F.size("ring")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("ring", i).alias("p"), F.get("ring", (i + 1) % n).alias("q")))
    return polygons.select("area", F.explode(pairs).alias("e")).select("area", F.col("e.p.lat").alias("lat1"), F.col("e.p.lon").alias("lon1"), F.col("e.q.lat").alias("lat2"), F.col("e.q.lon").alias("lon2"))


def bounding_boxes(polygons: DataFrame) -> DataFrame:
    e = edges(polygons)
    return e.groupBy("area").agg(F.min("lat1").alias("min_lat"), F.min("lon1").alias("min_lon"), F.max("lat1").alias("max_lat"), F.max("lon1").alias("max_lon"))


def points_in_edges(points: DataFrame, e: DataFrame, key: str = "doc_id", band: float = BAND) -> DataFrame:
    """key, area: the least name of the areas, given by their edges, that hold a point.

    A point first meets the areas whose box covers its cell of one degree and lies in the
    box, then the edges of those areas in its narrow band of latitude: two equi-joins. An
    area holds a point if an odd number of its edges lie to the east.
    """
    ends = e.select("area", F.explode(F.array(F.struct(F.col("lat1").alias("lat"), F.col("lon1").alias("lon")), F.struct(F.col("lat2").alias("lat"), F.col("lon2").alias("lon")))).alias("p"))
    boxes = ends.groupBy("area").agg(F.min("p.lat").alias("min_lat"), F.min("p.lon").alias("min_lon"), F.max("p.lat").alias("max_lat"), F.max("p.lon").alias("max_lon"))
    whole = lambda x: F.floor(x).cast("int")
    cells = boxes.withColumn("row", F.explode(F.sequence(whole("min_lat"), whole("max_lat")))).withColumn("column", F.explode(F.sequence(whole("min_lon"), whole("max_lon"))))
    p = points.filter("lat IS NOT NULL AND lon IS NOT NULL").select(key, "lat", "lon", whole("lat").alias("row"), whole("lon").alias("column"))
    near = p.join(cells, ["row", "column"]).filter("lat BETWEEN min_lat AND max_lat AND lon BETWEEN min_lon AND max_lon").select(key, "area", "lat", "lon", whole(F.col("lat") / band).alias("band"))
    sloped = e.filter("lat1 <> lat2")
    bands = F.sequence(whole(F.least("lat1", "lat2") / band), whole(F.greatest("lat1", "lat2") / band))
    crosses = ((F.col("lat1") > F.col("lat")) != (F.col("lat2") > F.col("lat"))) & (F.col("lon") < (F.col("lon2") - F.col("lon1")) * (F.col("lat") - F.col("lat1")) / (F.col("lat2") - F.col("lat1")) + F.col("lon1"))
    hits = near.join(sloped.withColumn("band", F.explode(bands)), ["area", "band"]).filter(crosses)
    return hits.groupBy(key, "area").agg(F.count("*").alias("n")).filter("n % 2 = 1").groupBy(key).agg(F.min("area").alias("area"))


def points_in_areas(points: DataFrame, polygons: DataFrame, key: str = "doc_id", band: float = BAND) -> DataFrame:
    """As points_in_edges, for polygons (area, ring)."""
    return points_in_edges(points, edges(polygons), key, band)


def means(ways: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """ways (id, refs), nodes (id, lat, lon) -> id, lat, lon: the mean of a way's first `most` references that exist."""
    members = ways.select("id", F.explode(F.slice("refs", 1, most)).alias("ref"))
    located = members.join(nodes.select(F.col("id").alias("ref"), "lat", "lon"), "ref")
    return located.groupBy("id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def centroids(ways: DataFrame, nodes: DataFrame, most: int = 50) -> DataFrame:
    """means, rounded as documents show them."""
    return means(ways, nodes, most).select("id", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))
