"""Map layers: points, stacks of equal points, bounds, zoom cells, community rings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from postsieve import schema as S, values as V
from postsieve.operators import geo
from postsieve.operators.geo import community_rollup
from postsieve.operators.quantile import ACCURACY, order_statistics
from postsieve.sources.gazetteer import GAZETTEER_SCHEMA, Places


def uncertainty_m(method: Column, kind: Column) -> Column:
    """How far off a drawn point may be; given coordinates are exact."""
    meters = F.lit(V.UNCERTAINTY_DEFAULT_M)
    for name, m in V.UNCERTAINTY_M.items():
        meters = F.when(kind == name, m).otherwise(meters)
    return F.when(method == "gazetteer", meters).otherwise(0).cast("long")


def valid_point(lat: Column, lon: Column) -> Column:
    return F.coalesce((F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


def points(records: DataFrame) -> DataFrame:
    """One row per record and place that can be drawn."""
    rows = records.select(
        "seq", "id", F.coalesce("labels.category.value", F.lit("unknown")).alias("category"),
        F.coalesce("labels.relevant.confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("labels.severity.value", F.lit(0.0)).alias("severity"),
        F.posexplode("places").alias("pos", "p"))
    return rows.where(valid_point(F.col("p.lat"), F.col("p.lon"))).select(
        "seq", "id", "pos", F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"), "category", "confidence", "severity",
        (F.col("p.method") != "gazetteer").alias("exact"), F.col("p.name").alias("label"),
        F.coalesce("p.kind", F.lit("")).alias("kind"), uncertainty_m(F.col("p.method"), F.col("p.kind")).alias("meters"))


def _spot(df: DataFrame) -> DataFrame:
    return df.withColumn("spot_lon", F.round("lon", 5)).withColumn("spot_lat", F.round("lat", 5))


def stacks(pts: DataFrame) -> DataFrame:
    """One row per spot (five decimals): posts, majority category, best confidence, first label.

    Three aggregates of falling size, so a city that holds a third of all posts is counted in parallel first.
    The ids of a stack stay rows of ``stack_members``.
    """
    spot = ["spot_lon", "spot_lat"]
    first = F.struct("seq", "pos", "id", "lon", "lat", "label", "kind").alias("first")
    per_post = _spot(pts).groupBy(*spot, "category", "id").agg(
        F.count("*").alias("hits"), F.max("confidence").alias("confidence"), F.min("exact").alias("exact"),
        F.min("meters").alias("meters"), F.min(first).alias("first"))
    per_category = per_post.groupBy(*spot, "category").agg(
        F.count("*").alias("n"), F.sum("hits").alias("hits"), F.max("confidence").alias("confidence"),
        F.min("exact").alias("exact"), F.min("meters").alias("meters"), F.min("first").alias("first"))
    # most hits, then first seen
    lead = F.struct((-F.col("hits")).alias("neg"), F.col("first.seq"), F.col("first.pos"), F.col("category"))
    whole = per_category.groupBy(*spot).agg(
        F.sum("n").alias("n"), F.min(lead).alias("lead"), F.max("confidence").alias("confidence"),
        F.min("exact").alias("exact"), F.min("meters").alias("meters"), F.min("first").alias("first"))
    return whole.select(
        *spot, F.col("first.id").alias("id"), F.col("first.lon").alias("lon"), F.col("first.lat").alias("lat"), "n",
        F.col("lead.category").alias("category"), "confidence", "exact", F.col("first.label").alias("label"),
        F.col("first.kind").alias("kind"), "meters",
        (F.col("meters") / (0.1493 * F.cos(F.radians("first.lat")))).alias("r20"))


def stack_members(pts: DataFrame) -> DataFrame:
    return _spot(pts).select("spot_lon", "spot_lat", "id").distinct()


def stack_listing(pts: DataFrame, limit: int = V.STACK_LIST_MAX) -> DataFrame:
    """Up to 100 posts per spot, most urgent first. The rank limit is applied before the shuffle as well."""
    once = _spot(pts).groupBy("spot_lon", "spot_lat", "id", "seq", "severity", "confidence").agg(F.count("*").alias("_n")).drop("_n")
    order = Window.partitionBy("spot_lon", "spot_lat").orderBy(F.desc("severity"), F.desc("confidence"), "seq")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def kth_smallest(df: DataFrame, column: str, k: int, buckets: int = ACCURACY) -> float | None:
    """Exact order statistic; ``buckets`` is the accuracy of the sketch that brackets it."""
    n = df.where(F.col(column).isNotNull()).count()
    found = order_statistics(df, {column: [k / max(1, n - 1)]}, lambda *_: k, buckets)
    return next((f.value for f in found.values() if f), None)


def trimmed_bounds(pts: DataFrame) -> DataFrame:
    """The central 90 percent per axis when there are more than 50 points, else everything. One row, from two passes over the points."""
    def rank(n: int, share: float) -> int:
        if n <= 50:
            return 0 if share < 0.5 else n - 1
        return math.floor(n * 0.05) if share < 0.5 else math.ceil(n * 0.95) - 1
    found = order_statistics(pts, {"lon": [0.05, 0.95], "lat": [0.05, 0.95]}, rank)
    row = [found[axis, share] and found[axis, share].value for share in (0.05, 0.95) for axis in ("lon", "lat")]
    return pts.sparkSession.createDataFrame([tuple(row)], "min_lon double, min_lat double, max_lon double, max_lat double")


def bounding_box(pts: DataFrame) -> DataFrame:
    return pts.agg(F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat"))


def grid(stack_rows: DataFrame, max_zoom: int = V.CLUSTER_MAX_ZOOM, radius_px: int = V.CLUSTER_RADIUS_PX) -> DataFrame:
    """Posts per screen cell and zoom level: Web Mercator cells of the cluster radius."""
    s = F.sin(F.radians("lat"))
    x = (F.col("lon") + 180) / 360
    y = F.lit(0.5) - F.log((1 + s) / (1 - s)) / (4 * math.pi)
    zoomed = stack_rows.withColumn("x", x).withColumn("y", y).withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(max_zoom))))
    scale = F.pow(F.lit(2.0), F.col("z")) * 512 / radius_px
    return (zoomed.groupBy("z", F.floor(F.col("x") * scale).alias("cx"), F.floor(F.col("y") * scale).alias("cy"))
            .agg(F.count("*").alias("stacks"), F.sum("n").alias("total")))


def reserve_table(spark, places: Places | DataFrame | None = None) -> DataFrame:
    """Reserve points of the gazetteer, of any size; one row per reserve."""
    if isinstance(places, DataFrame):
        return places.where("kind = 'reserve'").select("name", F.coalesce("community", "name").alias("community"), "lat", "lon")
    rows = [r for r in (places or Places.of()).rows if r["kind"] == "reserve"]
    return spark.createDataFrame(rows, GAZETTEER_SCHEMA).select(
        "name", F.coalesce("community", "name").alias("community"), "lat", "lon")


def _with_counts(reserves: DataFrame, records: DataFrame) -> DataFrame:
    counts = community_rollup(records).select(F.col("name").alias("community"), F.col("count").alias("posts"))
    return reserves.join(counts, "community", "left").fillna(0, ["posts"])


def rings(reserves: DataFrame, records: DataFrame, radius_km: float = V.COMMUNITY_RADIUS_KM, steps: int = 64) -> DataFrame:
    """A circle of 65 vertices around every reserve, and whether any record lies with its community."""
    d_lat = radius_km / V.KM_PER_DEGREE
    angle = lambda i: i / steps * (2 * math.pi)
    ring = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.struct(
        (F.col("lon") + F.lit(radius_km) / (V.KM_PER_DEGREE * F.cos(F.radians("lat"))) * F.sin(angle(i))).alias("lon"),
        (F.col("lat") + d_lat * F.cos(angle(i))).alias("lat")))
    return _with_counts(reserves, records).select("name", "community", (F.col("posts") > 0).alias("has_posts"), ring.alias("ring"))


def label_points(reserves: DataFrame, records: DataFrame) -> DataFrame:
    unit = F.when(F.col("posts") == 1, " post").otherwise(" posts")
    named = F.when(F.col("posts") > 0, F.concat("community", F.lit(", "), F.col("posts").cast("string"), unit)).otherwise(F.col("community"))
    return _with_counts(reserves, records).select(
        named.alias("text"), "posts", "lon", (F.col("lat") - V.COMMUNITY_RADIUS_KM / V.KM_PER_DEGREE).alias("lat"))


def nearest_community_joined(pts: DataFrame, reserves: DataFrame, radius_km: float = V.COMMUNITY_RADIUS_KM) -> DataFrame:
    """(id, community, community_id) for points with a reserve within the radius. Points at one place are measured once."""
    numbered = reserves if "ord" in reserves.columns else reserves.withColumn("ord", F.lit(0))
    near = geo.nearest_community_joined(pts.select("lat", "lon").where("lat IS NOT NULL AND lon IS NOT NULL").distinct(), numbered, radius_km)
    return pts.select("id", "lat", "lon").join(near, ["lat", "lon"]).select("id", F.col("_near.name").alias("community"), F.col("_near.id").alias("community_id"))
