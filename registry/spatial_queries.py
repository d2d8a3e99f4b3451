"""Map queries."""

from pyspark.sql import functions as F

from postsieve import values as V
from postsieve.operators import spatial
from registry.core import query
from registry.geo_sql import gazetteer_sql, km_sql
from registry.records import record_ctes, records
from registry import views
from registry.views import with_sql

_M = "CASE WHEN method <> 'gazetteer' THEN 0 ELSE CASE kind " + " ".join(f"WHEN '{k}' THEN {m}" for k, m in V.UNCERTAINTY_M.items()) + " ELSE 3000 END END"
PTS = {**record_ctes(), "pts": f"""SELECT r.seq, r.id, p.pos, p.lon, p.lat, coalesce(r.category, 'unknown') AS category,
  coalesce(r.rel_conf, 0) AS confidence, coalesce(r.severity, 0) AS severity, p.method <> 'gazetteer' AS exact, p.name AS label,
  coalesce(p.kind, '') AS kind, CAST({_M} AS BIGINT) AS meters, round(p.lon, 5) AS spot_lon, round(p.lat, 5) AS spot_lat
  FROM placed p JOIN rec r USING (id) WHERE abs(p.lat) <= 90 AND abs(p.lon) <= 180"""}
STACKS = """SELECT s.*, t.category FROM (
  SELECT spot_lon, spot_lat, count(DISTINCT id) AS n, max(confidence) AS confidence, bool_and(exact) AS exact, min(meters) AS meters,
    arg_min(label, seq * 100 + pos) AS label, arg_min(kind, seq * 100 + pos) AS kind, arg_min(id, seq * 100 + pos) AS id,
    arg_min(lat, seq * 100 + pos) AS lat, arg_min(lon, seq * 100 + pos) AS lon FROM pts GROUP BY 1, 2) s
  JOIN (SELECT * FROM (SELECT spot_lon, spot_lat, category, row_number() OVER (PARTITION BY spot_lon, spot_lat ORDER BY count(*) DESC, min(seq * 100 + pos)) AS r
    FROM pts GROUP BY 1, 2, 3) WHERE r = 1) t USING (spot_lon, spot_lat)"""


def pts(spark, sf):
    return spatial.points(records(spark, sf))


@query("g13_uncertainty", with_sql("SELECT kind, meters, count(*) AS n FROM pts GROUP BY 1, 2", **PTS))
def g13(spark, sf):
    return pts(spark, sf).groupBy("kind", "meters").agg(F.count("*").alias("n"))


@query("g14_points", with_sql("SELECT id, CAST(pos AS BIGINT) AS pos, lon, lat, category, confidence, exact, label, kind, meters FROM pts", **PTS))
def g14(spark, sf):
    return pts(spark, sf).select("id", F.col("pos").cast("long").alias("pos"), "lon", "lat", "category", "confidence", "exact", "label", "kind", "meters")


@query("f7_valid_points", "SELECT event_id AS seq FROM (" + with_sql("SELECT seq AS event_id FROM posts WHERE abs(lat) <= 90 AND abs(lon) <= 180", posts=views.posts_sql()) + ")")
def f7(spark, sf):
    return views.posts(spark, sf).where(spatial.valid_point(F.col("lat"), F.col("lon"))).select("seq")


@query("g15_stacks", with_sql(
    "SELECT id, lon, lat, CAST(n AS BIGINT) AS n, category, confidence, exact, label, kind, meters, CAST(round(meters / (0.1493 * cos(radians(lat))), 4) AS DOUBLE) AS r20 FROM st",
    **PTS, st=STACKS))
def g15(spark, sf):
    return spatial.stacks(pts(spark, sf)).drop("spot_lon", "spot_lat").withColumn("r20", F.round("r20", 4))


@query("g15_stack_members", with_sql("SELECT DISTINCT spot_lon, spot_lat, id FROM pts", **PTS))
def g15_members(spark, sf):
    return spatial.stack_members(pts(spark, sf))


@query("g16_trimmed_bounds", with_sql(
    """SELECT max(lon) FILTER (a = CASE WHEN n > 50 THEN floor(n * 0.05) ELSE 0 END) AS min_lon,
       max(lat) FILTER (b = CASE WHEN n > 50 THEN floor(n * 0.05) ELSE 0 END) AS min_lat,
       max(lon) FILTER (a = CASE WHEN n > 50 THEN ceil(n * 0.95) - 1 ELSE n - 1 END) AS max_lon,
       max(lat) FILTER (b = CASE WHEN n > 50 THEN ceil(n * 0.95) - 1 ELSE n - 1 END) AS max_lat
       FROM (SELECT lon, lat, count(*) OVER () AS n, row_number() OVER (ORDER BY lon) - 1 AS a, row_number() OVER (ORDER BY lat) - 1 AS b FROM pts)""", **PTS))
def g16(spark, sf):
    from postsieve.session import materialize
    return spatial.trimmed_bounds(materialize(pts(spark, sf).select("lon", "lat"), "points"))


@query("g17_zoom_cells", with_sql(
    """SELECT CAST(z AS BIGINT) AS z, CAST(floor((lon + 180) / 360 * pow(2.0, z) * 512 / 45) AS BIGINT) AS cx,
       CAST(floor((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * pow(2.0, z) * 512 / 45) AS BIGINT) AS cy,
       count(*) AS stacks, CAST(sum(n) AS BIGINT) AS total FROM st, range(12) t(z) GROUP BY 1, 2, 3""", **PTS, st=STACKS))
def g17(spark, sf):
    g = spatial.grid(spatial.stacks(pts(spark, sf)))
    return g.withColumn("z", F.col("z").cast("long"))


RES = {"res": "SELECT DISTINCT name, coalesce(community, name) AS community, lat, lon FROM gaz WHERE kind = 'reserve'",
       "cc": "SELECT community, count(DISTINCT id) AS posts FROM placed WHERE community IS NOT NULL GROUP BY 1"}


@query("g18_rings", with_sql(
    """SELECT name, coalesce(posts, 0) > 0 AS has_posts, CAST(i AS BIGINT) AS i,
       CAST(round(lon + 25.0 / (111.32 * cos(radians(lat))) * sin(i / 64.0 * 2 * pi()), 6) AS DOUBLE) AS ring_lon,
       CAST(round(lat + 25.0 / 111.32 * cos(i / 64.0 * 2 * pi()), 6) AS DOUBLE) AS ring_lat
       FROM res LEFT JOIN cc USING (community), range(65) t(i)""", **record_ctes(), **RES))
def g18(spark, sf):
    r = spatial.rings(spatial.reserve_table(spark), records(spark, sf))
    return r.select("name", "has_posts", F.posexplode("ring").alias("i", "v")).select(
        "name", "has_posts", F.col("i").cast("long").alias("i"), F.round("v.lon", 6).alias("ring_lon"), F.round("v.lat", 6).alias("ring_lat"))


@query("g19_community_labels", with_sql(
    """SELECT CASE WHEN coalesce(posts, 0) > 0 THEN community || ', ' || posts || CASE WHEN posts = 1 THEN ' post' ELSE ' posts' END ELSE community END AS text,
       coalesce(posts, 0) AS posts, lon, CAST(round(lat - 25 / 111.32, 6) AS DOUBLE) AS lat FROM res LEFT JOIN cc USING (community)""", **record_ctes(), **RES))
def g19(spark, sf):
    return spatial.label_points(spatial.reserve_table(spark), records(spark, sf)).withColumn("lat", F.round("lat", 6))


@query("g20_stack_listing", with_sql(
    """SELECT spot_lon, spot_lat, id, CAST(rank AS BIGINT) AS rank FROM (SELECT spot_lon, spot_lat, id,
       row_number() OVER (PARTITION BY spot_lon, spot_lat ORDER BY severity DESC, confidence DESC, seq) AS rank
       FROM (SELECT DISTINCT spot_lon, spot_lat, id, seq, severity, confidence FROM pts)) WHERE rank <= 100""", **PTS))
def g20(spark, sf):
    return spatial.stack_listing(pts(spark, sf)).select("spot_lon", "spot_lat", "id", F.col("rank").cast("long").alias("rank"))


@query("g21_bounding_box", with_sql("SELECT min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat FROM pts", **PTS))
def g21(spark, sf):
    return spatial.bounding_box(pts(spark, sf))


@query("j6_nearest_join", with_sql(
    f"""SELECT id, community, cid AS community_id FROM (SELECT p.id, g.community, g.name AS cid,
        row_number() OVER (PARTITION BY p.id ORDER BY {km_sql('p.lat', 'p.lon', 'g.lat', 'g.lon')}) AS r
        FROM posts p JOIN (SELECT DISTINCT ord, name, community, lat, lon FROM gaz WHERE is_first_nation) g
        ON abs(p.lat) <= 90 AND {km_sql('p.lat', 'p.lon', 'g.lat', 'g.lon')} <= 25) WHERE r = 1""",
    posts=views.posts_sql(), gaz=gazetteer_sql()))
def j6(spark, sf):
    p = views.posts(spark, sf).where(spatial.valid_point(F.col("lat"), F.col("lon")))
    return spatial.nearest_community_joined(p, spatial.reserve_table(spark))
