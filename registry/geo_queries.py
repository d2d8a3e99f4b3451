"""Geoparsing queries."""

from pyspark.sql import functions as F

from postsieve.functions.settle import settle
from postsieve.operators import geo
from postsieve.sources.gazetteer import Places
from registry import views
from registry.core import query
from registry.geo_sql import gazetteer_sql, hay_sql, ok_sql, km_sql, place_ctes
from registry.views import posts_sql, with_sql

PLACE_COLUMNS = ("id, CAST(pos AS BIGINT) AS pos, name, kind, lat, lon, confidence, method, community, community_id, alternatives")


def place_rows(df):
    """One row per (record, place)."""
    return df.select("id", F.posexplode("places").alias("pos", "p")).select(
        "id", F.col("pos").cast("long").alias("pos"), "p.name", "p.kind", "p.lat", "p.lon", "p.confidence", "p.method",
        F.col("p.community.name").alias("community"), F.col("p.community.id").alias("community_id"),
        F.when(F.col("p.alternatives").isNotNull(), F.array_join(F.col("p.alternatives.name"), "; ")).alias("alternatives"))


@query("g1_alias_index", with_sql(
    "SELECT id, count(*) AS aliases, count(DISTINCT ord) AS entries FROM posts JOIN gaz ON contains(' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || alias || ' ') GROUP BY id",
    posts=posts_sql(), gaz=gazetteer_sql()))
def g1(spark, sf):
    """Aliases and entries each post could name, nested ones included."""
    places = Places.of()
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " ")
    df = views.posts(spark, sf).select("id", words.alias("w"))
    found = df.select("id", settle(geo._inline_candidates(F.col("w"), places)).alias("c")).select("id", F.explode("c").alias("c")).select("id", "c.alias", "c.entries").distinct()
    per = found.select("id", "alias", F.explode("entries").alias("e"))
    return per.groupBy("id").agg(F.count("*").alias("aliases"), F.count_distinct(F.col("e.name")).alias("entries"))


@query("t5_searchable", with_sql(f"SELECT id, {hay_sql()} AS words FROM posts", posts=posts_sql()))
def t5(spark, sf):
    return views.posts(spark, sf).select("id", geo.searchable(F.col("text"), Places.of()).alias("words"))


@query("g2_hashtag_split", with_sql(
    """SELECT id, t.tag, coalesce(max_by(alias || ' ' || trim(regexp_replace(substr(lower(t.tag), length(alias) + 1), '[^a-z0-9]+', ' ', 'g')), length(alias)), '') AS split
       FROM (SELECT id, unnest(list_distinct(regexp_extract_all(text, '#([A-Za-z0-9_]+)', 1))) AS tag FROM posts) t
       LEFT JOIN (SELECT DISTINCT alias FROM gaz WHERE NOT contains(alias, ' ') AND length(alias) >= 3) ON starts_with(lower(tag), alias) AND length(tag) > length(alias) GROUP BY id, t.tag""",
    posts=posts_sql(), gaz=gazetteer_sql()))
def g2(spark, sf):
    """Every hashtag of a post with what it is split into behind its own words; empty where no alias begins it."""
    tags = F.array_distinct(F.regexp_extract_all("text", F.lit("#([A-Za-z0-9_]+)"), F.lit(1)))
    p = views.posts(spark, sf).select("id", F.explode(tags).alias("tag"))
    hay = F.trim(geo.searchable(F.concat(F.lit("#"), "tag"), Places.of()))
    own = F.trim(F.regexp_replace(F.lower("tag"), "[^a-z0-9]+", " "))
    return p.select("id", "tag", hay.alias("hay"), own.alias("own")).select("id", "tag", F.trim(F.substr("hay", F.length("own") + 1)).alias("split"))


@query("g3_accepted_aliases", with_sql("SELECT id, array_to_string(hits, '; ') AS aliases FROM found",
                                       posts=posts_sql(), **place_ctes("posts")))
def g3(spark, sf):
    p = views.posts(spark, sf).where(~geo.accepted_coordinates(F.col("lat"), F.col("lon")))
    return geo.find_aliases(p, None, F.col("text")).select("id", F.array_join(F.col("_hits.alias"), "; ").alias("aliases"))


@query("g4_country_scope", with_sql(f"SELECT {PLACE_COLUMNS} FROM placed", posts=posts_sql(), **place_ctes("posts", countries="'CA'")))
def g4(spark, sf):
    return place_rows(geo.geoparse(views.posts(spark, sf), countries=["CA"]))


@query("g7_geoparse", with_sql(f"SELECT {PLACE_COLUMNS} FROM placed", posts=posts_sql(), **place_ctes("posts")))
def g7(spark, sf):
    """Context vote, choice among namesakes, one hit per place and their order."""
    return place_rows(geo.geoparse(views.posts(spark, sf)))


@query("g7_geoparse_joined", with_sql(f"SELECT {PLACE_COLUMNS} FROM placed", posts=posts_sql(), **place_ctes("posts")))
def g7_joined(spark, sf):
    """The same through the alias join that large gazetteers take."""
    from postsieve.sources.gazetteer import default_gazetteer
    posts = views.posts(spark, sf)
    ok = geo.accepted_coordinates(F.col("lat"), F.col("lon"))
    df = posts.withColumn("_s", F.when(ok, "").otherwise(F.col("text")))
    df = geo._joined_candidates(df, F.col("_s"), default_gazetteer(spark))
    df = df.withColumn("_hits", geo._accept(F.col("_cands")))
    df = geo._resolve(df, "_hits", "_found")
    point = geo.provided_place(F.col("lat"), F.col("lon"), Places.of())
    return place_rows(df.withColumn("places", settle(F.when(ok, F.array(point)).otherwise(F.col("_found")))))


@query("g10_provided_points", with_sql(f"SELECT {PLACE_COLUMNS} FROM placed WHERE method = 'provided'", posts=posts_sql(), **place_ctes("posts")))
def g10(spark, sf):
    p = views.posts(spark, sf).where(geo.accepted_coordinates(F.col("lat"), F.col("lon")))
    return place_rows(geo.geoparse(p))


@query("g11_nearest_community", with_sql(
    f"""SELECT id, community, cid AS community_id FROM (SELECT p.id, g.community, g.name AS cid,
        row_number() OVER (PARTITION BY p.id ORDER BY {km_sql('p.lat', 'p.lon', 'g.lat', 'g.lon')}, g.ord) AS r
        FROM posts p JOIN (SELECT DISTINCT ord, name, community, lat, lon FROM gaz WHERE is_first_nation) g
        ON {ok_sql('p.lat', 'p.lon')} AND {km_sql('p.lat', 'p.lon', 'g.lat', 'g.lon')} <= 25) WHERE r = 1""",
    posts=posts_sql(), gaz=gazetteer_sql()))
def g11(spark, sf):
    p = views.posts(spark, sf).where(geo.accepted_coordinates(F.col("lat"), F.col("lon")))
    near = p.select("id", geo.nearest_community(F.col("lat"), F.col("lon"), Places.of()).alias("c")).where("c is not null")
    return near.select("id", F.col("c.name").alias("community"), F.col("c.id").alias("community_id"))


@query("g12_community_rollup", with_sql(
    "SELECT community AS name, count(DISTINCT id) AS count FROM placed WHERE community IS NOT NULL GROUP BY community",
    posts=posts_sql(), **place_ctes("posts")))
def g12(spark, sf):
    return geo.community_rollup(geo.geoparse(views.posts(spark, sf)))


@query("g6_context_votes", with_sql(
    """SELECT id, array_to_string(list_sort(list_distinct(admins)), ',') AS admins, array_to_string(list_sort(list_distinct(nations)), ',') AS countries FROM votes""",
    posts=posts_sql(), **place_ctes("posts")))
def g6(spark, sf):
    """Provinces and countries that the unambiguous matches of a post vote for."""
    p = views.posts(spark, sf).where(~geo.accepted_coordinates(F.col("lat"), F.col("lon")))
    hits = geo.find_aliases(p, None, F.col("text")).select("id", settle(F.filter("_hits", lambda m: F.size(m["entries"]) == 1)).alias("u")).where("size(u) > 0")
    votes = lambda field: F.array_join(F.array_sort(F.array_distinct(F.transform("u", lambda m: F.get(m["entries"], 0)[field]))), ",")
    return hits.select("id", votes("admin").alias("admins"), votes("country").alias("countries"))


@query("g8_hits", with_sql("SELECT id, name, confidence, community FROM placed WHERE method = 'gazetteer'", posts=posts_sql(), **place_ctes("posts")))
def g8(spark, sf):
    """One hit per place and post, regions capped, with the community."""
    return place_rows(geo.geoparse(views.posts(spark, sf))).where("method = 'gazetteer'").select("id", "name", "confidence", "community")


@query("g9_hit_order", with_sql("SELECT id, string_agg(name, ' > ' ORDER BY pos) AS names FROM placed GROUP BY id", posts=posts_sql(), **place_ctes("posts")))
def g9(spark, sf):
    r = geo.geoparse(views.posts(spark, sf)).where("size(places) > 0")
    return r.select("id", F.array_join("places.name", " > ").alias("names"))
