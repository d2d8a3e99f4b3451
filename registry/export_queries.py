"""Export and cache queries."""

from pyspark.sql import functions as F

from postsieve import values as V
from postsieve.operators import cache, decide
from postsieve.operators.profile import EventProfile
from postsieve.plans import export
from postsieve.session import materialize, scratch_path
from registry import views
from registry.core import query
from registry.records import LABELS_SQL, labels, record_ctes, records, records_table
from registry.text_queries import cell_sql, q, redact_sql, short_sql
from registry.theme_queries import LABEL, SIZES, SPOTS, briefs_sql
from registry.views import answers_sql, posts_sql, with_sql

R = record_ctes()
CAT_LBL = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.CATEGORY_LABELS.items()) + " END"
BAND = "(CASE WHEN severity >= 1.5 THEN 2 WHEN severity >= 0.75 THEN 1 ELSE 0 END)"
SEV_LBL = f"CASE {BAND} WHEN 2 THEN 'Urgent' WHEN 1 THEN 'Notable' ELSE 'Background' END"
GEO_LBL = "CASE p.method WHEN 'exif' THEN 'Exact' WHEN 'provided' THEN 'Given' WHEN 'gazetteer' THEN 'Inferred' END"


@query("x1_geojson_features", with_sql(
    f"""SELECT r.id, CAST(p.pos AS BIGINT) AS pos, r.text, category AS cat, {CAT_LBL} AS cat_lbl, {BAND} AS sev, {SEV_LBL} AS sev_lbl, rel_conf, p.confidence AS pl_conf,
        p.method AS geo_m, {GEO_LBL} AS geo_lbl, firsthand, classifier AS clsfr, model_version AS model_ver, p.community, r.ts, CAST(NULL AS VARCHAR) AS author, p.lon, p.lat
        FROM rec r JOIN placed p USING (id)""", **R))
def x1(spark, sf):
    """Features parsed back from the exported JSON."""
    schema = ("properties struct<id string, text string, cat string, cat_lbl string, sev int, sev_lbl string, rel_conf double, pl_conf double, geo_m string, "
              "geo_lbl string, firsthand boolean, clsfr string, model_ver string, community string, ts string, author string>, geometry struct<coordinates array<double>>")
    f = export.features(records(spark, sf)).select("pos", F.from_json("feature", schema).alias("f"))
    return f.select(F.col("pos").cast("long").alias("pos"), "f.properties.*", F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"))


@query("x1_features_with_authors", with_sql("SELECT author, count(*) AS n FROM rec JOIN placed USING (id) GROUP BY author", **R))
def x1_authors(spark, sf):
    f = export.features(records(spark, sf), include_authors=True)
    return f.groupBy(F.get_json_object("feature", "$.properties.author").alias("author")).agg(F.count("*").alias("n"))


@query("x2_omitted_no_place", with_sql("SELECT count(*) FILTER (NOT mapped) AS omitted_no_place FROM rec", **R))
def x2(spark, sf):
    return export.omitted_no_place(records(spark, sf))


def _num(x):
    return f"regexp_replace(CAST({x} AS VARCHAR), '\\.0$', '')"


_CELLS = [("r.id",), ("r.text",), ("category",), (CAT_LBL,), (f"CAST({BAND} AS VARCHAR)",), (SEV_LBL,), (_num("rel_conf"),), (_num("p.lat"),), (_num("p.lon"),),
          (_num("p.confidence"),), ("p.method",), (GEO_LBL,), ("CAST(firsthand AS VARCHAR)",), ("classifier",), ("model_version",), ("p.community",), ("''",), ("r.ts",)]


@query("x3_csv_lines", with_sql(
    "SELECT id, pos, " + " || ',' || ".join(cell_sql(f"c{i}") for i in range(len(_CELLS))) + " AS line FROM (SELECT r.id, coalesce(CAST(p.pos AS BIGINT), 0) AS pos, "
    + ", ".join(f"coalesce({c[0]}, '') AS c{i}" for i, c in enumerate(_CELLS)) + " FROM rec r LEFT JOIN placed p USING (id))", **R))
def x3(spark, sf):
    return export.csv_lines(records(spark, sf)).select("id", F.col("pos").cast("long").alias("pos"), "line")


CSV_LINES = ("SELECT " + " || ',' || ".join(cell_sql(f"c{i}") for i in range(len(_CELLS))) + " AS line FROM (SELECT "
             + ", ".join(f"coalesce({c[0]}, '') AS c{i}" for i, c in enumerate(_CELLS)) + " FROM rec r LEFT JOIN placed p USING (id))")


@query("x3_csv_file", with_sql(f"SELECT line, count(*) AS n, 'each' AS headers FROM ({CSV_LINES}) GROUP BY line", **R))
def x3_file(spark, sf):
    """Lines read back from the written parts; each part has its own header, which is taken off and counted."""
    path = scratch_path(spark, "export")
    export.write_csv(records(spark, sf), path)
    rows = spark.read.option("lineSep", "\r\n").text(path).select("value", F.input_file_name().alias("file"))
    head = F.regexp_replace("value", "^\ufeff", "") == export.csv_header()
    per_file = rows.groupBy("file").agg(F.count_if(head).alias("heads")).agg(F.min("heads").alias("lo"), F.max("heads").alias("hi"))
    said = per_file.select(F.when((F.col("lo") == 1) & (F.col("hi") == 1), "each").otherwise("wrong").alias("headers"))
    return rows.where(~head).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n")).crossJoin(said)


@query("x1_geojson_files", with_sql("SELECT count(*) AS features, min(placed.lon) AS west, max(placed.lat) AS north FROM rec JOIN placed USING (id)", **R))
def x1_files(spark, sf):
    """Features and bounding box read back from the written collections."""
    path = scratch_path(spark, "geojson")
    export.write_geojson(records(spark, sf), path)
    files = spark.read.schema("type string, bbox array<double>, features array<struct<type: string>>").option("multiLine", True).json(path)
    return files.where("type = 'FeatureCollection'").agg(F.sum(F.size("features")).alias("features"), F.min(F.col("bbox")[0]).alias("west"), F.max(F.col("bbox")[3]).alias("north"))


def brief_sql():
    return """SELECT section, CAST(rank AS BIGINT) AS rank, line FROM (
      SELECT 0 AS section, 0 AS rank, '# flood in public posts, 2024-01-01' AS line
      UNION ALL SELECT 0, 1, 'Draft. Labels are a program''s estimates for people to check; figures count posts.'
      UNION ALL SELECT 1, 0, '## Figures'
      UNION ALL SELECT 1, 1, '* posts: ' || count(*) || ', relevant: ' || count(*) FILTER (relevant) FROM rec
      UNION ALL SELECT 1, 2, '* relevant with a place: ' || count(*) FILTER (relevant AND mapped) || ', without: ' || count(*) FILTER (relevant AND NOT mapped) FROM rec
      UNION ALL SELECT 1, 3, '* read by the model: ' || count(*) FILTER (classifier = 'model') || ', by rules: ' || count(*) FILTER (classifier <> 'model') FROM rec
      UNION ALL SELECT 1, 4, '* model versions: ' || string_agg(DISTINCT model_version, ', ' ORDER BY model_version) FROM rec
      UNION ALL SELECT DISTINCT 2, 0, '## Communities' FROM seen_names
      UNION ALL SELECT 2, row_number() OVER (ORDER BY n DESC, seq, pos), '* ' || community || ': ' || n FROM seen_names
      UNION ALL SELECT DISTINCT 3, 0, '## Themes' FROM sizes
      UNION ALL SELECT 3, row_number() OVER (ORDER BY size DESC, category), '* ' || """ + LABEL + """ || ': ' || size || coalesce('; ' || (SELECT string_agg(name || ' ' || count, ', ' ORDER BY rank) FROM spots p WHERE p.category = s.category), '') FROM sizes s
      UNION ALL SELECT 4, 0, '## Summary'
      UNION ALL SELECT 4, 1, brief FROM briefs)"""


NAMED = """SELECT community, count(*) AS n, min(seq) AS seq, min_by(pos, seq * 1000 + pos) AS pos FROM (
  SELECT community, p.pos, r.seq FROM placed p JOIN rec r USING (id) WHERE relevant AND community IS NOT NULL) GROUP BY community"""


@query("x4_situation_brief", with_sql(brief_sql(), **R, sizes=SIZES, spots=SPOTS, seen_names=NAMED, **briefs_sql("SELECT '' AS scope, id FROM rec", "")))
def x4(spark, sf):
    """Every line of the brief."""
    return export.brief_lines(records_table(spark, sf), EventProfile(hazard="flood"), today="2024-01-01")


SMS = f"""SELECT *, sum(length(line) + 3) OVER (ORDER BY s DESC, seq) AS used, row_number() OVER (ORDER BY s DESC, seq) AS rank FROM (
  SELECT seq, (CASE WHEN category = 'rescue_request' THEN 100 ELSE 0 END) + (CASE WHEN category = 'access_blocked' THEN 80 ELSE 0 END) + (CASE WHEN mapped THEN 20 ELSE 0 END)
    + coalesce(severity, 0) * 5 + (CASE WHEN firsthand THEN 5 ELSE 0 END) AS s,
    coalesce({CAT_LBL}, 'Report') || coalesce(' @ ' || first_place, '') || ': ' || {short_sql('text', 80)} AS line FROM rec WHERE relevant)"""
SMS_HEAD = "'Flood update, ' || (SELECT count(*) FROM rec WHERE relevant) || ' auto-classified post(s):'"


@query("x5_sms_digest", with_sql(f"SELECT {SMS_HEAD} || (SELECT string_agg(' | ' || line, '' ORDER BY rank) FROM sms WHERE used + length({SMS_HEAD}) <= 480) AS digest", **R, sms=SMS))
def x5(spark, sf):
    return export.sms_digest(records_table(spark, sf))


@query("o5_sms_packing", with_sql(f"SELECT CAST(rank AS BIGINT) AS rank, line, CAST(used AS BIGINT) AS used FROM sms WHERE rank <= 160", **R, sms=SMS))
def o5(spark, sf):
    return export.sms_lines(records(spark, sf)).select(F.col("rank").cast("long").alias("rank"), "line", "used")


@query("x7_review_log", 'SELECT id, action, "at" FROM (' + views.REVIEWS_SQL + ")")
def x7(spark, sf):
    path = scratch_path(spark, "reviews")
    export.write_review_log(views.reviews(spark, sf), path)
    return spark.read.schema("id string, action string, at long").json(path)


# --- cache ------------------------------------------------------------------------------------

_VERSION = f"'{V.CACHE_VERSION}:' || sha256('q')"
KEY_SQL = f"sha256('flood|' || trim(regexp_replace(nfc_normalize(text), {q(r'\s+')}, ' ', 'g')) || '|' || {_VERSION})"
CACHED = {"posts": posts_sql(), "ans": answers_sql(), "lab": LABELS_SQL, "keyed": f"SELECT *, {KEY_SQL} AS key FROM posts",
          "entry": "SELECT key, max_by(relevant, seq) AS relevant, max_by(has_pii, seq) AS has_pii FROM keyed JOIN lab USING (id) WHERE seq % 3 = 0 AND seq % 30 <> 0 GROUP BY key"}


def _keyed(spark, sf):
    return cache.with_key(views.posts(spark, sf), "flood", questions="q")


def _old_cache(spark, sf):
    """Every third post was labelled before; a few entries came from rules and must not count."""
    k = _keyed(spark, sf).where("seq % 3 = 0").join(labels(spark, sf), "id")
    k = k.withColumn("classifier", F.when(F.col("seq") % 30 == 0, "heuristic").otherwise(V.MODEL_CLASSIFIER)).withColumn("model_version", F.lit("m0"))
    return k.select("key", "labels", "classifier", "model_version", F.when(decide.pii_fired(), F.lit("was redacted")).alias("redacted_text"),
                    F.col("seq").alias("ts"))


@query("k1_cache_key", with_sql("SELECT id, key FROM keyed", **CACHED))
def k1(spark, sf):
    return _keyed(spark, sf).select("id", "key")


@query("k2_question_version", f"SELECT doc_id, '{V.CACHE_VERSION}:' || sha256(text) AS version FROM documents")
def k2(spark, sf):
    """The version of every text as the wording of questions."""
    d = views.table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", cache.question_version(F.col("text")).alias("version"))


@query("k3_misses", with_sql("SELECT id FROM keyed WHERE key NOT IN (SELECT key FROM keyed WHERE seq % 3 = 0 AND seq % 30 <> 0)", **CACHED))
def k3(spark, sf):
    return cache.misses(_keyed(spark, sf), _old_cache(spark, sf)).select("id")


@query("k4_hits", with_sql(
    "SELECT k.id, CASE WHEN e.has_pii THEN 'was redacted' ELSE k.text END AS text, relevant, 'm0' AS model_version FROM keyed k JOIN entry e USING (key)", **CACHED))
def k4(spark, sf):
    """Every post is looked up; copies of a labelled text are hits too."""
    h = cache.hits(cache.lookup(_keyed(spark, sf), _old_cache(spark, sf)))
    return h.select("id", "text", F.col("labels.relevant.value").alias("relevant"), "model_version")


@query("k5_cacheable", with_sql("SELECT key, CASE WHEN has_pii THEN text END AS redacted_text FROM (SELECT key, has_pii, " + redact_sql("text") + " AS text FROM keyed JOIN lab USING (id) WHERE seq % 2 = 0)", **CACHED))
def k5(spark, sf):
    r = decide.label_posts(_keyed(spark, sf), labels(spark, sf)).withColumn(
        "classifier", F.when(F.col("seq") % 2 == 0, V.MODEL_CLASSIFIER).otherwise("heuristic"))
    from postsieve.functions import text as T
    r = r.withColumn("text", F.when(decide.pii_fired(), T.redact(F.col("text"))).otherwise(F.col("text")))
    return cache.entries(r, 7).select("key", "redacted_text")


@query("k6_store_evict", with_sql(
    """SELECT count(*) AS n, count(*) FILTER (ts = 1000000000) AS fresh, CAST(min(ts) AS BIGINT) AS oldest FROM (
       SELECT key, max(ts) AS ts FROM (SELECT key, seq AS ts FROM keyed WHERE seq % 3 = 0 UNION ALL SELECT key, 1000000000 FROM keyed WHERE seq % 10 = 1) GROUP BY key ORDER BY ts DESC LIMIT (SELECT count(*) // 4 FROM posts))""", **CACHED))
def k6(spark, sf):
    old = _old_cache(spark, sf)
    fresh = _keyed(spark, sf).where("seq % 10 = 1").join(labels(spark, sf), "id").withColumn("classifier", F.lit(V.MODEL_CLASSIFIER)).withColumn("model_version", F.lit("m1"))
    n = views.table(spark, sf, "events").count() // 4
    # a snapshot is a table: written once, then cut
    kept = cache.store(old, materialize(cache.entries(fresh, 1000000000), "fresh"), n)
    return kept.agg(F.count("*").alias("n"), F.count_if(F.col("ts") == 1000000000).alias("fresh"), F.min("ts").alias("oldest"))


@query("k6_funnel_delta", with_sql(
    "SELECT count(*) AS prefiltered, count(*) FILTER (relevant) AS relevant FROM keyed JOIN entry USING (key)", **CACHED))
def k6_delta(spark, sf):
    h = cache.hits(cache.lookup(_keyed(spark, sf), _old_cache(spark, sf)))
    return cache.funnel_delta(h).select("prefiltered", "relevant")


@query("k6_cache_table", with_sql(
    """SELECT k.id, relevant, CASE WHEN k.key IN (SELECT key FROM keyed WHERE seq % 5 = 1) THEN 'm1' ELSE 'm0' END AS model_version
       FROM keyed k JOIN (SELECT key, max_by(relevant, seq) AS relevant FROM (
         SELECT key, relevant, seq FROM keyed JOIN lab USING (id) WHERE seq % 3 = 0 AND seq % 30 <> 0
         UNION ALL SELECT key, relevant, 1000000000 + seq FROM keyed JOIN lab USING (id) WHERE seq % 5 = 1) GROUP BY key) USING (key)""", **CACHED))
def k6_table(spark, sf):
    """A table of cached labels, written in two goes and made compact once, against every post."""
    keyed = _keyed(spark, sf)
    fresh = keyed.where("seq % 5 = 1").join(labels(spark, sf), "id").select(
        "key", "labels", F.lit(V.MODEL_CLASSIFIER).alias("classifier"), F.lit("m1").alias("model_version"), F.lit(None).cast("string").alias("redacted_text"), (F.col("seq") + 1000000000).alias("ts"))
    folder = scratch_path(spark, "cache")
    table = cache.CacheTable(spark, "labels_" + folder[-16:], folder, buckets=16)
    table.append(_old_cache(spark, sf))
    table.append(fresh)
    table.compact()
    found = cache.lookup(keyed, table.entries()).where("entry IS NOT NULL")
    return found.select("id", F.col("entry.labels.relevant.value").alias("relevant"), F.col("entry.model_version").alias("model_version"))
