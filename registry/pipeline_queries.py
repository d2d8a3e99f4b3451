"""The whole way from posts to records, joins by id, and streams against their batch results."""

from pyspark.sql import functions as F

from postsieve import schema as S, values as V
from postsieve.operators import cache, decide, dedupe, facts
from postsieve.plans import triage as plan
from postsieve.session import materialize, scratch_path
from postsieve.streaming import triage_stream as st
from registry import views
from registry.core import query
from registry.geo_sql import gazetteer_sql
from registry.decide_queries import METER_SQL, _IMAGES, meter_ctes
from registry.dedupe_queries import kept_sql
from registry.geo_sql import ok_sql, place_ctes
from registry.profile_queries import kept_table, profile_of
from registry.records import LABELS_SQL, labels, record_ctes
from registry.score_queries import scored_ctes
from registry.views import answers_sql, posts_sql, with_sql

SC = scored_ctes()


def _posts_and_images(spark, sf):
    p = views.posts(spark, sf).withColumn("image_ref", F.lit(None).cast("string"))
    blank = p.withColumn("text", F.when(F.col("seq") % 200 == 3, " ").otherwise(F.col("text")))
    photos = views.image_posts(spark, sf).withColumn("id", F.concat(F.lit("p"), "seq")).withColumn("seq", F.col("seq") + 1000000000)
    return blank.drop("k").unionByName(photos, allowMissingColumns=True)


@query("o6_row_conservation", with_sql(
    """SELECT count(*) AS n, count(*) AS ids, count(*) FILTER (src = 'photo') AS photos, count(*) FILTER (src = 'blank') AS unusable FROM (
       SELECT CASE WHEN seq % 200 = 3 THEN 'blank' ELSE 'text' END AS src FROM posts UNION ALL SELECT 'photo' FROM imgs)""", posts=posts_sql(), imgs=views.IMAGE_POSTS_SQL))
def o6(spark, sf):
    """As many records as posts, every one labelled, ids unique."""
    posts = _posts_and_images(spark, sf)
    r = plan.triage(posts, profile_of(kept_table(spark, sf)), labels(spark, sf), decide.clean_descriptions(views.image_descriptions(spark, sf)))
    r = r.where("labels.relevant is not null")
    none = F.col("image_ref").isNull() & (F.trim("text") == "")
    return r.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count("image_ref").alias("photos"), F.count_if(none).alias("unusable"))


@query("r5_unusable_rows", with_sql("SELECT 'record ' || id || ' has no text and no image' AS reason FROM posts WHERE seq % 200 = 3", posts=posts_sql()))
def r5(spark, sf):
    return plan.unusable_rejects(_posts_and_images(spark, sf)).select("reason")


FULL = {**SC, "ans": answers_sql("kept"), "lab": LABELS_SQL,
        "scope": "SELECT DISTINCT country FROM pplaces JOIN gaz USING (alias)"}


def full_ctes():
    """Records of the full way with the detected profile and model labels for the candidates."""
    c = {**SC, "ans": answers_sql("kept"), "lab": LABELS_SQL,
         "joined": """SELECT f.*, l.* EXCLUDE (id, hazard, relevant, rel_conf, is_spam), CASE WHEN is_candidate THEN l.relevant ELSE false END AS relevant,
            CASE WHEN is_candidate THEN l.rel_conf ELSE 0.4 END AS rel_conf FROM filtered f LEFT JOIN lab l USING (id)"""}
    p = place_ctes("joined", "NOT is_candidate OR coalesce(NOT has_place, false)", countries="SELECT country FROM scope")
    ctes = {**c, "gaz": p.pop("gaz"), "scope": "SELECT DISTINCT country FROM pplaces JOIN gaz USING (alias)"}
    ctes.update(p)
    return ctes


@query("o7_full_triage", with_sql(
    """SELECT id, is_candidate, relevant, CAST(rel_conf AS DOUBLE) AS rel_conf, CASE WHEN is_candidate THEN 'model' ELSE 'heuristic' END AS classifier,
       (SELECT count(*) FROM placed p WHERE p.id = j.id) AS places FROM joined j""", **full_ctes()))
def o7(spark, sf):
    """Dedupe, profile, prefilter, labels, places; then later posts are added under the same profile."""
    kept = kept_table(spark, sf)
    profile = profile_of(kept)
    lab = labels(spark, sf)
    first = plan.triage(kept.where("seq % 4 <> 1"), profile, lab)
    r = plan.add(first, plan.triage(kept.where("seq % 4 = 1"), profile, lab))
    return r.select("id", "is_candidate", F.col("labels.relevant.value").alias("relevant"), F.col("labels.relevant.confidence").alias("rel_conf"),
                    "classifier", F.size("places").cast("long").alias("places"))


FUNNEL_SQL = """SELECT CAST(sum(duplicate_count) AS BIGINT) AS raw, count(*) AS deduped, count(*) FILTER (is_candidate) AS prefiltered, count(*) FILTER (relevant) AS relevant,
  count(*) FILTER (relevant AND mapped) AS mappable, count(*) FILTER (relevant AND NOT mapped) AS no_place
  FROM (SELECT *, EXISTS (SELECT 1 FROM placed p WHERE p.id = j.id) AS mapped FROM joined j)"""


def _funnel(spark, sf):
    kept = kept_table(spark, sf)
    return facts.funnel(plan.triage(kept, profile_of(kept), labels(spark, sf)))


@query("a9_funnel", with_sql(FUNNEL_SQL, **full_ctes()))
def a9(spark, sf):
    """Every stage of the full way, the prefilter with it."""
    return _funnel(spark, sf)


@query("a9_funnel_observed", with_sql(FUNNEL_SQL, **full_ctes()))
def a9_observed(spark, sf):
    """The stage counts observed while the records are written: no pass of their own."""
    kept = kept_table(spark, sf)
    records, seen = facts.observed_funnel(plan.triage(kept, profile_of(kept), labels(spark, sf)))
    records.select("id", "labels", "places").write.parquet(scratch_path(spark, "records"))
    return spark.createDataFrame([tuple(seen.get[c] for c in facts.FUNNEL)], ", ".join(f"{c} long" for c in facts.FUNNEL))


@query("a9_funnel_shares", with_sql(
    """SELECT CAST(round(mappable * 100.0 / greatest(raw, 1), 6) AS DOUBLE) AS mapped_pct, CAST(round(no_place * 100.0 / greatest(raw, 1), 6) AS DOUBLE) AS unplaced_pct,
       CAST(round(greatest(0, 100 - (mappable + no_place) * 100.0 / greatest(raw, 1)), 6) AS DOUBLE) AS remainder_pct FROM fun""", **full_ctes(), fun=FUNNEL_SQL))
def a9_shares(spark, sf):
    s = facts.funnel_shares(_funnel(spark, sf))
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


@query("o7_cache_and_budget", with_sql(
    """SELECT id, is_candidate, CASE WHEN hit OR pos <= 399 THEN 'model' ELSE 'heuristic' END AS classifier, is_candidate AND hit AS cached FROM (
       SELECT *, CASE WHEN is_candidate AND NOT hit THEN row_number() OVER (PARTITION BY is_candidate, hit ORDER BY score DESC, seq) - 1 END AS pos
       FROM (SELECT *, is_candidate AND seq % 3 = 0 AS hit FROM filtered))""", **SC))
def o7_budget(spark, sf):
    """Hits, misses, and a budget that ends the calls after the four hundredth."""
    kept = kept_table(spark, sf)
    profile, lab = profile_of(kept), materialize(labels(spark, sf), "labels")  # labels and cache are read several times each
    old = cache.with_key(kept.where("seq % 3 = 0"), profile.hazard).join(lab, "id").select(
        "key", "labels", F.lit(V.MODEL_CLASSIFIER).alias("classifier"), F.lit("m0").alias("model_version"), F.lit(None).cast("string").alias("redacted_text"), F.lit(1).cast("long").alias("ts"))
    old = materialize(old, "cache")
    calls = kept.select("id", F.lit(200).alias("status"), F.lit(0.25).alias("cost"), F.lit(False).alias("own_key"))
    paid = materialize(plan.paid_labels(kept, profile, lab, calls, old, budget=100.0), "paid")
    r = plan.triage(kept, profile, paid.select("id", "labels")).join(paid.select("id", "cached"), "id", "left")
    return r.select("id", "is_candidate", "classifier", F.coalesce("cached", F.lit(False)).alias("cached"))


@query("j1_labels_by_id", with_sql("SELECT id, l.relevant FROM kept LEFT JOIN lab l USING (id)", posts=posts_sql(), kept=kept_sql(), ans=answers_sql(), lab=LABELS_SQL))
def j1(spark, sf):
    j = decide.label_posts(dedupe.collapse_exact(views.posts(spark, sf)), labels(spark, sf))
    return j.select("id", F.col("labels.relevant.value").alias("relevant"))


@query("j3_new_only", with_sql("SELECT id FROM posts WHERE id NOT IN (SELECT 'e' || doc_id FROM documents)", posts=posts_sql()))
def j3(spark, sf):
    known = views.table(spark, sf, "documents").select(F.concat(F.lit("e"), "doc_id").alias("id"))
    return views.posts(spark, sf).join(known, "id", "left_anti").select("id")


@query("j4_text_contains", with_sql(
    """SELECT a.alias, count(*) AS posts FROM posts JOIN (SELECT DISTINCT alias FROM gaz WHERE length(alias) >= 3) a
       ON contains(' ' || regexp_replace(lower(text), '[^a-z0-9 ]', ' | ', 'g') || ' ', ' ' || a.alias || ' ') GROUP BY 1""", posts=posts_sql(), gaz=gazetteer_sql()))
def j4(spark, sf):
    """Every alias of the gazetteer that posts contain, nested ones included, and in how many."""
    from postsieve.operators.geo import with_named_aliases
    from postsieve.sources.gazetteer import Places
    a = with_named_aliases(views.posts(spark, sf).select("text"), F.col("text"), Places.of(), "a").select(F.explode("a").alias("alias"))
    return a.groupBy("alias").agg(F.count("*").alias("posts"))


@query("j5_hashtag_prefix", with_sql("""SELECT tag, max_by(alias, length(alias)) AS alias, any_value(posts) AS posts FROM (SELECT tag, count(*) AS posts FROM (SELECT unnest(regexp_extract_all(lower(text), '#([a-z0-9_]+)', 1)) AS tag FROM posts) GROUP BY 1)
       JOIN (SELECT DISTINCT alias FROM gaz WHERE NOT contains(alias, ' ') AND length(alias) >= 3) ON starts_with(tag, alias) AND length(tag) > length(alias) GROUP BY tag""", posts=posts_sql(), gaz=gazetteer_sql()))
def j5(spark, sf):
    """Hashtags joined with the longest alias they start with."""
    from postsieve.sources.gazetteer import default_gazetteer
    tags = views.posts(spark, sf).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("#([a-z0-9_]+)"), F.lit(1))).alias("tag")).groupBy("tag").agg(F.count("*").alias("posts"))
    prefixes = tags.where("length(tag) > 3").select("tag", "posts", F.explode(F.expr("transform(sequence(3, length(tag) - 1), n -> substring(tag, 1, n))")).alias("alias"))
    aliases = default_gazetteer(spark).select(F.explode("aliases").alias("alias")).where("alias not like '% %'").distinct()
    return prefixes.join(aliases, "alias").groupBy("tag", "posts").agg(F.max_by("alias", F.length("alias")).alias("alias"))


@query("j7_left_with_default", with_sql("SELECT name, coalesce(n, 0) AS posts FROM (SELECT DISTINCT name, community FROM gaz WHERE kind = 'reserve') LEFT JOIN (SELECT community, count(DISTINCT id) AS n FROM placed GROUP BY 1) USING (community)", **record_ctes()))
def j7(spark, sf):
    from postsieve.operators.spatial import _with_counts, reserve_table
    from registry.records import records
    return _with_counts(reserve_table(spark), records(spark, sf)).select("name", "posts")


# --- streams ----------------------------------------------------------------------------------

#: Rows of a file of a stream; a micro-batch has as many files as its rows need, so that its tasks grow in number and not in length.
ROWS_PER_FILE = 25_000


def _files_for(rows, batches=1):
    return max(1, -(-rows // (batches * ROWS_PER_FILE)))


def _stream_of(spark, df, name, batches=4):
    """A file stream of several micro-batches of equally many files."""
    path, files = scratch_path(spark, name), _files_for(df.count(), batches)
    df.repartition(batches * files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def _batches(spark, name, files, *parts):
    """A file stream of a micro-batch per part, in order; each part has so many partitions with rows, or one."""
    path = scratch_path(spark, name)
    for k, part in enumerate(parts):
        part.drop("seq").write.mode("append").parquet(path)
        written = len(spark.read.parquet(path).inputFiles())
        if written != (k + 1) * files:  # a part of fewer files would share its micro-batch with the next one
            raise ValueError(f"part {k} of {name}: {written - k * files} files instead of {files}")
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)


def _run(q):
    """Waits until the stream has taken all that is there, however long that is; its failure is raised here."""
    q.awaitTermination()


STREAM_SQL = {**SC}


SCOPE = "SELECT DISTINCT country FROM gaz WHERE (SELECT mixed FROM verdict) OR NOT EXISTS (SELECT 1 FROM pplaces) OR country IN (SELECT country FROM gaz JOIN pplaces USING (alias))"
_PLACED = place_ctes("filtered", "NOT is_candidate", countries="SELECT country FROM scope")
FILTERED_PLACES = {**SC, "gaz": _PLACED["gaz"], "scope": SCOPE, **_PLACED}


@query("st1_stream_triage", with_sql(
    """SELECT id, is_candidate, is_candidate AND least(0.95, score) >= 0.3 AND NOT spam AS relevant, CAST(CASE WHEN is_candidate THEN 0.3 ELSE 0.4 END AS DOUBLE) AS confidence, spam AS is_spam,
       CASE WHEN NOT is_candidate THEN NULL WHEN own THEN (SELECT h FROM target) ELSE 'other' END AS hazard, coalesce((SELECT string_agg(name, '; ' ORDER BY pos) FROM placed p WHERE p.id = f.id), '') AS places FROM filtered f""", **FILTERED_PLACES))
def st1(spark, sf):
    """A stream of posts under the fixed profile, labelled by rules: labels and places of every record."""
    kept = kept_table(spark, sf)
    profile = profile_of(kept)
    out, check = scratch_path(spark, "out"), scratch_path(spark, "check")
    r = st.triage_stream(_stream_of(spark, kept.select("seq", "id", "text", "lat", "lon"), "in"), profile)
    _run(st.write_append(r.select("id", "is_candidate", "labels", "places"), out, check))
    return spark.read.parquet(out).select("id", "is_candidate", F.col("labels.relevant.value").alias("relevant"), F.round("labels.relevant.confidence", 6).alias("confidence"), F.col("labels.is_spam.value").alias("is_spam"),
                                          F.col("labels.hazard.value").alias("hazard"), F.array_join("places.name", "; ").alias("places"))


@query("st1_late_answers", with_sql(
    "SELECT id, relevant FROM posts LEFT JOIN (SELECT id, relevant FROM lab JOIN posts USING (id) WHERE seq % 7 <> 0 AND seq % 11 <> 0) USING (id)",
    posts=posts_sql(), ans=answers_sql(), lab=LABELS_SQL))
def st1_answers(spark, sf):
    """Answers arrive on a stream of their own: some late, some twice, some never (seq % 7) and some too late (seq % 11)."""
    at = lambda seconds: (F.lit("2024-01-01").cast("timestamp").cast("long") + seconds).cast("timestamp")
    posts = views.posts(spark, sf).select("seq", "id", at(F.col("seq") % 600).alias("at"))
    late = F.when(F.col("seq") % 11 == 0, 7200).otherwise(F.col("seq") % 13 * 60)
    answers = labels(spark, sf).join(posts, "id").where("seq % 7 <> 0").withColumn("answered_at", at(F.col("seq") % 600 + late)).select("seq", "id", "labels", "answered_at")
    answers = materialize(answers, "labels")  # read once for each part
    again = answers.where("seq % 3 = 0").withColumn("labels", F.col("labels").withField("relevant", S.decision(F.lit(None).cast("boolean"), 0.0))).withColumn("answered_at", F.col("answered_at") + F.expr("INTERVAL 1 SECOND"))
    last, files = at(F.lit(90000)), _files_for(answers.count())
    end = lambda df, time: spark.range(0, files, 1, files).select("id").crossJoin(F.broadcast(df.limit(1).drop("id"))).withColumns(
        {"id": F.lit("end"), "seq": F.lit(-1).cast("long"), time: last})
    asked = _batches(spark, "asked", files, posts.repartition(files), end(posts, "at"), end(posts, "at"))
    said = _batches(spark, "answers", files, answers.repartition(files), again.repartition(files), end(answers, "answered_at"), end(answers, "answered_at"))
    out = scratch_path(spark, "out")
    _run(st.write_append(st.labelled_stream(asked, said, "1 hour"), out, scratch_path(spark, "check")))
    return spark.read.parquet(out).where("id <> 'end'").select("id", F.col("labels.relevant.value").alias("relevant"))


@query("st2_metered_ledger", with_sql(METER_SQL, **meter_ctes(0.15001, None)))
def st2_meter(spark, sf):
    """The meter inside a stream of calls in several batches, equal to one pass over the ledger."""
    path, source = scratch_path(spark, "meter"), scratch_path(spark, "calls")
    calls = views.ledger(spark, sf).select("pos", "status", "cost", "own_key")
    size = max(1, -(-calls.count() // 4))
    for k in range(4):
        calls.where(F.floor(F.col("pos") / size) == k).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(source)
    _run(st.write_metered(stream, path, scratch_path(spark, "check"), budget=0.15001))
    return st.metered(spark, path).select("pos", F.round("running_cost", 8).alias("running_cost"), "classifier")


@query("st2_running_funnel", with_sql(
    """SELECT count(*) AS deduped, count(*) FILTER (is_candidate) AS prefiltered, count(*) FILTER (is_candidate AND least(0.95, score) >= 0.3 AND NOT spam) AS relevant FROM filtered""", **SC))
def st2(spark, sf):
    kept = kept_table(spark, sf)
    profile = profile_of(kept)
    r = st.triage_stream(_stream_of(spark, kept.select("seq", "id", "text", "lat", "lon"), "in"), profile)
    log = scratch_path(spark, "funnel")
    _run(st.write_changes(st.running_funnel(r), log, scratch_path(spark, "check"), "complete"))
    return st.latest(spark, log).select("deduped", "prefiltered", "relevant")


@query("st2_running_spend", with_sql("SELECT count(*) AS calls, CAST(round(sum(cost), 8) AS DOUBLE) AS spent FROM led WHERE status = 200 AND NOT own_key", led=views.LEDGER_SQL))
def st2_spend(spark, sf):
    s = _stream_of(spark, views.ledger(spark, sf).select("pos", "status", "cost", "own_key"), "ledger")
    log = scratch_path(spark, "spend")
    _run(st.write_changes(st.running_spend(s), log, scratch_path(spark, "check"), "complete"))
    return st.latest(spark, log).select("calls", F.round("spent", 8).alias("spent"))


@query("st3_upsert_by_id", with_sql("SELECT id, 'new ' || text AS text FROM posts", posts=posts_sql()))
def st3(spark, sf):
    """Records come twice, in any order and also within one batch; the table holds the later version of each id."""
    p = views.posts(spark, sf).select("id", "text", F.lit(1).alias("version"))
    s = _stream_of(spark, p.unionByName(p.select("id", F.concat(F.lit("new "), "text").alias("text"), F.lit(2).alias("version"))), "twice")
    log = scratch_path(spark, "changes")
    _run(st.write_changes(s, log, scratch_path(spark, "check"), "append", key="id", order="version", snapshot_every=2))
    return st.latest(spark, log, "id", "version").select("id", "text")


@query("st5_stream_dedupe", with_sql("SELECT seq, id, text, CAST(duplicate_count AS BIGINT) AS duplicate_count FROM kept", posts=posts_sql(), kept=kept_sql()))
def st5(spark, sf):
    s = _stream_of(spark, views.posts(spark, sf).select("seq", "id", "text"), "posts")
    log = scratch_path(spark, "copies")
    _run(st.write_changes(st.running_copies(s), log, scratch_path(spark, "check"), "update"))
    return st.latest_copies(spark, log).select("seq", "id", "text", "duplicate_count")


@query("st6_fresh_urls", with_sql("SELECT url, 1 AS n FROM u GROUP BY url", u=views.URLS_SQL))
def st6(spark, sf):
    """Every link passes exactly once over several batches that lie within the time to live."""
    u = views.urls(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    out = scratch_path(spark, "urls")
    _run(st.write_append(st.fresh_urls(_stream_of(spark, u, "links", 3), ttl="3650 days"), out, scratch_path(spark, "check")))
    return spark.read.parquet(out).groupBy("url").agg(F.count("*").cast("int").alias("n"))
