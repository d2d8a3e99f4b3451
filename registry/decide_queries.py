"""Decision queries."""

from pyspark.sql import functions as F

from postsieve import values as V
from postsieve.operators import decide, meter
from registry import views
from registry.core import query
from registry.geo_queries import PLACE_COLUMNS, place_rows
from registry.geo_sql import ok_sql, place_ctes
from registry.records import LABELS_SQL, labels, record_ctes, records
from registry.text_queries import q
from registry.views import answers_sql, posts_sql, with_sql

ANS = {"posts": posts_sql(), "ans": answers_sql()}


def answers(spark, sf):
    return views.answers(views.posts(spark, sf).select("id", "k"))


@query("c1_read_answers", with_sql(
    """SELECT post_id, question, CASE WHEN type = 'noul' THEN noul >= 0.5 END AS value_bool,
       CASE WHEN type = 'choice' THEN choice END AS value_text, CASE WHEN type = 'score' THEN score END AS value_number,
       CASE WHEN type = 'noul' THEN abs(noul - 0.5) * 2 ELSE coalesce(confidence, 0) END AS confidence FROM ans""", **ANS))
def c1(spark, sf):
    return decide.read_answers(answers(spark, sf)).drop("type", "noul")


@query("c2_relevance", with_sql("SELECT id, relevant, rel_conf, via FROM lab", **ANS, lab=LABELS_SQL))
def c2(spark, sf):
    return labels(spark, sf).select("id", F.col("labels.relevant.value").alias("relevant"),
                                    F.col("labels.relevant.confidence").alias("rel_conf"), F.col("labels.relevant.via").alias("via"))


@query("c3_labels", with_sql(
    "SELECT id, relevant, hazard, hazard_conf, category, cat_conf, severity, has_place, is_request, has_pii, is_spam, firsthand FROM lab",
    **ANS, lab=LABELS_SQL))
def c3(spark, sf):
    v = lambda k: F.col(f"labels.{k}.value").alias(k)
    return labels(spark, sf).select(
        "id", v("relevant"), v("hazard"), F.col("labels.hazard.confidence").alias("hazard_conf"), v("category"),
        F.col("labels.category.confidence").alias("cat_conf"), v("severity"), *[v(x) for x in V.BOOLEAN_QUESTIONS])


GATE_COLS = ("relevant", "category", "hazard", "has_pii", "is_spam")


@query("c5_gates", with_sql(
    f"""SELECT question, count(*) AS n, count(*) FILTER (conf < gate) AS below FROM (
        SELECT question, CASE WHEN type = 'noul' THEN abs(noul - 0.5) * 2 ELSE confidence END AS conf,
        CASE question WHEN 'category' THEN 0.5 WHEN 'hazard' THEN 0.5 WHEN 'has_pii' THEN 0.3 ELSE 0.7 END AS gate
        FROM ans WHERE question IN ('category', 'hazard', 'has_pii', 'is_spam')
        UNION ALL SELECT 'relevant', rel_conf, 0.6 FROM lab) GROUP BY question""", **ANS, lab=LABELS_SQL))
def c5(spark, sf):
    gates = F.array(*[F.struct(F.lit(g).alias("question"), F.col(f"labels.{g}.confidence").alias("c"),
                               F.lit(V.CONFIDENCE_GATES[g]).alias("gate")) for g in GATE_COLS])
    rows = labels(spark, sf).select(F.explode(gates).alias("g")).select("g.*").where("c is not null")
    return rows.groupBy("question").agg(F.count("*").alias("n"), F.count_if(F.col("c") < F.col("gate")).alias("below"))


@query("c6_redact_on_pii", with_sql("SELECT id, text, coalesce(has_pii, false) AS redacted FROM rec", **record_ctes()))
def c6(spark, sf):
    return records(spark, sf).select("id", "text", F.col("raw_text").isNull().alias("redacted"))


@query("c7_geoparse_gate", with_sql(f"SELECT {PLACE_COLUMNS} FROM placed", **record_ctes()))
def c7(spark, sf):
    return place_rows(records(spark, sf))


@query("c8_review_routing", with_sql(
    "SELECT id, CASE WHEN rel_conf < 0.6 THEN 'auto' ELSE CASE WHEN seq % 2 = 0 THEN 'confirmed' ELSE 'auto' END END AS review FROM posts JOIN lab USING (id)",
    **ANS, lab=LABELS_SQL))
def c8(spark, sf):
    posts = views.posts(spark, sf).select("seq", "id", F.when(F.col("seq") % 2 == 0, "confirmed").otherwise("auto").alias("review"))
    return posts.join(labels(spark, sf), "id").select("id", decide.route_review(F.col("review")).alias("review"))


def _clean_sql(x):
    plain = f"trim(regexp_replace(regexp_replace({x}, {q(r'(?i)\b(verified|confirmed)\b')}, 'reported', 'g'), {q(r'\s+')}, ' ', 'g'))"
    return plain


_in = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
CLEAN_SQL = f"""SELECT id, {_clean_sql('alt_text')} AS alt_text, hazard_visible,
  CASE WHEN hazard IN {_in(V.ALL_HAZARDS)} THEN hazard ELSE 'other' END AS hazard,
  CASE WHEN category IN {_in(V.CATEGORIES)} THEN category ELSE 'sentiment' END AS category,
  CASE WHEN len(ok) > 0 THEN array_to_string(ok, ',') ELSE 'none' END AS submerged,
  CASE WHEN water_depth IN {_in(V.WATER_DEPTHS)} THEN water_depth ELSE 'unclear' END AS water_depth,
  least(1, greatest(0, confidence)) AS confidence,
  CASE WHEN trim(caption) = '' THEN {_clean_sql('alt_text')} ELSE {_clean_sql('caption')} END AS caption, trim(ocr_text) AS ocr_text
  FROM (SELECT *, list_filter(submerged, lambda s: s IN {_in(V.SUBMERGED)}) AS ok FROM raw) WHERE trim(alt_text) <> ''"""


@query("c10_image_hygiene", with_sql("SELECT * FROM clean", raw=views.IMAGE_SQL, clean=CLEAN_SQL))
def c10(spark, sf):
    return decide.clean_descriptions(views.image_descriptions(spark, sf)).withColumn("submerged", F.array_join("submerged", ","))


_IMAGES = {
    "raw": views.IMAGE_SQL, "clean": CLEAN_SQL, "imgs": views.IMAGE_POSTS_SQL, "meta": views.IMAGE_META_SQL,
    "withmeta": f"""SELECT i.seq, i.id, coalesce(i.ts, m.ts) AS ts, CASE WHEN {ok_sql('m.lat', 'm.lon')} THEN m.lat END AS lat,
        CASE WHEN {ok_sql('m.lat', 'm.lon')} THEN m.lon END AS lon FROM imgs i LEFT JOIN meta m USING (id)""",
}


@query("s19_image_meta", with_sql("SELECT id, ts, lat, lon FROM withmeta", **_IMAGES))
def s19(spark, sf):
    return decide.attach_image_meta(views.image_posts(spark, sf), views.image_meta(spark, sf)).select("id", "ts", "lat", "lon")


@query("c9_image_labels", with_sql(
    """SELECT t.id, t.text, coalesce(c.hazard_visible, false) AS relevant, coalesce(c.confidence, 0) AS confidence, c.hazard, c.category,
       CASE WHEN c.id IS NOT NULL THEN coalesce(p.n, 0) > 0 END AS has_place, coalesce(p.n, 0) AS places,
       CASE WHEN c.id IS NULL THEN 'heuristic' ELSE 'model' END AS classifier
       FROM told t LEFT JOIN clean c USING (id) LEFT JOIN (SELECT id, count(*) AS n FROM placed GROUP BY id) p USING (id)""",
    **_IMAGES, told="""SELECT w.*, CASE WHEN c.id IS NULL THEN '' WHEN c.ocr_text <> '' THEN c.ocr_text ELSE c.caption END AS text
       FROM withmeta w LEFT JOIN clean c USING (id)""", **place_ctes("told")))
def c9(spark, sf):
    images = decide.attach_image_meta(views.image_posts(spark, sf), views.image_meta(spark, sf))
    r = decide.label_images(images, decide.clean_descriptions(views.image_descriptions(spark, sf)))
    v = lambda k: F.col(f"labels.{k}.value").alias(k)
    return r.select("id", "text", v("relevant"), F.col("labels.relevant.confidence").alias("confidence"), v("hazard"), v("category"),
                    v("has_place"), F.size("places").cast("long").alias("places"), "classifier")


def meter_ctes(budget, stop):
    return {"led": views.LEDGER_SQL,
            "run": """SELECT *, sum(CASE WHEN status = 200 AND NOT own_key THEN cost ELSE 0 END) OVER w AS running_cost,
                 sum(CASE WHEN status = 200 THEN 1 ELSE 0 END) OVER w AS oks FROM led WINDOW w AS (ORDER BY pos)""",
            "bad": "SELECT *, row_number() OVER (PARTITION BY oks ORDER BY pos) AS streak FROM run WHERE status <> 200",
            "stops": f"""SELECT min(pos) AS stop FROM (SELECT pos FROM run WHERE status = 200 AND NOT own_key AND running_cost >= {budget}
                 UNION ALL SELECT pos FROM bad WHERE status = 402 OR streak >= 30)"""}


METER_SQL = """SELECT pos, CAST(round(running_cost, 8) AS DOUBLE) AS running_cost,
  CASE WHEN status = 200 AND (stop IS NULL OR pos <= stop) THEN 'model' ELSE 'heuristic' END AS classifier FROM run, stops"""


@query("c12_spend_meter", with_sql(METER_SQL, **meter_ctes(0.15001, None)))
def c12(spark, sf):
    m = meter.meter(views.ledger(spark, sf), budget=0.15001, rows_per_bucket=max(1000, 1))
    return m.select("pos", F.round("running_cost", 8).alias("running_cost"), "classifier")


@query("c13_failure_breaker", with_sql(METER_SQL, **meter_ctes(1e9, None)))
def c13(spark, sf):
    m = meter.meter(views.ledger(spark, sf), budget=1e9)
    return m.select("pos", F.round("running_cost", 8).alias("running_cost"), "classifier")


@query("c14_daily_ceiling", with_sql(
    "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(round(sum(cost), 8) AS DOUBLE) AS cost, sum(cost) >= 0.012 AS blocked FROM led WHERE status = 200 AND NOT own_key GROUP BY 1",
    led=views.LEDGER_SQL))
def c14(spark, sf):
    d = meter.daily_spend(views.ledger(spark, sf), ceiling=0.012)
    return d.select(F.col("day").cast("string").alias("day"), F.round("cost", 8).alias("cost"), "blocked")


_REPORTS = "event_id % 8 AS batch, event_id AS tick, 1.5 + CAST(event_id AS DOUBLE) / 1000 AS used, CAST(event_id AS DOUBLE) / 1000 AS spent, event_id % 997 = 5 AS degraded"


@query("c16_merge_spend", with_sql(
    """SELECT CAST(round(greatest(0, (SELECT used - spent FROM rep ORDER BY tick, batch LIMIT 1)) + sum(spent), 6) AS DOUBLE) AS used,
       CAST(round(sum(spent), 6) AS DOUBLE) AS spent, bool_or(degraded) AS degraded
       FROM (SELECT batch, max_by(spent, tick) AS spent, bool_or(degraded) AS degraded FROM rep GROUP BY batch)""",
    rep=f"SELECT {_REPORTS} FROM events"))
def c16(spark, sf):
    reports = views.table(spark, sf, "events").selectExpr(*views._split(_REPORTS)).withColumnRenamed("tick", "at")
    m = meter.merge_spend(reports)
    return m.select(F.round("used", 6).alias("used"), F.round("spent", 6).alias("spent"), "degraded")


REVIEWED = {**record_ctes(), "log": views.REVIEWS_SQL, "last": "SELECT id, max_by(action, \"at\") AS action FROM log GROUP BY id",
            "reviewed": "SELECT r.* EXCLUDE (review), coalesce(l.action, r.review) AS review FROM rec r LEFT JOIN last l USING (id)"}


def gauge_sql(conf, gate, review="review"):
    return (f"CASE WHEN {review} = 'rejected' THEN 'rejected' WHEN {conf} IS NULL THEN 'pending' WHEN classifier = 'heuristic' THEN 'no-reading' "
            f"WHEN {review} = 'confirmed' THEN 'checked' WHEN {conf} < {gate} THEN 'below' ELSE 'measured' END")


CAT_REVIEW = "(CASE WHEN review = 'rejected' THEN 'rejected' ELSE 'auto' END)"


def reviewed(spark, sf):
    return decide.apply_reviews(records(spark, sf), views.reviews(spark, sf))


@query("c17_gauge_states", with_sql(
    f"""SELECT id, {gauge_sql('rel_conf', 0.6)} AS state, {gauge_sql('cat_conf', 0.5, CAT_REVIEW)} AS category_state,
        CASE WHEN {gauge_sql('rel_conf', 0.6)} IN ('rejected', 'pending', 'no-reading') THEN '' ELSE printf('%.2f', rel_conf) END AS number
        FROM reviewed""", **REVIEWED))
def c17(spark, sf):
    return decide.review_state(reviewed(spark, sf)).select(
        "id", F.col("relevant_gauge.state").alias("state"), F.col("category_gauge.state").alias("category_state"),
        F.col("relevant_gauge.number").alias("number"))


@query("c18_severity_band", with_sql(
    "SELECT band, count(*) AS n FROM (SELECT CASE WHEN severity >= 1.5 THEN 2 WHEN severity >= 0.75 THEN 1 ELSE 0 END AS band FROM lab) GROUP BY band",
    **ANS, lab=LABELS_SQL))
def c18(spark, sf):
    return labels(spark, sf).groupBy(decide.severity_band(F.col("labels.severity.value")).alias("band")).agg(F.count("*").alias("n"))


@query("c19_confidence_band", with_sql(
    "SELECT band, count(*) AS n FROM (SELECT CASE WHEN rel_conf >= 0.6 THEN 'firm' WHEN rel_conf >= 0.3 THEN 'probable' ELSE 'uncertain' END AS band FROM lab) GROUP BY band",
    **ANS, lab=LABELS_SQL))
def c19(spark, sf):
    return labels(spark, sf).groupBy(decide.confidence_band(F.col("labels.relevant.confidence")).alias("band")).agg(F.count("*").alias("n"))


@query("c20_review_queue", with_sql(
    f"SELECT id FROM reviewed WHERE {gauge_sql('rel_conf', 0.6)} = 'below' OR (category IS NOT NULL AND {gauge_sql('cat_conf', 0.5, CAT_REVIEW)} = 'below')",
    **REVIEWED))
def c20(spark, sf):
    return decide.review_queue(reviewed(spark, sf)).select("id")


@query("c21_apply_reviews", with_sql("SELECT review, count(*) AS n FROM reviewed GROUP BY review", **REVIEWED))
def c21(spark, sf):
    return reviewed(spark, sf).groupBy("review").agg(F.count("*").alias("n"))


def _word_scorer(texts):
    """A scorer of a few words, for the seam that runs a model per Arrow batch."""
    import pandas as pd
    wet = texts.str.contains("flood|water", regex=True)
    topic = pd.DataFrame({"i": range(len(texts)), "question": "hazard_topic", "type": "noul", "noul": wet.map({True: 0.9, False: 0.2}), "choice": None, "score": None, "confidence": None})
    kind = pd.DataFrame({"i": range(len(texts)), "question": "hazard", "type": "choice", "noul": None, "choice": wet.map({True: "flood", False: "other"}), "score": None, "confidence": 0.7})
    return pd.concat([topic, kind])


@query("u1_batch_scorer", with_sql(
    """SELECT id, wet AS relevant, CAST(round(CASE WHEN wet THEN 0.8 ELSE 0.6 END, 6) AS DOUBLE) AS confidence, CASE WHEN wet THEN 'flood' ELSE 'other' END AS hazard
       FROM (SELECT id, regexp_matches(text, 'flood|water') AS wet FROM posts)""", posts=posts_sql()))
def u1_batch(spark, sf):
    """Answers made by a scorer inside the tasks, through labels."""
    lab = decide.to_labels(decide.decide(views.posts(spark, sf), _word_scorer))
    return lab.select("id", F.col("labels.relevant.value").alias("relevant"), F.round("labels.relevant.confidence", 6).alias("confidence"), F.col("labels.hazard.value").alias("hazard"))


@query("u1_rule_scorer", with_sql(
    f"""SELECT id, regexp_matches(text, {q(V.RULE_FLOOD_PATTERN)}) AND NOT regexp_matches(text, {q(V.RULE_SPAM_PATTERN)}) AS relevant,
        CASE {' '.join(f"WHEN regexp_matches(text, {q(p)}) THEN '{c}'" for p, c, _ in V.CATEGORY_RULES)} ELSE 'sentiment' END AS category FROM posts""",
    posts=posts_sql()))
def u1(spark, sf):
    """The decision seam with the offline rules, through answers and labels."""
    lab = decide.to_labels(decide.decide(views.posts(spark, sf)))
    return lab.select("id", F.col("labels.relevant.value").alias("relevant"), F.col("labels.category.value").alias("category"))
