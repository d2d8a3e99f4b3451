"""Labelled, placed records from the sample posts, in Spark and as SQL."""

from pyspark.sql import functions as F

from postsieve.functions.settle import settle
from postsieve.operators import decide, dedupe
from postsieve.session import materialize
from registry import views
from registry.dedupe_queries import kept_sql
from registry.geo_sql import place_ctes
from registry.text_queries import redact_sql
from registry.views import answers_sql, posts_sql

VERSION = "m1"


def kept(spark, sf):
    return dedupe.collapse_exact(views.posts(spark, sf))


def labels(spark, sf):
    return decide.to_labels(views.answers(views.posts(spark, sf).select("id", "k")))


def records(spark, sf):
    """Every distinct post with model labels, places, redaction and review state."""
    df = decide.label_posts(kept(spark, sf), labels(spark, sf), model_version=VERSION)
    df = df.withColumn("classifier", F.when(F.col("seq") % 6 == 0, "heuristic").otherwise(F.col("classifier")))
    df = df.withColumn("model_version", F.when(F.col("seq") % 6 != 0, F.concat(F.lit("m"), (F.col("seq") % 2).cast("string"))))
    return decide.finish(df.withColumn("labels", settle(F.col("labels"))), use_place=False)


def records_table(spark, sf):
    """The records written once, for reports that pass over them several times."""
    return materialize(records(spark, sf), "records")


def _pick(question, column, value):
    return f"max({column}) FILTER (question = '{question}') AS {value}"


LABELS_SQL = """SELECT *, greatest(h, r) >= 0.5 AS relevant, abs(greatest(h, r) - 0.5) * 2 AS rel_conf,
  CASE WHEN h >= r THEN 'hazard' ELSE 'response' END AS via FROM (
  SELECT post_id AS id, coalesce(max(noul) FILTER (question = 'hazard_topic'), 0) AS h,
    coalesce(max(noul) FILTER (question = 'response_topic'), 0) AS r,
    max(choice) FILTER (question = 'hazard') AS hazard, max(confidence) FILTER (question = 'hazard') AS hazard_conf,
    max(choice) FILTER (question = 'category') AS category, max(confidence) FILTER (question = 'category') AS cat_conf,
    max(score) FILTER (question = 'severity') AS severity,
    max(noul) FILTER (question = 'has_place') >= 0.5 AS has_place,
    max(noul) FILTER (question = 'is_request') >= 0.5 AS is_request,
    max(noul) FILTER (question = 'has_pii') >= 0.5 AS has_pii,
    max(noul) FILTER (question = 'is_spam') >= 0.5 AS is_spam,
    max(noul) FILTER (question = 'firsthand') >= 0.5 AS firsthand FROM ans GROUP BY post_id)"""


def record_ctes() -> dict[str, str]:
    """Ends in ``rec`` (one row per record) and ``placed`` (one row per record and place)."""
    return {
        "posts": posts_sql(), "kept": kept_sql(), "ans": answers_sql(), "lab": LABELS_SQL,
        "labelled": "SELECT k.*, l.* EXCLUDE (id) FROM kept k LEFT JOIN lab l USING (id)",
        **place_ctes("labelled", "coalesce(NOT has_place, false)"),
        "rec": f"""SELECT l.* EXCLUDE (text), CASE WHEN coalesce(has_pii, false) THEN {redact_sql('text')} ELSE text END AS text,
            CASE WHEN seq % 6 = 0 THEN 'heuristic' ELSE 'model' END AS classifier,
            CASE WHEN seq % 6 <> 0 THEN 'm' || (seq % 2) END AS model_version, 'auto' AS review,
            EXISTS (SELECT 1 FROM placed p WHERE p.id = l.id) AS mapped,
            (SELECT name FROM placed p WHERE p.id = l.id AND pos = 0) AS first_place FROM labelled l""",
    }
