"""Copies collapsed."""

from pyspark.sql import functions as F

from postsieve.operators import dedupe
from registry import views
from registry.core import query
from registry.text_queries import docs, key_sql, norm_sql
from registry.views import posts_sql, with_sql


def kept_sql(source: str = "posts", key=key_sql, count: str = "1") -> str:
    """First row per key in seq order with its copy count."""
    return f"""SELECT * EXCLUDE (_k, _r) FROM (
  SELECT *, sum({count}) OVER (PARTITION BY _k) AS duplicate_count, row_number() OVER (PARTITION BY _k ORDER BY seq) AS _r
  FROM (SELECT *, {key('text')} AS _k FROM {source}) WHERE _k <> '') WHERE _r = 1"""


@query("d1_exact_dedupe", with_sql("SELECT seq, id, text, CAST(duplicate_count AS BIGINT) AS duplicate_count FROM kept",
                                   posts=posts_sql(), kept=kept_sql()))
def d1(spark, sf):
    return dedupe.collapse_exact(views.posts(spark, sf)).select("seq", "id", "text", "duplicate_count")


@query("d1_dedupe_documents", with_sql(
    "SELECT seq AS doc_id, CAST(duplicate_count AS BIGINT) AS duplicate_count, length(text) AS n FROM kept",
    d="SELECT doc_id AS seq, text FROM documents", kept=kept_sql("d")))
def d1_documents(spark, sf):
    d = docs(spark, sf).withColumnRenamed("doc_id", "seq")
    return dedupe.collapse_exact(d).select(F.col("seq").alias("doc_id"), "duplicate_count",
                                           F.length("text").cast("long").alias("n"))


@query("d1_removed", with_sql("SELECT CAST(sum(duplicate_count - 1) AS BIGINT) AS removed, count(*) AS kept FROM kept",
                              posts=posts_sql(), kept=kept_sql()))
def d1_removed(spark, sf):
    return dedupe.removed_count(dedupe.collapse_exact(views.posts(spark, sf)))


@query("s10_merge_parts", with_sql(
    "SELECT part, id, CAST(duplicate_count AS BIGINT) AS duplicate_count FROM merged",
    posts=posts_sql(), parts="SELECT *, seq % 3 AS part FROM posts",
    first=f"""SELECT * EXCLUDE (_k, _r) FROM (SELECT *, count(*) OVER (PARTITION BY part, _k) AS dc,
      row_number() OVER (PARTITION BY part, _k ORDER BY seq) AS _r FROM (SELECT *, {key_sql('text')} AS _k FROM parts) WHERE _k <> '') WHERE _r = 1""",
    merged=kept_sql("(SELECT * FROM first)", norm_sql, "dc")))
def s10(spark, sf):
    parts = views.posts(spark, sf).withColumn("part", F.col("seq") % 3)
    # each part is collapsed on its own, then the parts are merged; the merge keeps the retweet prefix
    one_part = dedupe.collapse_exact(parts, within=("part",))
    return dedupe.collapse_exact(one_part, strip_retweets=False).select("part", "id", "duplicate_count")
