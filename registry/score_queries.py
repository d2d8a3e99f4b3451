"""Scoring queries."""

from dataclasses import replace

from pyspark.sql import functions as F

from postsieve import values as V
from postsieve.functions.settle import settle
from postsieve.operators import profile, score
from registry import views
from registry.core import query
from registry.profile_queries import hz, kept_table, profile_ctes, profile_of
from registry.text_queries import q, tokens_sql
from registry.views import posts_sql, with_sql

SPAM = "(" + " OR ".join(f"regexp_matches(text, {q(p)})" for p in V.SPAM_PATTERNS) + ")"
EMERGENCY = f"regexp_matches(text, {q(V.EMERGENCY_PATTERN)})"


def scored_ctes(hazard="(SELECT hazard FROM verdict)", focused="false"):
    own = "CASE (SELECT h FROM target) " + " ".join(f"WHEN '{h}' THEN {hz(h)}" for h in V.HAZARDS) + " ELSE false END"
    others = "CASE " + " ".join(f"WHEN (SELECT h FROM target) <> '{h}' AND {hz(h)} THEN '{h}'" for h in V.HAZARDS) + " END"
    return {
        **profile_ctes(),
        "target": f"SELECT {hazard} AS h, {focused} AS focused",
        "sig": f"""SELECT seq, {own} AS own, {others} AS other, {EMERGENCY} AS emergency, {SPAM} AS spam,
           EXISTS (SELECT 1 FROM pplaces WHERE contains(lower(text), string_split(alias, ',')[1])) AS near FROM kept""",
        "overlap": f"""SELECT seq, count(DISTINCT term) AS shared FROM (SELECT seq, unnest({tokens_sql('text')}) AS term FROM kept)
           JOIN (SELECT term FROM terms) USING (term) GROUP BY seq""",
        "scored": """SELECT k.*, s.own, s.spam, s.near, s.emergency, coalesce(o.shared, 0) AS shared,
             CASE WHEN own OR focused THEN NULL ELSE other END AS other,
             least(1.0, (CASE WHEN own THEN 0.5 WHEN other IS NOT NULL AND NOT focused THEN 0.3 ELSE 0 END)
               + (CASE WHEN emergency THEN 0.25 ELSE 0 END) + (CASE WHEN near THEN 0.15 ELSE 0 END)
               + least(0.2, 0.04 * coalesce(o.shared, 0))) AS score
           FROM kept k JOIN sig s USING (seq) LEFT JOIN overlap o USING (seq), target""",
        "filtered": f"SELECT *, NOT spam AND score >= {V.PREFILTER_THRESHOLD} AS is_candidate FROM scored",
    }


REASONS = """array_to_string(list_filter([CASE WHEN spam THEN 'matches spam pattern' END,
  CASE WHEN own THEN 'mentions ' || (SELECT h FROM target) WHEN other IS NOT NULL THEN 'mentions ' || other || ' (not the corpus''s dominant hazard)' END,
  CASE WHEN emergency THEN 'emergency vocabulary' END, CASE WHEN near THEN 'names a place from the event area' END,
  CASE WHEN shared > 0 THEN shared || ' shared corpus terms' END], lambda x: x IS NOT NULL), '; ')"""


def scored(spark, sf, change=lambda p: p):
    """Posts scored with the corpus profile, possibly changed, and that profile."""
    posts = kept_table(spark, sf)
    prof = change(profile_of(posts))
    return score.prefilter(score.score_relevance(posts, prof)), prof


@query("f1_hazard_lexicons", "SELECT seq, flood, fire, quake, storm, false AS other FROM (" + with_sql(
    "SELECT seq, " + ", ".join(f"{hz(h)} AS {h}" for h in V.HAZARDS) + " FROM posts", posts=posts_sql()) + ")")
def f1(spark, sf):
    return views.posts(spark, sf).select("seq", *[profile.hazard_match(F.col("text"), h).alias(h) for h in V.ALL_HAZARDS])


@query("f1_hazard_documents", "SELECT doc_id, " + ", ".join(f"{hz(h)} AS {h}" for h in V.HAZARDS) + " FROM documents")
def f1_documents(spark, sf):
    d = views.widen(views.table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", *[profile.hazard_match(F.col("text"), h).alias(h) for h in V.HAZARDS])


@query("f2_emergency", with_sql(f"SELECT seq, {EMERGENCY} AS emergency FROM posts", posts=posts_sql()))
def f2(spark, sf):
    return views.posts(spark, sf).select("seq", score.is_emergency(F.col("text")).alias("emergency"))


@query("f3_spam", with_sql(f"SELECT seq, {SPAM} AS spam FROM posts", posts=posts_sql()))
def f3(spark, sf):
    return views.posts(spark, sf).select("seq", score.is_spam(F.col("text")).alias("spam"))


@query("f4_threshold_split", with_sql("SELECT is_candidate, spam, count(*) AS n FROM filtered GROUP BY 1, 2", **scored_ctes()))
def f4(spark, sf):
    s, _ = scored(spark, sf)
    return s.groupBy("is_candidate", F.col("prefilter.likely_spam").alias("spam")).agg(F.count("*").alias("n"))


R1_SQL = f"SELECT seq, CAST(round(score, 6) AS DOUBLE) AS score, {REASONS} AS reasons, spam FROM scored"


def r1_rows(s):
    return s.select("seq", F.round("prefilter.score", 6).alias("score"), F.array_join("prefilter.reasons", "; ").alias("reasons"),
                    F.col("prefilter.likely_spam").alias("spam"))


@query("r1_score", with_sql(R1_SQL, **scored_ctes()))
def r1(spark, sf):
    return r1_rows(scored(spark, sf)[0])


@query("r1_score_storm_guess", with_sql(R1_SQL, **scored_ctes("'storm'")))
def r1_storm(spark, sf):
    """A wrong guess of the hazard: other hazards earn the smaller credit."""
    return r1_rows(scored(spark, sf, lambda p: replace(p, hazard="storm"))[0])


@query("p9_pinned_hazard", with_sql(R1_SQL, **scored_ctes("'flood'", "true")))
def p9(spark, sf):
    """The user pins the hazard: off-hazard vocabulary earns nothing."""
    return r1_rows(scored(spark, sf, lambda p: p.pinned("flood"))[0])


@query("r2_ranking", with_sql("SELECT seq, CAST(round(score, 6) AS DOUBLE) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, seq) - 1 AS position FROM filtered WHERE is_candidate", **scored_ctes()))
def r2(spark, sf):
    from postsieve.operators.position import with_position
    c = scored(spark, sf)[0].where("is_candidate").select("seq", F.round("prefilter.score", 9).alias("s"))
    return with_position(c, rank="s").select("seq", F.round("s", 6).alias("score"), "position")


@query("r3_heuristic_labels", with_sql(
    f"""SELECT seq, least(0.95, score) >= 0.3 AND NOT spam AS relevant, CAST(0.3 AS DOUBLE) AS relevant_confidence,
        CASE WHEN own THEN (SELECT h FROM target) ELSE 'other' END AS hazard, spam AS is_spam,
        CAST(CASE WHEN spam THEN 0.6 ELSE 0.3 END AS DOUBLE) AS spam_confidence FROM filtered WHERE is_candidate""", **scored_ctes()))
def r3(spark, sf):
    s, p = scored(spark, sf)
    s = s.where("is_candidate").select("seq", score.heuristic_labels(F.col("text"), p).alias("l"))
    return s.select("seq", F.col("l.relevant.value").alias("relevant"), F.col("l.relevant.confidence").alias("relevant_confidence"),
                    F.col("l.hazard.value").alias("hazard"), F.col("l.is_spam.value").alias("is_spam"),
                    F.col("l.is_spam.confidence").alias("spam_confidence"))


@query("r4_dropped_labels", with_sql(
    """SELECT seq, false AS relevant, CAST(0.4 AS DOUBLE) AS confidence, spam AS is_spam FROM filtered WHERE NOT is_candidate""", **scored_ctes()))
def r4(spark, sf):
    s = scored(spark, sf)[0].where("NOT is_candidate").select("seq", score.dropped_labels().alias("l"))
    return s.select("seq", F.col("l.relevant.value").alias("relevant"), F.col("l.relevant.confidence").alias("confidence"),
                    F.col("l.is_spam.value").alias("is_spam"))


def _rule_sql():
    rm = lambda p: f"regexp_matches(text, {q(p)})"
    cat = "CASE " + " ".join(f"WHEN {rm(p)} THEN '{c}'" for p, c, _ in V.CATEGORY_RULES) + " ELSE 'sentiment' END"
    sev = "CASE " + " ".join(f"WHEN {rm(p)} THEN {s}" for p, _, s in V.CATEGORY_RULES) + " ELSE 0 END"
    spam, flood = rm(V.RULE_SPAM_PATTERN), rm(V.RULE_FLOOD_PATTERN)
    return f"""SELECT seq, {flood} AND NOT {spam} AS relevant, CAST(CASE WHEN {spam} THEN 0.91 WHEN {flood} THEN 0.88 ELSE 0.34 END AS DOUBLE) AS confidence,
      {cat} AS category, CAST({sev} AS DOUBLE) AS severity, {rm(V.RULE_REQUEST_PATTERN)} AS is_request,
      NOT {rm(V.RULE_RESHARE_PATTERN)} AS firsthand, {spam} AS is_spam, CASE WHEN {flood} THEN 'flood' ELSE 'other' END AS hazard FROM posts"""


@query("r6_rule_classifier", with_sql(_rule_sql(), posts=posts_sql()))
def r6(spark, sf):
    p = views.posts(spark, sf).select("seq", settle(score.rule_labels(F.col("text"), F.lit(True))).alias("l"))
    v = lambda k: F.col(f"l.{k}.value").alias(k)
    return p.select("seq", v("relevant"), F.col("l.relevant.confidence").alias("confidence"), v("category"), v("severity"),
                    v("is_request"), v("firsthand"), v("is_spam"), v("hazard"))
