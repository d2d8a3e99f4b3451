"""Theme and brief queries."""

from pyspark.sql import functions as F

from postsieve import values as V
from postsieve.operators import themes
from registry import views
from registry.core import query
from registry.records import record_ctes, records, records_table
from registry.text_queries import STOP_SQL, tokens_sql
from registry.views import with_sql

LABEL = "CASE category " + " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in V.THEME_LABELS.items()) + " END"
SIZES = """SELECT category, count(*) AS size, 'c_' || row_number() OVER (ORDER BY count(*) DESC, category) AS theme_id
  FROM rec WHERE relevant AND category IS NOT NULL GROUP BY category"""
TOKS = f"""SELECT seq, category, term, p FROM (SELECT seq, category, unnest(t) AS term, generate_subscripts(t, 1) AS p FROM (
  SELECT seq, category, {tokens_sql('text')} AS t FROM rec WHERE relevant))"""
TERMS = """SELECT category, term, odds, row_number() OVER (PARTITION BY category ORDER BY round(odds, 12) DESC, first) AS rank FROM (
  SELECT c.category, c.term, c.first, ln(((n + 0.5) / (in_total + 0.5)) / ((greatest(0, all_n - n) + 0.5) / (greatest(1, (SELECT count(*) FROM toks) - in_total) + 0.5))) AS odds
  FROM (SELECT category, term, count(*) AS n, min(seq * 1000 + p) AS first FROM toks WHERE category IS NOT NULL GROUP BY 1, 2) c
  JOIN (SELECT term, count(*) AS all_n FROM toks GROUP BY 1) a USING (term)
  JOIN (SELECT category, count(*) AS in_total FROM toks GROUP BY 1) t ON c.category = t.category
  WHERE n >= 2 AND length(term) >= 3 AND NOT regexp_matches(term, '^[0-9]+$') AND term NOT IN ('redacted', 'redact', 'phone', 'email', 'address'))
  QUALIFY rank <= 3"""
REPS = """SELECT category, id, rank FROM (SELECT category, id, row_number() OVER (PARTITION BY category ORDER BY coalesce(cat_conf, 0) + coalesce(severity, 0) * 0.15
   + CASE WHEN mapped THEN 0.2 ELSE 0 END + CASE WHEN coalesce(firsthand, false) THEN 0.15 ELSE 0 END DESC, seq) AS rank, count(*) OVER (PARTITION BY category) AS size
   FROM rec WHERE relevant AND category IS NOT NULL) WHERE rank <= CASE WHEN size >= 3 THEN 3 ELSE least(2, size) END"""
SPOTS = """SELECT category, name, count, rank FROM (SELECT category, name, count(*) AS count,
   row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, min(seq * 100 + pos)) AS rank
   FROM rec JOIN placed USING (id) WHERE relevant AND category IS NOT NULL GROUP BY 1, 2) WHERE rank <= 3"""
ALL = {**record_ctes(), "toks": TOKS, "sizes": SIZES, "terms": TERMS, "reps": REPS, "spots": SPOTS}


@query("a1_themes", with_sql(
    f"""SELECT theme_id, category, {LABEL} AS label, size, (SELECT string_agg(term, ', ' ORDER BY rank) FROM terms t WHERE t.category = s.category) AS terms,
        (SELECT string_agg(id, ', ' ORDER BY rank) FROM reps t WHERE t.category = s.category) AS representative_ids,
        (SELECT string_agg(name || ' (' || count || ')', ', ' ORDER BY rank) FROM spots t WHERE t.category = s.category) AS top_places FROM sizes s""", **ALL))
def a1(spark, sf):
    t = themes.themes(records_table(spark, sf))
    return t.select("theme_id", "category", "label", "size", F.array_join("terms", ", ").alias("terms"),
                    F.array_join("representative_ids", ", ").alias("representative_ids"),
                    F.array_join(F.transform("top_places", lambda p: F.concat(p["name"], F.lit(" ("), p["count"].cast("string"), F.lit(")"))), ", ").alias("top_places"))


@query("a2_distinctive_terms", with_sql("SELECT category, CAST(rank AS BIGINT) AS rank, term, CAST(round(odds, 6) AS DOUBLE) AS odds FROM terms", **ALL))
def a2(spark, sf):
    t = themes.distinctive_terms(themes.word_counts(records(spark, sf)))
    return t.select("category", F.col("rank").cast("long").alias("rank"), "term", F.round("odds", 6).alias("odds"))


_DOC = {"rec": "SELECT doc_id AS seq, lang AS category, true AS relevant, text FROM documents"}


@query("a2_document_terms", with_sql("SELECT category, CAST(rank AS BIGINT) AS rank, term, CAST(round(odds, 6) AS DOUBLE) AS odds FROM terms",
       rec=_DOC["rec"], toks=TOKS, terms=TERMS.replace("seq * 1000 + p", "seq * 100000 + p")))
def a2_documents(spark, sf):
    from postsieve import schema as S
    d = views.widen(views.table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), "text", "lang"))
    labelled = d.select("seq", "text", S.labels(relevant=S.relevance(True, 1.0), category=S.decision(F.col("lang"), 1.0)).alias("labels"))
    t = themes.distinctive_terms(themes.word_counts(labelled))
    return t.select("category", F.col("rank").cast("long").alias("rank"), "term", F.round("odds", 6).alias("odds"))


@query("a3_representatives", with_sql("SELECT category, CAST(rank AS BIGINT) AS rank, id FROM reps", **ALL))
def a3(spark, sf):
    r = records_table(spark, sf)
    return themes.representatives(r, themes.theme_sizes(r)).select("category", F.col("rank").cast("long").alias("rank"), "id")


@query("a4_theme_places", with_sql("SELECT category, CAST(rank AS BIGINT) AS rank, name, count FROM spots", **ALL))
def a4(spark, sf):
    return themes.top_places(records(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


@query("a5_community_mentions", with_sql("SELECT community AS name, count(*) AS count FROM placed JOIN rec USING (id) WHERE relevant AND community IS NOT NULL GROUP BY 1", **record_ctes()))
def a5(spark, sf):
    return themes.community_mentions(themes._relevant(records(spark, sf))).select("name", "count")


def briefs_sql(scoped: str, scope: str) -> dict:
    """CTE `briefs` (scope, brief) over rows (scope, id) of `scoped`."""
    return {"scoped": scoped, "briefs": f"""SELECT NULLIF(scope, '') AS scope,
      CASE WHEN scope <> '' THEN scope || ' | ' ELSE '' END || 'Relevant: ' || rel || ' / ' || total || '.'
      || coalesce(' Themes: ' || th || '.', '')
      || CASE WHEN rel > 0 THEN ' With a place: ' || mp || ', without: ' || (rel - mp) || '.'
         ELSE '' END
      || coalesce(' Communities: ' || co || '.', '') AS brief
      FROM (SELECT scope, count(*) AS total, count(*) FILTER (relevant) AS rel, count(*) FILTER (relevant AND mapped) AS mp FROM scoped JOIN rec USING (id) GROUP BY scope)
      LEFT JOIN (SELECT scope, string_agg({LABEL} || ' (' || n || ')', ', ' ORDER BY n DESC, category) AS th FROM (
        SELECT scope, category, count(*) AS n FROM scoped JOIN rec USING (id) WHERE relevant AND category IS NOT NULL GROUP BY 1, 2) GROUP BY scope) USING (scope)
      LEFT JOIN (SELECT scope, string_agg(community || ' (' || n || ')', ', ' ORDER BY n DESC, first) AS co FROM (
        SELECT scope, community, count(*) AS n, min(seq * 100 + pos) AS first FROM scoped JOIN rec USING (id) JOIN placed USING (id)
        WHERE relevant AND community IS NOT NULL GROUP BY 1, 2) GROUP BY scope) USING (scope)"""}


@query("a6_brief", with_sql("SELECT brief FROM briefs", **record_ctes(), **briefs_sql("SELECT '' AS scope, id FROM rec", "")))
def a6(spark, sf):
    return themes.brief_or_empty(themes.with_scope(records_table(spark, sf))).select("brief")


@query("a7_theme_brief", with_sql("SELECT scope, brief FROM briefs", **record_ctes(), sizes=SIZES, **briefs_sql(
    f"SELECT {LABEL} AS scope, id FROM rec WHERE relevant AND category = (SELECT category FROM sizes WHERE theme_id = 'c_2')", "")))
def a7_theme(spark, sf):
    return themes.briefs(themes.with_scope(records_table(spark, sf), "theme", "c_2"))


@query("a7_community_brief", with_sql("SELECT scope, brief FROM briefs", **record_ctes(), **briefs_sql(
    "SELECT DISTINCT 'siksika nation' AS scope, id FROM placed WHERE lower(community) = 'siksika nation'", "")))
def a7_community(spark, sf):
    return themes.brief_or_empty(themes.with_scope(records_table(spark, sf), "community", "siksika nation"), "siksika nation")


@query("a7_empty_scope", with_sql("SELECT 'Nowhere Nation' AS scope, CASE WHEN count(*) = 0 THEN 'Nowhere Nation | nothing.' END AS brief FROM placed WHERE community = 'Nowhere Nation'", **record_ctes()))
def a7_empty(spark, sf):
    return themes.brief_or_empty(themes.with_scope(records_table(spark, sf), "community", "Nowhere Nation"), "Nowhere Nation")


@query("a8_community_briefs", with_sql("SELECT scope, brief FROM briefs", **record_ctes(), **briefs_sql(
    "SELECT DISTINCT community AS scope, id FROM placed WHERE community IS NOT NULL", "")))
def a8(spark, sf):
    return themes.community_briefs(records_table(spark, sf))
