"""Corpus profile queries, over the posts left by exact dedupe."""

from pyspark.sql import Window, functions as F

from postsieve import values as V
from postsieve.operators import dedupe, profile
from postsieve.session import materialize
from postsieve.sources.gazetteer import Places, countries_of, default_gazetteer, display_names
from registry import views
from registry.core import query
from registry.dedupe_queries import kept_sql
from registry.geo_sql import alias_rank_sql, gazetteer_sql
from registry.text_queries import q, tokens_sql
from registry.views import posts_sql, with_sql


def kept(spark, sf, **kw):
    return dedupe.collapse_exact(views.posts(spark, sf, **kw))


def kept_table(spark, sf):
    """Deduplicated posts written once, because the profile passes over them several times."""
    return materialize(kept(spark, sf), "kept")


def profile_of(posts):
    """The profile every scoring query uses: detected, then focused when mixed."""
    return profile.focus(profile.detect(posts), posts)


def hz(h, x="text"):
    return f"regexp_matches({x}, {q(V.HAZARD_PATTERNS[h])})"


def sample_sql(source):
    return (f"SELECT * FROM (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS i, count(*) OVER () AS total FROM {source} "
            f"WHERE text <> '') WHERE i % CAST(ceil(total / {V.SAMPLE_SIZE}.0) AS BIGINT) = 0")


def texts_sql(source):
    return f"SELECT * FROM {source} WHERE text <> ''"


def places_sql(sample):
    return f"""SELECT a.alias, a.rank, count(*) AS n FROM {sample} s JOIN ar a
      ON contains(lower(s.text), a.alias) AND regexp_matches(lower(s.text), '(^|[^a-z0-9])' || a.alias || '([^a-z0-9]|$)')
      WHERE length(a.alias) >= 3 GROUP BY 1, 2 ORDER BY n DESC, rank LIMIT 8"""


COUNTS = "SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER ({hz(h)}) AS {h}" for h in V.HAZARDS) + " FROM sample"
VERDICT = """SELECT *, CASE WHEN enough AND top >= second * 1.5 THEN best ELSE 'other' END AS hazard,
  enough AND (SELECT count(*) FROM unnest([flood, fire, quake, storm]) u(c) WHERE c >= 0.15 * (flood + fire + quake + storm) AND flood + fire + quake + storm > 0) >= 2 AS mixed FROM (
  SELECT *, top >= greatest(5, n * 0.02) AS enough FROM (
    SELECT *, list_reverse_sort([flood, fire, quake, storm])[1] AS top, list_reverse_sort([flood, fire, quake, storm])[2] AS second,
      CASE greatest(flood, fire, quake, storm) WHEN flood THEN 'flood' WHEN fire THEN 'fire' WHEN quake THEN 'quake' ELSE 'storm' END AS best FROM hcounts))"""
TERMS = f"""SELECT term, count(*) AS n, min(seq * 1048576 + p) AS first FROM (
    SELECT seq, term, min(p) AS p FROM (SELECT seq, unnest(toks) AS term, generate_subscripts(toks, 1) AS p
      FROM (SELECT seq, {tokens_sql('text')} AS toks FROM sample)) GROUP BY 1, 2)
  GROUP BY term HAVING count(*) >= 3 AND count(*) < 0.6 * (SELECT count(*) FROM sample) ORDER BY n DESC, first, term LIMIT 40"""


def profile_ctes(source="kept", text_posts="posts"):
    return {"posts": posts_sql(), "kept": kept_sql(), "sample": texts_sql(source), "hcounts": COUNTS, "verdict": VERDICT,
            "terms": TERMS, "ar": alias_rank_sql(), "pplaces": places_sql("sample")}


@query("p1_sample", with_sql("SELECT seq, id FROM picked", **profile_ctes(), picked=sample_sql("kept")))
def p1(spark, sf):
    return profile.sample_posts(kept_table(spark, sf))[0].select("seq", "id")


@query("p2_hazard_counts", with_sql("SELECT * FROM hcounts", **profile_ctes()))
def p2(spark, sf):
    return profile.hazard_profile(profile.with_text(kept(spark, sf))).select("n", *V.HAZARDS)


@query("p3_hazard_verdict", with_sql("SELECT hazard FROM verdict", **profile_ctes()))
def p3(spark, sf):
    return profile.hazard_profile(profile.with_text(kept(spark, sf))).select("hazard")


@query("p4_hazard_shares", with_sql("SELECT " + ", ".join(f"{h} / (flood + fire + quake + storm) AS {h}_share" for h in V.HAZARDS) + " FROM hcounts", **profile_ctes()))
def p4(spark, sf):
    return profile.hazard_profile(profile.with_text(kept(spark, sf))).select(*[f"{h}_share" for h in V.HAZARDS])


@query("p5_mixed", with_sql("SELECT hazard, mixed FROM verdict", **profile_ctes()))
def p5(spark, sf):
    return profile.hazard_profile(profile.with_text(kept(spark, sf))).select("hazard", "mixed")


@query("p6_terms", with_sql("SELECT row_number() OVER (ORDER BY n DESC, first, term) AS rank, term, n FROM terms", **profile_ctes()))
def p6(spark, sf):
    texts = profile.with_text(kept_table(spark, sf))
    top = profile.term_counts(texts, texts.count())
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "first", "term"))  # 40 rows at most
    return top.select(rank.cast("long").alias("rank"), "term", "n")


def _ranked_places(df):
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "rank"))  # 8 rows at most
    return df.select(rank.cast("long").alias("place_rank"), "alias", "n")


@query("p7_places", with_sql("SELECT row_number() OVER (ORDER BY n DESC, rank) AS place_rank, alias, n FROM pplaces", **profile_ctes()))
def p7(spark, sf):
    return _ranked_places(profile.place_counts(profile.with_text(kept(spark, sf)), Places.of()))


@query("p8_focus_places", with_sql(
    "SELECT row_number() OVER (ORDER BY n DESC, rank) AS place_rank, alias, n FROM pplaces",
    **{**profile_ctes(), "sample": texts_sql(f"(SELECT * FROM kept WHERE {hz('flood')})")}))
def p8(spark, sf):
    return _ranked_places(profile.target_places(kept(spark, sf)))


@query("p10_place_names", with_sql(
    "SELECT DISTINCT last_name AS name FROM pplaces JOIN (SELECT alias, max_by(name, ord) AS last_name FROM gaz GROUP BY alias) USING (alias)",
    **profile_ctes(), gaz=gazetteer_sql()))
def p10(spark, sf):
    ranked = profile.place_counts(profile.with_text(kept(spark, sf)), Places.of())
    return display_names(ranked, default_gazetteer(spark))


@query("g5_countries", with_sql("SELECT DISTINCT country FROM pplaces JOIN gaz USING (alias)", **profile_ctes(), gaz=gazetteer_sql()))
def g5(spark, sf):
    ranked = profile.place_counts(profile.with_text(kept(spark, sf)), Places.of())
    return countries_of(ranked, default_gazetteer(spark))


@query("a14_disclosed_shares", with_sql(
    """SELECT row_number() OVER (ORDER BY c DESC, i) AS rank, hazard, CAST(floor(c * 100.0 / t + 0.5) AS BIGINT) AS percent FROM (
       SELECT unnest(['flood','fire','quake','storm']) AS hazard, unnest([0,1,2,3]) AS i, unnest([flood, fire, quake, storm]) AS c,
       flood + fire + quake + storm AS t FROM verdict WHERE mixed) WHERE c >= 0.01 * t""",
    **profile_ctes()))
def a14(spark, sf):
    return profile.disclosed_shares(profile.hazard_profile(profile.with_text(kept(spark, sf))))
