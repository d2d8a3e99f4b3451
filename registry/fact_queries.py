"""Fact, explorer and question queries."""

from pyspark.sql import functions as F

from postsieve import schema as S, values as V
from postsieve.functions import text as T
from postsieve.operators import ask, facts, recurrence, themes
from postsieve.sources.gazetteer import default_rows
from registry import views
from registry.core import query
from registry.geo_sql import _s
from registry.records import record_ctes, records, records_table
from registry.text_queries import q, snippet_sql, tokens_sql
from registry.theme_queries import REPS, SIZES
from registry.views import posts_sql, with_sql

R = record_ctes()
FUNNEL_SQL = """SELECT CAST(sum(duplicate_count) AS BIGINT) AS raw, count(*) AS deduped, count(*) AS prefiltered,
  count(*) FILTER (relevant) AS relevant, count(*) FILTER (relevant AND mapped) AS mappable, count(*) FILTER (relevant AND NOT mapped) AS no_place FROM rec"""


_BATCH = "event_id % 6 AS batch, event_id AS tick, event_id % 11 AS prefiltered, event_id % 7 AS relevant, event_id % 5 AS mappable, event_id % 3 AS no_place"


@query("a11_merge_funnels", with_sql(
    "SELECT CAST(sum(prefiltered) AS BIGINT) AS prefiltered, CAST(sum(relevant) AS BIGINT) AS relevant, CAST(sum(mappable) AS BIGINT) AS mappable, CAST(sum(no_place) AS BIGINT) AS no_place FROM (SELECT * FROM rep QUALIFY row_number() OVER (PARTITION BY batch ORDER BY tick DESC) = 1)",
    rep=f"SELECT {_BATCH} FROM events"))
def a11(spark, sf):
    return facts.merge_funnels(views.table(spark, sf, "events").selectExpr(*views._split(_BATCH)).withColumnRenamed("tick", "at"))


@query("a12_add_funnels", with_sql(
    "SELECT " + ", ".join(f"{c} + (SELECT {c} FROM fun WHERE part = 1) AS {c}" for c in facts.FUNNEL) + " FROM fun WHERE part = 0", **R,
    fun=FUNNEL_SQL.replace("SELECT CAST", "SELECT seq % 2 AS part, CAST") + " GROUP BY 1"))
def a12(spark, sf):
    r = records_table(spark, sf)
    half = lambda p: facts.funnel(r.where(F.col("seq") % 2 == p), prefiltered=F.lit(True))
    return facts.add_funnels(half(0), half(1))


@query("a13_hazard_breakdown", with_sql("SELECT hazard, count(*) AS count, CAST(round(count(*) / sum(count(*)) OVER (), 9) AS DOUBLE) AS share FROM rec WHERE hazard IS NOT NULL GROUP BY hazard", **R))
def a13(spark, sf):
    return facts.hazard_breakdown(records(spark, sf)).withColumn("share", F.round("share", 9))


@query("a15_flood_totals", with_sql("SELECT count(*) AS found, count(*) FILTER (mapped) AS mapped FROM rec WHERE relevant AND coalesce(hazard = 'flood', true)", **R))
def a15(spark, sf):
    return facts.flood_totals(records(spark, sf))


@query("a16_relevant_communities", with_sql("SELECT community AS name, count(DISTINCT id) AS count FROM placed JOIN rec USING (id) WHERE relevant AND community IS NOT NULL GROUP BY 1", **R))
def a16(spark, sf):
    return facts.relevant_communities(records(spark, sf))


@query("a17_classifier_mix", with_sql(
    """SELECT count(*) FILTER (classifier <> 'heuristic') AS model_count, count(*) FILTER (classifier = 'heuristic') AS rule_count,
       (SELECT string_agg(model_version, ', ' ORDER BY f) FROM (SELECT model_version, min(seq) AS f FROM rec WHERE classifier <> 'heuristic' AND model_version IS NOT NULL GROUP BY 1)) AS model_versions FROM rec""", **R))
def a17(spark, sf):
    return facts.classifier_mix(records(spark, sf)).withColumn("model_versions", F.array_join("model_versions", ", "))


EXPLORE = "SELECT id, mapped FROM rec WHERE relevant AND rel_conf >= 0.2 AND (category IS NULL OR category IN ('evacuation', 'damage', 'aid')) AND (hazard IS NULL OR hazard = 'flood') AND contains(lower(text), 'water')"


def _explored(spark, sf):
    return facts.explore(records(spark, sf), categories=["evacuation", "damage", "aid"], min_confidence=0.2, flood_only=True, query=" WATER ")


@query("f5_explorer", with_sql(f"SELECT id FROM ({EXPLORE})", **R))
def f5(spark, sf):
    return _explored(spark, sf).select("id")


@query("f5_explorer_community", with_sql(
    "SELECT id FROM rec WHERE relevant AND mapped AND is_request AND hazard = 'storm' AND EXISTS (SELECT 1 FROM placed p WHERE p.id = rec.id AND community = 'Siksika Nation')", **R))
def f5_community(spark, sf):
    return facts.explore(records(spark, sf), only_mapped=True, only_requests=True, hazard="storm", community="Siksika Nation").select("id")


@query("f6_mapped_counts", with_sql(f"SELECT count(*) FILTER (mapped) AS mapped, count(*) FILTER (NOT mapped) AS unmapped FROM ({EXPLORE})", **R))
def f6(spark, sf):
    return facts.mapped_counts(_explored(spark, sf))


@query("j2_theme_members", with_sql("SELECT id FROM rec WHERE relevant AND category = (SELECT category FROM sizes WHERE theme_id = 'c_1')", **R, sizes=SIZES))
def j2(spark, sf):
    r = records_table(spark, sf)
    return facts.explore(r, theme_members=themes.members(r, themes.theme_sizes(r), "c_1")).select("id")


@query("f9_share_view", with_sql("SELECT count(*) AS n, 0 AS leaked FROM rec", **R))
def f9(spark, sf):
    """Shared rows are looked through as they leave."""
    v = facts.share_view(records(spark, sf))
    row = F.to_json(F.struct("*"))
    leak = F.get_json_object(row, "$.raw_text").isNotNull() | F.get_json_object(row, "$.image_ref").isNotNull()
    return v.agg(F.count("*").alias("n"), F.count_if(leak).cast("int").alias("leaked"))


BAND = "CASE WHEN severity >= 1.5 THEN 2 WHEN severity >= 0.75 THEN 1 ELSE 0 END"


@query("o1_sorted_report", with_sql(
    f"SELECT id, CAST(rank AS BIGINT) AS rank FROM (SELECT id, row_number() OVER (ORDER BY coalesce(first_place, 'zzz') COLLATE NOCASE DESC, seq) AS rank FROM rec) WHERE rank <= 300", **R))
def o1(spark, sf):
    page = facts.report_page(records(spark, sf), "place", 0, True, 300).withColumn("p", F.monotonically_increasing_id())
    from pyspark.sql import Window
    return page.select("id", F.row_number().over(Window.orderBy("p")).cast("long").alias("rank"))  # 300 rows


@query("o2_report_page", with_sql(f"SELECT id FROM rec ORDER BY {BAND} DESC, seq LIMIT 200 OFFSET 200", **R))
def o2(spark, sf):
    return facts.report_page(records(spark, sf), "severity", 1).select("id")


@query("o3_triage_order", with_sql(
    "SELECT category, list_position(['rescue_request','access_blocked','evacuation','damage','advisory','aid','sentiment'], category) - 1 AS rank, count(*) AS n FROM rec WHERE category IS NOT NULL GROUP BY 1", **R))
def o3(spark, sf):
    c = F.col("labels.category.value")
    return records(spark, sf).groupBy(c.alias("category")).agg(F.count("*").alias("n")).withColumn("rank", facts.triage_rank(F.col("category")))


# --- questions --------------------------------------------------------------------------------

def phrase_sql(x):
    return f"'(?i)(?:^|[^a-z0-9])(?:' || array_to_string(list_transform({x}, lambda p: replace(regexp_replace(lower(p), '([.*+?^${{}}()|\\[\\]\\\\])', '\\\\\\1', 'g'), ' ', '\\s+')), '|') || ')(?:[^a-z0-9]|$)'"


_PLACES = "SELECT * FROM (VALUES " + ", ".join(
    f"({r['ord']}, {_s(r['name'])}, [{', '.join(_s(a) for a in r['aliases'])}])" for r in default_rows()) + ") p(ord, label, phrases)"
QUESTION_STOP = "[" + ", ".join(f"'{w}'" for w in V.QUESTION_STOP_WORDS) + "]"
ASKED = {
    "questions": views.QUESTIONS_SQL, "place_list": _PLACES,
    "place_terms": f"""SELECT qid, ord, label, phrases FROM questions q JOIN place_list p ON len(list_filter(p.phrases, lambda a:
        length(a) > 2 AND contains(lower(q.question), a) AND regexp_matches(lower(q.question), '(^|[^a-z0-9])' || a || '([^a-z0-9]|$)'))) > 0""",
    "covered": "SELECT qid, list_distinct(flatten(list_transform(flatten(list(phrases)), lambda p: string_split(p, ' ')))) AS words FROM place_terms GROUP BY qid",
    "extra": r"""SELECT qid, unnest(e) AS e, generate_subscripts(e, 1) AS i FROM (SELECT qid, list_concat(
        list_transform(regexp_extract_all(question, '["“]([^"”]+)["”]', 1), lambda s: trim(s)),
        list_filter(list_slice(list_filter(regexp_split_to_array(regexp_replace(question, '[^A-Za-z0-9''\s-]', ' ', 'g'), '\s+'), lambda w: w <> ''), 2, 1000000),
          lambda w: regexp_matches(w, '^[A-Z][a-z]{2,}'))) AS e FROM questions)""",
    "extra_terms": f"""SELECT qid, min(i) AS i, arg_min(e, i) AS e FROM extra LEFT JOIN covered USING (qid)
        WHERE NOT list_contains({QUESTION_STOP}, lower(e)) AND NOT coalesce(list_contains(words, lower(e)), false) GROUP BY qid, lower(e)""",
    "terms_q": """SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY kind, o) - 1 AS rank, label, phrases FROM (
        SELECT qid, 0 AS kind, ord AS o, label, phrases FROM place_terms UNION ALL SELECT qid, 1, i, e, [e] FROM extra_terms)""",
}
FACTS_Q = {**R, **ASKED,
           "patterns": f"SELECT DISTINCT label, phrases, {phrase_sql('phrases')} AS pat FROM terms_q",
           "hits": "SELECT label, phrases, r.id, r.seq, r.relevant FROM patterns t JOIN rec r ON regexp_matches(r.text, t.pat)",
           "counted": "SELECT label, phrases, count(*) AS count_all, count(*) FILTER (relevant) AS count_relevant FROM hits GROUP BY 1, 2",
           "facts_q": "SELECT qid, rank, label, phrases, coalesce(count_all, 0) AS count_all, coalesce(count_relevant, 0) AS count_relevant FROM terms_q LEFT JOIN counted USING (label, phrases)",
           "keys": f"SELECT DISTINCT qid, w FROM (SELECT qid, unnest({tokens_sql('question')}) AS w FROM questions) WHERE length(w) > 3",
           "spoken": f"SELECT seq, w, count(*) AS n FROM (SELECT seq, unnest({tokens_sql('text')}) AS w FROM rec WHERE relevant) GROUP BY 1, 2",
           "points": """SELECT qid, seq, sum(p) AS overlap, bool_or(ft) AS first_term FROM (
               SELECT qid, seq, n AS p, false AS ft FROM spoken JOIN keys USING (w)
               UNION ALL SELECT qid, seq, 2, rank = 0 FROM hits h JOIN terms_q t USING (label, phrases) WHERE h.relevant
               UNION ALL SELECT qid, seq, 0, false FROM questions, (SELECT seq FROM rec WHERE relevant)) GROUP BY 1, 2""",
           "proof": """SELECT qid, rank, seq, id, overlap, first_term FROM (SELECT p.*, r.id, row_number() OVER (PARTITION BY qid
               ORDER BY overlap DESC, coalesce(severity, 0) DESC, coalesce(rel_conf, 0) DESC, seq) AS rank FROM points p JOIN rec r USING (seq)) WHERE rank <= 60"""}


@query("f11_count_questions", with_sql(f"SELECT qid, regexp_matches(question, {q(V.COUNT_QUESTION_PATTERN)}) AS counts FROM questions", questions=views.QUESTIONS_SQL))
def f11(spark, sf):
    return views.questions(spark, sf).select("qid", ask.is_count_question(F.col("question")).alias("counts"))


@query("a19_question_terms", with_sql("SELECT qid, CAST(rank AS BIGINT) AS rank, label, array_to_string(phrases, ', ') AS phrases FROM terms_q", **ASKED))
def a19(spark, sf):
    t = ask.extract_terms(views.questions(spark, sf))
    return t.select("qid", F.col("rank").cast("long").alias("rank"), "label", F.array_join("phrases", ", ").alias("phrases"))


@query("a18_exact_counts", with_sql("SELECT qid, CAST(rank AS BIGINT) AS rank, label, count_all, count_relevant FROM facts_q", **FACTS_Q))
def a18(spark, sf):
    f = ask.exact_facts(ask.extract_terms(views.questions(spark, sf)), records_table(spark, sf))
    return f.select("qid", F.col("rank").cast("long").alias("rank"), "label", "count_all", "count_relevant")


@query("a18_totals", with_sql("SELECT count(*) AS total_loaded, count(*) FILTER (relevant) AS total_relevant FROM rec", **R))
def a18_totals(spark, sf):
    return ask.totals(records(spark, sf))


@query("a18_most_named_places", with_sql("SELECT name, count(DISTINCT id) AS count FROM placed JOIN rec USING (id) GROUP BY name ORDER BY count DESC, min(seq * 100 + pos) LIMIT 8", **R))
def a18_places(spark, sf):
    return ask.most_named_places(records(spark, sf)).select("name", "count")


def _evidence(spark, sf):
    r = records_table(spark, sf)
    qs = views.questions(spark, sf)
    terms = ask.extract_terms(qs)
    return r, qs, terms, ask.evidence(qs, terms, r)


@query("a21_evidence", with_sql("SELECT qid, CAST(rank AS BIGINT) AS rank, id, CAST(overlap AS BIGINT) AS overlap FROM proof", **FACTS_Q))
def a21(spark, sf):
    return _evidence(spark, sf)[3].select("qid", F.col("rank").cast("long").alias("rank"), "id", "overlap")


ANSWERS_Q = f"""SELECT qid, count_all || ' of the ' || (SELECT count(*) FROM rec) || ' loaded posts mention ' || regexp_replace(label, ', [A-Z]{{2}}$', '')
  || CASE WHEN count_relevant <> count_all THEN ', ' || count_relevant || ' of them classified relevant.' ELSE '.' END AS sentence,
  coalesce((SELECT string_agg(id, ', ' ORDER BY rank) FROM (SELECT id, rank FROM proof p WHERE p.qid = f.qid AND first_term ORDER BY rank LIMIT 2)), '') AS cited
  FROM facts_q f JOIN questions USING (qid) WHERE f.rank = 0 AND regexp_matches(question, {q(V.COUNT_QUESTION_PATTERN)})"""


def _answers(spark, sf):
    r, qs, terms, proof = _evidence(spark, sf)
    return r, ask.answer_counts(qs, ask.exact_facts(terms, r), proof, r.count())


@query("a20_count_answers", with_sql(ANSWERS_Q, **FACTS_Q))
def a20(spark, sf):
    return _answers(spark, sf)[1].withColumn("cited", F.array_join("cited", ", "))


@query("a24_source_snippets", with_sql(
    f"SELECT DISTINCT id, {snippet_sql('text', 40)} AS snippet FROM rec WHERE id IN (SELECT unnest(string_split(cited, ', ')) FROM ans_q)", **FACTS_Q, ans_q=ANSWERS_Q))
def a24(spark, sf):
    r, answers = _answers(spark, sf)
    return ask.source_snippets(answers, r)


_SENT = """conv_id * 1000 + turn AS sid,
  CASE WHEN conv_id % 7 = 0 THEN 'This was confirmed by crews.' WHEN conv_id % 7 = 1 THEN '200,000 people were affected.' WHEN turn % 5 = 4 THEN '  ' ELSE text || ' — ' || turn END AS sentence"""


def sentences(spark, sf):
    c = views.table(spark, sf, "conversations")
    return c.selectExpr(*views._split(_SENT), "CASE WHEN turn % 4 = 3 THEN array() WHEN conv_id % 5 = 0 THEN array('e1', 'x' || turn, 'x9') ELSE array('e' || (conv_id % 3 + 1)) END AS cited")


SENT = {"sentences": f"SELECT {_SENT}, CASE WHEN turn % 4 = 3 THEN [] WHEN conv_id % 5 = 0 THEN ['e1', 'x' || turn, 'x9'] ELSE ['e' || (conv_id % 3 + 1)] END AS cited FROM conversations",
        "judged": f"""SELECT sid, t AS sentence, cited, CASE WHEN t = '' THEN 'empty sentence' WHEN len(cited) = 0 THEN 'no citations'
           WHEN len(list_filter(cited, lambda c: NOT list_contains(['e1', 'e2', 'e3'], c))) > 0
             THEN 'cites unknown id ' || list_filter(cited, lambda c: NOT list_contains(['e1', 'e2', 'e3'], c))[1]
           WHEN regexp_matches(t, {q(V.KILL_PATTERN)}) THEN '{V.KILL_REASON}' WHEN regexp_matches(t, {q(V.PEOPLE_PATTERN)}) THEN '{V.PEOPLE_REASON}' END AS reason
           FROM (SELECT sid, regexp_replace(sentence, {q(r'^\s+|\s+$')}, '', 'g') AS t, cited FROM sentences)"""}


def _enforced(spark, sf):
    allowed = views.table(spark, sf, "events").where("event_id IN (1, 2, 3)").select(F.concat(F.lit("e"), "event_id").alias("id"))
    return ask.enforce_citations(sentences(spark, sf), allowed)


@query("a22_citations_kept", with_sql(f"SELECT sid, regexp_replace(sentence, {q('\\s*[—–]\\s*')}, ', ', 'g') AS sentence FROM judged WHERE reason IS NULL", **SENT))
def a22_kept(spark, sf):
    return _enforced(spark, sf)[0].select("sid", "sentence")


@query("a22_citations_dropped", with_sql("SELECT sid, reason FROM judged WHERE reason IS NOT NULL", **SENT))
def a22_dropped(spark, sf):
    return _enforced(spark, sf)[1].select("sid", "reason")


@query("f10_kill_phrases", with_sql(f"SELECT sid, CASE WHEN regexp_matches(sentence, {q(V.KILL_PATTERN)}) THEN '{V.KILL_REASON}' WHEN regexp_matches(sentence, {q(V.PEOPLE_PATTERN)}) THEN '{V.PEOPLE_REASON}' END AS reason FROM sentences", **SENT))
def f10(spark, sf):
    return sentences(spark, sf).select("sid", ask.kill_reason(F.col("sentence")).alias("reason"))


@query("f8_narrative_inputs", with_sql("SELECT id, text, category FROM rec WHERE NOT coalesce(has_pii, false) AND id IN (SELECT id FROM reps)", **R, reps=REPS))
def f8(spark, sf):
    r = records_table(spark, sf)
    return ask.narrative_inputs(themes.representatives(r, themes.theme_sizes(r)), r).select("id", "text", "category")


@query("a23_numbers_kept", r"""SELECT doc_id, len(list_filter(regexp_extract_all(text, '[0-9][0-9,]*(?:\.[0-9]+)?'), lambda n: NOT contains(lower(replace(text, '7', '8')), n))) = 0 AS kept FROM documents""")
def a23(spark, sf):
    d = views.table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", ask.keeps_numbers(F.col("text"), F.lower(F.replace("text", F.lit("7"), F.lit("8")))).alias("kept"))


_SCORES = "doc_id % 4 AS phrasing, CAST((doc_id * 37 + doc_id % 4 * 13) % 101 AS DOUBLE) / 100 AS p, quality = 1 AS label"


@query("a26_separation", f"SELECT phrasing, count(*) AS n, CAST(round(min(p) FILTER (label) - max(p) FILTER (NOT label), 9) AS DOUBLE) AS separation, count(*) FILTER (abs(p - 0.5) * 2 < 0.6) AS uncertain FROM (SELECT {_SCORES} FROM labels) GROUP BY phrasing")
def a26(spark, sf):
    return facts.separation(views.table(spark, sf, "labels").selectExpr(*views._split(_SCORES))).withColumn("separation", F.round("separation", 9))


@query("a25_throughput", """WITH RECURSIVE raw AS (SELECT event_id % 20 AS run, event_id * 23 + event_id * event_id % 31 AS t, event_id AS done FROM events),
  ordered AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY t) AS i FROM raw),
  fold AS (SELECT run, i, t, done, CAST(0 AS DOUBLE) AS rate, CAST(0 AS DOUBLE) AS ema, false AS emit FROM ordered WHERE i = 1
    UNION ALL SELECT o.run, o.i, CASE WHEN o.t - f.t < 50 THEN f.t ELSE o.t END, CASE WHEN o.t - f.t < 50 THEN f.done ELSE o.done END,
      CASE WHEN o.t - f.t < 50 THEN f.rate ELSE greatest(0, o.done - f.done) / ((o.t - f.t) / 1000.0) END,
      CASE WHEN o.t - f.t < 50 THEN f.ema WHEN f.ema > 0 THEN f.ema * 0.7 + 0.3 * greatest(0, o.done - f.done) / ((o.t - f.t) / 1000.0)
        ELSE greatest(0, o.done - f.done) / ((o.t - f.t) / 1000.0) END, o.t - f.t >= 50
    FROM fold f JOIN ordered o ON o.run = f.run AND o.i = f.i + 1)
  SELECT run, t, done, CAST(round(rate, 6) AS DOUBLE) AS rate, CAST(round(ema, 6) AS DOUBLE) AS ema FROM fold WHERE emit""")
def a25(spark, sf):
    p = views.table(spark, sf, "events").selectExpr("event_id % 20 AS run", "event_id * 23 + event_id * event_id % 31 AS t", "event_id AS done")
    t = recurrence.throughput(p)
    return t.select("run", "t", "done", F.round("rate", 6).alias("rate"), F.round("ema", 6).alias("ema"))


@query("o4_top_k", with_sql("SELECT id FROM rec WHERE relevant ORDER BY coalesce(severity, 0) DESC, rel_conf DESC, seq LIMIT 100", **R))
def o4(spark, sf):
    """The hundred most urgent relevant records."""
    r = records(spark, sf).where(S.relevant())
    return r.orderBy(F.desc(F.coalesce("labels.severity.value", F.lit(0.0))), F.desc("labels.relevant.confidence"), "seq").limit(100).select("id")
