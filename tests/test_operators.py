import random
import re

import pandas as pd
from pyspark.sql import functions as F

from postsieve import schema as S, values as V
from postsieve.operators import ask, cache, decide, dedupe, facts, meter, position, profile, score, themes
from postsieve.operators.profile import EventProfile
from postsieve.plans import export, triage
from postsieve.sources.gazetteer import Places

POST = "seq long, id string, text string, lat double, lon double"


def posts(spark, texts):
    return spark.createDataFrame([(i, f"e{i}", t, None, None) for i, t in enumerate(texts)], POST)


def test_dedupe_keeps_first_and_counts(spark):
    got = dedupe.collapse_exact(posts(spark, ["Flood here!", "RT @a: flood  HERE", "!!", "other", "RT @b other", "RT gone"])).orderBy("seq").collect()
    assert [(r["text"], r["duplicate_count"]) for r in got] == [("Flood here!", 2), ("other", 2)]
    kept = dedupe.collapse_exact(posts(spark, ["x y", "RT @a: x y"]), strip_retweets=False)
    assert kept.count() == 2


def test_position_equals_global_order_under_ties(spark):
    rng = random.Random(1)
    rows = [(i * 7, float(rng.choice([0.5, 0.75, 1.0])), rng.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "seq long, s double, v double")
    got = position.with_position(df, rank="s", sums={"run": F.col("v")}, rows_per_bucket=100).collect()
    want, total = {}, 0.0
    for p, (seq, s, v) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0]))):
        total += v
        want[seq] = (p, total)
    assert all(r["position"] == want[r["seq"]][0] and abs(r["run"] - want[r["seq"]][1]) < 1e-6 for r in got) and len(got) == 3000


def test_position_with_uneven_keys(spark):
    seqs = sorted({*range(1000), *[10**6 + 13 * i for i in range(1000)], 2**60, 2**61})
    df = spark.createDataFrame([(q,) for q in seqs], "seq long")
    got = {r["seq"]: r["position"] for r in position.with_position(df, rows_per_bucket=50).collect()}
    assert got == {q: i for i, q in enumerate(seqs)}
    sizes = [r["count"] for r in position.ranged(df, [F.col("seq")], len(seqs), 50).groupBy("_range").count().collect()]
    assert len(sizes) > 30 and max(sizes) <= 200


def test_position_with_all_scores_distinct(spark):
    rng = random.Random(4)
    rows = [(i, rng.random()) for i in range(4000)]
    df = spark.createDataFrame(rows, "seq long, s double").repartition(8)
    got = {r["seq"]: r["position"] for r in position.with_position(df, rank="s", rows_per_bucket=100).collect()}
    assert got == {q: i for i, (q, _) in enumerate(sorted(rows, key=lambda r: -r[1]))}
    ranges = position.ranged(df, [F.col("s").desc(), F.col("seq")], 4000, 100).groupBy("_range").count().collect()
    assert 30 <= len(ranges) <= 40 and max(r["count"] for r in ranges) <= 400  # prefixed over the ranges, not over 4,000 scores


def test_order_statistics_take_two_passes(spark):
    from postsieve.operators import quantile
    rng = random.Random(6)
    values = [(rng.gauss(0, 1), float(rng.choice([1, 1, 1, 2, 3])), rng.randrange(10**6)) for _ in range(5000)] + [(None, None, None)] * 5
    df = spark.createDataFrame(values, "a double, b double, c long").repartition(6)
    settled, runs = quantile._settled, []
    quantile._settled = lambda *how: runs.append(how[1]) or settled(*how)
    try:
        found = quantile.order_statistics(df, {c: [0.05, 0.5, 0.95] for c in "abc"}, lambda n, f: int(n * f), accuracy=200)
    finally:
        quantile._settled = settled
    for i, c in enumerate("abc"):
        column = sorted(v[i] for v in values if v[i] is not None)
        for f in (0.05, 0.5, 0.95):
            want = column[int(5000 * f)]
            assert found[c, f] == quantile.Found(want, sum(v < want for v in column), column.count(want))
    assert [len(r) for r in runs] == [9, 0]
    assert quantile.order_statistics(df.where("a IS NULL"), {"a": [0.5]}, lambda n, f: 0) == {("a", 0.5): None}


def test_gazetteer_file(spark, tmp_path):
    from postsieve.sources.gazetteer import read_gazetteer
    import json
    path = tmp_path / "g.json"
    path.write_text(json.dumps({"note": "n", "places": [{"name": "Aa, X", "aliases": ["Aa", "aax"], "lat": 1, "lon": 2.5, "kind": "city", "admin": "X", "country": "CA"},
                                                        {"name": "Bb", "aliases": ["bb"], "lat": 3, "lon": 4, "kind": "reserve", "admin": "Y", "country": "CA", "isFirstNation": True, "community": "Bb Nation"}]}))
    g = read_gazetteer(spark, str(path))
    from postsieve.operators import geo
    got = geo.geoparse(posts(spark, ["rain in #aaxflood and bb"]), g).first()["places"]
    assert [(p["name"], p["community"] and p["community"]["name"]) for p in got] == [("Bb", "Bb Nation"), ("Aa, X", None)]


def test_must_keep_posts_survive(spark):
    must = ["the dam bridge is under water", "evacuating, there is water in our basement", "is hwy 22 flooded #yycflood",
            "state of emergency for the whole valley", "grandparents stranded by the flood, please help"]
    got = score.prefilter(score.score_relevance(posts(spark, must), EventProfile("flood", ("calgary",)))).collect()
    assert all(r["is_candidate"] for r in got)


def test_focus_and_off_hazard_credit(spark):
    mix = ["flood in Calgary"] * 6 + ["tornado in Boston"] * 8 + ["nice day"] * 5
    p = posts(spark, [f"{t} {i}" for i, t in enumerate(mix)])
    found = profile.detect(p)
    assert found.mixed and found.hazard == "other" and found.hazard_shares["storm"] > 0.5
    focused = profile.focus(found, p)
    assert focused.hazard == "flood" and focused.focused and focused.places == ("calgary",)
    assert profile.focus(found.pinned(), p).user_edited
    tornado = posts(spark, ["Oklahoma tornado destroyed homes"])
    s = lambda pr: score.score_relevance(tornado, pr).first()["prefilter"]["score"]
    from dataclasses import replace
    assert s(focused) < s(replace(focused, focused=False))
    flood = posts(spark, ["Flooding in Sardinia after storm #sardegna"])
    assert score.score_relevance(flood, focused).first()["prefilter"]["score"] >= 0.15


def test_place_ranking_is_letter_exact(spark):
    named = posts(spark, ["high river", "high-river", "high  river", "thigh river", "(High River)"])
    assert profile.place_counts(named, Places.of()).first()["n"] == 2


def test_gauge_states(spark):
    d = lambda v, c: S.decision(v, c)
    none = F.lit(None).cast("struct<value:boolean,confidence:double>")
    cases = [(d(True, 0.88), "model", "auto", "measured"), (d(True, 0.42), "model", "auto", "below"), (none, "model", "auto", "pending"),
             (d(False, 0.7), "heuristic", "auto", "no-reading"), (d(True, 0.88), "model", "confirmed", "checked"), (d(True, 0.88), "model", "rejected", "rejected")]
    df = spark.range(1)
    for dec, c, r, want in cases:
        assert df.select(decide.gauge(dec, 0.6, F.lit(c), F.lit(r)).alias("g")).first()["g"]["state"] == want
    g = df.select(decide.gauge(d(True, 1.4), 0.6, F.lit("model"), F.lit("auto")).alias("g")).first()["g"]
    assert g["level"] == 1.0 and df.select(decide.gauge(d(True, 0.88), 0.6, F.lit("model"), F.lit("auto")).alias("g")).first()["g"]["number"] == "0.88"


def rule_scorer(texts: pd.Series) -> pd.DataFrame:
    """The keyword rules once more, as a batch function."""
    rows = []
    for i, t in texts.items():
        spam, flood = bool(re.search(V.RULE_SPAM_PATTERN, t, re.A)), bool(re.search(V.RULE_FLOOD_PATTERN, t, re.A))
        c = 0.91 if spam else 0.88 if flood else 0.34
        rows.append((i, "hazard_topic", "noul", 0.5 + c / 2 if flood and not spam else 0.5 - c / 2, None, None, None))
        category = next((n for p, n, _ in V.CATEGORY_RULES if re.search(p, t, re.A)), "sentiment")
        rows.append((i, "category", "choice", None, category, None, 0.48 if category == "sentiment" else 0.76))
    return pd.DataFrame(rows, columns=["i", "question", "type", "noul", "choice", "score", "confidence"])


def test_scorer_seam_equals_expressions(spark, sf):
    from registry import views
    p = views.posts(spark, sf)
    pick = lambda df: {(r["id"], r["labels"]["relevant"]["value"], round(r["labels"]["relevant"]["confidence"], 6), r["labels"]["category"]["value"]) for r in df.collect()}
    assert pick(decide.to_labels(decide.decide(p, rule_scorer))) == pick(decide.to_labels(decide.decide(p)))


def test_meter_against_a_loop(spark):
    rng = random.Random(5)
    for budget, fail, run_at in ((0.01, 0.1, None), (9.0, 0.05, 700), (9.0, 0.0, None)):
        rows = [(i, 429 if rng.random() < fail or (run_at and run_at <= i < run_at + 31) else 200, 0.00004, i % 9 == 0) for i in range(1500)]
        if budget == 9.0 and run_at is None:
            rows[1200] = (1200, 402, 0.00004, False)
        spent, bad, stopped, want = 0.0, 0, False, []
        for _, status, cost, own in rows:
            model = not stopped and status == 200
            if not stopped:
                if status == 200:
                    bad = 0
                    spent += 0 if own else cost
                    stopped = not own and spent >= budget
                else:
                    bad += 1
                    stopped = status == 402 or bad >= 30
            want.append("model" if model else "heuristic")
        df = spark.createDataFrame(rows, "pos long, status int, cost double, own_key boolean")
        got = [r["classifier"] for r in meter.meter(df, budget, rows_per_bucket=100).orderBy("pos").collect()]
        assert got == want


def labelled(spark, rows):
    """rows: (seq, id, text, category, severity, pii, places)"""
    df = spark.createDataFrame([(s, i, t, c, float(v), p, pl) for s, i, t, c, v, p, pl in rows],
                               f"seq long, id string, text string, c string, sev double, pii boolean, places {S.PLACES}")
    lab = S.labels(relevant=S.relevance(True, 0.9), category=F.when(F.col("c").isNotNull(), S.decision(F.col("c"), 0.8)),
                   severity=S.decision(F.col("sev"), 0.5), has_pii=S.decision(F.col("pii"), 0.9))
    return df.withColumn("labels", lab).withColumn("classifier", F.lit("model")).withColumn("model_version", F.lit("m1")).withColumn(
        "author", F.concat(F.lit("author_"), "id")).withColumn("review", F.lit("auto"))


def place(name="Calgary, AB", lat=51.0, lon=-114.0, community=None):
    return (name, "city", lat, lon, 0.85, "gazetteer", None, community)


def test_exports_edge_records(spark):
    r = labelled(spark, [(0, "a", "=cmd|'/c calc'!A1", "access_blocked", 2, False, [place()]),
                         (1, "b", 'Water at 5th, "Main" St\nrising fast', "damage", 1, False, [place(), place("Two", 50.5, -113.0)]),
                         (2, "c", "no place", None, 0, True, [])])
    lines = [x["line"] for x in export.csv_lines(r).orderBy("seq", "pos").collect()]
    assert len(lines) == 4 and lines[0].startswith("a,'=cmd|'/c calc'!A1,access_blocked,Route blocked,2,Urgent,0.9,51,'-114,0.85,gazetteer,Inferred,")
    assert lines[1].startswith('b,"Water at 5th, ""Main"" St\nrising fast",damage') and lines[3].startswith("c,no place,,,0,Background,0.9,,,,,,")
    f = export.features(r).orderBy("seq", "pos").collect()
    assert len(f) == 3 and '"coordinates":[-114.0,51.0]' in f[0]["feature"] and "author" not in f[0]["feature"]
    assert "author_a" in export.features(r, True).orderBy("seq").first()["feature"]
    assert export.omitted_no_place(r).first()[0] == 1
    text = "\n".join(x["line"] for x in export.brief_lines(r, EventProfile("flood"), [("Roads are closed", ["a", "b"])], "2024-01-01").orderBy("section", "rank").collect())
    assert "* posts: 3, relevant: 3" in text and "* Roads are closed [a, b]" in text and not re.search(V.KILL_PATTERN, text)
    none = [x["line"] for x in export.brief_lines(r.where("seq > 9"), EventProfile()).collect()]
    assert "No posts." in none and not [x for x in none if x.startswith("* posts")]


def test_sms_stops_at_the_first_line_that_does_not_fit(spark):
    r = labelled(spark, [(0, "a", "w" * 60, "rescue_request", 2, False, [place()]), (1, "b", "long words " * 20, "access_blocked", 2, False, []), (2, "c", "x", "aid", 0, False, [])])
    text = export.sms_digest(r, 150).first()["digest"]
    assert text == f"Flood update, 3 auto-classified post(s): | Needs help @ Calgary, AB: {'w' * 60}" and len(text) <= 150
    assert export.sms_digest(r.where("seq > 9")).first()["digest"] == "No records to report."
    none = r.withColumn("labels", S.labels(relevant=S.relevance(False, 0.9)))
    assert export.sms_digest(none).first()["digest"] == "No relevant reports in this set."


def watched(df, folder):
    """The rows, and a function that tells how many have been read in all: each leaves a file."""
    import os
    import uuid
    folder.mkdir()

    def run(batches):
        for batch in batches:
            for _ in range(batch.num_rows):
                open(os.path.join(folder, uuid.uuid4().hex), "w").close()
            yield batch
    return df.mapInArrow(run, df.schema), lambda: len(os.listdir(folder))


def test_exports_run_the_records_once(spark, tmp_path):
    r = labelled(spark, [(0, "a", "first", "rescue_request", 2, False, [place()]), (1, "b", "second", "access_blocked", 2, False, []), (2, "c", "x", "aid", 0, False, [place()])])
    for k, use in enumerate((lambda df: export.write_geojson(df, str(tmp_path / "g")), lambda df: export.sms_digest(df).collect(), lambda df: export.write_csv(df, str(tmp_path / "c")))):
        rows, seen = watched(r, tmp_path / f"seen{k}")
        use(rows)
        assert seen() == 3
    rows, seen = watched(r.withColumn("is_candidate", F.lit(True)), tmp_path / "funnel")
    observed, funnel = facts.observed_funnel(rows)
    observed.write.mode("overwrite").parquet(str(tmp_path / "r"))
    assert seen() == 3 and funnel.get == {"raw": 3, "deduped": 3, "prefiltered": 3, "relevant": 3, "mappable": 2, "no_place": 1}
    assert export.write_geojson(r, str(tmp_path / "g")) == {"bbox": [-114.0, 51.0, -114.0, 51.0], "omitted_no_place": 1}


def test_exports_of_nothing_are_complete_files(spark, tmp_path):
    none = labelled(spark, [(0, "a", "first", "aid", 0, False, [])])
    assert export.write_geojson(none, str(tmp_path / "g")) == {"bbox": None, "omitted_no_place": 1}
    text = "".join(x["value"] for x in spark.read.text(str(tmp_path / "g")).collect())
    assert text == '{"type":"FeatureCollection","features":[]}'
    assert export.write_csv(none.where("seq > 9"), str(tmp_path / "c")) == 0
    assert [x["value"].lstrip("\ufeff") for x in spark.read.text(str(tmp_path / "c")).collect()] == [export.csv_header()]


def test_cache_rules(spark):
    df = spark.createDataFrame([("Road  closed at\nBow River",), ("  Road closed at Bow River ",), ("road closed at bow river",), (" ",)], "text string")
    k = [r[0] for r in df.select(cache.cache_key(F.col("text"), "flood")).collect()]
    assert k[0] == k[1] and k[0] != k[2] and k[3] is None
    assert k[0] != df.select(cache.cache_key(F.col("text"), "quake")).first()[0]
    r = labelled(spark, [(0, "a", "Bow River flooding", "aid", 0, False, []), (1, "b", "Second", "aid", 0, True, []), (2, "c", "", "aid", 0, False, [])])
    r = cache.with_key(r.withColumn("classifier", F.when(F.col("id") == "b", "heuristic").otherwise("model")), "flood")
    stored = cache.store(spark.createDataFrame([], cache.CACHE), cache.entries(r, 1))
    assert stored.count() == 1
    keyed = r.select("seq", "id", "text", "key", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))
    assert [x["id"] for x in cache.misses(keyed, stored).orderBy("seq").collect()] == ["b", "c"]
    hit = cache.hits(cache.lookup(keyed, stored)).first()
    assert hit["id"] == "a" and hit["model_version"] == "m1" and hit["places"][0]["name"] == "Bow River, AB"
    many = spark.createDataFrame([(f"k{i}", None, "model", None, None, i // 3) for i in range(12)], cache.CACHE)
    left = cache.evict_oldest(many, 5).collect()
    assert len(left) == 5 and {x["ts"] for x in left} == {2, 3} and sum(x["ts"] == 3 for x in left) == 3


def test_citations(spark):
    s = spark.createDataFrame([(0, "This is a fabricated claim.", ["r_999"]), (1, "This one cites nothing.", []), (2, "This confirmed report is spin.", ["a"]),
                               (3, "200,000 people were affected by this.", ["a"]), (4, " ", ["a"]), (5, "Roads closed — two of them.", ["a", "b"])], "sid long, sentence string, cited array<string>")
    kept, dropped = ask.enforce_citations(s, spark.createDataFrame([("a",), ("b",)], "id string"))
    assert [r["sentence"] for r in kept.collect()] == ["Roads closed, two of them."]
    assert {r["sid"]: r["reason"] for r in dropped.collect()} == {0: "cites unknown id r_999", 1: "no citations", 2: V.KILL_REASON, 3: V.PEOPLE_REASON, 4: "empty sentence"}


def test_question_terms(spark):
    q = spark.createDataFrame([(0, "How many posts mention Calgary?"), (1, 'Any "road closed" news near High River from Morley?'), (2, "What do people need most right now?"), (3, "is Bridgeland Calgary ok? Bridgeland")], "qid long, question string")
    got = {}
    for r in ask.extract_terms(q).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["label"])
    assert got == {0: ["Calgary, AB"], 1: ["High River, AB", "Stoney Nakoda (Morley) 142-144", "road closed"], 3: ["Calgary, AB", "Bridgeland"]}


def test_quoted_phrases_with_marks_are_exact(spark):
    terms = spark.createDataFrame([(0, 0, "can't", ["can't"]), (1, 0, "road  closed", ["road  closed"])], "qid long, rank int, label string, phrases array<string>")
    p = posts(spark, ["I can't go", "I can 't go", "Road\nclosed.", "roadclosed"])
    assert {(r["label"], r["seq"]) for r in ask.term_matches(terms, p).collect()} == {("can't", 0), ("road  closed", 2)}


def test_funnel_identity_and_invariants(spark, sf):
    from registry.records import records
    r = records(spark, sf)
    f = facts.funnel(r, prefiltered=F.lit(True)).first()
    assert f["relevant"] == f["mappable"] + f["no_place"] and f["raw"] >= f["deduped"]
    assert r.where("labels.has_pii.value AND raw_text is not null").count() == 0
    bad = r.select(F.explode_outer("places").alias("p")).where("p is not null AND (p.method is null OR p.confidence is null)")
    assert bad.count() == 0
    ids = themes.themes(r).select(F.explode("representative_ids").alias("id"))
    assert ids.join(r.select("id"), "id", "left_anti").count() == 0


def test_no_row_is_lost(spark, sf):
    from registry.pipeline_queries import _posts_and_images
    from registry import views
    p = _posts_and_images(spark, sf)
    r = triage.triage(p, EventProfile("flood"), None, decide.clean_descriptions(views.image_descriptions(spark, sf)))
    assert r.count() == p.count() and r.where("labels.relevant is null").count() == 0


def test_phrases_match_alike_in_place_and_joined(spark, monkeypatch):
    from postsieve.operators import ask
    p = posts(spark, ["a dam, at high-river", "high river and High River", "st. john's docks", "st john s", "nothing", "dam dam"]).withColumn("rel", F.col("seq") % 2 == 0)
    terms = spark.createDataFrame([("High River", ["high river", "highriver"]), ("St. John's", ["st. john's"]), ("dam", ["dam"]), ("dam", ["dam"])], "label string, phrases array<string>")
    got = []
    for limit in (ask.MAX_INLINE_WORDS, 0):
        monkeypatch.setattr(ask, "MAX_INLINE_WORDS", limit)
        got.append(sorted((r["label"], r["seq"], r["rel"]) for r in ask.term_matches(terms, p, ("rel",)).collect()))
    assert got[0] == got[1] and len(got[0]) == len(set(got[0])) and ("dam", 5, False) in got[0]
    assert ask.term_matches(terms.limit(0), p, ("rel",)).count() == 0


def test_throughput_equals_a_loop_over_any_chunks(spark):
    from postsieve.operators import recurrence
    rng = random.Random(8)
    rows = [(run, t, done) for run, n in ((1, 400), (2, 1), (3, 60), (9, 90)) for t, done in zip(
        sorted(rng.randrange(n * 30) for _ in range(n)), (sorted(rng.randrange(200) for _ in range(n)) if run != 9 else [0] * 50 + list(range(40))))]
    want = []
    for run in (1, 2, 3, 9):
        (t, done), *rest = [r[1:] for r in sorted(rows) if r[0] == run]
        ema = 0.0
        for a, b in rest:
            if a - t >= 50:
                rate = max(0.0, b - done) / ((a - t) / 1000)
                ema = 0.7 * ema + 0.3 * rate if ema > 0 else rate
                t, done = a, b
                want.append((run, a, b, round(rate, 6), round(ema, 6)))
    df = spark.createDataFrame(rows, "run long, t long, done long")
    for size in (7, 100, 10**6):
        got = sorted((r["run"], r["t"], r["done"], round(r["rate"], 6), round(r["ema"], 6)) for r in recurrence.throughput(df, size).collect())
        assert got == sorted(want)
    assert recurrence.throughput(df.limit(0)).count() == 0


def entry_rows(spark, rows):
    df = spark.createDataFrame(rows, "key string, model_version string, ts long")
    from postsieve.schema import LABELS
    return df.select("key", F.lit(None).cast(LABELS).alias("labels"), F.lit(V.MODEL_CLASSIFIER).alias("classifier"), "model_version", F.lit(None).cast("string").alias("redacted_text"), "ts")


def test_a_key_twice_in_the_cache_does_not_double_posts(spark):
    keyed = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "seq long, key string")
    found = cache.lookup(keyed, entry_rows(spark, [("a", "m0", 1), ("a", "m1", 2), ("a", "m0", 2)])).orderBy("seq").collect()
    assert [r["entry"] and r["entry"]["model_version"] for r in found] == ["m1", None, None]


def test_cache_table_moves_posts_only(spark, tmp_path):
    name = f"t{tmp_path.name.replace('-', '_')}"
    table = cache.CacheTable(spark, name, str(tmp_path), buckets=8)
    assert table.entries().count() == 0
    table.append(entry_rows(spark, [(f"k{i}", "m0", i) for i in range(200)]))
    table.append(entry_rows(spark, [(f"k{i}", "m1", 1000 + i) for i in range(50)]))
    keyed = spark.createDataFrame([(i, f"k{i}") for i in range(0, 400, 2)], "seq long, key string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        found = cache.lookup(keyed, table.entries())
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in final
    said = {r["seq"]: r["entry"] and r["entry"]["model_version"] for r in found.collect()}
    assert len(said) == 200 and said[10] == "m1" and said[60] == "m0" and said[300] is None
    table.compact(max_entries=120)
    assert {r["key"] for r in table.entries().collect()} == {f"k{i}" for i in [*range(50), *range(130, 200)]} and table._versions() == [1]


def test_evidence_equals_scoring_every_post(spark):
    rng = random.Random(12)
    words = ["water", "bridge", "road", "shelter", "dinner", "school", "hospital", "harbour"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 6))), rng.choice([0.0, 1.0, 2.0]), rng.choice([0.5, 0.9])) for k in range(700)]
    r = labelled(spark, [(k, f"e{k}", text, "damage", severity, False, []) for k, text, severity, _ in rows])
    r = r.withColumn("labels", F.col("labels").withField("relevant", S.relevance(True, 0.9)))
    asked = [(1, "water on the bridge"), (2, "Is the \"harbour road\" open?"), (3, "bridge water on it"), (4, "water water dinner school hospital"), (5, "nothing at all matches this"), (6, "harbour")]
    q = spark.createDataFrame(asked, "qid long, question string")
    terms = ask.extract_terms(q)
    got = {}
    for x in ask.evidence(q, terms, r, limit=7).collect():
        got.setdefault(x["qid"], []).append((x["rank"], x["seq"], x["overlap"], x["first_term"]))
    named = {}
    for t in terms.collect():
        named.setdefault(t["qid"], []).append((t["rank"], t["phrases"]))
    tokens = {k: {w for w in q0 if len(w) > 3} for k, q0 in q.select("qid", ask.T.tokenize(F.col("question"))).rdd.map(tuple).collect()}
    for qid, _ in asked:
        scored = []
        for k, text, severity, _ in rows:
            hit = [rank for rank, phrases in named.get(qid, []) if any(f" {p.lower()} " in f" {text} " for p in phrases)]
            scored.append((-(sum(text.split().count(w) for w in tokens[qid]) + 2 * len(hit)), -severity, k, 0 in hit))
        want = [(i + 1, k, -p, first) for i, (p, _, k, first) in enumerate(sorted(scored)[:7])]
        assert sorted(got[qid]) == want, qid


def test_question_terms_with_a_joined_gazetteer(spark, monkeypatch):
    from postsieve.sources import gazetteer
    q = spark.createDataFrame([(1, "How many posts mention Calgary or London?"), (2, "Siksika Nation and \"High River\" today"), (3, "no place")], "qid long, question string")
    inline = sorted(map(str, ask.extract_terms(q).collect()))
    monkeypatch.setattr(gazetteer, "MAX_INLINE_ALIASES", 10)
    assert sorted(map(str, ask.extract_terms(q, gazetteer.default_gazetteer(spark)).collect())) == inline
