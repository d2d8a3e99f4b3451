import random

import pytest
from pyspark.sql import functions as F

from postsieve.operators import geo, spatial
from postsieve.sources.gazetteer import Places, merge_gazetteer, default_gazetteer

GOLDEN = [
    ("they shut the glenmore dam gates", "Glenmore"), ("is hwy 22 passable tonight", "Highway 22"), ("so much rain #yycflood", "Calgary"),
    ("buses leave Medicine Hat at noon", "Medicine Hat"), ("tents going up at Siksika Nation", "Siksika"), ("no power in high-river", "High River"),
    ("who is at millennium park", "Millennium Park"), ("boats on millennium park, calgary", "Millennium Park, Calgary"), ("rain over London", "London"),
    ("nothing but sandbags", None), ("a quiet camp. that is all.", None), ("crews reach Lake St. Martin", "Lake St. Martin"),
    ("dykes hold at cumberland house", "Cumberland House"), ("Lytton First Nation wants pumps", "Lytton"), ("bridge to Kahnawake closed", "Kahnawake"),
    ("Tobique on alert", "Tobique"), ("ice jam near Old Crow", "Old Crow"),
]


def parse(spark, texts, **kw):
    df = spark.createDataFrame([(i, f"e{i}", t, None, None) for i, t in enumerate(texts)], "seq long, id string, text string, lat double, lon double")
    return [r["places"] for r in geo.geoparse(df, **kw).orderBy("seq").collect()]


def test_golden_texts(spark):
    for (text, want), places in zip(GOLDEN, parse(spark, [g[0] for g in GOLDEN])):
        assert (want is None and not places) or want in places[0]["name"], text
        assert all(p["method"] == "gazetteer" and 0 < p["confidence"] <= 1 for p in places)


def test_ambiguity_and_context(spark):
    alone, context = parse(spark, ["millennium park", "millennium park in Calgary"])
    assert alone[0]["confidence"] == 0.35 and [a["name"] for a in alone[0]["alternatives"]] == ["Millennium Park, Chicago, IL"]
    assert context[0]["confidence"] == 0.8 and [p["name"] for p in context] == ["Millennium Park, Calgary, AB", "Calgary, AB"]


def test_large_gazetteers_give_the_same_places_communities_and_scope(spark, monkeypatch):
    """A gazetteer of its own, once as a constant and once joined."""
    from postsieve.operators import profile
    from postsieve.plans import triage
    from postsieve.sources import gazetteer as G
    own = [(0, "Far Camp", ["far camp"], 10.0, 179.99, "reserve", "XX", "ZZ", None, True, "Far Nation"), (1, "Near Town", ["near town", "neartown"], 11.0, 20.0, "town", "YY", "ZY", 10, False, None)]
    rows = [(0, "at far camp now", None, None), (1, "given", 10.01, -179.99), (2, "given", 50.7667, -112.8833), (3, "#neartownfire and near town", None, None), (4, None, 11.0, 20.0)]
    posts = spark.createDataFrame(rows, "seq long, text string, lat double, lon double")
    table, seen = spark.createDataFrame(own, G.GAZETTEER_SCHEMA), []
    for limit in (G.MAX_INLINE_ALIASES, 0):
        monkeypatch.setattr(G, "MAX_INLINE_ALIASES", limit)
        got = {r["seq"]: [(p["name"], p["community"] and p["community"]["name"]) for p in r["places"]] for r in geo.geoparse(posts, table).collect()}
        ranked = [r["alias"] for r in profile.place_counts(posts.where("text is not null"), table).collect()]
        seen.append((got, ranked, triage.scope_of(profile.EventProfile(places=("far camp",)), table)))
    assert seen[0] == seen[1] and seen[0][0][1] == [("Provided coordinates", "Far Nation")] and seen[0][0][2] == [("Provided coordinates", None)]
    assert seen[0][1] == ["near town", "far camp"] and seen[0][2] == ["ZZ"]


def test_country_scope_drops_foreign_places(spark):
    assert parse(spark, ["Boston and Calgary"], countries=["CA"])[0][0]["name"] == "Calgary, AB"
    assert parse(spark, ["Boston"], countries=["CA"])[0] == []


def test_given_coordinates_win_and_find_their_community(spark):
    df = spark.createDataFrame([(0, "Calgary", 50.7667, -112.8833, "exif"), (1, "Calgary", 0.0, 0.0, "exif")], "seq long, text string, lat double, lon double, geo_method string")
    first, second = [r["places"] for r in geo.geoparse(df).orderBy("seq").collect()]
    assert first[0]["method"] == "exif" and first[0]["community"]["name"] == "Siksika Nation" and len(first) == 1
    assert second[0]["name"] == "Calgary, AB"


def by_replacement(words, aliases):
    """The rule in words: longest alias first, every occurrence blanked."""
    hay, hits = f" {' '.join(words)} ", []
    for a in aliases:
        if f" {a} " in hay:
            hits.append(a)
            # a blank that does not fuse the neighbours
            hay = hay.replace(f" {a} ", " | ")
    return hits


@pytest.mark.parametrize("path", ["inline", "joined"])
def test_longest_first_equals_replacement(spark, path):
    places = Places.of()
    aliases = places.aliases()
    pool = sorted({w for a in aliases for w in a.split()}) + ["x", "the"]
    rng = random.Random(7)
    texts = [" ".join(rng.choice(aliases) if rng.random() < 0.5 else rng.choice(pool) for _ in range(8)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, text string")
    if path == "inline":
        found = geo.find_aliases(df, places, F.col("text"))
    else:
        found = geo._joined_candidates(df, F.col("text"), default_gazetteer(spark))
        found = found.withColumn("_hits", geo._accept(F.col("_cands")))
    got = {r["seq"]: [h["alias"] for h in r["_hits"]] for r in found.select("seq", "_hits").collect()}
    for i, t in enumerate(texts):
        # equal lengths keep file order in both
        assert got[i] == by_replacement(t.split(), aliases), t


def test_adjacent_copies_leave_the_second_to_shorter_aliases(spark):
    df = spark.createDataFrame([(0, "siksika nation siksika nation")], "seq long, text string")
    assert [h["alias"] for h in geo.find_aliases(df, None, F.col("text")).first()["_hits"]] == ["siksika nation", "siksika"]


def test_merge_is_idempotent(spark):
    base = default_gazetteer(spark)
    new = base.where("ord < 2").withColumn("name", F.when(F.col("ord") == 0, "Newtown").otherwise(F.col("name")))
    once, refused = merge_gazetteer(base, new)
    assert once.count() == base.count() + 1 and [r["reason"] for r in refused.collect()] == ["already present"]
    assert merge_gazetteer(once, new)[0].count() == once.count()


def test_kth_smallest_equals_sorting(spark):
    rng = random.Random(3)
    values = [rng.choice([1.5, 2.25, rng.random() * 1e6, 7.0]) for _ in range(999)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (0, 49, 500, 998):
        assert spatial.kth_smallest(df, "v", k, buckets=16) == sorted(values)[k]


def test_stack_majority_counts_posts_and_first_wins_ties(spark):
    rows = [(1, "a", 0, "aid"), (2, "b", 0, "damage"), (3, "c", 0, "damage"), (4, "d", 0, "aid")]
    pts = spark.createDataFrame([(s, i, p, 1.0, 2.0, c, 0.5, 0.0, False, "L", "city", 8000) for s, i, p, c in rows],
                                "seq long, id string, pos int, lon double, lat double, category string, confidence double, severity double, exact boolean, label string, kind string, meters long")
    r = spatial.stacks(pts).first()
    assert (r["n"], r["category"], r["id"]) == (4, "aid", "a")
