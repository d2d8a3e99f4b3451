"""What a corpus is about: hazard, whether it mixes several, distinctive terms, places."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from postsieve import values as V
from postsieve.functions import text as T
from postsieve.functions.settle import place_number
from postsieve.operators.geo import named_aliases_joined, with_named_aliases
from postsieve.operators.position import systematic_sample
from postsieve.sources.gazetteer import Places, fits_inline


@dataclass(frozen=True)
class EventProfile:
    """A few dozen values per corpus, so it travels as constants inside the scoring plan."""

    hazard: str = "other"
    places: tuple[str, ...] = ()
    terms: tuple[str, ...] = ()
    mixed: bool = False
    detected_hazard: str = "other"
    hazard_shares: dict[str, float] = field(default_factory=dict)
    focused: bool = False
    user_edited: bool = False

    def pinned(self, hazard: str = "flood") -> "EventProfile":
        """The user's choice of hazard; detection no longer overrides it."""
        return replace(self, hazard=hazard, user_edited=True, focused=True)

    def to_row(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(self.hazard, self.mixed, self.detected_hazard, dict(self.hazard_shares), self.focused,
              list(self.places), list(self.terms), self.user_edited)],
            "hazard string, mixed boolean, detected_hazard string, hazard_shares map<string,double>, "
            "focused boolean, places array<string>, terms array<string>, user_edited boolean")


def hazard_match(text: Column, hazard: str) -> Column:
    """``other`` never matches."""
    return T.matches(text, V.HAZARD_PATTERNS[hazard]) if hazard in V.HAZARD_PATTERNS else F.lit(False)


def with_text(posts: DataFrame) -> DataFrame:
    return posts.where(F.coalesce(F.col("text") != "", F.lit(False)))


def sample_posts(posts: DataFrame, limit: int = V.SAMPLE_SIZE) -> tuple[DataFrame, int]:
    """Posts with text, every n-th of them when there are more than ``limit``."""
    return systematic_sample(with_text(posts), limit)


def hazard_profile(sample: DataFrame) -> DataFrame:
    """One row: counts per vocabulary, verdict, shares, and whether several hazards share the corpus."""
    counts = sample.agg(F.count("*").alias("n"), *[
        F.count_if(hazard_match(F.col("text"), h)).alias(h) for h in V.HAZARDS])
    # the ordinal breaks ties in the fixed hazard order
    ranked = F.array_sort(F.array(*[F.struct((-F.col(h)).alias("neg"), F.lit(i).alias("i"), F.lit(h).alias("h"))
                                    for i, h in enumerate(V.HAZARDS)]))
    total = sum((F.col(h) for h in V.HAZARDS), F.lit(0))
    counts = counts.withColumn("ranked", ranked).withColumn("total", total)
    top, second = -F.col("ranked")[0]["neg"], -F.col("ranked")[1]["neg"]
    enough = top >= F.greatest(F.lit(5.0), F.col("n") * 0.02)
    share = {h: F.when(F.col("total") > 0, F.col(h) / F.col("total")) for h in V.HAZARDS}
    substantial = sum((F.when(share[h] >= 0.15, 1).otherwise(0) for h in V.HAZARDS), F.lit(0))
    return counts.select(
        "n", *V.HAZARDS,
        F.when(enough & (top >= second * 1.5), F.col("ranked")[0]["h"]).otherwise("other").alias("hazard"),
        *[share[h].alias(f"{h}_share") for h in V.HAZARDS],
        (enough & (substantial >= 2)).alias("mixed"))


def term_counts(sample: DataFrame, n: int) -> DataFrame:
    """Words of at least three posts and fewer than 60 % of them, 40 most frequent; ties go to the first seen, then by word.

    Counted before the shuffle, so a word costs one row per input partition. The first place is one decimal number (any post, then
    word up to 2**20), which keeps the aggregation in a hash table.
    """
    words = F.array_distinct(F.split(T.normalize(F.col("text")), " "))
    seen = (sample.select("seq", F.posexplode(words).alias("pos", "term")).where(T.is_token(F.col("term")))
            .groupBy("term").agg(F.count("*").alias("n"), F.min(place_number("seq", "pos")).alias("first")))
    kept = seen.where((F.col("n") >= V.TERM_MIN_DF) & (F.col("n") < n * V.TERM_MAX_SHARE))
    return kept.orderBy(F.desc("n"), "first", "term").limit(V.TERM_LIMIT)


def place_counts(sample: DataFrame, places: Places | DataFrame, limit: int = V.PLACE_LIMIT) -> DataFrame:
    """Aliases by number of posts that name them; ties go to the longer alias. A large gazetteer is joined."""
    if isinstance(places, DataFrame) and fits_inline(places):
        places = Places.of(places)
    if isinstance(places, DataFrame):
        named = named_aliases_joined(sample, places).withColumn("rank", F.struct(-F.length("alias"), "first"))
        return named.groupBy("alias", "rank").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rank").limit(limit)
    ranks = sample.sparkSession.createDataFrame(list(enumerate(places.aliases())) or [(0, "")], "rank int, alias string")
    named = with_named_aliases(sample.select("text"), F.col("text"), places, "a").select(F.explode("a").alias("alias"))
    counts = named.groupBy("alias").agg(F.count("*").alias("n")).join(F.broadcast(ranks), "alias")  # as many rows as fit a plan
    return counts.orderBy(F.desc("n"), "rank").limit(limit)


def _ranked_names(df: DataFrame, name: str, order: list) -> list[str]:
    return [r[0] for r in df.orderBy(*order).select(name).collect()]  # at most 40 or 8 rows


def detect(posts: DataFrame, places: Places | DataFrame | None = None, sample_size: int | None = None) -> EventProfile:
    """Profile of a corpus, over all its posts unless a sample size is given.

    Three passes of aggregates over narrow columns; pass a written table.
    """
    places = places or Places.of()
    texts = _chosen(posts.select("seq", "text"), sample_size)
    h = hazard_profile(texts).first().asDict()
    terms = _ranked_names(term_counts(texts, h["n"]), "term", [F.desc("n"), "first", "term"])
    named = _ranked_names(place_counts(texts, places), "alias", [F.desc("n"), "rank"])
    shares = {k: h[f"{k}_share"] for k in V.HAZARDS if h[f"{k}_share"] is not None}
    return EventProfile(h["hazard"], tuple(named), tuple(terms), h["mixed"], h["hazard"], shares)


def _chosen(posts: DataFrame, sample_size: int | None) -> DataFrame:
    return with_text(posts) if sample_size is None else sample_posts(posts, sample_size)[0]


def target_places(posts: DataFrame, places: Places | DataFrame | None = None, target: str = "flood", sample_size: int | None = None) -> DataFrame:
    """Place ranking over the posts that name the target hazard."""
    about = posts.select("seq", "text").where(hazard_match(F.col("text"), target))
    return place_counts(_chosen(about, sample_size), places or Places.of())


def focus(profile: EventProfile, posts: DataFrame, places: Places | DataFrame | None = None, target: str = "flood",
          sample_size: int | None = None) -> EventProfile:
    """A mixed corpus is looked at for one hazard, with the places of its posts; others are left alone."""
    if not profile.mixed or profile.user_edited:
        return profile
    named = _ranked_names(target_places(posts, places, target, sample_size), "alias", [F.desc("n"), "rank"])
    return replace(profile, hazard=target, focused=True, places=tuple(named) or profile.places)


def disclosed_shares(profile_row: DataFrame) -> DataFrame:
    """Hazard shares of at least one percent, largest first, in whole percent."""
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(h).alias("hazard"), F.col(f"{h}_share").alias("share"))
                      for i, h in enumerate(V.HAZARDS)])
    rows = profile_row.where("mixed").select(F.explode(pairs).alias("p")).select("p.*").where("share >= 0.01")
    rank = F.row_number().over(Window.orderBy(F.desc("share"), "i"))  # four rows at most
    return rows.select(rank.cast("long").alias("rank"), "hazard", F.floor(F.col("share") * 100 + 0.5).cast("long").alias("percent"))
