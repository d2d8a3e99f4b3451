"""The whole way from posts to records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postsieve import schema as S, values as V
from postsieve.functions import text as T
from postsieve.functions.settle import settle
from postsieve.operators import cache, decide, dedupe, geo, profile as P, score
from postsieve.operators.meter import meter
from postsieve.operators.position import with_position
from postsieve.session import materialize
from postsieve.sources.gazetteer import Places, countries_of


def prepare(posts: DataFrame, places: Places | DataFrame | None = None) -> tuple[DataFrame, P.EventProfile]:
    """Copies collapsed (written once, since profile and scoring pass over them) and the corpus profile."""
    kept = materialize(dedupe.collapse_with_images(posts) if "image_ref" in posts.columns else dedupe.collapse_exact(posts), "kept")
    return kept, P.focus(P.detect(kept, places), kept, places)


def scope_of(profile: P.EventProfile, gazetteer: Places | DataFrame | None = None) -> list[str] | None:
    """Countries of a single-region corpus, by the gazetteer in use; a mixed one is not limited."""
    if profile.mixed or not profile.places:
        return None
    if isinstance(gazetteer, DataFrame):
        named = gazetteer.sparkSession.createDataFrame([(p,) for p in profile.places], "alias string")  # 8 at most
        return sorted(r["country"] for r in countries_of(named, gazetteer).collect() if r["country"]) or None  # the countries of 8 names
    return (gazetteer or Places.of()).countries_of(list(profile.places)) or None


def triage(posts: DataFrame, profile: P.EventProfile, labels: DataFrame | None = None, images: DataFrame | None = None,
           gazetteer: Places | DataFrame | None = None, threshold: float = V.PREFILTER_THRESHOLD, model_version: str | None = None) -> DataFrame:
    """Records for every post; as many rows leave as enter.

    Text posts take one pass: a candidate gets the model's labels (or heuristic ones where there are none), a
    post below the threshold and one without anything to read are labelled as such. ``labels`` (id, labels) are
    the model's answers, ``images`` the cleaned descriptions; image posts form the second branch.
    """
    scope = scope_of(profile, gazetteer)
    blank = T.is_blank(F.col("text"))
    has_image = F.col("image_ref").isNotNull() if "image_ref" in posts.columns else F.lit(False)
    text_posts = posts.where(~blank | ~has_image)
    df = score.prefilter(score.score_relevance(text_posts, profile), threshold)
    df = df.withColumn("is_candidate", F.col("is_candidate") & ~blank)
    if labels is None:
        df = df.withColumn("_model", F.lit(None).cast(S.LABELS))
    else:
        df = df.join(labels.withColumnRenamed("labels", "_model"), "id", "left")
    modelled = F.col("is_candidate") & F.col("_model").isNotNull()
    chosen = (F.when(blank, score.unusable_labels()).when(~F.col("is_candidate"), score.dropped_labels())
              .when(modelled, F.col("_model")).otherwise(score.heuristic_labels(F.col("text"), profile)))
    df = (df.withColumn("labels", settle(chosen))
          .withColumn("classifier", F.when(modelled, V.MODEL_CLASSIFIER).otherwise(V.RULE_CLASSIFIER))
          .withColumn("model_version", F.when(modelled, F.lit(model_version)).cast("string")).drop("_model"))
    # rows that were not candidates keep given coordinates but are not searched
    skip = ~F.col("is_candidate") | decide.says_no_place()
    df = geo.geoparse(df, gazetteer, scope, use_place=False, skip=skip)
    pii = decide.pii_fired()
    df = (df.withColumn("raw_text", F.when(~pii, F.col("text"))).withColumn("text", F.when(pii, T.redact(F.col("text"))).otherwise(F.col("text")))
          .withColumn("review", decide.route_review(F.lit("auto"))))
    if "image_ref" not in posts.columns:
        return df
    photo = posts.where(blank & has_image)
    empty = photo.sparkSession.createDataFrame([], "id string, alt_text string, hazard_visible boolean, hazard string, category string, "
                                               "submerged array<string>, water_depth string, confidence double, caption string, ocr_text string")
    shown = decide.label_images(photo, empty if images is None else images, gazetteer, scope)
    shown = shown.withColumn("is_candidate", F.lit(False)).withColumn("review", decide.route_review(F.lit("auto")))
    return df.unionByName(shown, allowMissingColumns=True)


def paid_labels(posts: DataFrame, profile: P.EventProfile, labels: DataFrame, calls: DataFrame, cached: DataFrame | None = None,
                questions: str = "", budget: float = V.SESSION_BUDGET, threshold: float = V.PREFILTER_THRESHOLD, **limits) -> DataFrame:
    """(id, labels, cached): the labels that candidates have from the cache or from a call the budget still allowed.

    Candidates without an entry queue by score, best first; ``calls`` (id, status, cost, own_key) is what their calls came to,
    and the meter ends them at the budget, a refusal or a run of failures. Candidates after the stop have no row here, so
    ``triage`` labels them by rules. A call without a row in ``calls`` was never answered.
    """
    scored = score.prefilter(score.score_relevance(posts, profile), threshold).where("is_candidate")
    keyed = materialize(cache.with_key(scored.select("seq", "id", "text", F.col("prefilter.score").alias("score")), profile.hazard, questions=questions), "candidates")
    if cached is None:
        hit, missed = None, keyed
    else:
        hit = cache.lookup(keyed, cached).where("entry IS NOT NULL").select("id", "entry.labels", F.lit(True).alias("cached"))
        missed = cache.misses(keyed, cached)
    queue = with_position(missed.select("seq", "id", "score"), "seq", rank="score").select("id", F.col("position").alias("pos"))
    ledger = queue.join(calls.select("id", "status", "cost", "own_key"), "id", "left")
    ledger = ledger.select("id", "pos", F.coalesce("status", F.lit(0)).alias("status"), F.coalesce("cost", F.lit(0.0)).alias("cost"), F.coalesce("own_key", F.lit(False)).alias("own_key"))
    paid = meter(ledger, budget, **limits).where(F.col("classifier") == V.MODEL_CLASSIFIER)
    fresh = paid.select("id").join(labels.select("id", "labels"), "id").withColumn("cached", F.lit(False))
    return fresh if hit is None else hit.unionByName(fresh)


def unusable_rejects(records: DataFrame) -> DataFrame:
    """Reject entries of records with neither text nor image."""
    none = T.is_blank(F.col("text")) & (F.col("image_ref").isNull() if "image_ref" in records.columns else F.lit(True))
    return records.where(none).select(F.lit(0).cast("long").alias("row"), F.concat(
        F.lit("record "), "id", F.lit(" has no text and no image")).alias("reason"))


def add(records: DataFrame, new_records: DataFrame) -> DataFrame:
    """Later records join the working set; the profile they were made with stays as it was."""
    return records.unionByName(new_records, allowMissingColumns=True)
