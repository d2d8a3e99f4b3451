"""Typed decisions: raw answers to labels, labels to records, image descriptions, reviews."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from postsieve import schema as S, values as V
from postsieve.functions import text as T
from postsieve.functions.regex import java
from postsieve.functions.settle import settle
from postsieve.operators import geo, score
from postsieve.sources.gazetteer import Places

ANSWERS = "post_id string, question string, type string, noul double, choice string, score double, confidence double"
Scorer = Callable[[pd.Series], pd.DataFrame]


# --- answers ----------------------------------------------------------------------------------

def decide(posts: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """Answers for every post, one row per question.

    ``scorer`` maps a batch of texts to rows (``i`` = index in the batch, then the answer columns) and runs per
    Arrow batch inside the tasks; nothing leaves them. Without one, the keyword rules answer as expressions.
    """
    if scorer is None:
        return rule_answers(posts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["id"].reset_index(drop=True)
            out = scorer(batch["text"].reset_index(drop=True))
            yield out.assign(post_id=out["i"].map(ids)).drop(columns="i").reindex(
                columns=["post_id", "question", "type", "noul", "choice", "score", "confidence"])

    return posts.select("id", "text").mapInPandas(run, ANSWERS)


def _as_noul(d: Column) -> Column:
    return F.when(d["value"], 0.5 + d["confidence"] / 2).otherwise(0.5 - d["confidence"] / 2)


def rule_answers(posts: DataFrame) -> DataFrame:
    """The keyword rules in the shape of model answers. Places are judged by the geoparser."""
    has_place = F.size("places") > 0 if "places" in posts.columns else F.lit(False)
    df = posts.select("id", settle(score.rule_labels(F.col("text"), has_place)).alias("l"))
    rows = []
    for question, kind in V.QUESTIONS:
        source = "relevant" if question == "hazard_topic" else question
        if question == "response_topic":
            continue  # the rules judge one topic; a missing answer counts as 0
        d = F.col(f"l.{source}")
        rows.append(F.struct(
            F.lit(question).alias("question"), F.lit(kind).alias("type"),
            (_as_noul(d) if kind == "noul" else F.lit(None)).cast("double").alias("noul"),
            (d["value"] if kind == "choice" else F.lit(None)).cast("string").alias("choice"),
            (d["value"] if kind == "score" else F.lit(None)).cast("double").alias("score"),
            (d["confidence"] if kind != "noul" else F.lit(None)).cast("double").alias("confidence")))
    return df.select(F.col("id").alias("post_id"), F.explode(F.array(*rows)).alias("a")).select("post_id", "a.*")


def read_answers(answers: DataFrame) -> DataFrame:
    """Adds ``value_bool`` / ``value_text`` / ``value_number`` and the usable confidence of each answer."""
    noul = (F.col("type") == "noul") | F.col("noul").isNotNull()
    p = F.coalesce("noul", F.lit(0.0))
    return answers.select(
        "post_id", "question", "type", "noul",
        F.when(noul, p >= 0.5).alias("value_bool"),
        F.when(~noul & (F.col("type") == "choice"), F.col("choice")).alias("value_text"),
        F.when(~noul & (F.col("type") != "choice"), F.col("score")).alias("value_number"),
        # distance from the boundary is the confidence of a probability
        F.when(noul, F.abs(p - 0.5) * 2).otherwise(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))


def to_labels(answers: DataFrame) -> DataFrame:
    """(id, labels): one aggregate by post. Relevance is the stronger of the two topic answers."""
    read = read_answers(answers)
    picks = []
    for question, kind in V.QUESTIONS:
        here = F.col("question") == question
        if question in ("hazard_topic", "response_topic"):
            picks.append(F.max(F.when(here, F.coalesce("noul", F.lit(0.0)))).alias(question))
            continue
        value = {"noul": "value_bool", "choice": "value_text", "score": "value_number"}[kind]
        picks += [F.max(F.when(here, F.col(value))).alias(f"{question}_v"),
                  F.max(F.when(here, F.col("confidence"))).alias(f"{question}_c")]
    wide = read.groupBy("post_id").agg(*picks).fillna(0.0, ["hazard_topic", "response_topic"])
    h, r = F.col("hazard_topic"), F.col("response_topic")
    p = F.greatest(h, r)
    decisions = {
        "relevant": S.relevance(p >= 0.5, F.abs(p - 0.5) * 2, F.when(h >= r, "hazard").otherwise("response")),
        "hazard_topic": S.decision(h >= 0.5, F.abs(h - 0.5) * 2),
        "response_topic": S.decision(r >= 0.5, F.abs(r - 0.5) * 2),
    }
    for question, _ in V.QUESTIONS[2:]:
        decisions[question] = F.when(F.col(f"{question}_c").isNotNull(),
                                     S.decision(F.col(f"{question}_v"), F.col(f"{question}_c")))
    return wide.select(F.col("post_id").alias("id"), S.labels(**decisions).alias("labels"))


# --- records ----------------------------------------------------------------------------------

def says_no_place(labels: str = "labels") -> Column:
    return F.coalesce(~F.col(f"{labels}.has_place.value"), F.lit(False))


def pii_fired(labels: str = "labels") -> Column:
    return F.coalesce(F.col(f"{labels}.has_pii.value"), F.lit(False))


def route_review(review: Column, labels: str = "labels") -> Column:
    """Below the relevance gate the row goes back to ``auto``; it never promotes one."""
    unsure = F.coalesce(F.col(f"{labels}.relevant.confidence"), F.lit(0.0)) < V.CONFIDENCE_GATES["relevant"]
    return F.when(unsure, "auto").otherwise(review)


def finish(labelled: DataFrame, gazetteer: Places | DataFrame | None = None, countries: list[str] | None = None,
           use_place: bool = True) -> DataFrame:
    """Labelled posts to records: places, redaction, review. Expressions only.

    The text is searched for places before it is redacted, and not at all when the model saw none and no
    coordinates came with the row. ``raw_text`` is kept unless personal data was found.
    """
    df = geo.geoparse(labelled, gazetteer, countries, use_place=use_place, skip=says_no_place())
    review = F.col("review") if "review" in labelled.columns else F.lit("auto")
    return (df.withColumn("raw_text", F.when(~pii_fired(), F.col("text")))
            .withColumn("text", F.when(pii_fired(), T.redact(F.col("text"))).otherwise(F.col("text")))
            .withColumn("review", route_review(review)))


def label_posts(posts: DataFrame, labels: DataFrame, classifier: str = V.MODEL_CLASSIFIER,
                model_version: str | None = None) -> DataFrame:
    """Posts with their labels by id; posts without an answer get none."""
    df = posts.join(labels, "id", "left")
    return (df.withColumn("classifier", F.lit(classifier))
            .withColumn("model_version", F.lit(model_version).cast("string")))


# --- images -----------------------------------------------------------------------------------

def _clean_line(c: Column, limit: int | None = None) -> Column:
    plain = T.collapse(F.regexp_replace(c, java(r"(?i)\b(verified|confirmed)\b"), "reported"))
    if limit is None:
        return plain
    return F.when(F.length(plain) > limit, F.concat(F.rtrim(F.substring(plain, 1, limit - 1)), F.lit("…"))).otherwise(plain)


def _one_of(c: Column, allowed, default: str) -> Column:
    return F.when(c.isin(list(allowed)), c).otherwise(F.lit(default))


def clean_descriptions(raw: DataFrame, text_limit: int | None = None) -> DataFrame:
    """Image descriptions with unknown values coerced; rows without alternative text are void. Texts are whole unless limited."""
    kept = F.filter(F.coalesce("submerged", F.array().cast("array<string>")), lambda s: s.isin(list(V.SUBMERGED)))
    return raw.where(~T.is_blank(F.col("alt_text"))).select(
        "id", _clean_line(F.col("alt_text"), text_limit).alias("alt_text"),
        F.coalesce("hazard_visible", F.lit(False)).alias("hazard_visible"),
        _one_of(F.col("hazard"), V.ALL_HAZARDS, "other").alias("hazard"),
        _one_of(F.col("category"), V.CATEGORIES, "sentiment").alias("category"),
        F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("none"))).alias("submerged"),
        _one_of(F.col("water_depth"), V.WATER_DEPTHS, "unclear").alias("water_depth"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.0)))).alias("confidence"),
        _clean_line(F.when(T.is_blank(F.col("caption")), F.col("alt_text")).otherwise(F.col("caption")), text_limit).alias("caption"),
        T.trim_all(F.coalesce("ocr_text", F.lit(""))).alias("ocr_text"))


def attach_image_meta(images: DataFrame, image_meta: DataFrame) -> DataFrame:
    """Coordinates and time stored in the photo. The row's own time wins; bad coordinates are ignored."""
    meta = image_meta.select(F.col("id"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("ts").alias("_ts"))
    ok = geo.accepted_coordinates(F.col("_lat"), F.col("_lon"))
    return (images.join(meta, "id", "left")
            .withColumn("lat", F.when(ok, F.col("_lat"))).withColumn("lon", F.when(ok, F.col("_lon")))
            .withColumn("geo_method", F.when(ok, "exif")).withColumn("ts", F.coalesce("ts", "_ts"))
            .drop("_lat", "_lon", "_ts"))


def label_images(images: DataFrame, descriptions: DataFrame, gazetteer: Places | DataFrame | None = None,
                 countries: list[str] | None = None) -> DataFrame:
    """Image rows with text from the picture, places and labels. ``descriptions`` must be cleaned."""
    d = descriptions.select("id", F.struct("alt_text", "hazard_visible", "hazard", "category", "confidence",
                                           "caption", "ocr_text").alias("_d"))
    df = images.join(d, "id", "left")
    spoken = F.coalesce(F.when(F.col("_d.ocr_text") != "", F.col("_d.ocr_text")),
                        F.when(F.col("_d.caption") != "", F.col("_d.caption")), F.col("text"))
    df = geo.geoparse(df.withColumn("text", spoken), gazetteer, countries, use_place=False)
    seen, placed = F.col("_d").isNotNull(), F.size("places") > 0
    c = F.col("_d.confidence")
    full = S.labels(
        relevant=S.relevance(F.col("_d.hazard_visible"), c), hazard=S.decision(F.col("_d.hazard"), c),
        category=S.decision(F.col("_d.category"), c),
        has_place=S.decision(placed, F.when(placed, 0.9).otherwise(0.5)))
    return (df.withColumn("labels", F.when(seen, full).otherwise(S.labels(relevant=S.relevance(False, 0.0))))
            .withColumn("image_alt", F.col("_d.alt_text"))
            .withColumn("classifier", F.when(seen, V.MODEL_CLASSIFIER).otherwise(V.RULE_CLASSIFIER))
            .drop("_d"))


# --- review -----------------------------------------------------------------------------------

def gauge(decision: Column, gate: float, classifier: Column, review: Column) -> Column:
    """How a decision reads to a person: state, level and number, in order of precedence."""
    c = F.least(F.lit(1.0), F.greatest(F.lit(0.0), decision["confidence"]))
    state = (F.when(review == "rejected", "rejected").when(decision.isNull(), "pending")
             .when(classifier == V.RULE_CLASSIFIER, "no-reading").when(review == "confirmed", "checked")
             .when(c < gate, "below").otherwise("measured"))
    read = ~state.isin("rejected", "pending", "no-reading")
    return F.struct(state.alias("state"), F.when(read, c).otherwise(0.0).alias("level"),
                    F.when(read, F.format_string("%.2f", c)).otherwise("").alias("number"))


def review_state(records: DataFrame, gates: dict[str, float] = V.CONFIDENCE_GATES) -> DataFrame:
    """Adds the gauges of relevance and category. A confirmation speaks for relevance only."""
    category_review = F.when(F.col("review") == "rejected", "rejected").otherwise("auto")
    category = gauge(F.col("labels.category"), gates["category"], F.col("classifier"), category_review)
    return (records
            .withColumn("relevant_gauge", gauge(F.col("labels.relevant"), gates["relevant"], F.col("classifier"), F.col("review")))
            .withColumn("category_gauge", F.when(F.col("labels.category").isNotNull(), category)))


def review_queue(records: DataFrame) -> DataFrame:
    """Records with a decision below its gate."""
    return review_state(records).where(
        (F.col("relevant_gauge.state") == "below") | F.coalesce(F.col("category_gauge.state") == "below", F.lit(False)))


def apply_reviews(records: DataFrame, log: DataFrame) -> DataFrame:
    """The last action per id wins. The log itself is append only."""
    last = log.groupBy("id").agg(F.max_by("action", "at").alias("_action"))
    return records.join(last, "id", "left").withColumn("review", F.coalesce("_action", "review")).drop("_action")


def severity_band(score_col: Column) -> Column:
    return F.when(score_col >= 1.5, 2).when(score_col >= 0.75, 1).otherwise(0)


def confidence_band(c: Column) -> Column:
    return (F.when(c.isNull(), "uncertain").when(c >= 0.6, "firm").when(c >= 0.3, "probable").otherwise("uncertain"))
