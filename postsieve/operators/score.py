"""Free local scoring: what is worth a model call, what is spam, and labels when no model is at hand."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from postsieve import schema as S, values as V
from postsieve.functions import text as T
from postsieve.functions.settle import settle, worked_out
from postsieve.operators.profile import EventProfile, hazard_match


def is_spam(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [T.matches(text, p) for p in V.SPAM_PATTERNS])


def is_emergency(text: Column) -> Column:
    return T.matches(text, V.EMERGENCY_PATTERN)


def score_relevance(posts: DataFrame, profile: EventProfile, text: str = "text") -> DataFrame:
    """Adds ``prefilter`` (score, reasons, likely_spam). Column expressions only: one pass, no shuffle.

    A profile term is already a token, so intersecting the plain words with the terms equals intersecting the
    tokens, and no word needs a stop-word test.
    """
    t = F.col(text)
    own = hazard_match(t, profile.hazard)
    other = F.lit(None).cast("string")
    if not profile.focused:
        for h in reversed(V.HAZARDS):
            if h != profile.hazard:
                other = F.when(hazard_match(t, h), F.lit(h)).otherwise(other)
    stems = [p.lower().split(",")[0] for p in profile.places]
    lowered = F.lower(t)
    near = reduce(lambda a, b: a | b, [lowered.contains(s) for s in stems], F.lit(False))
    if profile.terms:
        words = F.split(T.normalize(t), " ")
        shared = F.size(F.array_intersect(words, F.array(*[F.lit(x) for x in profile.terms])))
    else:
        shared = F.lit(0)
    df = posts.withColumn("_sig", settle(F.struct(
        own.alias("own"), F.when(~own, other).alias("other"), is_emergency(t).alias("emergency"), near.alias("near"),
        shared.alias("shared"), is_spam(t).alias("spam"))))
    s = {k: F.col(f"_sig.{k}") for k in ("own", "other", "emergency", "near", "shared", "spam")}
    score = F.when(s["own"], V.SCORE_OWN).when(s["other"].isNotNull(), V.SCORE_OTHER).otherwise(0.0)
    score = score + F.when(s["emergency"], V.SCORE_EMERGENCY).otherwise(0.0)
    score = score + F.when(s["near"], V.SCORE_NEAR).otherwise(0.0)
    score = score + F.least(F.lit(V.SCORE_TERMS_MAX), s["shared"] * F.lit(V.SCORE_TERM))
    reasons = F.array_compact(F.array(
        F.when(s["spam"], "matches spam pattern"),
        F.when(s["own"], f"mentions {profile.hazard}")
         .when(s["other"].isNotNull(), F.concat(F.lit("mentions "), s["other"], F.lit(" (not the corpus's dominant hazard)"))),
        F.when(s["emergency"], "emergency vocabulary"),
        F.when(s["near"], "names a place from the event area"),
        F.when(s["shared"] > 0, F.concat(s["shared"].cast("string"), F.lit(" shared corpus terms")))))
    return df.withColumn("prefilter", F.struct(
        F.least(F.lit(1.0), score).alias("score"), reasons.alias("reasons"), s["spam"].alias("likely_spam"))).drop("_sig")


def prefilter(scored: DataFrame, threshold: float = V.PREFILTER_THRESHOLD) -> DataFrame:
    """Adds ``is_candidate``. Both sides stay in the result; nothing is dropped silently."""
    keep = ~F.col("prefilter.likely_spam") & (F.col("prefilter.score") >= threshold)
    return scored.withColumn("is_candidate", keep)


def ranked_candidates(scored: DataFrame) -> DataFrame:
    """Best candidates first, file order among equals, so that a budget that runs out has kept the best."""
    return scored.where("is_candidate").orderBy(F.desc("prefilter.score"), "seq")


def heuristic_labels(text: Column, profile: EventProfile) -> Column:
    """Labels from the local score. The hazard must come from the post's own text."""
    p = F.least(F.lit(0.95), F.col("prefilter.score"))
    spam = F.col("prefilter.likely_spam")
    own = F.when(hazard_match(text, profile.hazard), F.lit(profile.hazard)).otherwise("other")
    return S.labels(
        relevant=S.relevance((p >= 0.3) & ~spam, 0.3),
        is_spam=S.decision(spam, F.when(spam, 0.6).otherwise(0.3)),
        hazard=S.decision(own, 0.3))


def dropped_labels() -> Column:
    spam = F.col("prefilter.likely_spam")
    return S.labels(relevant=S.relevance(False, 0.4), is_spam=S.decision(spam, F.when(spam, 0.6).otherwise(0.3)))


def unusable_labels() -> Column:
    return S.labels(relevant=S.relevance(False, 0.0))


def rule_labels(text: Column, has_place: Column) -> Column:
    """Offline keyword classifier: the first matching rule gives category and severity.

    Every pattern is tried once per text at most: the answers are read many times below, so they are worked out first.
    """
    rule = F.lit(None).cast("int")
    for i in reversed(range(len(V.CATEGORY_RULES))):
        rule = F.when(T.matches(text, V.CATEGORY_RULES[i][0]), i).otherwise(rule)
    found = F.struct(
        rule.alias("rule"), T.matches(text, V.RULE_SPAM_PATTERN).alias("spam"), T.matches(text, V.RULE_FLOOD_PATTERN).alias("flood"),
        T.matches(text, V.RULE_REQUEST_PATTERN).alias("request"), T.matches(text, V.RULE_RESHARE_PATTERN).alias("reshare"), has_place.alias("place"))
    return worked_out(found, _labels_of_rules)


def _labels_of_rules(found: Column) -> Column:
    c = V.RULE_CONFIDENCE
    rule, spam, flood, place = found["rule"], found["spam"], found["flood"], found["place"]
    category, severity = F.lit("sentiment"), F.lit(0.0)
    for i, (_, name, level) in enumerate(V.CATEGORY_RULES):
        category = F.when(rule == i, name).otherwise(category)
        severity = F.when(rule == i, float(level)).otherwise(severity)
    return S.labels(
        relevant=S.relevance(flood & ~spam, F.when(spam, c["relevant_spam"]).when(flood, c["relevant_hit"]).otherwise(c["relevant_miss"])),
        hazard=S.decision(F.when(flood, "flood").otherwise("other"), F.when(flood, c["hazard_hit"]).otherwise(c["hazard_miss"])),
        category=S.decision(category, F.when(category == "sentiment", c["category_sentiment"]).otherwise(c["category_hit"])),
        severity=S.decision(severity, c["severity"]),
        has_place=S.decision(place, F.when(place, c["has_place_hit"]).otherwise(c["has_place_miss"])),
        is_request=S.decision(found["request"], c["is_request"]),
        has_pii=S.decision(False, c["has_pii"]),
        is_spam=S.decision(spam, F.when(spam, c["is_spam_hit"]).otherwise(c["is_spam_miss"])),
        firsthand=S.decision(~found["reshare"], c["firsthand"]))
