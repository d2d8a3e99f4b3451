"""Record shapes shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from postsieve import values as V

PLACE = ("struct<name:string,kind:string,lat:double,lon:double,confidence:double,method:string,"
         "alternatives:array<struct<name:string,lat:double,lon:double>>,community:struct<name:string,id:string>>")
PLACES = f"array<{PLACE}>"
_BOOL = "struct<value:boolean,confidence:double>"
_TEXT = "struct<value:string,confidence:double>"
LABEL_TYPES = {
    "relevant": "struct<value:boolean,confidence:double,via:string>",
    "hazard_topic": _BOOL, "response_topic": _BOOL, "hazard": _TEXT, "category": _TEXT,
    "severity": "struct<value:double,confidence:double>",
    **{q: _BOOL for q in V.BOOLEAN_QUESTIONS},
}
LABELS = "struct<" + ",".join(f"{k}:{t}" for k, t in LABEL_TYPES.items()) + ">"

POSTS = ("seq long, id string, source string, text string, lat double, lon double, place string, ts string, "
         "author string, source_url string, fetch_method string, image_ref string, duplicate_count long")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decision(value, confidence) -> Column:
    """A value with how sure we are of it."""
    v = value if isinstance(value, Column) else F.lit(value)
    c = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return F.struct(v.alias("value"), c.cast("double").alias("confidence"))


def relevance(value, confidence, via="hazard") -> Column:
    v = value if isinstance(value, Column) else F.lit(value)
    c = confidence if isinstance(confidence, Column) else F.lit(confidence)
    w = via if isinstance(via, Column) else F.lit(via)
    return F.struct(v.alias("value"), c.cast("double").alias("confidence"), w.alias("via"))


def labels(**decisions: Column) -> Column:
    """The label struct; questions that are not given stay null."""
    return F.struct(*[
        decisions[q].cast(t).alias(q) if q in decisions else F.lit(None).cast(t).alias(q)
        for q, t in LABEL_TYPES.items()])


def no_places() -> Column:
    return F.array().cast(PLACES)


def relevant(prefix: str = "labels") -> Column:
    """True only for records labelled relevant."""
    return F.coalesce(F.col(f"{prefix}.relevant.value"), F.lit(False))
