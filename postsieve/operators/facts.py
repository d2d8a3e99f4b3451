"""Exact figures over all records: funnel, breakdowns, explorer filters, pages, separation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from postsieve import schema as S, values as V
from postsieve.functions import text as T
from postsieve.functions.settle import settle
from postsieve.operators.decide import severity_band
from postsieve.operators.geo import community_rollup

FUNNEL = ("raw", "deduped", "prefiltered", "relevant", "mappable", "no_place")


def placed() -> Column:
    return F.size("places") > 0


def _stages(records: DataFrame, raw: int | None = None, prefiltered: Column | None = None) -> list[Column]:
    rel = S.relevant()
    copies = F.coalesce("duplicate_count", F.lit(1)) if "duplicate_count" in records.columns else F.lit(1)
    passed = F.col("is_candidate") if prefiltered is None else prefiltered
    counted = F.coalesce(F.sum(copies), F.lit(0)) if raw is None else F.max(F.lit(raw))
    return [counted.cast("long").alias("raw"), F.count("*").alias("deduped"), F.count_if(passed).alias("prefiltered"), F.count_if(rel).alias("relevant"),
            F.count_if(rel & placed()).alias("mappable"), F.count_if(rel & ~placed()).alias("no_place")]


def funnel(records: DataFrame, raw: int | None = None, prefiltered: Column | None = None) -> DataFrame:
    """One row of stage counts in one pass. ``raw`` defaults to the copies behind the records."""
    row = records.agg(*_stages(records, raw, prefiltered))
    return row if raw is None else row.withColumn("raw", F.lit(raw).cast("long"))


def observed_funnel(records: DataFrame, prefiltered: Column | None = None) -> tuple[DataFrame, Observation]:
    """The records, and an observation that has the stage counts once they have been written or read in full: no pass of its own."""
    seen = Observation()
    return records.observe(seen, *_stages(records, None, prefiltered)), seen


def funnel_shares(funnel_row: DataFrame) -> DataFrame:
    """Percent of the raw rows mapped, relevant without place, and gone before that."""
    total = F.greatest(F.col("raw"), F.lit(1))
    mapped, unplaced = F.col("mappable") / total * 100, F.col("no_place") / total * 100
    return funnel_row.select(mapped.alias("mapped_pct"), unplaced.alias("unplaced_pct"),
                             F.greatest(F.lit(0.0), 100 - mapped - unplaced).alias("remainder_pct"))


def merge_funnels(reports: DataFrame) -> DataFrame:
    """Batches report (batch, at, counts) repeatedly; the last report of each batch counts."""
    names = ("prefiltered", "relevant", "mappable", "no_place")
    last = reports.groupBy("batch").agg(F.max(F.struct("at", *names)).alias("r"))
    return last.agg(*[F.coalesce(F.sum(f"r.{n}"), F.lit(0)).alias(n) for n in names])


def merge_rejects(rejects: DataFrame, limit: int | None = None) -> DataFrame:
    """The rejected rows of a merged report in order: all of them, or the first ones for display."""
    ordered = rejects.orderBy("batch", "row")
    return ordered if limit is None else ordered.limit(limit)


def add_funnels(*funnels: DataFrame) -> DataFrame:
    """Cached or later batches added to a funnel."""
    union = funnels[0]
    for f in funnels[1:]:
        union = union.unionByName(f, allowMissingColumns=True)
    return union.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in funnels[0].columns])


def hazard_breakdown(records: DataFrame) -> DataFrame:
    known = records.where(F.col("labels.hazard.value").isin(list(V.ALL_HAZARDS)))
    counts = known.groupBy(F.col("labels.hazard.value").alias("hazard")).agg(F.count("*").alias("count"))
    return counts.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy()))  # five rows at most


def flood_totals(records: DataFrame) -> DataFrame:
    """What the flood-only view holds: relevant, and labelled flood or not labelled."""
    seen = S.relevant() & F.coalesce(F.col("labels.hazard.value") == "flood", F.lit(True))
    return records.agg(F.count_if(seen).alias("found"), F.count_if(seen & placed()).alias("mapped"))


def relevant_communities(records: DataFrame) -> DataFrame:
    return community_rollup(records.where(S.relevant()))


def classifier_mix(records: DataFrame) -> DataFrame:
    """Model and rule counts, and the model versions in order of first appearance (a handful)."""
    by = records.groupBy("classifier", "model_version").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    model = F.col("classifier") != V.RULE_CLASSIFIER
    named = F.when(model & F.col("model_version").isNotNull(), F.struct("first", "model_version"))
    return by.agg(F.coalesce(F.sum(F.when(model, F.col("n"))), F.lit(0)).alias("model_count"),
                  F.coalesce(F.sum(F.when(~model, F.col("n"))), F.lit(0)).alias("rule_count"),
                  F.transform(F.array_sort(F.collect_list(named)), lambda v: v["model_version"]).alias("_v")
                  ).select("model_count", "rule_count", F.array_distinct("_v").alias("model_versions"))


# --- explorer ---------------------------------------------------------------------------------

def explore(records: DataFrame, categories: list[str] | None = None, min_confidence: float = 0.0,
            only_mapped: bool = False, only_requests: bool = False, flood_only: bool = False,
            hazard: str | None = None, community: str | None = None, query: str = "",
            theme_members: DataFrame | None = None) -> DataFrame:
    """Relevant records that pass every given filter. A missing category or hazard label passes its set filter;
    picking one hazard demands the label."""
    keep = S.relevant() & (F.coalesce("labels.relevant.confidence", F.lit(0.0)) >= min_confidence)
    category, kind = F.col("labels.category.value"), F.col("labels.hazard.value")
    if categories is not None:
        keep &= category.isNull() | category.isin(categories)
    if only_mapped:
        keep &= placed()
    if only_requests:
        keep &= F.coalesce("labels.is_request.value", F.lit(False))
    if flood_only:
        keep &= kind.isNull() | (kind == "flood")
    if hazard:
        keep &= F.coalesce(kind == hazard, F.lit(False))
    if community:
        keep &= F.exists("places", lambda p: F.coalesce(p["community"]["name"] == community, F.lit(False)))
    needle = query.strip().lower()
    if needle:
        keep &= F.lower("text").contains(needle)
    out = records.where(keep)
    return out if theme_members is None else out.join(theme_members.select("id"), "id", "left_semi")


def mapped_counts(view: DataFrame) -> DataFrame:
    return view.agg(F.count_if(placed()).alias("mapped"), F.count_if(~placed()).alias("unmapped"))


def triage_rank(category: Column) -> Column:
    rank = F.lit(len(V.CATEGORY_TRIAGE_ORDER))
    for i, c in enumerate(V.CATEGORY_TRIAGE_ORDER):
        rank = F.when(category == c, i).otherwise(rank)
    return rank


SORTS = {
    "severity": lambda: severity_band(F.col("labels.severity.value")),
    "confidence": lambda: F.coalesce("labels.relevant.confidence", F.lit(0.0)),
    "category": lambda: F.collate(F.coalesce("labels.category.value", F.lit("zzz")), "UNICODE"),
    "place": lambda: F.collate(F.coalesce(F.get("places.name", 0), F.lit("zzz")), "UNICODE"),
}


def sort_records(records: DataFrame, sort: str = "severity", descending: bool = True) -> DataFrame:
    key = SORTS[sort]()
    return records.orderBy(key.desc() if descending else key.asc(), "seq")


def report_page(records: DataFrame, sort: str = "severity", page: int = 0, descending: bool = True,
                rows: int = V.PAGE_ROWS) -> DataFrame:
    """One page of the report table; Spark keeps only the rows up to its end while sorting."""
    return sort_records(records, sort, descending).offset(page * rows).limit(rows)


def share_view(records: DataFrame) -> DataFrame:
    """Without the columns that never leave: original text and image reference."""
    return records.drop("raw_text", "image_ref")


# --- separation -------------------------------------------------------------------------------

def separation(scored_labels: DataFrame, gate: float = V.CONFIDENCE_GATES["relevant"]) -> DataFrame:
    """Per phrasing of a question: lowest positive minus highest negative, and how many need review."""
    positive = F.col("label")
    return scored_labels.groupBy("phrasing").agg(
        F.count("*").alias("n"),
        (F.min(F.when(positive, F.col("p"))) - F.max(F.when(~positive, F.col("p")))).alias("separation"),
        F.count_if(F.abs(F.col("p") - 0.5) * 2 < gate).alias("uncertain"))
