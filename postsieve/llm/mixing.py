"""Mixing sources to target weights, in DataFrame functions only.

Every document gets a hash-random key. The key's leading digits cut each source into ranges; the ranges' word counts are
summed and prefixed, and only inside a range are documents sorted and prefixed. So each source lies in one random order with
exact running sums, though no task ever holds a source. A source's budget is cut at the exact word; a budget beyond the
source repeats it in whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from postsieve.llm.shared import text_mark, written
from postsieve.llm.words import WORD

WEIGHTS = (3.0, 1.0, 2.0)
#: Mean number of documents in a range, and the most ranges a source is cut into (their sums meet in one task per source).
RANGE_ROWS, MAX_RANGES = 512, 1 << 20
#: A range of so many times the mean number of rows, all of one key or of few, is cut again.
HOT = 8


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target): share times all words, dealt by weight, none above `most` times its source.

    Input: a row (source, source_size) per source. Weights repeat over the sources by code point, null last. What a full source
    can't take is dealt to the others by weight until none is above: all others then have one level per weight. Taking
    sources as full one by one, in the order of cap / weight, raises the level as long as they are above it and lowers it
    after, so the level is the largest met on the way.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    every = Window.partitionBy()
    rows = rows.withColumn("step", (F.sum("source_size").over(every) * F.lit(float(share)) - full) / rest)
    level = F.max("step").over(every)
    return rows.select("source", "source_size", F.least("cap", level * F.col("weight")).alias("target"))


def _sums(rows: DataFrame) -> DataFrame:
    return written(rows.groupBy("part").agg(F.first("source").alias("source"), F.min("digest").alias("least"), F.sum("size").alias("words"), F.count("*").alias("rows")), "ranges")


def _cut_again(rows: DataFrame, hot: DataFrame, limit: int) -> DataFrame:
    """Cuts the ranges in hot (part) by the digest of the text. A text that is too frequent itself is dealt out by row: its rows in a
    range are alike but for other columns, so it makes no difference which comes first."""
    texts = rows.join(F.broadcast(hot), "part", "left_semi").groupBy("part", "mark").agg(F.count("*").alias("copies"))
    heavy = texts.where(F.col("copies") > limit).select("part", "mark", F.ceil(F.col("copies") / limit).alias("pieces"))
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    rows = rows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "part", "left").join(F.broadcast(heavy), ["part", "mark"], "left")
    own = F.concat(F.lit("="), F.col("mark").cast("string"), F.lit(":"), F.pmod(F.xxhash64("place"), F.col("pieces")).cast("string"))
    dealt = F.coalesce(own, F.pmod(F.xxhash64("mark"), F.lit(4096)).cast("string"))
    return rows.withColumn("part", F.when(F.col("hot"), F.concat("part", F.lit("|"), dealt)).otherwise(F.col("part"))).drop("hot", "pieces", "place")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS,
        share: float = 1.5, most: float = 2.0, carry: bool = False) -> DataFrame:
    """One row per document: key, size, source_size, target, taken; with carry, the document's own columns in `row` instead of key.

    size counts words, 0 for a null or empty text. taken counts the words the mix takes: size for each whole epoch, then up
    to the source's budget (its target, rounded down) in the random order, so that one document per source may be taken in
    part. The order is that of the MD5 of the key, ties by key and size: reruns agree, and repeated rows are interchangeable.
    Where very many rows share a key, a null one too, their texts' digests come before key and size. Null keys and null sources
    count as values. Only the named columns matter; others may have any name. No rows give none.
    """
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    own = [F.struct("*").alias("row")] if carry else []
    rows = docs.select(*own, F.col(key).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), digest.alias("digest"), text_mark(F.col(text)).alias("mark"))
    if not carry:
        rows = written(rows, "sizes")
    ranges = max(1, min(MAX_RANGES, rows.select("id").count() // RANGE_ROWS))
    rows = rows.withColumn("part", F.concat(F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")), F.lit(":"),
                                            F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * ranges / F.lit(1 << 32)).cast("string")))
    sums = _sums(rows)
    limit = HOT * max(1, sums.agg(F.sum("rows")).first()[0] or 0) // ranges
    hot = sums.where(F.col("rows") > limit).select("part")  # one range in HOT at most
    if ranges > 1 and not hot.isEmpty():
        rows = _cut_again(written(rows, "rows"), hot, limit)
        sums = _sums(rows)
    budget = F.floor("target").cast("long")
    goals = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most).select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0).alias("epochs"),
        F.when(F.col("source_size") > 0, budget % F.col("source_size")).otherwise(0).alias("rest"))
    before = Window.partitionBy("source").orderBy("least", "part").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).withColumnRenamed("source", "s")
            .join(goals, F.col("s").eqNullSafe(F.col("source"))).select("part", "before", "source_size", "target", "epochs", "rest"))
    inside = Window.partitionBy("part").orderBy("digest", "id", "size", "mark").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    last = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("start")))
    out = rows.join(cuts, "part").withColumn("start", start).withColumn("taken", (F.col("epochs") * F.col("size") + last).cast("long"))
    return out.select("row" if carry else F.col("id").alias(key), "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents: each row as many times as the mix takes it whole. The one document a source's budget cuts, and
    documents without words, have no whole copy for that part."""
    copies = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(0).cast("int")
    out = mix(docs, carry=True, **how).withColumn("copies", copies).where("copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
