"""Exact copies collapsed to the first one, with a copy count."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postsieve.functions import text as T
from postsieve.functions.settle import settle


def collapse_exact(posts: DataFrame, strip_retweets: bool = True, order: str = "seq",
                   within: tuple[str, ...] = ()) -> DataFrame:
    """One row per distinct text key: the first in file order, with ``duplicate_count`` summed.

    Groups are keyed by a digest of the key, so long texts do not cross the shuffle twice, and the copies of
    one text collapse map side before it: a text that makes up a third of all rows is one row per input
    partition. Posts without words vanish. Copies that already carry a count (parts merged earlier) add it up.
    ``within`` names columns (a part) whose values are collapsed separately.
    """
    count = F.coalesce("duplicate_count", F.lit(1)) if "duplicate_count" in posts.columns else F.lit(1)
    columns = [c for c in posts.columns if c != "duplicate_count"]
    key = T.copy_key(F.col("text"), strip_retweets)
    return (
        posts.withColumn("_key", settle(key)).where("_key <> ''")
        .groupBy(*within, F.sha2("_key", 256).alias("_digest"))
        .agg(F.min_by(F.struct(*columns), order).alias("r"), F.sum(count.cast("long")).alias("duplicate_count"))
        .select("r.*", "duplicate_count")
    )


def collapse_with_images(posts: DataFrame, strip_retweets: bool = True) -> DataFrame:
    """``collapse_exact`` for posts that may carry an image instead of text; those rows are kept as they are."""
    blank = T.is_blank(F.col("text"))
    images = posts.where(blank & F.col("image_ref").isNotNull())
    if "duplicate_count" not in posts.columns:
        images = images.withColumn("duplicate_count", F.lit(1).cast("long"))
    return collapse_exact(posts.where(~blank), strip_retweets).unionByName(images)


def removed_count(deduped: DataFrame) -> DataFrame:
    """How many rows the collapse took away."""
    return deduped.agg(F.coalesce(F.sum(F.col("duplicate_count") - 1), F.lit(0)).alias("removed"),
                       F.count("*").alias("kept"))
