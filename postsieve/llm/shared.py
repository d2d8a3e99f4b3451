"""Tables written once to the folder all executors share, digests of texts, and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postsieve.session import materialize


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder; the driver then lets go of shuffle files that no plan needs any more.

    Spark removes them when the driver's objects that stand for them are collected, which a driver with little to do puts off. Without a JVM
    handle, as on Spark Connect, they go when the server collects its garbage.
    """
    out = materialize(df, name)
    jvm = getattr(df.sparkSession, "_jvm", None)
    if jvm is not None:
        jvm.System.gc()
    return out


def text_mark(text: Column) -> Column:
    """A 64-bit digest that tells the texts of rows with one key apart; null is a text of its own."""
    return F.xxhash64(text, text.isNull())


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links (a, b), where component is the smallest node reachable.

    Alternates large-star and small-star steps over plain joins until the links stop changing: a number of rounds that
    grows with the logarithm of the longest chain. Nulls and loops are dropped, repeated links count once. A hub's rows are
    pre-aggregated for its minimum, and the joins can be split by Spark where a hub is hot. Each round is a table in the
    shared folder. No links give no rows.
    """
    links = (links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
             .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    links, before = written(links, "links"), None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        links = written(small, "small")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
