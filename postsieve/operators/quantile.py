"""Exact order statistics in two passes: a mergeable sketch brackets all of them at once, one scan settles them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

#: The sketch's rank error is a share 1 / ACCURACY of the rows; a bracket holds some six times that.
ACCURACY = 10_000


@dataclass(frozen=True)
class Found:
    """A value, how many rows lie below it and how many are equal to it."""

    value: float
    below: int
    equal: int


def order_statistics(df: DataFrame, wanted: dict[str, list[float]], rank: Callable[[int, float], int], accuracy: int = ACCURACY) -> dict[tuple[str, float], Found | None]:
    """The value of 0-based rank ``rank(n, fraction)`` among the n non-null values of each numeric column, for its fractions.

    First pass: count, smallest, largest, and a quantile sketch for every column. Second pass: of each bracket, the rows below it as one
    count and the rows in it by value. Where a bracket misses, which needs fewer rows than ``accuracy``, all values are counted
    once more. Whole numbers are exact up to 2^53. Columns without values give None.
    """
    margin = 2 / accuracy
    parts = [x for c, fractions in wanted.items() for x in (
        F.count(c), F.min(c), F.max(c),
        F.percentile_approx(c, [min(1.0, max(0.0, f + d)) for f in fractions for d in (-margin, margin)], accuracy))]
    row, goals, out = df.agg(*parts).first(), [], {}
    for i, (column, fractions) in enumerate(wanted.items()):
        n, least, most, points = row[4 * i:4 * i + 4]
        for j, f in enumerate(fractions):
            out[column, f] = None
            if n:
                goals.append((column, f, min(n - 1, max(0, rank(n, f))), points[2 * j], points[2 * j + 1], least, most))
    missed = []
    found = _settled(df, [(c, k, lo, hi) for c, _, k, lo, hi, _, _ in goals])
    for goal, got in zip(goals, found):
        if got is None:
            missed.append(goal)
        out[goal[0], goal[1]] = got
    for goal, got in zip(missed, _settled(df, [(c, k, least, most) for c, _, k, _, _, least, most in missed])):
        out[goal[0], goal[1]] = got
    return out


def _settled(df: DataFrame, goals: list[tuple]) -> list[Found | None]:
    """For goals (column, rank, low, high) the value of that rank, where it lies between low and high."""
    if not goals:
        return []
    cells = F.array(*[F.when(F.col(c) <= F.lit(hi), F.struct(F.lit(i).alias("goal"), F.lit(k).cast("long").alias("k"), F.when(F.col(c) >= F.lit(lo), F.col(c)).cast("double").alias("v")))
                      for i, (c, k, lo, hi) in enumerate(goals)])
    counts = df.select(F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("x")).select("x.*").groupBy("goal", "k", "v").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("goal").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = counts.withColumn("upto", F.sum("n").over(upto)).where(F.col("upto") > F.col("k")).groupBy("goal").agg(F.min_by(F.struct("v", "n", "upto"), "upto").alias("r"))
    rows = {r["goal"]: r["r"] for r in first.collect()}  # a row per goal
    return [None if (r := rows.get(i)) is None or r["v"] is None else Found(r["v"], r["upto"] - r["n"], r["n"]) for i in range(len(goals))]
