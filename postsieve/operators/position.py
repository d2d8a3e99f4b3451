"""Global row positions and running sums without putting all rows into one task.

Rows are range-partitioned by their sort key: Spark samples the key and picks splitters, so ranges come out even whatever the
values are, all distinct or a few with many ties (``seq`` cuts those). Ranges are sorted and written once, with each row's place in
its range; range counts and sums are prefixed over the ranges alone. A position is a range's offset plus a place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from postsieve.session import materialize

ROWS_PER_RANGE = 1_000_000
#: Spark's driver samples some keys per range; beyond this number of ranges they get larger and sorts spill.
MAX_RANGES = 4096
_PLACE = (1 << 33) - 1


def ranged(df: DataFrame, order: list[Column], n: int, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """The rows with ``_range`` and ``_place`` (0-based inside it) in the given order, as a table in the shared folder."""
    ranges = max(1, min(MAX_RANGES, -(-n // rows_per_range)))
    rows = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = rows.withColumn("_range", F.shiftright("_id", 33)).withColumn("_place", F.col("_id").bitwiseAND(F.lit(_PLACE)))
    return materialize(rows.drop("_id"), "ranges")


def with_position(df: DataFrame, seq: str = "seq", rank: str | None = None, sums: dict[str, Column] | None = None,
                  rows_per_bucket: int = ROWS_PER_RANGE, total: int | None = None) -> DataFrame:
    """Adds ``position`` (0-based in ``rank`` desc, ``seq`` order) and the named running sums (inclusive).

    ``seq`` must be unique.
    """
    sums = sums or {}
    marked = df.withColumns({f"_v_{name}": value for name, value in sums.items()}) if sums else df
    order = [F.col(rank).desc(), F.col(seq)] if rank else [F.col(seq)]
    if total is None:  # counted, sampled and dealt out: three passes, so whatever the rows are made of is worked out before
        marked = materialize(marked, "unranked")
        total = marked.count()
    rows = ranged(marked, order, total, rows_per_bucket)
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"), *[F.sum(f"_v_{s}").alias(f"_t_{s}") for s in sums])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # MAX_RANGES rows at most
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                           *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0.0)).alias(f"_b_{s}") for s in sums])
    running = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(F.broadcast(offsets), "_range").select(
        *df.columns, (F.col("_place") + F.col("_before")).cast("long").alias("position"),
        *[(F.sum(f"_v_{s}").over(running) + F.col(f"_b_{s}")).alias(s) for s in sums])


def stride_for(n: int, limit: int) -> int:
    return 1 if n <= limit else -(-n // limit)


def systematic_sample(df: DataFrame, limit: int, seq: str = "seq") -> tuple[DataFrame, int]:
    """With more than ``limit`` rows, every ceil(n / limit)-th row in order, else all rows; and how many.

    Only the ``seq`` column is ranked; the chosen keys (at most ``limit``) are joined back.
    """
    total = df.count()
    stride = stride_for(total, limit)
    if stride == 1:
        return df, total
    chosen = (with_position(df.select(seq), seq, total=total)
              .where(F.col("position") % stride == 0).select(F.col(seq).alias("_chosen")))
    # at most `limit` keys by construction
    sample = df.join(F.broadcast(chosen), df[seq] == chosen["_chosen"], "left_semi")
    return sample, -(-total // stride)
