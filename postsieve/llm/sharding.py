"""Sharding by vector bin packing.

Groups of equal texts are placed where the dot product of their (bytes, words, rows) with the shard's residual capacity is
highest, largest first. Groups that are large against a shard are items of their own; a group of more than half a shard is
cut into pieces of whole rows, each booked at the rows it holds; all small groups fall into a fixed number of cells by the
digest of their text. So at most CELLS_PER_SHARD + 3 * LARGE items per shard are packed, however many documents there are,
and equal texts stay together up to half a shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from postsieve.llm.mixing import word_count
from postsieve.llm.shared import written

CELLS_PER_SHARD, LARGE, PIECES = 256, 64, 16
SLOT_ROWS, MAX_RANGES = 128, 1 << 16
#: Copies of one row are numbered in runs of so many.
RUN = 4096


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """A shard for each item (bytes, words, rows): the highest dot product with what the shard has left, largest first."""
    total = np.maximum(items.sum(0), 1e-9)
    share = items / total * shards
    left = np.ones((shards, items.shape[1]))
    out = np.zeros(len(items), dtype=np.int64)
    for i in np.lexsort((np.arange(len(items)), -share.sum(1), -share.max(1))):
        out[i] = k = int(np.argmax(left @ share[i]))
        left[k] -= share[i]
    return out


def cut(rows: DataFrame, wide: DataFrame) -> DataFrame:
    """The rows of the groups in wide (digest, base, pieces) with their item. Rows that agree in all columns are counted, then
    numbered, so that they may part too."""
    same = rows.join(F.broadcast(wide), "digest").groupBy(*rows.columns, "base", "pieces").agg(F.count("*").alias("copies"))
    runs = same.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {RUN}"))))
    each = runs.withColumn("copy", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("copies"), (F.col("run") + 1) * RUN) - 1)))
    return each.select(*rows.columns, (F.col("base") + F.pmod(F.xxhash64("id", "copy"), F.col("pieces"))).alias("item"))


def assign_shards(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, size (UTF-8 bytes plus 16), text_crc32, law `bytes`, shard, slot, grown_shard (null).

    Slots are gapless from 0 in each shard. A null text has no bytes, no words and a null text_crc32; null texts are one group.
    A group of more than half a shard is parted by rows; a single row stays whole. Repeated rows are equal texts. Null keys
    are allowed. Shards are decided by all texts, so a changed table may move documents; the same table gives the same shards.
    Ties in a shard are ordered by key and checksum. Other columns are not read. An empty table gives no rows.
    """
    rows = docs.select(
        F.col(key).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"), word_count(F.col(text)).alias("words"),
        F.crc32(F.col(text).cast("binary")).alias("text_crc32"), F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("")).alias("digest"))
    rows = written(rows, "sizes")
    groups = written(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.sum("words").alias("words"), F.count("*").alias("rows")), "groups")
    total = groups.agg(F.sum("bytes"), F.sum("words"), F.sum("rows"), F.count("*")).first()
    n = total[2] or 0
    parts = [F.col(c) * float(shards) / float(t or 1) for c, t in zip(("bytes", "words", "rows"), total)]
    groups = groups.withColumn("share", F.greatest(*parts))
    cells = CELLS_PER_SHARD * shards
    light = groups.where(F.col("share") * LARGE <= 1).groupBy(F.pmod(F.xxhash64("digest"), F.lit(cells)).alias("item")).agg(
        F.sum("bytes").alias("bytes"), F.sum("words").alias("words"), F.sum("rows").alias("rows")).orderBy("item").collect()
    large = groups.where(F.col("share") * LARGE > 1).orderBy("digest").collect()  # at most 3 * LARGE * shards, as their shares sum to 3
    ids, vectors = [r["item"] for r in light], [(r["bytes"], r["words"], r["rows"]) for r in light]
    base, whole, wide = cells, [], []
    for r in large:
        k = int(np.ceil(r["share"] * PIECES)) if r["share"] > 0.5 and r["rows"] > 1 else 1
        if k > 1:
            wide.append((r["digest"], base, k))
        else:
            whole.append((r["digest"], base))
            ids.append(base)
            vectors.append((r["bytes"], r["words"], r["rows"]))
        base += k
    spark = docs.sparkSession
    at = spark.createDataFrame(whole, "digest string, base long")
    item = F.coalesce("base", F.pmod(F.xxhash64("digest"), F.lit(cells)))
    if wide:
        cuts = spark.createDataFrame(wide, "digest string, base long, pieces long")
        parted = written(cut(rows, cuts), "pieces")
        for r in parted.groupBy("item").agg(F.sum("size").alias("bytes"), F.sum("words").alias("words"), F.count("*").alias("rows")).orderBy("item").collect():
            ids.append(r["item"])
            vectors.append((r["bytes"], r["words"], r["rows"]))
        rows = rows.join(F.broadcast(cuts), "digest", "left_anti")
    rows = rows.join(F.broadcast(at), "digest", "left").withColumn("item", item).drop("base")
    if wide:
        rows = rows.unionByName(parted)
    placed = pack(np.array(vectors, dtype=float).reshape(-1, 3), shards)
    shard_of = spark.createDataFrame([(int(i), int(s)) for i, s in zip(ids, placed)], "item long, shard int")
    ranges = max(1, min(MAX_RANGES, n // (shards * SLOT_ROWS)))
    turn = F.xxhash64("id", "text_crc32")
    rows = (rows.join(F.broadcast(shard_of), "item")
            .select("id", "size", "text_crc32", "shard", turn.alias("turn"), F.pmod(turn, F.lit(ranges)).alias("part")))
    rows = written(rows, "shards")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("turn", "id", "text_crc32"))
    return rows.join(starts, ["shard", "part"]).select(
        F.col("id").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + place - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
