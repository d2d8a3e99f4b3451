"""Near copies of vectors by Euclidean p-stable hashing.

For unit vectors, a cosine of c is a distance of sqrt(2 - 2 c). A hash table quantises `functions` Gaussian projections of a vector with
one random offset each; vectors at that distance share a value with a known probability, all values of a table with its
power, and at least one of `tables` tables but for the stated chance `miss`. The number of functions grows with the logarithm of
the largest label, so that unrelated vectors share few buckets, and the number of tables follows from both.

Equal vectors are one class with a weight. Vectors that share a bucket are compared by exact cosine in the task that holds
the bucket, a large bucket in pairs of blocks; a pair counts in the first table where it meets. What leaves a task is the
number of links each vector gained and a spanning forest of them, never the pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postsieve.llm.shared import components, written
from postsieve.llm.words import mix

#: Width of a quantised projection, for unit vectors; distance from which vectors count as unrelated when functions are dealt.
WIDTH, UNRELATED = 2.0, 1.0
#: Vectors of a block of a large bucket; rows that a task compares at a time; pairs whose cosines are held at a time.
BLOCK, PART_ROWS, PAIRS = 2_048, 16_384, 1 << 18


def meeting(distance: float, width: float = WIDTH) -> float:
    """The probability that vectors at a distance share one quantised projection."""
    t = width / distance
    return math.erf(t / math.sqrt(2)) - math.sqrt(2 / math.pi) / t * (1 - math.exp(-t * t / 2))


def layout(rows: int, cosine: float, miss: float) -> tuple[int, int]:
    """(functions, tables) for so many vectors of one label."""
    functions = max(4, math.ceil(math.log(max(rows, 2)) / -math.log(meeting(UNRELATED))))
    return functions, math.ceil(math.log(miss) / math.log1p(-meeting(math.sqrt(2 - 2 * cosine)) ** functions))


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled by their largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def bucket_keys(units: np.ndarray, labels: np.ndarray, functions: int, tables: int) -> np.ndarray:
    """A 64-bit key per vector and table, made of the table, the label's digest and the quantised projections."""
    r = np.random.default_rng(13)
    directions, offsets = r.normal(size=(units.shape[1], tables * functions)), r.uniform(0, WIDTH, tables * functions)
    cells = np.floor((units @ directions + offsets) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(units), tables, functions)
    key = mix(labels[:, None] + np.arange(tables, dtype=np.uint64)[None, :])
    for j in range(functions):
        key = mix(key ^ cells[:, :, j]) + np.uint64(0x9E3779B97F4A7C15)
    return key


def _usable(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    v = F.col("v")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    return rows.withColumn("takes_part", F.coalesce(v.isNotNull() & F.col("id").isNotNull() & F.col("label").isNotNull() & sound, F.lit(False)))


def digested(rows: DataFrame) -> DataFrame:
    """(id, label, class, v): the digest of label and vector, and the vector's doubles; both null where a row takes no part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, part = batch.column(2), batch.column(3).to_pylist()
            flat, at = np.array(vectors.flatten(), dtype=float) + 0.0, np.concatenate([[0], np.cumsum(vectors.value_lengths().fill_null(0).to_numpy())])
            held = [flat[a:b].tobytes() if p else None for a, b, p in zip(at, at[1:], part)]
            marks = [None if v is None else hashlib.blake2b(v + label.encode(), digest_size=16).digest() for v, label in zip(held, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.binary()), pa.array(held, pa.binary())], ["id", "label", "class", "v"])
    return rows.mapInArrow(run, "id long, label string, class binary, v binary")


def hashed(classes: DataFrame, functions: int, tables: int) -> DataFrame:
    """(node, weight, group, keys, v) per class (node, weight, label, v): the digest of label and length, bucket keys, unit vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(3).to_pylist()
            sizes = np.array([len(v) for v in held], dtype=np.int64)
            labels = np.array([int.from_bytes(hashlib.blake2b(f"{s}:{x}".encode(), digest_size=8).digest(), "little") for s, x in zip(sizes, batch.column(2).to_pylist())], dtype=np.uint64)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                part = batch.take(pa.array(at))
                units = unit(np.frombuffer(b"".join(held[i] for i in at), dtype=float).reshape(len(at), -1))
                keys = bucket_keys(units, labels[at], functions, tables).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(labels[at].view(np.int64)), pa.array(list(keys), pa.list_(pa.int64())), pa.array([u.tobytes() for u in units], pa.binary())], ["node", "weight", "group", "keys", "v"])
    return classes.select("node", "weight", "label", "v").mapInArrow(run, "node long, weight long, group long, keys array<long>, v binary")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n numbers the smallest one reachable over the pairs (a, b)."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[a], least[b])
        before = least.copy()
        np.minimum.at(least, a, low)
        np.minimum.at(least, b, low)
        least = least[least]
        if (least == before).all():
            return least


def paired(rows: pa.Table, cosine: float) -> pa.Table:
    """Links within the cells of one part: rows (a, null, weight) for links gained, (a, b, 0) for a spanning forest.

    A cell holds one block of a bucket (all pairs) or two (pairs across). A pair counts where it first shares a bucket.
    """
    bucket, x, y, own, table, node, weight, group = (rows.column(c).to_numpy() for c in ("bucket", "x", "y", "own", "table", "node", "weight", "group"))
    order = np.lexsort((own, y, x, bucket))
    cells = np.flatnonzero(np.diff(bucket[order], prepend=0) | np.diff(x[order], prepend=-1) | np.diff(y[order], prepend=-1))
    cells = np.unique(np.concatenate([[0], cells, [len(order)]])).astype(np.int64)
    units, keys = rows.column("v").to_pylist(), rows.column("keys").combine_chunks()
    keys = keys.flatten().to_numpy().reshape(len(order), -1)
    numbers, gained, left, right = {}, [], [], []
    for a, b in zip(cells, cells[1:]):
        at = order[a:b]
        first = at[own[at] == x[at[0]]]
        second = first if x[at[0]] == y[at[0]] else at[own[at] != x[at[0]]]
        if not len(second) or len(at) < 2:
            continue
        u = np.frombuffer(b"".join(units[i] for i in first), dtype=float).reshape(len(first), -1)
        w = u if second is first else np.frombuffer(b"".join(units[i] for i in second), dtype=float).reshape(len(second), -1)
        if u.shape[1] != w.shape[1]:
            continue
        step, t = max(1, PAIRS // len(second)), int(table[at[0]])
        for lo in range(0, len(first), step):
            i, j = np.nonzero(u[lo:lo + step] @ w.T >= cosine)
            i, j = first[i + lo], second[j]
            good = (group[i] == group[j]) & ((i < j) if second is first else True)
            i, j = i[good], j[good]
            if t and len(i):
                new = ~(keys[i, :t] == keys[j, :t]).any(1)
                i, j = i[new], j[new]
            left.append(i)
            right.append(j)
    left, right = (np.concatenate(s).astype(np.int64) if s else np.zeros(0, np.int64) for s in (left, right))
    known, number = np.unique(node, return_inverse=True)
    links = np.zeros(len(known), np.int64)
    np.add.at(links, number[left], weight[right])
    np.add.at(links, number[right], weight[left])
    least, some = forest(len(known), number[left], number[right]), np.flatnonzero(links)
    far = np.flatnonzero(least != np.arange(len(known)))
    return pa.table({"a": pa.array(np.concatenate([known[some], known[far]])), "b": pa.array(np.concatenate([known[some], known[least[far]]]), mask=np.arange(len(some) + len(far)) < len(some)),
                     "links": pa.array(np.concatenate([links[some], np.zeros(len(far), np.int64)]))})


def linked(nodes: DataFrame, cosine: float) -> DataFrame:
    """Links of (node, weight, group, keys, v), as paired() gives them, over all buckets that two nodes share."""
    bands = nodes.select("node", F.posexplode("keys").alias("table", "bucket"))
    shared = bands.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    members = written(bands.join(shared, "bucket"), "members")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node", "bucket"), blocks).cast("int")
    cells = members.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("node", "table", "bucket", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    cells = cells.withColumn("cell", F.xxhash64("bucket", "x", "y"))
    held = members.agg(F.sum(blocks)).first()[0] or 0
    parts = max(1, -(-held // PART_ROWS))
    rows = cells.join(nodes, "node").withColumn("part", F.pmod("cell", F.lit(parts)))
    return rows.groupBy("part").applyInArrow(lambda table: paired(table, cosine), "a long, b long, links long")


def near_vectors(vectors: DataFrame, cosine: float = 0.98, miss: float = 1e-4, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: <key>, n_links, component_id, kept.

    Vectors of equal label and length link where their cosine in double precision is `cosine` or more; n_links counts the other rows
    a row is linked with, component_id is the smallest key reachable, kept says whether that is the row's own. No pair below the
    threshold links; a pair just at it is missed with probability `miss`, closer ones less often, equal ones never.

    A null, empty or zero vector, null or non-finite components, a null label and a null key link with nothing; a null key has a
    null component and is kept. Repeated rows are rows of their own, linked with each other where they take part; rows that
    repeat a key with another vector or label are judged by their own. Other columns are not read. An empty table gives no rows.
    """
    rows = written(digested(_usable(vectors, key, vector, label)), "digested")
    sound = rows.where(F.col("class").isNotNull())
    classes = sound.groupBy("class").agg(F.count("*").alias("weight"), F.min("id").alias("least"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    none = rows.where(F.col("class").isNull()).select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    stand = sound.withColumnRenamed("id", "least").join(classes, ["class", "least"]).select("node", "weight", "label", "v").dropDuplicates(["node"])
    stand = written(stand, "stand")
    most = stand.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if not most:
        return none
    functions, tables = layout(most, cosine, miss)
    nodes = written(hashed(stand, functions, tables), "hashed")
    links = written(linked(nodes, cosine), "links")
    gained = links.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    comp = components(links.where("b IS NOT NULL").select("a", "b"))
    known = classes.join(gained, "node", "left").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = written(known, "known")
    ids = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(ids, "component").select("class", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = sound.join(written(known, "judged"), "class").select(F.col("id").alias(key), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    return out.unionByName(none)
