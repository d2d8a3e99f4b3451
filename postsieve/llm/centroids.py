"""Centroid clustering of integer vectors by scalar lookup tables.

Components become integers, so each dimension takes few different values. Vectors are kept in slices: the values that occur in
each dimension of a slice, sorted, and for each vector its values' numbers. In a round, the squared difference between every
occurring value of a dimension and every centroid's component there is tabulated; a vector's distances are then gathered from
the tables and added up, without a product per vector. A round sends counts and componentwise sums per centroid, nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postsieve.llm.shared import written

#: Integers below LIMIT take part; from WIDE on, squared differences could pass 64 bits and are reckoned in Python's integers.
LIMIT, WIDE = 1 << 62, 1 << 27
MOST = (1 << 63) - 1
#: Vectors of a slice; their values' numbers fit 16 bits.
SLICE = 4096
SLICES = "ids binary, missing binary, sizes binary, occurring binary, codes binary"


def kept(vectors: DataFrame, key: str, vector: str, size: int, scale: int) -> DataFrame:
    """(id, v): vectors of just `size` finite components, as integers floor(scale * x)."""
    v = F.col("v")
    whole = F.transform(v, lambda x: F.floor(x * F.lit(float(scale))))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(LIMIT // scale)))
    return vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where((F.size("v") == size) & sound).select("id", whole.alias("v"))


def encoded(rows: DataFrame, size: int) -> DataFrame:
    """The vectors in slices: ids, and per dimension the occurring values and each vector's numbers among them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                x = np.array(part.column(1).flatten(), dtype=np.int64).reshape(-1, size)
                values, codes = zip(*(np.unique(x[:, j], return_inverse=True) for j in range(size)))
                row = [part.column(0).fill_null(0).to_numpy().tobytes(), part.column(0).is_null().to_numpy(zero_copy_only=False).tobytes(),
                       np.array([len(u) for u in values], np.int64).tobytes(), np.concatenate(values).tobytes(), np.stack(codes).astype(np.uint16).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.binary()) for r in row], ["ids", "missing", "sizes", "occurring", "codes"])
    return rows.mapInArrow(run, SLICES)


def decoded(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, whether they are missing, occurring values and the numbers (dimension by vector) of each component in them."""
    ids, missing, sizes, occurring, codes = (batch.column(j)[row].as_py() for j in range(5))
    sizes = np.frombuffer(sizes, np.int64)
    starts = np.cumsum(sizes) - sizes
    return np.frombuffer(ids, np.int64), np.frombuffer(missing, bool), np.frombuffer(occurring, np.int64), np.frombuffer(codes, np.uint16).reshape(len(sizes), -1) + starts[:, None]


def assigned(occurring: np.ndarray, codes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centroid (ties: the smaller number) and its squared distance (MOST at most), from a table per centroid."""
    if max(np.abs(occurring).max(), np.abs(centroids).max()) >= WIDE:
        occurring, centroids = occurring.astype(object), centroids.astype(object)
    first = np.concatenate([[0], codes.max(1)[:-1] + 1])  # where each dimension's values begin
    dimension = np.searchsorted(first, np.arange(len(occurring)), side="right") - 1
    nearest = np.zeros(codes.shape[1], np.int64)
    least = np.full(codes.shape[1], np.inf) if occurring.dtype == object else np.full(codes.shape[1], MOST)
    least = least.astype(occurring.dtype)
    for k, centre in enumerate(centroids):
        table = (occurring - centre[dimension]) ** 2
        far = np.zeros(codes.shape[1], occurring.dtype)
        for numbers in codes:
            far += table[numbers]
        closer = (far < least).astype(bool)
        nearest[closer], least[closer] = k, far[closer]
    return nearest, np.minimum(least, MOST).astype(np.int64)


def start(rows: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the smallest digests of seed and id, in that order; equal ids by components, missing ids last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return np.array([r["v"] for r in rows.orderBy(digest.asc_nulls_last(), "v").limit(clusters).collect()], dtype=np.int64)


def moved(slices: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every non-empty centroid at the componentwise floor of its vectors' mean; empty ones stay."""
    clusters, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((clusters, size + 1), dtype=object)
        for batch in batches:
            for row in range(batch.num_rows):
                _, _, occurring, codes = decoded(batch, row)
                nearest, _ = assigned(occurring, codes, centroids)
                wide = np.abs(occurring).max() >= 1 << 48
                order = np.argsort(nearest, kind="stable")
                held = np.bincount(nearest, minlength=clusters)
                full = np.flatnonzero(held)
                at = (np.cumsum(held) - held)[full]
                total[:, 0] += held
                for j, numbers in enumerate(codes):
                    total[full, j + 1] += np.add.reduceat(occurring[numbers[order]].astype(object if wide else np.int64), at)
        cluster, place = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(cluster.ravel(), pa.int32()), pa.array(place.ravel(), pa.int32()), pa.array([str(x) for x in total.ravel()])], ["cluster", "place", "total"])
    total = np.zeros((clusters, size + 1), dtype=object)
    for r in slices.mapInArrow(run, "cluster int, place int, total string").groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():  # clusters * (size + 1) rows
        total[r["cluster"], r["place"]] = int(r["total"])
    out = centroids.copy()
    for k in range(clusters):
        if total[k, 0]:
            out[k] = [int(s) // int(total[k, 0]) for s in total[k, 1:]]
    return out


def cluster(vectors: DataFrame, clusters: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(<key>, cluster, distance, cluster_inertia, inertia, centroid_sha256) per kept vector.

    Vectors of just `size` components, none null or non-finite, become integers floor(scale * x). Centroids start as start() says,
    move `rounds` times to their vectors' componentwise floor(sum / count), and vectors are assigned once more. Distances are
    squared; inertia is summed in whole numbers. Rounds end early when no centroid moves, as further ones would change nothing.

    A component whose integer is 2^62 or more in absolute value does not fit: such vectors take no part. Distances and inertia beyond
    a long stand at its largest value. Repeated rows count and are returned a row each; a null key takes part and is no start unless keys are too few. Fewer
    vectors than clusters give as many clusters. Equal start vectors leave the larger number empty. Other columns are not read. An
    empty table gives no rows.
    """
    rows = kept(vectors, key, vector, size, scale)
    slices = written(encoded(rows, size), "slices")
    centroids = start(rows, clusters, seed)
    schema = f"{key} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], schema)
    for _ in range(rounds):
        before, centroids = centroids, moved(slices, centroids)
        if (before == centroids).all():
            break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, missing, occurring, codes = decoded(batch, row)
                nearest, least = assigned(occurring, codes, centroids)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=missing), pa.array(nearest, pa.int32()), pa.array(least)], ["id", "cluster", "distance"])
    out = written(slices.mapInArrow(run, "id long, cluster int, distance long"), "assigned")
    sums = {r["cluster"]: int(r["d"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # a row per cluster
    marks = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]

    def of_cluster(values: list) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    inertia = [min(sums.get(k, 0), MOST) for k in range(len(centroids))]
    return out.select(F.col("id").alias(key), "cluster", "distance", of_cluster(inertia).cast("long").alias("cluster_inertia"), F.lit(min(sum(sums.values()), MOST)).cast("long").alias("inertia"), of_cluster(marks).alias("centroid_sha256"))
