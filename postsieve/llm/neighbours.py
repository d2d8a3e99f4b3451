"""Approximate nearest neighbours by low-dimensional stable projections and kd-trees.

Vectors are projected by a fixed Gaussian matrix to `dims` numbers. For a pair at distance r the squared projected distance over
r squared follows a chi-square law with `dims` degrees of freedom; that is the stopping test: a search that has seen every
vector of projected distance below p and whose k-th neighbour is at distance r may stop once the law's value at p^2 / r^2 is
`sure` or more, as any one true neighbour is then missed with probability 1 - sure at most.

A top kd-tree, fitted on a bounded sample, deals all vectors into cells, and neighbouring cells make up a part. Each query first searches the
part of its own cell, then only parts with a cell that the test can't rule out by its projected distance. A query travels once to each of these
parts, whatever the number of their cells; queries meet a part in blocks of their own number there, so a part's
vectors travel once per block of the queries that reach it, and not at all where none does. In a task, a kd-tree of small leaves is walked outward from the
query and the leaves' vectors verified on the originals. Largest inner product is nearest distance once every vector gets one
more coordinate that makes all lengths equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import FloatType

from postsieve.llm.shared import written

#: Sampled vectors the top tree is fitted on; mean vectors of a cell, queries of a block, vectors of a leaf.
SAMPLE, CELL_ROWS, QUERY_ROWS, LEAF = 20_000, 1_024, 32_768, 64
#: Parts of a table, as long as a part has 2 * CELL_ROWS to PART_ROWS vectors; queries of a block that walk their leaves together; rows that
#: these find before the best are kept and the others dropped.
PARTS, PART_ROWS, WALK_ROWS, HITS = 32, 65_536, 2_048, 1 << 20
DIMS, SURE = 8, 0.97


def chi_square(x: np.ndarray, dims: int) -> np.ndarray:
    """The chi-square distribution function for an even number of degrees of freedom: 1 - e^(-x/2) * sum of (x/2)^i / i!."""
    half = np.asarray(x, dtype=float) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, dims // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-np.minimum(half, 700)) * total


def stop_ratio(dims: int, sure: float) -> float:
    """The ratio p^2 / r^2 from which the stopping test holds."""
    lo, hi = 0.0, 20.0 * dims
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(np.array(mid), dims) < sure else (lo, mid)
    return hi


def projection(size: int, dims: int) -> np.ndarray:
    return np.random.default_rng(11).normal(size=(size + 1, dims))


def lifted(vectors: np.ndarray, radius: float) -> np.ndarray:
    """One more coordinate, so that all vectors have length `radius`."""
    return np.concatenate([vectors, np.sqrt(np.maximum(radius * radius - (vectors * vectors).sum(1), 0))[:, None]], 1)


class Tree:
    """A kd-tree as nested median cuts: `boxes` (low, high) of its leaves, in order; fitted on points, open at the outside."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.cuts: list = []
        self.low: list = []
        self.high: list = []
        dims = points.shape[1]
        self._split(points, leaves, np.full(dims, -np.inf), np.full(dims, np.inf))
        self.boxes = np.array(self.low).reshape(-1, dims), np.array(self.high).reshape(-1, dims)

    def _split(self, points, leaves, low, high) -> int:
        at = len(self.cuts)
        spread = points.max(0) - points.min(0) if len(points) else np.zeros(len(low))
        axis = int(np.argmax(spread))
        if leaves < 2 or spread[axis] <= 0:
            self.cuts.append((-1, len(self.low), 0, 0))
            self.low.append(low)
            self.high.append(high)
            return at
        value = float(np.median(points[:, axis]))
        below = points[:, axis] < value
        if not below.any():
            value = float(points[points[:, axis] > value, axis].min())
            below = points[:, axis] < value
        self.cuts.append(None)
        upper, lower = low.copy(), high.copy()
        upper[axis], lower[axis] = value, value
        left = self._split(points[below], leaves // 2, low, lower)
        right = self._split(points[~below], leaves - leaves // 2, upper, high)
        self.cuts[at] = (axis, value, left, right)
        return at

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        out, work = np.zeros(len(points), dtype=np.int64), [(0, np.arange(len(points)))]
        while work:
            node, rows = work.pop()
            axis, value, left, right = self.cuts[node]
            if axis < 0:
                out[rows] = value
            elif len(rows):
                below = points[rows, axis] < value
                work += [(left, rows[below]), (right, rows[~below])]
        return out


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared projected distance of each point to each box."""
    out = np.zeros((len(points), len(low)))
    for j in range(points.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, j] - points[:, j, None], points[:, j, None] - high[None, :, j]), 0)
        out += gap * gap
    return out


class Cell:
    """A block of vectors with a kd-tree of leaves of about LEAF points over their projections; leaves of equal points are cut by number."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray):
        leaves = max(1, len(ids) // LEAF)
        tree = Tree(points, leaves)
        leaf = tree.leaf_of(points)
        order = np.argsort(leaf, kind="stable")
        self.ids, self.vectors, points, leaf = ids[order], vectors[order], points[order], leaf[order]
        first = np.searchsorted(leaf, np.arange(len(tree.boxes[0]) + 1))
        self.first = np.concatenate([*(np.arange(a, b, 2 * LEAF) for a, b in zip(first, first[1:])), [len(ids)]]).astype(np.int64)
        rows = [points[a:b] for a, b in zip(self.first, self.first[1:])]
        self.low, self.high = np.array([r.min(0) for r in rows]), np.array([r.max(0) for r in rows])

    def search(self, query_ids, queries, points, bound, radius: float, k: int, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (query number, id, score): each query's best k here among those that reach its bound, ties to smaller ids.

        All queries walk their leaves outward together, in steps that double; a query leaves the walk when the next leaf's
        projected distance passes the stopping test against the k-th best score so far (or its bound).
        """
        n, leaves = len(queries), len(self.low)
        reach = box_distance(points, self.low, self.high)
        order = np.argsort(reach, axis=1)
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        worst, last_id, active, done, step = bound.copy(), np.full(n, np.iinfo(np.int64).max), np.arange(n), 0, 4
        while done < leaves and len(active):
            far = np.maximum(2 * radius * radius - 2 * worst[active], 0)
            active = active[~(reach[active, order[active, done]] >= ratio * far)]
            where = order[active, done:done + step]
            who = np.repeat(active, where.shape[1])
            where = where.ravel()
            turn = np.argsort(where, kind="stable")
            where, who = where[turn], who[turn]
            cuts = np.flatnonzero(np.diff(where, prepend=-1))
            found, held = [best], 0
            for a, b in zip(cuts, [*cuts[1:], len(where)]):
                lo, hi = self.first[where[a]], self.first[where[a] + 1]
                rows = who[a:b]
                score = queries[rows] @ self.vectors[lo:hi].T
                q, c = np.nonzero(score >= worst[rows, None])
                q, i, s = rows[q], self.ids[lo:hi][c], score[q, c]
                keep = (i != query_ids[q]) & ((s > worst[q]) | (i < last_id[q]))
                found.append((q[keep], i[keep], s[keep]))
                held += len(found[-1][0])
                if held > HITS or b == len(where):
                    best = top(*(np.concatenate(x) for x in zip(*found)), k)
                    count = np.bincount(best[0], minlength=n)
                    last, full = np.cumsum(count) - 1, count >= k
                    worst[full], last_id[full] = best[2][last[full]], best[1][last[full]]
                    found, held = [best], 0
            done, step = done + step, step * 2
        return best


def top(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each q, in the order of q, score (best first) and id."""
    turn = np.lexsort((ids, -score, q))
    q, ids, score = q[turn], ids[turn], score[turn]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < k
    return q[keep], ids[keep], score[keep]


def parts_of(sizes: list[tuple[int, int]], most: int) -> list[tuple[int, int, int]]:
    """(cell, first part, blocks) for cells with their numbers of vectors, in the order of the cells; parts are numbered from 0 without gaps.

    Neighbouring cells make up a part of `most` vectors at most; a cell that has more is cut into blocks, each a part of its own.
    """
    out, part, filled = [], -1, most
    for cell, n in sizes:
        blocks = -(-n // most)
        if filled + n > most:
            part, filled = part + 1, 0
        out.append((cell, part, blocks))
        part, filled = part + blocks - 1, filled + n
    return out


def _matrix(column: pa.Array, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width).astype(np.float64)


def _usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col("v")
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(v.isNotNull() & F.col("id").isNotNull() & sound)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", dims: int = DIMS, sure: float = SURE) -> DataFrame:
    """(query_id, rank, <key>, score): each query's k nearest found by inner product in double precision, best first.

    Rows of the query's own id are the query's own and no candidates. Null ids, null and zero vectors, vectors with null or non-finite
    components and those of another length than the most common one (ties: the longest) take no part on either side. Repeated
    candidate rows count as rows each. Equal query rows are one query; rows that share an id with different vectors are
    queries of their own under that id, with ranks of their own. Fewer candidates than k are all returned, as the test never holds
    before k are found. Ties go to the smaller id. Other columns are not read. Empty tables give no rows.
    """
    spark, schema = vectors.sparkSession, f"query_id long, rank int, {key} long, score double"
    usable, asked = _usable(vectors, key, vector), _usable(queries, key, vector)
    lengths = usable.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).collect()
    longest = asked.where(F.size("v").isin([r["d"] for r in lengths])).agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), F.count("*")).first() if lengths else (None, 0)
    if not lengths or not longest[1]:
        return spark.createDataFrame([], schema)
    d, n, m = max(((r["d"], r["n"], r["m"]) for r in lengths), key=lambda r: (r[1], r[0]))
    radius, ratio, matrix = float(np.sqrt(max(m, longest[0]))) * (1 + 1e-12), stop_ratio(dims, sure), projection(d, dims)
    usable, asked = usable.where(F.size("v") == d), asked.where(F.size("v") == d).distinct()
    share, turn = min(1.0, 1.5 * SAMPLE / n), F.xxhash64("id", "v")
    chosen = usable.where(F.pmod(turn, F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(turn, "id").select("v").limit(SAMPLE)  # the same on every run

    def project(batches):
        for batch in batches:
            points = lifted(np.array(batch.column(0).flatten(), dtype=np.float64).reshape(-1, d), radius) @ matrix
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in points], pa.binary())], ["p"])
    sample = np.frombuffer(b"".join(r["p"] for r in chosen.mapInArrow(project, "p binary").collect()), dtype=np.float64).reshape(-1, dims)
    tree = Tree(sample, int(max(1, min(n // CELL_ROWS, len(sample) // 8))))
    low, high = tree.boxes

    kind = "f4" if all(isinstance(df.select(vector).schema[0].dataType.elementType, FloatType) for df in (vectors, queries)) else "f8"  # as given

    def place(batches):
        for batch in batches:
            x = np.array(batch.column(1).flatten(), dtype=np.float64).reshape(-1, d)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tree.leaf_of(lifted(x, radius) @ matrix)), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())], ["id", "cell", "v"])
    shape = "id long, cell long, v binary"
    data = written(usable.mapInArrow(place, shape), "placed")
    ask = written(asked.mapInArrow(place, shape).withColumn("query", F.monotonically_increasing_id()), "asked")
    sizes = sorted((int(r["cell"]), r["n"]) for r in data.groupBy("cell").agg(F.count("*").alias("n")).collect())  # a row per cell, SAMPLE / 8 at most
    layout = parts_of(sizes, min(PART_ROWS, max(2 * CELL_ROWS, -(-n // PARTS))))
    parts = F.broadcast(spark.createDataFrame(layout, "cell long, first long, blocks long"))
    data = data.join(parts, "cell").withColumn("part", F.col("first") + F.pmod(F.xxhash64("id"), "blocks")).select("part", "id", "v")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        ids, number = right.column("id").to_numpy(), right.column("query").to_numpy()
        if left.num_rows and right.num_rows:
            x, y, bound = _matrix(left.column("v"), d, kind), _matrix(right.column("v"), d, kind), right.column("bound").to_numpy()
            part, points = Cell(left.column("id").to_numpy(), x, lifted(x, radius) @ matrix), lifted(y, radius) @ matrix
            for a in range(0, len(ids), WALK_ROWS):
                q, i, s = part.search(*(z[a:a + WALK_ROWS] for z in (ids, y, points, bound)), radius, k, ratio)
                found.append((q + a, i, s))
        q, i, s = (np.concatenate(z) for z in zip(*found))
        return pa.table({"query": pa.array(number[q], pa.int64()), "query_id": pa.array(ids[q], pa.int64()), "id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64())})

    def visit(rows: DataFrame) -> DataFrame:
        """What queries find in the parts of rows (part, query, id, v, bound)."""
        turns = F.broadcast(rows.groupBy("part").agg(F.ceil(F.count("*") / QUERY_ROWS).alias("turns")))  # a row per part
        mine = data.join(turns, "part").withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1))).select("part", "turn", "id", "v")
        rows = rows.join(turns, "part").withColumn("turn", F.pmod(F.xxhash64("query"), "turns")).select("part", "turn", "query", "id", "v", "bound")
        return mine.groupBy("part", "turn").cogroup(rows.groupBy("part", "turn")).applyInArrow(meet, "query long, query_id long, id long, score double")

    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    best = lambda rows: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    own = ask.join(parts, "cell").withColumn("part", F.explode(F.sequence("first", F.col("first") + F.col("blocks") - 1)))
    home = written(best(visit(own.select("part", "query", "id", "v", F.lit(float("-inf")).alias("bound")))), "home")
    # a row per query on both sides: files of many like values are small, and Spark would take such a table for one to broadcast
    bound = home.where(F.col("rank") == k).select("query", F.col("score").alias("bound")).hint("merge")
    cells, first, blocks = (np.array(x) for x in zip(*layout))
    starts = np.flatnonzero(np.diff(first, prepend=-1))
    run = np.full(len(low), -1)
    run[cells] = np.searchsorted(first[starts], first)

    def reach(batches):
        for batch in (b.slice(a, WALK_ROWS) for b in batches for a in range(0, b.num_rows, WALK_ROWS)):
            cell, least = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            points = lifted(_matrix(batch.column(3), d, kind), radius) @ matrix
            go = ~(box_distance(points, low, high) >= ratio * np.maximum(2 * radius * radius - 2 * least, 0)[:, None])
            go = np.logical_or.reduceat(go[:, cells], starts, axis=1)  # of cells that share a part
            go[np.flatnonzero(run[cell] >= 0), run[cell][run[cell] >= 0]] = False
            go = np.repeat(go, blocks[starts], axis=1)
            goals = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], go.sum(1).cumsum()]), pa.int32()), pa.array(np.nonzero(go)[1], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), batch.column(4), goals], ["query", "id", "v", "bound", "parts"])
    far = ask.join(bound, "query", "left").select("query", "id", "cell", "v", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))
    goals = written(far.mapInArrow(reach, "query long, id long, v binary, bound double, parts array<long>"), "goals")
    away = visit(goals.withColumn("part", F.explode("parts")).drop("parts"))
    out = best(home.drop("rank").unionByName(away))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")
