"""Near duplicates by SetSketch registers.

Each document's distinct word shingles are summed up in `registers` exponentially spaced, truncated minima: register i
holds floor(1 - log_b(h)) of the smallest exponential value h that any shingle takes under hash function i, cut to 16 bits.
Registers of two sets merge by maximum and agree about as often as the sets overlap. Bands of four registers propose pairs,
the joint likelihood of the registers given both exact set sizes drops hopeless ones, and every remaining pair is confirmed
on its full shingle sets.

No bucket is expanded into all its pairs. Equal sets are collapsed first. Of the documents that share a bucket, the shingles that
no other of them has are counted: they bound every similarity from above, exactly, and most members of a large group of
near copies that are too far from the rest fall to that bound. Each other member of a bucket is paired with the bucket's most
central member, the one with the smallest share of such shingles. Buckets whose members are not in one component after that go
through an exact second step: in blocks of bounded size, members meet those outside the bucket's main component with their whole
sets, so every pair of a bucket is compared or already joined, and only links leave the block. A pair at similarity 0.8 shares none of 32 bands with probability 5e-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postsieve.llm.shared import components, text_mark, written
from postsieve.llm.words import Words, pieces, shingle_sets

BASE, RATE, TOP = 1.001, 20.0, 65535
BLOCK = 1024
#: A pair is dropped unread only when its registers speak this strongly (log-likelihood) against the threshold.
AGAINST = 18.0


def _functions(registers: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(7)
    return r.integers(0, 1 << 32, registers, dtype=np.uint32) | np.uint32(1), r.integers(0, 1 << 32, registers, dtype=np.uint32)


def registers_of(sets: list[np.ndarray], registers: int) -> np.ndarray:
    """Registers (one row per non-empty set)."""
    factor, turn = _functions(registers)
    sizes = np.array([len(s) for s in sets if len(s)], dtype=np.int64)
    if not len(sizes):
        return np.zeros((0, registers), np.uint16)
    x = (np.concatenate([s for s in sets if len(s)]) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum(sizes) - sizes
    least = np.empty((len(sizes), registers), dtype=np.uint32)
    for i in range(registers):
        least[:, i] = np.minimum.reduceat((x ^ turn[i]) * factor[i], starts)
    h = -np.log1p(-(least + 0.5) / 2.0 ** 32) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def _chance(x):
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def _likelihood(j, u, plus, minus, same):
    up, down = _chance(np.maximum(u - (1 - u) * j, 0)), _chance(np.maximum(1 - u - u * j, 0))
    return plus * np.log(np.maximum(up, 1e-12)) + minus * np.log(np.maximum(down, 1e-12)) + same * np.log(np.maximum(1 - up - down, 1e-12))


def joint_estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The most likely similarity of each pair of register rows, and how much more likely it is (log) than the threshold.

    The likelihood of the counts of larger, smaller and equal registers, given both set sizes, is concave in the similarity;
    its peak is found by interval reduction for all pairs at once.
    """
    plus, minus = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - plus - minus
    u = size_a / np.maximum(size_a + size_b, 1)
    top = np.minimum(u / (1 - u), (1 - u) / u)
    lo, hi = np.zeros(len(u)), top.copy()
    for _ in range(24):
        p, q = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        right = _likelihood(p, u, plus, minus, same) < _likelihood(q, u, plus, minus, same)
        lo, hi = np.where(right, p, lo), np.where(right, hi, q)
    best = (lo + hi) / 2
    return best, _likelihood(best, u, plus, minus, same) - _likelihood(np.minimum(threshold, top), u, plus, minus, same)


def hopeful(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    fits = 100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b)
    best, lead = joint_estimate(a, b, size_a, size_b, percent / 100)
    return fits & ((best >= percent / 100) | (lead <= AGAINST))


def sketches(docs: DataFrame, width: int, registers: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, mark, n_shingles, digest, sketch) for every row; digest and sketch are null where the set is empty, mark tells texts apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", limit=1 << 20):
            sets = shingle_sets(Words(batch.column(1), lower=True), width)
            sizes, full = np.array([len(s) for s in sets], dtype=np.int64), np.array([len(s) > 0 for s in sets])
            rows = iter(registers_of(sets, registers))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(pa.int64()), batch.column(2), pa.array(sizes),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([next(rows).tobytes() if f else None for f in full], pa.binary())], ["doc_id", "mark", "n_shingles", "digest", "sketch"])
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), text_mark(F.col(text)).alias("mark"))
    return rows.mapInArrow(run, "doc_id long, mark long, n_shingles long, digest binary, sketch binary")


def full_sets(docs: DataFrame, nodes: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """(doc_id, shingles, halves) of the documents named in nodes (doc_id); halves are the digests' upper halves, sorted."""
    def run(batches):
        for batch in pieces(batches, "text", limit=1 << 20):
            sets = shingle_sets(Words(batch.column(1), lower=True), width)
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            flat = np.concatenate(sets).view(np.int64) if sizes.sum() else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
            halves = pa.array([(s >> np.uint64(32)).astype(np.uint32).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, halves], ["doc_id", "shingles", "halves"])
    wanted = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).join(nodes, "doc_id", "left_semi")
    return wanted.mapInArrow(run, "doc_id long, shingles array<long>, halves binary")


def bounded(na, ua, nb, ub, percent: int):
    """Whether sizes and numbers of own shingles leave the threshold possible (numpy arrays or columns of whole numbers).

    The intersection holds no own shingle of either set, the union holds them all: so with o the smaller of what else they
    hold, the similarity is o / (o + ua + ub) at most.
    """
    least = F.least if not isinstance(na, np.ndarray) else np.minimum
    shared = least(na - ua, nb - ub)
    return 100 * shared >= percent * (shared + ua + ub)


def _likely(pairs: DataFrame, reps: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose own shingles and registers leave the threshold possible."""
    @F.pandas_udf("boolean")
    def passes(sa: pd.Series, sb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        if not len(sa):
            return pd.Series([], dtype=bool)
        as_rows = lambda s: np.frombuffer(b"".join(s), dtype=np.uint16).reshape(len(s), -1)
        return pd.Series(hopeful(as_rows(sa), as_rows(sb), na.to_numpy(float), nb.to_numpy(float), percent))

    known = reps.select("rep", "sketch").join(facts, "rep")
    left = known.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("own").alias("ua"), F.col("sketch").alias("sa"))
    right = known.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("own").alias("ub"), F.col("sketch").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").where(bounded(F.col("na"), F.col("ua"), F.col("nb"), F.col("ub"), percent))
    return both.where(passes("sa", "sb", "na", "nb")).select("a", "b")


def _confirmed(likely: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold."""
    both = likely.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    sizes = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("shared"), (F.size("x") + F.size("y")).alias("total"))
    return sizes.where(100 * F.col("shared") >= percent * (F.col("total") - F.col("shared"))).select("a", "b")


def band_keys(sketch: Column, registers: int, band: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(registers // band - 1)), lambda i: F.xxhash64(i, F.substring(sketch, i * (2 * band) + 1, F.lit(2 * band))))


def overlaps(rows: np.ndarray, sets: list[np.ndarray]):
    """A function that gives the size of each listed set's intersection with set k; all sets are numbered once."""
    at = np.cumsum([0, *(len(x) for x in sets)])
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    mine = np.concatenate([number[at[r]:at[r + 1]] for r in rows])
    starts = np.cumsum([0, *(len(sets[r]) for r in rows[:-1])])
    mark = np.zeros(int(number.max()) + 1, dtype=np.int32)

    def shared(k: int) -> np.ndarray:
        own = number[at[k]:at[k + 1]]
        mark[own] = 1
        out = np.add.reduceat(mark[mine], starts)
        mark[own] = 0
        return out
    return shared


def _rest(members: DataFrame, comp: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Pairs across components within the buckets that span several, compared whole; the exact second step.

    Sets travel as halves of their digests here: an intersection can only come out too large by that, so no link is lost, and
    what is found is confirmed on whole digests afterwards.
    """
    sizes = written(members.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 2"), "sizes")
    rows = (members.join(sizes, "bucket").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
            .select("bucket", "rep", "members", F.coalesce("component", "rep").alias("component")))
    rows = written(rows, "members")
    parts = rows.groupBy("bucket", "component").agg(F.count("*").alias("c"))
    main = parts.groupBy("bucket").agg(F.max(F.struct("c", "component")).alias("m"), F.count("*").alias("parts")).where("parts > 1")
    main = written(main, "main")  # a join with a table, not with the aggregation itself, may be split at a large bucket
    spread = written(rows.join(main.select("bucket", F.col("m.component").alias("main"), F.col("m.c").alias("held")), "bucket"), "spread")
    if spread.isEmpty():
        return None
    pieces_of = lambda n: F.ceil(n / BLOCK).cast("int")
    blocks, chunks, turn = pieces_of(F.col("members")), pieces_of(F.col("members") - F.col("held")), F.xxhash64("rep", "bucket")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    inside = spread.withColumn("block", F.pmod(turn, blocks).cast("int")).withColumn("chunk", each(chunks)).withColumn("outside", F.lit(False))
    outside = spread.where("component <> main").withColumn("chunk", F.pmod(turn, chunks).cast("int")).withColumn("block", each(blocks)).withColumn("outside", F.lit(True))

    def meet(table: pa.Table) -> pa.Table:
        rep, component, out = (table.column(c).to_numpy() for c in ("rep", "component", "outside"))
        held = [np.frombuffer(x, dtype=np.uint32) for x in table.column("halves").to_pylist()]
        size, rows, found = np.array([len(x) for x in held]), np.flatnonzero(~out), []
        if len(rows) and out.any():
            shared = overlaps(rows, held)
            for k in np.flatnonzero(out):
                m = shared(k)
                other = rows[(100 * m >= percent * (size[rows] + size[k] - m)) & (component[rows] != component[k])]
                found.append(np.stack([np.minimum(rep[other], rep[k]), np.maximum(rep[other], rep[k])], 1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    columns = ["bucket", "rep", "component", "block", "chunk", "outside"]
    rows = inside.select(columns).unionByName(outside.select(columns)).join(sets.select(F.col("doc_id").alias("rep"), "halves"), "rep")
    return rows.groupBy("bucket", "block", "chunk").applyInArrow(meet, "a long, b long").distinct()


def _judged(docs: DataFrame, width: int, percent: int, registers: int, band: int, key: str, text: str) -> DataFrame:
    """near_duplicates() with `mark`, the digest of each row's text."""
    sk = written(sketches(docs, width, registers, key, text), "sketches")
    named = sk.where("n_shingles > 0 AND doc_id IS NOT NULL")
    first = named.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    reps = named.join(first, (named.doc_id == first.rep) & (named.digest == first.digest), "left_semi").select("digest", F.col("doc_id").alias("rep"), "n_shingles", "sketch")
    reps = written(reps, "reps")
    bands = reps.select("rep", F.explode(band_keys(F.col("sketch"), registers, band)).alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("bucket")
    members = written(bands.join(shared, "bucket").distinct(), "members")
    sets = written(full_sets(docs, members.select(F.col("rep").alias("doc_id")).distinct(), width, key, text), "sets")
    alone = sets.select("doc_id", F.explode("shingles").alias("s")).groupBy("s").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("hi")).where("doc_id = hi")
    facts = sets.select(F.col("doc_id").alias("rep"), F.size("shingles").cast("long").alias("n")).join(alone.groupBy(F.col("doc_id").alias("rep")).agg(F.count("*").alias("own")), "rep", "left")
    own = F.when(F.count("*") > 1, 0).otherwise(F.coalesce(F.max("own"), F.lit(0))).cast("long")  # texts that share a doc_id have no shingles of their own
    facts = written(facts.groupBy("rep").agg(F.max("n").alias("n"), own.alias("own")).where(100 * (F.col("n") - F.col("own")) >= percent * F.col("n")), "facts")
    members = written(members.join(facts, "rep"), "members")
    heads = members.groupBy("bucket").agg(F.min(F.struct((F.col("own") / F.col("n")).alias("share"), "rep")).alias("h"), F.count("*").alias("c")).where("c > 1").select("bucket", F.col("h.rep").alias("head"))
    heads = written(heads, "heads")  # so that Spark may split a large bucket in the join
    star = members.join(heads, "bucket").where("rep <> head").select(F.least("rep", "head").alias("a"), F.greatest("rep", "head").alias("b"))
    pairs = written(star.distinct(), "pairs")
    links = written(_confirmed(written(_likely(pairs, reps, facts, percent), "likely"), sets, percent), "links")
    comp = components(links)
    more = _rest(members, comp, sets, percent)
    if more is not None:
        likely = written(more, "likely")
        if not likely.isEmpty():
            comp = components(links.unionByName(written(_confirmed(likely, sets, percent), "links")))
    joined = reps.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    with_set = sk.where("n_shingles > 0").join(written(joined, "classes"), "digest", "left").select("doc_id", "mark", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    without = sk.where("n_shingles = 0").select("doc_id", "mark", "n_shingles", F.col("doc_id").alias("component_id"))
    return with_set.unionByName(without).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, registers: int = 128, band: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id).

    Words are lower-cased in A-Z. A set holds the distinct shingles of `width` words; a text of fewer words is one shingle.
    Documents are linked where 100 * intersection >= percent * union. A null or empty text has an empty set and no link; a
    null doc_id takes part in no link, has a null component_id and is kept. Repeated rows give a row each; rows that
    repeat a doc_id are judged by their own texts. Columns besides key and text are not read. An empty table gives no rows.
    """
    return _judged(docs, width, percent, registers, band, key, text).drop("mark")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, registers: int = 128, band: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay when one of each group of near duplicates is kept, all columns: the one with the smallest key.

    Rows are judged by key and text: of rows that share both one stays, rows that share a key with different texts stay or go by
    their own text. Rows with a null key stay, as do null and empty texts, but for repeats of a key. Columns of any
    other name are carried. An empty table gives no rows.
    """
    said = _judged(docs, width, percent, registers, band, key, text).where("doc_id IS NOT NULL")
    said = said.groupBy("doc_id", "mark").agg(F.min("kept").alias("kept"), F.count("*").alias("n"))
    rows = docs.select(F.struct("*").alias("row"), F.col(key).cast("long").alias("doc_id"), text_mark(F.col(text)).alias("mark"))
    rows = rows.join(written(said, "said"), ["doc_id", "mark"], "left").where(F.coalesce("kept", F.lit(True)))
    alone = rows.where(F.coalesce("n", F.lit(1)) == 1).select("row")
    repeated = rows.where("n > 1").groupBy("doc_id", "mark").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    return alone.unionByName(repeated).select("row.*")
