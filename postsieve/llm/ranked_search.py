"""Ranked lexical search for many queries at once, by evaluating common subexpressions of their term sets once.

A query's score is a sum over its terms, so queries that share terms share parts of that sum. Term sets that several queries
hold are mined (terms that occur in just the same queries first, then pairs of such sets, pairs of pairs, and so on); each
becomes a node of a graph whose children are terms or earlier nodes. For a slice of documents every node's partial accumulator
is made once, in the order of the graph, and a query adds up the few nodes left to it.

Texts are read once per block of queries: documents leave the scan as their length and the counts of the block's terms. Corpus
counts are sums over these rows, and the scores of a task leave it as each query's best k.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from postsieve.llm.shared import written
from postsieve.llm.words import Words, mix, pieces

#: Term slots of the queries that one reading of the texts carries to the tasks, and of those that share one graph. More queries take more
#: readings or graphs, not more memory; a single query may be larger.
BLOCK_SLOTS, GRAPH_SLOTS = 1 << 20, 1 << 14
#: Bytes of accumulators held at a time; neighbours among which a query's nodes are paired in a round of mining.
ACCUMULATORS, REACH = 32 << 20, 64

#: ASCII other than letters and digits parts terms.
BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def terms(texts: pa.Array) -> Words:
    return Words(texts, lower=True, outside=BREAK)


@dataclass
class Graph:
    """Sums over numbered leaves: `nodes[j]` lists what node `size + j` adds up, `queries[q]` what query q adds up."""

    size: int
    nodes: list[np.ndarray]
    queries: list[np.ndarray]

    def sums(self, leaves: np.ndarray) -> np.ndarray:
        """A row of sums per query, from a row per leaf."""
        rows = np.empty((self.size + len(self.nodes), leaves.shape[1]), dtype=leaves.dtype)
        rows[:self.size] = leaves
        for j, parts in enumerate(self.nodes, self.size):
            np.add.reduce(rows[parts], 0, out=rows[j])
        return np.stack([np.add.reduce(rows[parts], 0) for parts in self.queries]) if self.queries else rows[:0]


def mine(queries: list[np.ndarray], size: int, reach: int = REACH) -> Graph:
    """A graph for queries given as sorted leaf numbers below `size`; every leaf of a query is counted just once in its sum."""
    nodes: list[np.ndarray] = []
    # leaves with the same set of queries: the sum of the queries' digests tells them
    held, sign = np.zeros(size, np.int64), np.zeros(size, np.uint64)
    for q, leaves in enumerate(queries):
        held[leaves] += 1
        sign[leaves] += mix(np.array([q + 1], dtype=np.uint64))[0]
    common = np.flatnonzero(held > 1)
    common = common[np.argsort(sign[common], kind="stable")]
    stand = np.arange(size)  # what stands for a leaf: itself, or the node that adds up its set
    for part in np.split(common, np.flatnonzero(np.diff(sign[common])) + 1):
        if len(part) > 1:
            stand[part] = size + len(nodes)
            nodes.append(part)
    left = [np.unique(stand[leaves]) for leaves in queries]
    uses = np.concatenate([held, np.zeros(len(nodes), np.int64)])
    uses[size:] = [held[part[0]] for part in nodes]
    while True:
        codes = []
        for parts in left:
            own = parts[uses[parts] > 1]
            for at in range(0, len(own), reach):
                run = own[at:at + reach]
                a, b = np.triu_indices(len(run), 1)
                codes.append(run[a] * len(uses) + run[b])
        code, times = np.unique(np.concatenate(codes) if codes else np.zeros(0, np.int64), return_counts=True)
        code, times = code[times > 1], times[times > 1]
        if not len(code):
            break
        partner, made = {}, []
        for c in code[np.argsort(-times, kind="stable")]:
            a, b = divmod(int(c), len(uses))
            if a not in partner and b not in partner:
                partner[a], partner[b] = (b, size + len(nodes)), (a, size + len(nodes))
                made.append((a, b))
                nodes.append(np.array([a, b]))
        uses = np.concatenate([uses, np.zeros(len(made), np.int64)])
        for q, parts in enumerate(left):
            here = set(parts.tolist())
            new = [partner[a][1] if a in partner and partner[a][0] in here else a for a in here]
            left[q] = np.unique(np.array(new, dtype=np.int64))
        uses[:] = 0
        for parts in left:
            uses[parts] += 1
    return Graph(size, nodes, left)


def query_terms(items: DataFrame, item_key: str, text: str) -> DataFrame:
    """(item, terms): each item's distinct terms as sorted digests; rows that share an item's key are one item, items without terms leave."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words = terms(batch.column(1))
            digests = words.hashes().view(np.int64)
            rows = [np.unique(digests[a:b]) for a, b in zip(words.first, words.first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tolist() for r in rows], pa.list_(pa.int64()))], ["item", "terms"])
    rows = items.select(F.col(item_key).cast("long").alias("item"), F.col(text).alias("text")).mapInArrow(run, "item long, terms array<long>")
    return rows.where(F.size("terms") > 0).groupBy("item").agg(F.array_distinct(F.flatten(F.collect_set("terms"))).alias("terms"))


def query_blocks(items: DataFrame, slots: int) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """Items (item, terms) in blocks of at most `slots` terms, one item at least; the driver holds one block."""
    block, held = [], 0
    for item, own in items.orderBy("item").toLocalIterator():
        if block and held + len(own) > slots:
            yield block
            block, held = [], 0
        block.append((item, np.array(own, dtype=np.int64).view(np.uint64)))
        held += len(own)
    if block:
        yield block


def graphs(block: list[tuple[int | None, np.ndarray]], slots: int) -> tuple[np.ndarray, list[tuple[list, np.ndarray, Graph]]]:
    """The block's terms (sorted digests), and for each run of items of at most `slots` terms: items, their terms' numbers, graph."""
    known = np.unique(np.concatenate([own for _, own in block]))
    runs, held = [[]], 0
    for item, own in block:
        if runs[-1] and held + len(own) > slots:
            runs.append([])
            held = 0
        runs[-1].append((item, np.searchsorted(known, own)))
        held += len(own)
    out = []
    for run in runs:
        used = np.unique(np.concatenate([own for _, own in run]))
        out.append(([item for item, _ in run], used, mine([np.sort(np.searchsorted(used, own)) for _, own in run], len(used))))
    return known, out


def counted(docs: DataFrame, known: np.ndarray, key: str, text: str) -> DataFrame:
    """(doc_id, n, term, tf) per document with at least one term: its length, the numbers of known terms it holds, how often."""
    low = np.zeros(1 << 16, dtype=bool)
    low[known & np.uint64(0xFFFF)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", limit=1 << 20):
            words = terms(batch.column(1))
            digests = words.hashes()
            maybe = np.flatnonzero(low[digests & np.uint64(0xFFFF)])
            place = np.searchsorted(known, digests[maybe])
            good = known[np.minimum(place, len(known) - 1)] == digests[maybe]
            pair, tf = np.unique(words.text_of(maybe[good]) * len(known) + place[good], return_counts=True)
            full = np.flatnonzero(words.count)
            at = np.searchsorted(pair // len(known), np.append(full, len(words.count))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(full)), pa.array(words.count[full].astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(at), pa.array((pair % len(known)).astype(np.int32))), pa.ListArray.from_arrays(pa.array(at), pa.array(tf.astype(np.int64)))], ["doc_id", "n", "term", "tf"])
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n long, term array<int>, tf array<long>")


def document_counts(rows: DataFrame, size: int) -> np.ndarray:
    """In how many documents each known term occurs; a task adds up its own rows first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["term", "df"])
    out = np.zeros(size, dtype=np.int64)
    for r in rows.select("term").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():  # known terms at most
        out[r["term"]] = r["df"]
    return out


def length_part(n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """10 + (90 * n * documents) div words, exactly."""
    if len(n) and 90 * int(n.max()) * documents >= 1 << 62:
        return np.array([10 + 90 * int(x) * documents // words for x in n], dtype=np.int64)
    return 10 + 90 * n * documents // words


class Best:
    """The k best rows (score, doc_id, doc_id missing) of each query so far; equal scores by smaller doc_id, missing ones last."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.zeros(queries, dtype=np.int64)
        self.rows = np.zeros((4, 0), dtype=np.int64)  # query, score, doc_id, missing

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        q, d = np.nonzero((scores > 0) & (scores >= self.least[:, None]))
        if not len(q):
            return
        rows = np.concatenate([self.rows, np.stack([q, scores[q, d], ids[d], missing[d]])], 1)
        rows = rows[:, np.lexsort((rows[2], rows[3], -rows[1], rows[0]))]
        place = np.arange(rows.shape[1]) - np.searchsorted(rows[0], rows[0])
        self.rows = rows[:, place < self.k]
        full = place[place < self.k] == self.k - 1
        self.least[self.rows[0, full]] = self.rows[1, full]


def best_of(rows: DataFrame, parts: list[tuple[list, np.ndarray, Graph]], weights: np.ndarray, documents: int, words: int, k: int) -> DataFrame:
    """(item, doc_id, score): each task's k best documents per item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(len(items), k) for items, _, _ in parts]
        for batch in batches:
            at = np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy())])
            term, tf = batch.column(2).flatten().to_numpy().astype(np.int64), batch.column(3).flatten().to_numpy()
            missing = batch.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            ids = batch.column(0).fill_null(0).to_numpy()
            own = np.repeat(np.arange(batch.num_rows), np.diff(at))
            part = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * length_part(batch.column(1).to_numpy(), documents, words)[own]))
            for (_, used, graph), top in zip(parts, best):
                step = max(1, ACCUMULATORS // (8 * (2 * graph.size + len(graph.nodes) + len(graph.queries))))
                place = np.minimum(np.searchsorted(used, term), len(used) - 1)
                good = used[place] == term
                for a in range(0, batch.num_rows, step):
                    b = min(a + step, batch.num_rows)
                    mine_ = slice(at[a], at[b])
                    here = good[mine_]
                    leaves = np.zeros((graph.size, b - a), dtype=np.int64)
                    leaves[place[mine_][here], own[mine_][here] - a] = part[mine_][here]
                    top.add(graph.sums(leaves), ids[a:b], missing[a:b])
        for (items, _, _), top in zip(parts, best):
            q, score, ids, missing = top.rows
            yield pa.RecordBatch.from_arrays([pa.array([items[i] for i in q], pa.int64()), pa.array(ids, pa.int64(), mask=missing.astype(bool)), pa.array(score)], ["item", "doc_id", "score"])
    return rows.mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_slots: int = BLOCK_SLOTS, graph_slots: int = GRAPH_SLOTS) -> DataFrame:
    """(<item_key>, rank, <key>, score): each item's k best documents with a score above 0, by descending score, then ascending key.

    Terms are the longest runs of letters and digits of ASCII and of all other characters, with A-Z lower-cased, in whole texts. With N
    documents that hold a term, L terms in all of them, n in one, df documents holding a term and tf its occurrences in one, a term
    weighs floor(1000 * ln((2N + 2) / (2 df + 1))) and adds weight * (10^9 tf div (1000 tf + 8 (10 + 90 n N div L))) once per item.

    A null or empty text has no terms: such a document isn't counted, such an item finds nothing. Rows that share an item's key are one
    item with the terms of all. Repeated documents are counted and ranked a row each; a null key ranks behind equal scores, a
    null item key is an item of its own. Terms are told apart by 64-bit digests. Only the named columns are read. An empty table on
    either side gives no rows. Items are the stated query set: a block of them at a time is held by the driver and carried to the tasks.
    """
    schema = f"{item_key} long, rank int, {key} long, score long"
    found, totals = None, None
    for block in query_blocks(written(query_terms(items, item_key, item_text), "items"), block_slots):
        known, parts = graphs(block, graph_slots)
        rows = written(counted(docs, known, key, text), "counted")
        if totals is None:
            totals = rows.agg(F.count("*"), F.sum("n")).first()
        if not totals[0]:
            break
        df = document_counts(rows, len(known))
        weights = np.array([math.floor(1000 * math.log((2 * totals[0] + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
        best = written(best_of(rows, parts, weights, totals[0], totals[1], k).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64))), "best")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return docs.sparkSession.createDataFrame([], schema)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for by in (["item", "part"], ["item"]):  # what many tasks found is thinned before an item's rows meet
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return found.select(F.col("item").alias(item_key), F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias(key), "score")
