"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are dealt into ranges of their number of shingles (powers of two). An item's MinHash sketch is its smallest shingle hashes, as
many as its range keeps: for the largest size of the range the number of shingles that may be missing, and SPARE more. A range also
has a bound, the largest hash any of its sketches holds; a document's sketch for the range is all its shingle hashes up to that
bound, so a short item is searched in a long document without the document's length mattering.

The share of an item's sketch found in a document estimates its containment. A pair is a candidate when no more of the sketch is
missing than shingles may be missing in all; as a document that qualifies can't miss more, no pair is lost, at any size.
Candidates are counted on all shingle digests, and what reaches the threshold is confirmed word by word, in the same task.
Documents are scanned once per block of items, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postsieve.llm.shared import written
from postsieve.llm.words import Words, pieces

#: Bytes of item texts that one pass over the documents carries to the tasks. More items take more passes, not more memory.
MAX_ITEM_BYTES = 16 << 20
#: Hashes of a sketch beyond those that may be missing.
SPARE = 8
PAIRS = "doc_id long, item_id long, item_shingles long, shared long"


class SizeRange:
    """The sketches of the items of one range of sizes and one shingle width: `hashes` sorted, with the item each belongs to."""

    def __init__(self, width: int, largest: int, percent: int, items: list[tuple[int, np.ndarray]]):
        self.width, keep = width, largest - -(-largest * percent // 100) + 1 + SPARE
        sketches = [(number, grams[:keep]) for number, grams in items]
        owners = np.repeat(np.array([number for number, _ in sketches]), [len(s) for _, s in sketches])
        hashes = np.concatenate([s for _, s in sketches])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owners, self.bound = hashes[order], owners[order], hashes.max()

    def candidates(self, grams: np.ndarray, text: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Rows (text, item) that share as much of the item's sketch as `least` asks for."""
        low = np.flatnonzero(grams <= self.bound)
        at = np.searchsorted(self.hashes, grams[low])
        low, at = low[(good := self.hashes[at] == grams[low])], at[good]
        number = np.searchsorted(self.hashes, self.hashes[at], side="right") - at
        entry = np.repeat(at - (np.cumsum(number) - number), number) + np.arange(number.sum())
        met = np.unique(np.stack([np.repeat(text[low], number), entry], 1), axis=0)  # each hash of a sketch once per text
        pairs, shared = np.unique(np.stack([met[:, 0], self.owners[met[:, 1]]], 1), axis=0, return_counts=True)
        return pairs[shared >= least[pairs[:, 1]]]


class ItemIndex:
    """A bounded block of items by ranges of size, with the shingle digests and words of each."""

    def __init__(self, items: list[tuple[int, str]], width: int, percent: int):
        self.percent, self.ids, self.widths, self.grams, self.words = percent, [], [], [], []
        words = Words(pa.array([t for _, t in items], pa.string()), lower=True)
        hashes = words.hashes()
        by_width = {w: words.windows(hashes, w) for w in {min(width, int(n)) for n in words.count if n}}
        ranges: dict[tuple[int, int], list] = {}
        for k, (item_id, _) in enumerate(items):
            n, lo = int(words.count[k]), int(words.first[k])
            if not n:
                continue
            w = min(width, n)
            grams, at = by_width[w]
            own = np.unique(grams[np.searchsorted(at, lo):np.searchsorted(at, lo + n)])
            ranges.setdefault((w, int(len(own) - 1).bit_length()), []).append((len(self.ids), own))
            self.ids.append(item_id)
            self.widths.append(w)
            self.grams.append(own)
            self.words.append([words.word(i) for i in range(lo, lo + n)])
        self.ranges = [SizeRange(w, 1 << size, percent, own) for (w, size), own in sorted(ranges.items(), key=lambda r: r[0])]
        n = np.array([len(g) for g in self.grams], dtype=np.int64)
        keep = np.zeros(len(n), dtype=np.int64)
        for part in self.ranges:
            keep += np.bincount(part.owners, minlength=len(n))
        self.least = keep - (n - -(-n * percent // 100))

    def exact(self, item: int) -> set:
        said, w = self.words[item], self.widths[item]
        return {tuple(said[j:j + w]) for j in range(len(said) - w + 1)}

    def matches(self, words: Words, hashes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text number, item number, the item's shingles, those in the text) of the pairs that reach the threshold."""
        for w in sorted(set(self.widths)):
            grams, at = words.windows(hashes, w)
            text = words.text_of(at)
            found = [part.candidates(grams, text, self.least) for part in self.ranges if part.width == w]
            pairs = np.concatenate(found)
            pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
            for t, items in zip(np.unique(pairs[:, 0]), np.split(pairs[:, 1], np.flatnonzero(np.diff(pairs[:, 0])) + 1)):
                own = np.unique(grams[np.searchsorted(text, t):np.searchsorted(text, t, side="right")])
                enough = [k for k in items if 100 * int(np.isin(self.grams[k], own, assume_unique=True).sum()) >= self.percent * len(self.grams[k])]
                if enough:
                    said = [words.word(i) for i in range(int(words.first[t]), int(words.first[t + 1]))]
                    shingles = {tuple(said[i:i + w]) for i in range(len(said) - w + 1)}
                for k in enough:
                    item = self.exact(k)
                    shared = len(item & shingles)
                    if 100 * shared >= self.percent * len(item):
                        yield int(t), int(k), len(item), shared


def item_blocks(items: DataFrame, item_key: str, text: str, limit: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most `limit` bytes (one item at least); never more than one block is held."""
    block, size = [], 0
    for item_id, t in items.select(F.col(item_key).cast("long"), F.col(text)).where(F.col(text).isNotNull()).toLocalIterator():
        if block and size + 4 * len(t) > limit:
            full, block, size = [block], [], 0
            yield full.pop()
        block.append((item_id, t))
        size += 4 * len(t)
    if block:
        yield block


def _holding(rows: DataFrame, index: ItemIndex) -> DataFrame:
    """The pairs of documents (doc_id, text) and the items of one block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", limit=1 << 20):
            words = Words(batch.column(1), lower=True)
            found = list(index.matches(words, words.hashes()))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array([t for t, _, _, _ in found], pa.int64())), pa.array([index.ids[k] for _, k, _, _ in found], pa.int64()),
                pa.array([n for _, _, n, _ in found], pa.int64()), pa.array([n for _, _, _, n in found], pa.int64())], ["doc_id", "item_id", "item_shingles", "shared"])
    return rows.mapInArrow(run, PAIRS)


def contaminated(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """Pairs (doc_id, item_id, item_shingles, shared) where 100 * shared >= percent * item_shingles.

    Words are lower-cased in A-Z; shingles are distinct runs of `width` words. An item of fewer words is one shingle, its whole
    sequence, found anywhere in a document. Items without words are found nowhere; null and empty documents hold nothing.
    Repeated documents or items give a row each; a null doc_id or item_id is carried as null. Only the named columns are
    read. An empty table on either side gives no rows. Items are the stated query set: they go to the tasks in blocks of
    bounded size, each block over all documents. A block's pairs are written to the shared folder before the next block is
    taken, so the driver holds the texts of one block.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for block in item_blocks(items, item_key, item_text, max_item_bytes):
        index = ItemIndex(block, width, percent)  # built once, carried to the tasks
        del block
        part = written(_holding(rows, index), "pairs")
        del index
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], PAIRS)


def clean(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """The documents that hold no item, all columns; documents with a null key stay.

    Each row is judged by its own text, also where rows repeat a key; rows are dropped in the scan, without a join. Null and empty
    texts stay. An empty table on either side changes nothing. With several blocks of items, each block's scan reads what the
    one before it kept.
    """
    place = (docs.columns.index(key), docs.columns.index(text))

    def kept(index: ItemIndex):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, place[1], limit=1 << 20):
                words = Words(batch.column(place[1]), lower=True)
                stays = np.ones(batch.num_rows, dtype=bool)
                stays[[t for t, _, _, _ in index.matches(words, words.hashes())]] = False
                yield batch.filter(pa.array(stays | batch.column(place[0]).is_null().to_numpy(zero_copy_only=False)))
        return run
    out = docs
    for block in item_blocks(items, item_key, item_text, max_item_bytes):
        out = written(out.mapInArrow(kept(ItemIndex(block, width, percent)), docs.schema), "clean")
    return out
