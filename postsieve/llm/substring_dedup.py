"""Exact substring dedup by fixed-block anchors.

A window of `window` words holds at least one whole block of (window + 1) // 2 words that starts at a multiple of its length.
Those blocks of every document are the index; every rolling window of that length probes it. A probe that shares its
digest with an indexed block elsewhere is a hit, and both occurrences of any repeated window contain one. Hits are extended:
each full window round a hit is compared by a 95-bit digest of its whole word sequence, and overlapping repeated windows
merge into maximal exact repeats.

Index and probes meet by digest, never in the driver or one task: tasks send one entry of 7 bytes per distinct probe of a
slice of about 4 MB, so a passage in a third of all documents costs an entry per slice, not per document. What is a hit
within a slice is known on the spot. No pairs of occurrences are made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from postsieve.llm.shared import written
from postsieve.llm.words import Words, mix, pieces

BLANKS = r"[\x20\x09-\x0D]+"
ROWS = "part long, slice long, kind int, a binary, b binary"
SEND, DOCS, HITS = 0, 1, 2
#: Words whose probes meet in one part, some 14 MB packed.
PART_WORDS = 2 << 20


def joined_words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " "))


def _repeated(values: np.ndarray) -> np.ndarray:
    """The sorted values that occur more than once."""
    s = np.sort(values)
    return np.unique(s[1:][s[1:] == s[:-1]])


def _among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    if not len(some):
        return np.zeros(len(values), dtype=bool)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


def _pack(values: np.ndarray, extra: np.ndarray | None, width: int) -> np.ndarray:
    out = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    if extra is not None:
        out = np.concatenate([out, extra.astype("<u4").view(np.uint8).reshape(-1, 4)], 1)
    return np.ascontiguousarray(out)


def _unpack(data: bytes, width: int, wide: bool) -> tuple[np.ndarray, np.ndarray | None]:
    raw = np.frombuffer(data, dtype=np.uint8).reshape(-1, width + 4 * wide)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :width] = raw[:, :width]
    return full.view("<u8").ravel(), np.ascontiguousarray(raw[:, width:]).view("<u4").ravel() if wide else None


def _send(grams: np.ndarray, at: np.ndarray, flag: np.ndarray, second: np.ndarray | None, parts: int, width: int) -> tuple[list, np.ndarray]:
    """Entries of a slice by part (part, digests, gaps), and the places that are repeated within the slice."""
    twice = _repeated(grams)
    local = _among(grams, twice)
    low = (grams & np.uint64((1 << (8 * width - 1)) - 1) if width < 8 else grams >> np.uint64(1)) << np.uint64(1)
    if local.any():
        where = np.flatnonzero(local)
        _, first, group = np.unique(grams[where], return_index=True, return_inverse=True)
        any_flag = np.zeros(len(first), dtype=bool)
        np.logical_or.at(any_flag, group, flag[where])
        keep = ~local
        keep[where[first]] = True
        flag = flag.copy()
        flag[where[first]] = any_flag
        chosen = np.flatnonzero(keep)
    else:
        chosen = np.arange(len(grams))
    part = ((grams[chosen] >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)
    order = np.sort((part.astype(np.int64) << 32) | chosen)
    chosen, part = order & 0xFFFFFFFF, order >> 32
    packed = _pack(low[chosen] | flag[chosen].astype(np.uint64), None if second is None else second[chosen], width)
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    out = []
    for lo, hi in zip(cuts, [*cuts[1:], len(part)]):
        gaps = np.diff(at[chosen[lo:hi]], prepend=0)
        out.append((int(part[lo]), packed[lo:hi].tobytes(), gaps.astype("<u2" if gaps.max() < 65536 else "<u4").tobytes()))
    return out, at[local]


def _meet(width: int, wide: bool, need_flag: bool):
    """For one part: the places whose digest occurs in more than one entry (with one flagged, where flags are needed)."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist() if table.num_rows else []
        out = [(r["slice"], r["kind"], r["a"], r["b"]) for r in rows if r["kind"] != SEND]
        sent = [r for r in rows if r["kind"] == SEND]
        if sent:
            values, second = _unpack(b"".join(r["a"] for r in sent), width, wide)
            counts = np.array([len(r["a"]) // (width + 4 * wide) for r in sent])
            key = values >> np.uint64(1)
            hit = _among(key, _repeated(key))
            if need_flag:
                flagged = np.unique(key[hit & (values & np.uint64(1) == 1)])
                hit &= _among(key, flagged)
            where = np.flatnonzero(hit)
            if wide and len(where):
                order = np.lexsort((second[where], key[where]))
                k, s = key[where][order], second[where][order]
                same = (k[1:] == k[:-1]) & (s[1:] == s[:-1])
                pair = np.concatenate([same, [False]]) | np.concatenate([[False], same])
                where = np.sort(where[order[pair]])
            ends = np.cumsum(counts)
            cuts = np.searchsorted(where, np.concatenate([[0], ends]))
            for r, n, first, lo, hi in zip(sent, counts, ends - counts, cuts, cuts[1:]):
                if hi > lo:
                    at = np.cumsum(np.frombuffer(r["b"], dtype="<u2" if len(r["b"]) == 2 * n else "<u4").astype(np.int64))
                    out.append((r["slice"], HITS, at[where[lo:hi] - first].astype("<u4").tobytes(), None))
        return pa.table({"slice": pa.array([x[0] for x in out], pa.int64()), "kind": pa.array([x[1] for x in out], pa.int32()),
                         "a": pa.array([x[2] for x in out], pa.binary()), "b": pa.array([x[3] for x in out], pa.binary())})
    return run


def _to_texts(table: pa.Table) -> pa.Table:
    """For one slice: its hits by document, as word numbers from the document's start."""
    rows = table.to_pylist() if table.num_rows else []
    keys, found = [], []
    docs = next((r for r in rows if r["kind"] == DOCS), None)
    hits = [np.frombuffer(r["a"], dtype="<u4") for r in rows if r["kind"] == HITS]
    if docs and hits:
        at = np.unique(np.concatenate(hits)).astype(np.int64)
        first = np.frombuffer(docs["b"], dtype="<u4").astype(np.int64)
        cuts = np.searchsorted(at, first)
        for k in np.flatnonzero(np.diff(cuts)):
            keys.append(docs["a"][32 * k:32 * k + 32])
            found.append((at[cuts[k]:cuts[k + 1]] - first[k]).astype("<u4").tobytes())
    return pa.table({"digest": pa.array(keys, pa.binary()), "hits": pa.array(found, pa.binary())})


def _slices(batches, work) -> Iterator[pa.RecordBatch]:
    """Rows for the exchange: entries by part, and each slice's own hits and documents, which only pass through."""
    number = TaskContext.get().partitionId() << 32
    for batch in pieces(batches, "text"):
        number += 1
        words, entries, local = work(batch)
        rows = [(part, number, SEND, a, b) for part, a, b in entries]
        if len(words.count):
            digests = batch.column(0).to_pylist()
            rows.append((-1 - number, number, DOCS, b"".join(digests), words.first.astype("<u4").tobytes()))
        if len(local):
            rows.append((-1 - number, number, HITS, local.astype("<u4").tobytes(), None))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()),
                                          pa.array([r[3] for r in rows], pa.binary()), pa.array([r[4] for r in rows], pa.binary())], ["part", "slice", "kind", "a", "b"])


def _parts(df: DataFrame, words: int) -> int:
    """Parts of at most about PART_WORDS entries, so that a part's size does not follow the input."""
    return max(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-words // PART_WORDS))


def _by_text(rows: DataFrame, width: int, wide: bool, need_flag: bool, name: str) -> DataFrame:
    met = rows.groupBy("part").applyInArrow(_meet(width, wide, need_flag), "slice long, kind int, a binary, b binary")
    return written(met.groupBy("slice").applyInArrow(_to_texts, "digest binary, hits binary"), name)


def anchors(texts: DataFrame, window: int, total: int) -> DataFrame:
    """(digest, hits): word numbers where a probe meets an indexed block, for texts (digest, text) of so many words in total."""
    block, parts = (window + 1) // 2, _parts(texts, total)

    def work(batch):
        words = Words(batch.column(1))
        grams, at = words.windows(words.hashes(), block)
        aligned = (at - words.first[words.text_of(at)]) % block == 0
        return words, *_send(grams, at, aligned, None, parts, 5)
    return _by_text(texts.mapInArrow(lambda it: _slices(it, work), ROWS), 5, False, True, "anchors")


def extended(texts: DataFrame, window: int, total: int) -> DataFrame:
    """(digest, hits): starts of windows that occur elsewhere, for texts (digest, text, hits, copies) with anchors as hits."""
    block, parts = (window + 1) // 2, _parts(texts, total)

    def work(batch):
        words = Words(batch.column(1))
        hashes = words.hashes()
        grams, at = words.windows(hashes, window)
        second = words.windows(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), window)[0].astype(np.uint32)
        near = np.zeros(len(words.start) + 1, dtype=np.int32)
        hits = [np.frombuffer(h, dtype="<u4").astype(np.int64) + words.first[k] for k, h in enumerate(batch.column(2).to_pylist())]
        hits = np.concatenate(hits) if hits else np.zeros(0, np.int64)
        np.add.at(near, np.maximum(hits - (window - block), 0), 1)
        np.add.at(near, hits + 1, -1)
        some = np.flatnonzero(np.cumsum(near)[at] > 0)
        grams, at, second = grams[some], at[some], second[some]
        copied = np.array(batch.column(3).to_pylist(), dtype=bool)[words.text_of(at)] if len(at) else np.zeros(0, bool)
        entries, local = _send(grams, at, copied, second, parts, 8)
        return words, entries, np.union1d(local, at[copied])
    return _by_text(texts.mapInArrow(lambda it: _slices(it, work), ROWS), 8, True, False, "windows")


def _strip(batches, window: int) -> Iterator[pa.RecordBatch]:
    """Rows (digest, text, starts): how many words the windows at these starts cover, and what is left."""
    for batch in pieces(batches, "text"):
        words, removed, left, spans = Words(batch.column(1)), [], [], []
        for k, starts in enumerate(batch.column(2).to_pylist()):
            at = np.frombuffer(starts or b"", dtype="<u4").astype(np.int64)
            lo, n = int(words.first[k]), int(words.count[k])
            step = np.zeros(n + 1, dtype=np.int32)
            np.add.at(step, at, 1)
            np.add.at(step, at + window, -1)
            gone = np.cumsum(step)[:n] > 0
            edge = np.diff(gone.astype(np.int8), prepend=0, append=0)
            spans.append(list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())))
            removed.append(int(gone.sum()))
            left.append(hashlib.sha256(b" ".join(words.word(lo + i) for i in np.flatnonzero(~gone))).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(left, pa.string()),
                                          pa.array([[{"first": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))],
                                         ["digest", "n_removed", "kept_sha256", "spans"])


def repeated_passages(docs: DataFrame, window: int = 35, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_words, n_removed, kept_sha256, spans (maximal repeats as word ranges, end exclusive).

    A word goes where a window of `window` consecutive words of its document covers it whose sequence starts anywhere else
    too, in this document or another; words are taken as they are. Windows are judged on the input. A null or blank text has no
    words. Repeated rows are copies of each other; a null key is carried. Results depend on the word sequence alone, so
    copies share one computation. Other columns are not read. An empty table gives no rows.
    """
    line = joined_words(F.col(text))
    digest = F.unhex(F.sha2(line.cast("binary"), 256))
    rows = docs.select(F.col(key).alias("id"), line.alias("line")).select(
        "id", F.unhex(F.sha2(F.col("line").cast("binary"), 256)).alias("digest"),
        F.when(F.col("line") == "", 0).otherwise(F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"))
    rows = written(rows, "rows")
    total = rows.agg(F.sum("n_words")).first()[0] or 0
    hits = anchors(docs.select(digest.alias("digest"), F.col(text).alias("text")), window, total)
    chosen = (hits.groupBy("digest").agg(F.first("hits").alias("hits"))
              .join(rows.groupBy("digest").agg(F.min(F.coalesce(F.col("id"), F.lit(-1))).alias("one"), F.count("*").alias("n")), "digest"))
    chosen = written(chosen.select(F.col("digest").alias("wanted"), "hits", "one", (F.col("n") > 1).alias("copied")), "chosen")
    texts = (docs.select(F.coalesce(F.col(key), F.lit(-1)).alias("one"), F.col(text).alias("text")).join(chosen, "one")
             .where(F.unhex(F.sha2(joined_words(F.col("text")).cast("binary"), 256)) == F.col("wanted")))
    texts = written(texts.select(F.col("wanted").alias("digest"), "text", "hits", "copied"), "texts")
    starts = extended(texts, window, total).groupBy("digest").agg(F.first("hits").alias("starts"))
    cut = texts.select("digest", "text").join(starts, "digest").select("digest", "text", "starts").mapInArrow(
        lambda it: _strip(it, window), "digest binary, n_removed long, kept_sha256 string, spans array<struct<first: long, end: long>>")
    cut = written(written(cut, "cut").dropDuplicates(["digest"]), "once")  # so that Spark may split the copies of one text in the join
    out = rows.join(cut, "digest", "left")
    return out.select(F.col("id").alias(key), "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
                      F.coalesce("kept_sha256", F.lower(F.hex("digest"))).alias("kept_sha256"), "spans")
