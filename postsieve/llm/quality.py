"""Quality classifier: regularised quadratic discriminant on transformed document statistics.

Statistics are counts over a document's bytes, words and lines. Shares are drawn towards a typical share by a fixed weight, so that
short texts are not judged by noise, and logarithms make them near normal. Each class has a mean and a covariance that is
shrunk towards the pooled covariance and its diagonal; the score compares log densities by Mahalanobis distances through
Cholesky factors that are computed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postsieve.llm.shared import text_mark, written
from postsieve.llm.words import Words, pieces

#: Share of class covariance given to the pooled one, and of the pooled one given to its diagonal.
SHRINK, DIAGONAL = 0.1, 0.1
#: Characters or words of typical text that every share is mixed with.
_WEIGHT = 60.0
_UPPER, _LOWERCASE, _DIGIT, _STOP, _SYMBOL, _LINE, _REST = range(7)


def _kinds() -> np.ndarray:
    kind = np.full(256, _REST, dtype=np.uint8)
    kind[65:91], kind[97:123], kind[48:58] = _UPPER, _LOWERCASE, _DIGIT
    kind[[ord(c) for c in ".,;:?'\"()-"]] = _STOP
    kind[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = _SYMBOL
    kind[10] = _LINE
    return kind


KIND = _kinds()
NAMES = ("length", "word_length", "symbols", "upper", "digits", "stops", "lines", "short_words", "distinct_words", "distinct_lines", "symbol_words", "longest")


def _per_part(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of the values between neighbouring places; the places rise from 0 to the number of values. No running sum is held."""
    out, full = np.zeros(len(at) - 1, dtype=np.int64), np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, at[full], dtype=np.int64)
    return out


def _distinct(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=n)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of NAMES per text; null and empty texts have those of no words at all."""
    words = Words(texts, lower=False)
    n, at, kind = len(words.count), words.text_at, KIND[words.data]
    count = lambda k: _per_part(kind == k, at).astype(float)
    w, size = words.count.astype(float), words.end - words.start
    chars = _per_part((words.data & 0xC0) != 0x80, at).astype(float)
    solid = _per_part(size, words.first).astype(float)
    symbol_word = np.logical_or.reduceat(kind == _SYMBOL, words.start) if len(size) else np.zeros(0, bool)  # blanks after a word are no symbols
    hashes, owner = words.hashes(), np.repeat(np.arange(n), words.count)
    distinct = _distinct(hashes, owner, n).astype(float)
    # a line's digest is the sum of its words' digests times their place in it
    line_no = np.searchsorted(np.flatnonzero(kind == _LINE), words.start)
    starts = np.flatnonzero(np.diff(line_no, prepend=-1) | np.diff(owner, prepend=-1)) if len(size) else np.zeros(0, np.int64)
    if len(starts):
        place = np.arange(len(size)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(size)]])))
        digest = np.add.reduceat(hashes * (2 * place.astype(np.uint64) + np.uint64(1)), starts)
        full_lines = np.bincount(owner[starts], minlength=n).astype(float)
        distinct_lines = _distinct(digest, owner[starts], n).astype(float)
    else:
        full_lines = distinct_lines = np.zeros(n)
    longest = np.maximum.reduceat(np.concatenate([size, [0]]), words.first[:-1]) * (words.count > 0) if len(size) else np.zeros(n)
    drawn = lambda x, total, typical: np.log((x + _WEIGHT * typical) / (total + _WEIGHT))
    per_text = lambda flags: _per_part(flags, words.first).astype(float)
    return np.stack([
        np.log1p(w), np.log((solid + 5 * 6.0) / (w + 5)), drawn(count(_SYMBOL), chars, 0.002), drawn(count(_UPPER), chars, 0.02), drawn(count(_DIGIT), chars, 0.002),
        drawn(count(_STOP), chars, 0.03), drawn(count(_LINE), w, 0.02), drawn(per_text(size <= 1), w, 0.03),
        np.log((distinct + 20) / (w + 20)), np.log((distinct_lines + 5) / (full_lines + 5)), drawn(per_text(symbol_word), w, 0.002), np.log1p(np.minimum(longest, 60))], 1)


@dataclass
class Model:
    """Per class: mean, lower Cholesky factor of the covariance, its log determinant, log prior. No classes: a constant score.

    The factors' inverses are kept once they are needed, so a batch costs a product per class.
    """

    classes: dict[int, tuple[np.ndarray, np.ndarray, float, float]] = field(default_factory=dict)
    constant: float = 0.5
    inverses: dict[int, np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row of statistics."""
        if len(self.classes) < 2:
            return np.full(len(x), self.constant)
        density = {}
        for k, (mean, factor, log_det, prior) in self.classes.items():
            if k not in self.inverses:
                self.inverses[k] = np.linalg.inv(factor)
            z = self.inverses[k] @ (x - mean).T
            density[k] = prior - log_det / 2 - (z * z).sum(0) / 2
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -700, 700)))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, mark, x): the statistics of every row; mark is a digest of its text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", limit=1 << 19):
            x = statistics(batch.column(1))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), rows], ["doc_id", "mark", "x"])
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), text_mark(F.col(text)).alias("mark")).mapInArrow(run, f"doc_id {kind}, mark long, x array<double>")


def fit(features: DataFrame, labels: DataFrame, label: str = "quality", shrink: float = SHRINK, diagonal: float = DIAGONAL) -> Model:
    """The model of (doc_id, x) joined with (doc_id, label 0 or 1); rows set aside by the key's checksum are not learnt from.

    Count, sum and sum of products per class are gathered by Spark; the driver sees two rows of them per class. A class with
    fewer than two rows leaves the share of label 1 (0.5 without labels) as everyone's score.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("label IN (0, 1)").where(~held_out(F.col("doc_id"))).distinct()
    d = len(NAMES)

    def sums(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column(0).to_numpy()
            x = np.array(batch.column(1).flatten()).reshape(-1, d)
            total = [np.concatenate([[float((y == k).sum())], x[y == k].sum(0), (x[y == k].T @ x[y == k]).ravel()]) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([t.tolist() for t in total])], ["label", "sums"])
    parts = features.join(known, "doc_id").select("label", "x").mapInArrow(sums, "label int, sums array<double>")
    rows = parts.select("label", F.posexplode("sums")).groupBy("label", "pos").agg(F.sum("col").alias("v")).collect()  # 2 * (1 + d + d * d) at most
    total = np.zeros((2, 1 + d + d * d))
    for r in rows:
        total[r["label"], r["pos"]] = r["v"]
    n = total[:, 0]
    if n.min() < 2:
        return Model(constant=float(n[1] / n.sum()) if n.sum() else 0.5)
    means = total[:, 1:1 + d] / n[:, None]
    spread = total[:, 1 + d:].reshape(2, d, d) - n[:, None, None] * np.einsum("ki,kj->kij", means, means)
    pooled = spread.sum(0) / (n.sum() - 2)
    pooled = (1 - diagonal) * pooled + diagonal * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
    model = Model()
    for k in (0, 1):
        factor = np.linalg.cholesky((1 - shrink) * spread[k] / (n[k] - 1) + shrink * pooled)
        model.classes[k] = means[k], factor, 2 * float(np.log(np.diag(factor)).sum()), float(np.log(n[k] / n.sum()))
    return model


def _scored(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, cut: float) -> DataFrame:
    """(doc_id, mark, score, predicted) of every row."""
    rows = written(features(docs, key, text), "statistics")
    model = fit(rows, labels.withColumnRenamed(key, "doc_id") if key != "doc_id" else labels, label)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(2).flatten()).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.score(x))], ["doc_id", "mark", "score"])
    return rows.mapInArrow(run, f"doc_id {kind}, mark long, score double").withColumn("predicted", (F.col("score") >= cut).cast("int"))


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", cut: float = 0.3) -> DataFrame:
    """One row per document: key, held_out, score (0 to 1, of its text alone), predicted (1 from `cut` on).

    A null or empty text is scored as a text of no words. A null key is never held out and finds no label. Repeated rows are
    scored each, and learnt from each where labelled; repeated labels count once, contradictory ones both. Other columns
    are not read. An empty table gives no rows; without labels of both classes the score is constant (see fit).
    """
    scored = _scored(docs, labels, key, text, label, cut)
    return scored.select(F.col("doc_id").alias(key), held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", cut: float = 0.3) -> DataFrame:
    """The documents the model accepts, all columns; documents with a null key stay.

    Each row is judged by its own text, also where rows repeat a key; equal rows stay or go together. Null and empty texts are scored
    as texts of no words. An empty table gives no rows; without labels of both classes the score is constant and judges all alike.
    Columns of any other name are carried.
    """
    bad = _scored(docs, labels, key, text, label, cut).where((F.col("predicted") == 0) & F.col("doc_id").isNotNull()).select("doc_id", "mark").distinct()
    rows = docs.alias("d")
    return rows.join(bad.alias("b"), (F.col(f"d.`{key}`") == F.col("b.doc_id")) & (text_mark(F.col(f"d.`{text}`")) == F.col("b.mark")), "left_anti")
