"""Words of whole texts as numpy arrays, inside Arrow tasks.

A word is a run of characters other than the six blanks U+0020 and U+0009 to U+000D. Blanks are single bytes of UTF-8,
so words are found and hashed in the bytes of a column without making a Python string of any of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = r"[^\x20\x09-\x0D]+"
PIECE_BYTES = 4 << 20

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 output bits; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(batches, *columns: str | int, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of record batches in slices of about `limit` bytes of the named (or numbered) columns, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = sum(pc.fill_null(pc.binary_length(batch.column(c if isinstance(c, int) else batch.schema.get_field_index(c))), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
        slot = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(slot)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(int(a), int(b - a))


class Words:
    """Words of a slice of texts: `first[k]:first[k + 1]` are the word numbers of text k; `start`, `end` their byte places.

    `outside` marks the bytes that no word holds (the six blanks unless given).
    """

    def __init__(self, texts: pa.Array, lower: bool = False, outside: np.ndarray = _BLANK):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
        body = texts.buffers()[2]
        data = np.frombuffer(body, dtype=np.uint8)[offsets[0]:offsets[-1]] if body is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.data = _LOWER[data] if lower else data
        self.text_at = offsets - offsets[0]
        inside = ~outside[self.data]
        edges = self.text_at[1:-1][(self.text_at[1:-1] > 0) & (self.text_at[1:-1] < len(self.data))]
        at = inside.copy()
        at[1:] &= ~inside[:-1]
        at[edges] = inside[edges]
        self.start = np.flatnonzero(at)
        at[:] = inside
        at[:-1] &= ~inside[1:]
        at[edges - 1] = inside[edges - 1]
        self.end = np.flatnonzero(at) + 1
        self.first = np.searchsorted(self.start, self.text_at)
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit digest of each word."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray(shape=(len(self.data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        left = self.end - self.start
        h = left.astype(np.uint64) * _ODD
        at, who = self.start, None
        while len(at):
            part = eight[at] & _KEEP[np.minimum(left, 8)]
            h_part = mix((h if who is None else h[who]) ^ part * _ODD2) + _ODD
            if who is None:
                h = h_part
            else:
                h[who] = h_part
            more = np.flatnonzero(left > 8)
            who = more if who is None else who[more]
            at, left = at[more] + 8, left[more] - 8
        return h

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Digests of every run of `width` words within one text, and the number of its first word."""
        n = len(hashes) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        acc = hashes[:n].copy()
        for j in range(1, width):
            acc *= _ODD
            acc += hashes[j:n + j]
        room = np.repeat(self.first[1:], self.count)[:n] - np.arange(n) >= width
        at = np.flatnonzero(room)
        return mix(acc[at] + np.uint64(width)), at

    def text_of(self, at: np.ndarray) -> np.ndarray:
        """The text to which each word number belongs."""
        return np.searchsorted(self.first, at, side="right") - 1

    def word(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()


def shingle_sets(words: Words, width: int) -> list[np.ndarray]:
    """Each text's distinct shingles of `width` words as sorted digests. Fewer words: the sequence as one; none: empty."""
    hashes = words.hashes()
    grams, at = words.windows(hashes, width)
    cut = np.searchsorted(at, words.first)
    sets = []
    for k, n in enumerate(words.count):
        if n >= width:
            sets.append(np.unique(grams[cut[k]:cut[k + 1]]))
        elif n:
            acc = np.uint64(0)
            with np.errstate(over="ignore"):
                for h in hashes[words.first[k]:words.first[k + 1]]:
                    acc = acc * _ODD + h
            sets.append(mix(np.array([acc + np.uint64(int(n))], dtype=np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
