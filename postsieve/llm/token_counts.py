"""Token counts by offset-mapped attribution.

A document's fields are joined and encoded once, as a whole. Tokens of a byte-level vocabulary have fixed byte lengths, so their
running sum gives each token's span; spans are interval-joined to the document's sections (the lines of each field) by binary
search, and a token that crosses a border goes where an explicit rule puts it. So the sections' counts sum to the document's.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postsieve.llm.words import pieces

#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: the characters that the pattern's \\s stands for.
BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: From this many blanks on a run is cut out before the pattern sees it.
LONG_RUN = 100_000
RULES = ("start", "end", "most")
MAX_VOCABULARY_BYTES = 64 << 20
_loaded: dict[int, tuple] = {}


def encoder(ranks: bytes, pattern: str):
    """(encoding, byte length of each id), loaded once per worker process."""
    key = hash((ranks, pattern))
    if key not in _loaded:
        import tiktoken
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        lengths = np.zeros(max(table.values()) + 1, dtype=np.int64)
        for token, i in table.items():
            lengths[i] = len(token)
        _loaded[key] = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=table, special_tokens={}), lengths
    return _loaded[key]


def encode(text: str, ranks: bytes, pattern: str) -> np.ndarray:
    """The ids of a text.

    The default pattern tries every length of a run of blanks before it gives up, and fails on very long ones. What it does with a run
    is known: one piece of all blanks but the last, or of all at the text's end, and the last one begins what follows. A piece
    never holds a blank behind another character, so long runs are cut out by that rule and the rest is encoded as it is.
    """
    encoding = encoder(ranks, pattern)[0]
    plain = lambda t: encoding.encode_to_numpy(t, disallowed_special=())
    if pattern != PATTERN or len(text) < LONG_RUN:
        return plain(text)
    out, at = [], 0
    for run in re.finditer(f"[{BLANKS}]{{{LONG_RUN},}}", text):
        whole, end = encoder(ranks, r"(?s).+")[0], run.end() - (run.end() < len(text))
        out += [plain(text[at:run.start()]), whole.encode_to_numpy(text[run.start():end], disallowed_special=())]
        at = end
    return np.concatenate([*out, plain(text[at:])]) if out else plain(text)


def attribute(ends: np.ndarray, borders: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token. ends: byte ends of consecutive tokens; borders: byte ends of consecutive sections.

    start: where its first byte lies; end: where its last byte lies; most: where most of its bytes lie, ties to the earlier.
    """
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    first, last = np.searchsorted(borders, starts, side="right"), np.searchsorted(borders, ends - 1, side="right")
    if rule == "start":
        return first
    if rule == "end":
        return last
    out = first.copy()
    for i in np.flatnonzero(first != last):
        cuts = np.clip(borders[first[i]:last[i] + 1], starts[i], ends[i])
        out[i] = first[i] + int(np.argmax(np.diff(np.concatenate([[starts[i]], cuts]))))
    return out


def sections_of(body: bytes) -> np.ndarray:
    """Byte ends of a field's lines, each with the line end that closes it; an empty field is one empty line."""
    cuts = np.flatnonzero(np.frombuffer(body, dtype=np.uint8) == 10) + 1
    return cuts if len(cuts) and cuts[-1] == len(body) else np.concatenate([cuts, [len(body)]]).astype(np.int64)


def count_tokens(docs: DataFrame, vocabulary: str, fields: tuple[str, ...] = ("text",), key: str = "doc_id", rule: str = "start", pattern: str = PATTERN) -> DataFrame:
    """Rows (key, field, section, start, end, n_tokens): every line of every field with its tokens.

    vocabulary: path of a file of ranks on the driver, of at most 64 MB; it is sent to the tasks once. Fields are joined by a
    line end that counts with the field before it; section numbers, start and end (characters, end exclusive) are within the
    field. A null or empty field is one section without characters of its own. Repeated rows give rows each, null keys are
    carried, special tokens' strings are ordinary text, runs of any length are encoded in full, and only the named columns are read. An empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(vocabulary, "rb") as f:
        ranks = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(ranks) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to send to every task")
    ranks = docs.sparkSession.sparkContext.broadcast(ranks)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, lengths = encoder(ranks.value, pattern)
        for batch in pieces(batches, *(f"f{i}" for i in range(len(fields)))):
            rows, owner = [], []
            columns = [c.to_pylist() for c in batch.columns[1:]]
            for i, values in enumerate(zip(*columns)):
                whole = "\n".join(v or "" for v in values)
                data = whole.encode()
                ends = np.cumsum(lengths[encode(whole, ranks.value, pattern)])
                if len(data) != (ends[-1] if len(ends) else 0):
                    raise ValueError("tokens do not cover the text")
                borders, names, at = [], [], 0
                for name, v in zip(fields, values):
                    own = sections_of((v or "").encode()) + at
                    at = int(own[-1]) + 1
                    borders.append(own)
                    names += [(name, n) for n in range(len(own))]
                last = [b.copy() for b in borders]
                for b in last[:-1]:
                    b[-1] += 1
                inside = attribute(ends, np.concatenate(last), rule) if len(ends) else np.zeros(0, np.int64)
                counts = np.bincount(np.minimum(inside, len(names) - 1), minlength=len(names))
                before = np.concatenate([[0], np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)])
                stops = [before[b] - before[b0] for b, b0 in zip(borders, [0, *(int(b[-1]) + 1 for b in borders[:-1])])]
                starts = np.concatenate([np.concatenate([[0], s[:-1]]) for s in stops])
                rows += [(n, s, int(a), int(b), int(c)) for (n, s), a, b, c in zip(names, starts, np.concatenate(stops), counts)]
                owner += [i] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64()))] + [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                                             ["key", "field", "section", "start", "end", "n_tokens"])
    rows = docs.select(F.col(key).alias("key"), *(F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)))
    out = rows.mapInArrow(run, f"key {kind}, field string, section int, start long, end long, n_tokens long")
    return out.select(F.col("key").alias(key), "field", "section", "start", "end", "n_tokens")
