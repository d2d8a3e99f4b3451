"""Uploaded files of any encoding, read by byte ranges.

Files are listed by Spark and cut into ranges; a task reads its ranges and nothing else, so a file's size doesn't matter. Borders follow
the encoding: a character that a border cuts belongs to the range in which it begins, and so does a line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes of a range, and of the ranges that one task reads.
RANGE, TASK_BYTES = 4 << 20, 64 << 20

# --- fixed values: characters of windows-1252 at bytes 80 to 9F (unused bytes stay as they are) ---
_W1252_BYTES = [0x80, *range(0x82, 0x8D), 0x8E, *range(0x91, 0x9D), 0x9E, 0x9F]
_W1252_CHARS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def _encoding(content: Column, valid: Column) -> Column:
    """What the first bytes tell, and ``valid`` (as UTF-8) where they tell nothing."""
    head = F.hex(F.substring(content, 1, 1024))
    pairs = F.floor(F.length(head) / 4).cast("int")  # whole two-byte units
    zero = lambda offset: F.size(F.filter(F.sequence(F.lit(0), pairs - 1),
                                          lambda i: F.substring(head, i * 4 + offset, F.lit(2)) == "00"))
    wide = F.when(pairs >= 8, (zero(3) / pairs > 0.5) & (zero(1) / pairs < 0.1)).otherwise(False)
    found = lambda name, sure: F.struct(F.lit(name).alias("encoding"), F.lit(sure).alias("confidence"))
    return (F.when(head.startswith("EFBBBF"), found("utf-8", "certain"))
            .when(head.startswith("FFFE"), found("utf-16le", "certain"))
            .when(head.startswith("FEFF"), found("utf-16be", "certain"))
            .when(wide, found("utf-16le", "guessed"))
            .when(valid, found("utf-8", "certain"))
            .otherwise(found("windows-1252", "guessed")))


def _decoded(content: Column, encoding: Column) -> Column:
    latin = F.translate(F.decode(content, "ISO-8859-1"), "".join(chr(b) for b in _W1252_BYTES), _W1252_CHARS)
    return (F.when(encoding == "utf-16le", F.decode(content, "UTF-16LE"))
            .when(encoding == "utf-16be", F.decode(content, "UTF-16BE"))
            .when(encoding == "windows-1252", latin).otherwise(content.cast("string")))


def byte_ranges(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(path, length, start) of every range of every file; neighbouring ranges of a file go to one task, up to TASK_BYTES."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # contents are not read
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("long"))).alias("start"))
    total = files.agg(F.sum(F.ceil(F.col("length") / TASK_BYTES) + 1)).first()[0] or 1
    return ranges.repartition(int(total), "path", F.floor(F.col("start") / TASK_BYTES)).sortWithinPartitions("path", "start")


class _Reader:
    """Bytes of files by position; holds the last file open. Local files, and what pyarrow's file systems reach."""

    def __init__(self):
        self.path, self.file = None, None

    def read(self, path: str, start: int, size: int) -> bytes:
        if path != self.path:
            if self.file is not None:
                self.file.close()
            url = urlparse(path)
            if url.scheme in ("", "file"):
                self.file = open(unquote(url.path), "rb")  # closed with the next file
            else:
                from pyarrow import fs
                system, inside = fs.FileSystem.from_uri(path)
                self.file = system.open_input_file(inside)
            self.path = path
        self.file.seek(start)
        return self.file.read(size)


def _pieces(ranges: DataFrame, size: int) -> DataFrame:
    """(path, start, content, u8, le, be): a range's bytes as they are and with its borders moved for UTF-8, UTF-16LE and UTF-16BE."""
    def lead(b: bytes) -> int:  # bytes that only go on a character of UTF-8
        return next((i for i, x in enumerate(b[:3]) if x & 0xC0 != 0x80), min(3, len(b)))

    def low(b: bytes, high: int) -> int:  # the second half of a surrogate pair
        return 2 if len(b) >= 2 and 0xDC <= b[high] <= 0xDF else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for batch in batches:
            for path, length, start in zip(*(c.to_pylist() for c in batch.columns)):
                data = reader.read(path, start, size + 4)
                content, after = data[:size], data[size:]
                cut = lambda of, *how: content[of(content, *how) if start else 0:] + after[:of(after, *how)]  # noqa: E731,B023
                row = [path, start, content, cut(lead), cut(low, 1), cut(low, 0)]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.int64(), *[pa.binary()] * 4))], ["path", "start", "content", "u8", "le", "be"])
    return ranges.mapInArrow(run, "path string, start long, content binary, u8 binary, le binary, be binary")


def audit_files(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(path, start, encoding, confidence, text): a row per range of each file, in order of start its whole text; a read never fails over
    an encoding guess. `size` must be even. A file is read twice: first for its encoding, which any of its bytes may decide."""
    pieces = _pieces(byte_ranges(spark, path, size), size)
    told = pieces.groupBy("path").agg(F.min(F.is_valid_utf8(F.col("u8").cast("string"))).alias("valid"),
                                      F.max(F.when(F.col("start") == 0, F.substring("content", 1, 1024))).alias("head"))
    told = told.select("path", _encoding(F.col("head"), F.col("valid")).alias("e"))
    encoding = F.col("e.encoding")
    aligned = F.when(encoding == "utf-8", F.col("u8")).when(encoding == "utf-16le", F.col("le")).when(encoding == "utf-16be", F.col("be")).otherwise(F.col("content"))
    text = _decoded(aligned, encoding)
    return pieces.join(told, "path").select("path", "start", "e.encoding", "e.confidence", F.when(F.col("start") == 0, F.regexp_replace(text, "^\ufeff", "")).otherwise(text).alias("text"))


def range_lines(spark: SparkSession, path: str, encoding: str, blanks: bool, size: int = 4 * RANGE) -> DataFrame:
    """(value, file, block, id): the lines of files in a known encoding, each from the range in which it begins, numbered there.

    Lines end with a line feed, a carriage return or both. UTF-16 without byte order follows the file's first two bytes. Blank lines are
    left out unless asked for.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for batch in batches:
            for name, length, start in zip(*(c.to_pylist() for c in batch.columns)):
                codec = encoding
                if re.fullmatch("utf-?16", codec, re.I):
                    codec = "utf-16-le" if reader.read(name, 0, 2) == b"\xff\xfe" else "utf-16-be"
                unit = len("\n".encode(codec))
                kind = {1: "u1", 2: "<u2" if "\n".encode(codec)[0] else ">u2", 4: "<u4" if "\n".encode(codec)[0] else ">u4"}[unit]
                # from the character before the range, to see whether a line begins with it, up to the end of the last line
                begin, end = max(0, start - 2 * unit), min(length, start + size)
                data, more = reader.read(name, begin, end - begin), end
                while more < length:
                    ahead = reader.read(name, more, RANGE)
                    data, more = data + ahead, more + len(ahead)
                    marks = np.frombuffer(data[end - begin - unit:len(data) // unit * unit], dtype=kind)
                    if ((marks[1:] == 10) | (marks[1:] == 13)).any() and not (marks[-1] == 13 and more < length):
                        break
                marks = np.frombuffer(data[:len(data) // unit * unit], dtype=kind)
                stops = np.flatnonzero((marks == 10) | ((marks == 13) & (np.append(marks[1:], 0) != 10)))  # the last character of each line end
                firsts = np.concatenate([[0], stops + 1]) if not begin else stops + 1
                lasts = np.append(stops, len(marks))[:len(firsts)] if not begin else np.append(stops[1:], len(marks))
                at = begin + firsts * unit
                mine = (at >= start) & (at < end)
                out = []
                for a, b in zip(firsts[mine], lasts[mine]):
                    line = data[a * unit:b * unit].decode(codec, "replace")
                    line = line[:-1] if b < len(marks) and marks[b] == 10 and line.endswith("\r") else line
                    out.append(line.lstrip("\ufeff") if begin == 0 and a == 0 else line)
                if not blanks:
                    out = [x for x in out if x]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array([name] * len(out), pa.string()), pa.array([start] * len(out), pa.int64()), pa.array(range(len(out)), pa.int64())], ["value", "file", "block", "id"])
    return byte_ranges(spark, path, size).mapInArrow(run, "value string, file string, block long, id long")
