"""URL filters over a sorted digest array.

A rule is a host and the start of a path. Rules become one file: sorted 64-bit xxhash keys of their strings, verdicts, and the
strings themselves. Tasks memory-map the file and probe it with vectorised binary search for every host suffix and every
path start of a length that some rule has; a probe counts only if the stored string is the probed one, so collisions of keys
do no harm. The file has a checked size; a larger list of rules meets the distinct probes in a join instead, with equal
results.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postsieve.session import scratch_path

MAX_FILE_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What stands between the first :// and /, ? or #, in lower case (A-Z); empty without a url or ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def _key(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text)


def suffixes(host: str) -> list[str]:
    """The host and the hosts it is under, longest first."""
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))] if host else []


class DigestArray:
    """Keys, places of strings, verdicts (1: block) and strings in one buffer, which may be a memory map.

    Layout, all little-endian: count n and number m of path lengths (8 bytes each), m lengths, n keys in order, n + 1 places,
    n verdict bytes, strings.
    """

    def __init__(self, data):
        head = np.frombuffer(data, "<i8", 2)
        n, m = int(head[0]), int(head[1])
        self.lengths = np.frombuffer(data, "<i8", m, 16)
        self.keys = np.frombuffer(data, "<u8", n, 16 + 8 * m)
        self.places = np.frombuffer(data, "<i8", n + 1, 16 + 8 * m + 8 * n)
        at = 16 + 8 * m + 8 * n + 8 * (n + 1)
        self.blocks = np.frombuffer(data, "u1", n, at)
        self.strings = memoryview(data)[at + n:]

    @staticmethod
    def build(rules: list[tuple[str, str, str]], key=_key) -> bytes:
        """From distinct (host, path, verdict)."""
        rows = sorted((key((h + p).encode()), (h + p).encode(), v == "block", len(p)) for h, p, v in rules)
        lengths = np.array(sorted({r[3] for r in rows}), dtype="<i8")
        places = np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])]).astype("<i8")
        return b"".join([np.array([len(rows), len(lengths)], "<i8").tobytes(), lengths.tobytes(), np.array([r[0] for r in rows], "<u8").tobytes(),
                         places.tobytes(), np.array([r[2] for r in rows], "u1").tobytes(), *(r[1] for r in rows)])

    @staticmethod
    def open(path: str) -> "DigestArray":
        return DigestArray(np.memmap(path, dtype=np.uint8, mode="r"))

    def judge(self, hosts: list[str], paths: list[str], key=_key) -> tuple[list, list]:
        """For each url its longest rule (None: no rule) and verdict (None)."""
        owner, probes, digests = [], [], []
        for i, (host, path) in enumerate(zip(hosts, paths)):
            starts = [path[:n] for n in self.lengths[::-1] if n <= len(path)]
            for s in suffixes(host):
                for p in starts:
                    text = (s + p).encode()
                    owner.append(i)
                    probes.append((text, len(s)))
                    digests.append(key(text))
        digests = np.array(digests, dtype=np.uint64)
        lo, hi = np.searchsorted(self.keys, digests, "left"), np.searchsorted(self.keys, digests, "right")
        best: dict[int, tuple] = {}
        for j in np.flatnonzero(hi > lo):
            text, host_length = probes[j]
            for r in range(lo[j], hi[j]):
                if self.strings[self.places[r]:self.places[r + 1]] == text:
                    best[owner[j]] = max(best.get(owner[j], (0,)), (len(text.decode()), host_length, text.decode(), bool(self.blocks[r])))
        found = [best.get(i) for i in range(len(hosts))]
        return [b and b[2] for b in found], [b and ("block" if b[3] else "allow") for b in found]


def _distinct_rules(rules: DataFrame) -> DataFrame:
    return (rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
            .where("host IS NOT NULL AND host <> '' AND verdict IN ('allow', 'block')").groupBy("host", "path").agg(F.max("verdict").alias("verdict")))


def _ship(spark: SparkSession, data: bytes) -> str:
    """Puts the array in the shared folder and has every executor fetch its own copy; its name."""
    path = scratch_path(spark, "rules") + ".bin"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", max_file_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """One row per page: key, host, path, rule (host and path in one string, or null), verdict (default without a rule).

    Rules are (host, path, verdict allow or block). A rule fits its host and all hosts under it where the url's path starts
    with the rule's; the longest string wins, of equal ones the longer host. Hosts compare in lower case. Rules without a host
    or with another verdict never fit; a null path is empty; a rule given twice blocks if either does. A null url or one
    without :// has an empty host and path and gets the default. Repeated rows give a row each; null keys are carried; other
    columns are not read. No rules: the default for all. An empty table gives no rows.
    """
    spark, rules = pages.sparkSession, _distinct_rules(rules)
    rows = pages.select(F.col(key).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    size = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 25)).first()[0] or 0
    if size <= max_file_bytes:
        name = _ship(spark, DigestArray.build([tuple(r) for r in rules.collect()]))

        @F.pandas_udf("struct<rule: string, verdict: string>")
        def judge(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            array = DigestArray.open(SparkFiles.get(name))
            for host, path in parts:
                rule, verdict = array.judge(host.tolist(), path.tolist())
                yield pd.DataFrame({"rule": pd.Series(rule, dtype=object), "verdict": pd.Series(verdict, dtype=object)})
        out = rows.withColumn("found", judge("host", "path")).select("id", "host", "path", "found.rule", "found.verdict")
    else:
        out = _joined(rows, rules)
    return out.select(F.col("id").alias(key), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _joined(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """The same for lists of any length: distinct (host, path) pairs are probed by xxhash keys in a join with the rules."""
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().collect()]  # at most as many as the longest path has characters
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.array(*(F.struct(F.lit(n).alias("n"), F.substring("path", 1, n).alias("start")) for n in sorted(lengths))), lambda s: s["n"] <= F.length("path"))
    distinct = rows.where("host <> ''").select("host", "path").distinct()
    probes = distinct.select("host", "path", F.explode(suffix).alias("s"), starts.alias("starts")).select("host", "path", "s", F.explode("starts.start").alias("start"))
    probes = probes.withColumn("k", F.xxhash64(F.concat("s", "start")))
    listed = rules.select(F.xxhash64(F.concat("host", "path")).alias("k"), F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    hits = probes.join(listed, "k").where("s = rule_host AND start = rule_path")
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length(F.concat("rule_host", "rule_path")).alias("n"), F.length("rule_host").alias("h"), F.concat("rule_host", "rule_path").alias("rule"), "verdict")).alias("b"))
    return rows.join(best, ["host", "path"], "left").select("id", "host", "path", F.col("b.rule").alias("rule"), F.col("b.verdict").alias("verdict"))
