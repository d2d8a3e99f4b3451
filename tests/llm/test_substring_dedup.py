import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from postsieve.llm.substring_dedup import repeated_passages

SCHEMA = "doc_id long, text string, digest string, hits string, part string"


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = {j for s in range(len(w) - window + 1) if seen[tuple(w[s:s + window])] > 1 for j in range(s, s + window)}
        left = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [6, 35])
def test_equals_brute_force(spark, window):
    r = np.random.default_rng(window)
    fresh = lambda n: [f"t{x}" for x in r.integers(0, 10 ** 7, n)]
    shared = [fresh(k) for k in (window - 1, window, window + 1, 3 * window, 90)]
    docs = []
    for _ in range(60):
        w = fresh(int(r.integers(0, 200)))
        for s in shared:
            if r.random() < 0.3:
                at = int(r.integers(0, len(w) + 1))
                w[at:at] = s
        docs.append(" ".join(w))
    twice = fresh(2 * window)
    docs += [" ".join(twice + fresh(7) + twice), "same word " * 100, docs[0], docs[0], "", None, " \t\n", "été x " * 3, " ".join(fresh(30_000))]
    rows = [(None if k == 3 else 7 * k, t) for k, t in enumerate(docs)] + [(0, docs[0]), (0, "other")]
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)
    got = repeated_passages(df, window=window)
    assert sorted((tuple(x)[:4] for x in got.collect()), key=str) == brute(rows, window)
    for row in got.where("n_removed > 0").collect():
        assert sum(s["end"] - s["first"] for s in row["spans"]) == row["n_removed"]


def test_empty_table(spark):
    assert repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0
