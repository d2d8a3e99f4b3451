import math
import re
from collections import Counter

import numpy as np
import pytest

from postsieve.llm import ranked_search as R

DOCS, ITEMS = "doc_id long, text string, rank string, score string", "item_id long, text string, doc_id string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    held = [(i, Counter(w), len(w)) for i, t in docs if (w := words(t))]
    total, every = len(held), sum(n for _, _, n in held)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for i, own in asked.items():
        scores = []
        for d, tf, n in held:
            m = 100 - 90 + (90 * n * total) // every
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * sum(w in c for _, c, _ in held) + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 8 * m)) for w in own if w in tf)
            if s > 0:
                scores.append((-s, d is None, d or 0, d, s))
        out += [(i, r + 1, d, s) for r, (*_, d, s) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, **how):
    a = spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS).repartition(3)
    b = spark.createDataFrame([(*i, "z") for i in items], ITEMS)
    got = R.search(a, b, **how)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("how", [{}, {"block_slots": 30, "graph_slots": 12}])
def test_against_brute_force(spark, how):
    r = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["Zürich", "水", "Ab", "x9"]
    p = 1 / np.arange(1, len(vocabulary) + 1)
    text = lambda n: " ".join(r.choice(vocabulary, n, p=p / p.sum()))
    docs = [(i, text(int(r.integers(1, 40)))) for i in range(150)] + [(900, text(3000))]
    items = [(i, text(12)) for i in range(14)] + [(50, "absent terms only")]
    assert found(spark, docs, items, k=5, **how) == brute(docs, items, 5)


def test_ties_nulls_empty_and_repeated_rows(spark):
    docs = [(7, "Red fox"), (3, "red FOX"), (None, "red fox"), (5, None), (6, ""), (8, "..!"), (3, "red fox"), (9, "blue a\x00b")]
    items = [(1, "fox!"), (1, "blue"), (2, None), (3, "--"), (None, "red"), (4, "b")]
    assert found(spark, docs, items, k=10) == brute(docs, items, 10)
    assert [r[2] for r in sorted(found(spark, docs, [(1, "fox")], k=3), key=lambda r: r[1])] == [3, 3, 7]
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, "  ")], items) == []


def test_graph_adds_every_term_once_and_shares():
    r = np.random.default_rng(5)
    base = np.arange(0, 20)
    queries = [np.unique(np.concatenate([base[: int(r.integers(5, 20))], r.integers(20, 200, 6)])) for _ in range(40)]
    graph = R.mine(queries, 200)
    leaves = r.integers(0, 1000, (200, 7))
    assert (graph.sums(leaves) == np.stack([leaves[q].sum(0) for q in queries])).all()
    added = sum(len(n) for n in graph.nodes) + sum(len(q) for q in graph.queries)
    assert graph.nodes and added < 0.7 * sum(len(q) for q in queries)
    assert (R.mine([np.array([3]), np.array([3])], 4).sums(leaves[:4]) == leaves[[3, 3]]).all()


def test_length_part_beyond_64_bits():
    n = np.array([10**9, 1], dtype=np.int64)
    assert R.length_part(n, 10**12, 10**14).tolist() == [10 + 90 * int(x) * 10**12 // 10**14 for x in n]
