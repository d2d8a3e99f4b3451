import hashlib
import math

import numpy as np

from postsieve.llm import centroids as C

SCHEMA = "vec_id long, embedding array<double>, cluster string, inertia string"


def brute(rows, clusters, rounds, size, scale=1024, seed=3):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    centres = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        owner = [near(v)[1] for _, v in kept]
        centres = [[sum(x) // len(x) for x in zip(*own)] if (own := [v for (_, v), o in zip(kept, owner) if o == k]) else c for k, c in enumerate(centres)]
    final = [(i, *near(v)[::-1]) for i, v in kept]
    held = {k: sum(d for _, o, d in final if o == k) for k in range(clusters)}
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted([(i, k, d, held[k], sum(held.values()), marks[k]) for i, k, d in final], key=str)


def found(spark, rows, **how):
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in C.cluster(df, **how).collect()), key=str)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(C, "SLICE", 37)
    r = np.random.default_rng(8)
    centres = r.normal(size=(5, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(centres[r.integers(0, 5, 300)] + 0.4 * r.normal(size=(300, 6)))]
    for rounds in (0, 1, 10):
        assert found(spark, rows, clusters=8, rounds=rounds, size=6) == brute(rows, 8, rounds, 6)


def test_ties_copies_and_vectors_left_out(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, [2.0, -2.0]), (4, [2.0, -2.0]), (None, [0.5, 0.25]),
            (5, None), (6, [1.0]), (7, [1.0, None]), (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (10, [])]
    assert found(spark, rows, clusters=4, rounds=3, size=2) == brute(rows, 4, 3, 2)
    few = [(1, [0.5, -0.25]), (2, [3.0, 1.0])]
    assert found(spark, few, clusters=8, rounds=10, size=2) == brute(few, 8, 10, 2)
    assert found(spark, [], size=2) == [] and found(spark, rows[6:], size=2) == []


def test_large_components_are_exact(spark):
    rows = [(i, [float(i * 1e6), -3e5 * i, 0.5]) for i in range(6)]
    assert found(spark, rows, clusters=2, rounds=4, size=3) == brute(rows, 2, 4, 3)
    assert len(found(spark, [*rows, (99, [1e300, 0.0, 0.0])], clusters=2, rounds=4, size=3)) == 6
    far = found(spark, [(1, [4e15, 0.0, 0.0]), (2, [-4e15, 0.0, 0.0]), (3, [3e15, 0.0, 0.0])], clusters=1, rounds=1, size=3)
    assert len(far) == 3 and max(r[2] for r in far) == C.MOST and far[0][4] == C.MOST
