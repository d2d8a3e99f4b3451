import numpy as np
import pytest

from postsieve.llm import vector_dedup as D

SCHEMA = "vec_id long, embedding array<double>, label int, n_links string, kept string"


def brute(rows, cosine=0.98):
    use = [k for k, (i, v, label) in enumerate(rows) if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {k: D.unit(np.array([rows[k][1]], dtype=float))[0] for k in use}
    link = {k: [j for j in use if j != k and rows[j][2] == rows[k][2] and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= cosine] for k in use}
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            new = [j for j in link.get(todo.pop(), []) if j not in seen]
            seen.update(new)
            todo += new
        least = None if i is None else min(rows[j][0] for j in seen)
        out.append((i, len(link.get(k, [])), least, i is None or least == i))
    return sorted(out, key=str)


def found(spark, rows, **how):
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in D.near_vectors(df, **how).collect()), key=str)


def groups(r, sizes, dims, noise):
    rows = []
    for size in sizes:
        centre, label = r.normal(size=dims), int(r.integers(0, 3))
        rows += [(v * r.uniform(0.1, 9), label) for v in centre / np.linalg.norm(centre) + noise * r.normal(size=(size, dims)) / np.sqrt(dims)]
    order = r.permutation(len(rows))
    return [(int(k), rows[j][0].tolist(), rows[j][1]) for k, j in enumerate(order)]


@pytest.mark.parametrize("block", [2048, 16])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK", block)
    monkeypatch.setattr(D, "PART_ROWS", 500)
    monkeypatch.setattr(D, "PAIRS", 64)
    rows = groups(np.random.default_rng(9), [1] * 150 + [2, 3, 5, 8, 120], 32, 0.13)
    want = brute(rows)
    assert found(spark, rows) == want and sum(n for _, n, _, _ in want) > 3000


def test_chains_copies_and_rows_that_take_no_part(spark):
    ray = lambda deg: [float(np.cos(np.radians(deg))), float(np.sin(np.radians(deg)))]
    rows = [(9 - k, ray(8 * k), 1) for k in range(6)] + [(20, ray(8), 2), (21, ray(0), None), (22, [0.0, 0.0], 1), (23, [None, 1.0], 1), (24, None, 1), (25, [], 1),
            (26, [float("nan"), 1.0], 1), (27, [1e300, 1e300], 3), (28, [1e-300, 1e-300], 3), (None, ray(0), 1), (30, [1.0, 0.0, 0.0], 1), (29, ray(8), 2), (29, ray(8), 2), (29, ray(90), 2)]
    rows += [(100 + k, [3.0, 4.0], 5) for k in range(70)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == [] and found(spark, [(1, None, None)]) == [(1, 0, 1, True)]


def test_layout_keeps_its_promise():
    for n in (2, 1000, 10**7):
        functions, tables = D.layout(n, 0.98, 1e-4)
        assert (1 - D.meeting(0.2) ** functions) ** tables <= 1e-4 and D.meeting(D.UNRELATED) ** functions * n <= 1 or functions == 4
    r = np.random.default_rng(1)
    offset, moved = r.uniform(0, D.WIDTH, 200_000), r.normal(size=200_000)
    share = np.mean(np.floor(offset / D.WIDTH) == np.floor((offset + moved) / D.WIDTH))
    assert abs(share - D.meeting(1.0)) < 0.005
