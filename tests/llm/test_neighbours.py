import numpy as np
import pytest

from postsieve.llm import neighbours as A

SCHEMA = "vec_id long, embedding array<float>, rank string, score string, cell string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], SCHEMA)


def recall(got, rows, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float32).astype(float)
    hit = total = 0
    for q in {r["query_id"] for r in got}:
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        score = x @ x[ids == q][0]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        assert [r["rank"] for r in mine] == list(range(1, len(order) + 1))
        assert np.allclose([r["score"] for r in mine], [score[ids == r["vec_id"]][0] for r in mine], rtol=1e-12)
        assert all((a["score"], -a["vec_id"]) >= (b["score"], -b["vec_id"]) for a, b in zip(mine, mine[1:]))
        hit += len({r["vec_id"] for r in mine} & {int(ids[j]) for j in order})
        total += len(order)
    return hit / total


@pytest.mark.parametrize("scale", [0.0, 0.6])
def test_recall_against_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(A, "CELL_ROWS", 128)
    r = np.random.default_rng(6)
    centres = r.normal(size=(12, 24))
    x = centres[r.integers(0, 12, 1500)] + 0.3 * r.normal(size=(1500, 24))
    x *= np.exp(scale * r.normal(size=(1500, 1)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = frame(spark, rows)
    got = A.nearest(df, df.where("vec_id % 20 = 0"), k=10).collect()
    assert len(got) == 75 * 10 and recall(got, rows, 10) >= 0.9


def test_ties_few_candidates_and_unusable_vectors(spark):
    rows = [(0, [1.0, 0.0]), (5, [0.5, 0.5]), (3, [0.5, 0.5]), (9, [float("nan"), 1.0]), (10, None), (11, [0.0, 0.0]), (12, [1.0, None]), (13, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (14, [float("inf"), 0.0]), (8, [-1.0, 0.0])]
    df = frame(spark, rows)
    got = [tuple(r) for r in A.nearest(df, df.where("vec_id = 0 OR vec_id >= 9"), k=4).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3, 0.5), (0, 2, 5, 0.5), (0, 3, 8, -1.0)]
    assert A.nearest(df, df.limit(0)).count() == 0 and A.nearest(df.limit(0), df).count() == 0


def test_many_copies_of_one_vector(spark, monkeypatch):
    monkeypatch.setattr(A, "CELL_ROWS", 64)
    rows = [(i, [0.6, 0.8, 0.0]) for i in range(700)] + [(1000 + i, [float(i % 7), 1.0, float(i % 5)]) for i in range(300)]
    df = frame(spark, rows)
    got = A.nearest(df, df.where("vec_id % 100 = 0"), k=5).collect()
    assert recall(got, rows, 5) >= 0.9


def test_chi_square_law():
    assert abs(A.chi_square(np.array(15.5073), 8) - 0.95) < 1e-4 and abs(A.stop_ratio(8, 0.95) - 15.5073) < 1e-3


def test_repeated_query_rows_are_one_query_and_ids_with_two_vectors_are_two(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=6).tolist()) for i in range(60)]
    plain = frame(spark, rows)
    want = [tuple(x) for x in A.nearest(plain, plain.where("vec_id = 20"), k=5).orderBy("rank").collect()]
    df = frame(spark, [*rows, rows[20], rows[20], rows[46]])
    got = [tuple(x) for x in A.nearest(df, df.where("vec_id = 20"), k=5).orderBy("rank", "vec_id").collect()]
    twice = [w for w in want for _ in range(2 if w[2] == 46 else 1)][:5]
    assert [g[2:] for g in got] == [w[2:] for w in twice] and [g[1] for g in got] == [1, 2, 3, 4, 5]
    other = [-x for x in rows[20][1]]
    two = frame(spark, [*rows, (20, other)])
    got = A.nearest(two, two.where("vec_id = 20"), k=5).collect()
    assert sorted(x["rank"] for x in got) == sorted([1, 2, 3, 4, 5] * 2) and not [x for x in got if x["vec_id"] == 20]


def test_a_cell_travels_once_per_block_of_its_own_queries(spark, monkeypatch):
    monkeypatch.setattr(A, "CELL_ROWS", 64)
    monkeypatch.setattr(A, "QUERY_ROWS", 8)
    r = np.random.default_rng(3)
    centres = 40 * r.normal(size=(8, 12))
    rows = [(i, (centres[i % 8] + r.normal(size=12)).tolist()) for i in range(800)]
    df = frame(spark, rows)
    for every in (40, 20):
        asked = df.where(f"vec_id % {every} = 0")
        got = A.nearest(df, asked, k=3)
        got_rows = got.collect()
        assert len(got_rows) == asked.count() * 3 and recall(got_rows, rows, 3) >= 0.9


def unit_vectors(n, size=16):
    x = np.random.default_rng(8).normal(size=(n, size))
    return [(i, v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1)[:, None])]


def test_steps_have_a_row_per_vector_or_query_and_none_is_broadcast_by_query(spark, monkeypatch):
    """Vectors without structure: nearly every query reaches every cell, which must not become a row each, nor a table to broadcast."""
    monkeypatch.setattr(A, "CELL_ROWS", 16)
    counts, plans, kept = {}, [], A.written

    def written(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        out = kept(df, name)
        counts[name] = out.count()
        return out
    monkeypatch.setattr(A, "written", written)
    rows = unit_vectors(1600)
    df = frame(spark, rows)
    got = A.nearest(df, df.where("vec_id % 20 = 0"), k=5)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert recall(got.collect(), rows, 5) >= 0.9
    assert len(counts) == 4 and max(counts.values()) <= 1600, counts
    assert not [p for p in plans if "BroadcastHashJoin [query#" in p]


def test_parts_blocks_and_walks_lose_nothing(spark, monkeypatch):
    for name, value in (("CELL_ROWS", 16), ("PART_ROWS", 40), ("QUERY_ROWS", 9), ("WALK_ROWS", 4)):
        monkeypatch.setattr(A, name, value)
    rows = unit_vectors(500) + [(1000 + i, unit_vectors(1)[0][1]) for i in range(120)]  # equal vectors fill parts of their own
    df, far = frame(spark, rows), frame(spark, [(5000 + i, [-3.0 * z for z in v]) for i, v in unit_vectors(30)])
    got = A.nearest(df, df.where("vec_id % 20 = 0"), k=20).collect()
    assert len(got) == 31 * 20 and recall(got, rows, 20) >= 0.9
    other = A.nearest(df, far, k=7).collect()
    x = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    best = {5000 + i: np.sort(x @ np.array(v, dtype=np.float32).astype(float) * -3)[::-1][:7] for i, v in unit_vectors(30)}
    assert len(other) == 30 * 7
    assert sum(abs(r["score"] - best[r["query_id"]][r["rank"] - 1]) < 1e-6 for r in other) >= 0.9 * len(other)


def test_parts_of_cells():
    assert A.parts_of([(0, 5), (2, 5), (3, 25), (7, 1), (8, 9), (9, 1)], 10) == [(0, 0, 1), (2, 0, 1), (3, 1, 3), (7, 4, 1), (8, 4, 1), (9, 5, 1)]


def test_components_in_double_precision_are_kept(spark):
    rows = [(0, [1.0, 0.0]), (1, [1 / 3, 1.0]), (2, [1 / 3 + 1e-12, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in A.nearest(df, df.where("vec_id = 0"), k=2).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 1 / 3 + 1e-12), (0, 2, 1, 1 / 3)]


def test_copies_of_one_vector_are_searched_a_bounded_number_at_a_time(monkeypatch):
    monkeypatch.setattr(A, "HITS", 1000, raising=False)
    seen, kept = [], A.top

    def top(q, ids, score, k):
        seen.append(len(q))
        return kept(q, ids, score, k)
    monkeypatch.setattr(A, "top", top)
    x, ids = np.tile([0.6, 0.8], (20_000, 1)), np.random.default_rng(4).permutation(20_000)
    points = A.lifted(x, 1.0) @ A.projection(2, 8)
    cell = A.Cell(ids, x, points)
    q, i, _ = cell.search(np.arange(30), x[:30], points[:30], np.full(30, -np.inf), 1.0 + 1e-9, 5, A.stop_ratio(8, 0.97))
    assert np.diff(cell.first).max() <= 2 * A.LEAF and cell.first[-1] == 20_000
    assert max(seen) <= 1000 + 30 * 2 * A.LEAF + 30 * 5
    assert [list(i[q == n]) for n in range(30)] == [[m for m in range(6) if m != n][:5] for n in range(30)]
