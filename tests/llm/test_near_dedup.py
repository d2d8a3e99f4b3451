import re

import numpy as np
import pyarrow as pa
import pytest

from postsieve.llm import near_dedup as N
from postsieve.llm.shared import components
from postsieve.llm.words import Words, shingle_sets

SCHEMA = "doc_id long, text string, n_shingles string, bucket string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets[i] = {tuple(w[j:j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                    low = min(comp[a], comp[b])
                    comp = {k: (low if v in (comp[a], comp[b]) else v) for k, v in comp.items()}
                    changed = True
    return sorted((i, len(sets[i]), comp[i], comp[i] == i) for i in sets)


def family(seed, copies, edits, n=120):
    r = np.random.default_rng(seed)
    base = [f"w{seed}x{x}" for x in r.integers(0, 400, n)]
    out = [" ".join(base)]
    for _ in range(copies):
        w = list(base)
        for at in r.integers(0, n, int(r.integers(0, edits))):
            w[at] = f"e{r.integers(0, 10 ** 9)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def rows():
    texts = family(1, 60, 22) + family(2, 12, 9) + family(3, 3, 3, 5000) + ["", None, "One", "one", "ONE two", "one Two", "  \n"]
    texts += [texts[0]] * 4 + ["Aa " * 9, "aa " * 30]
    order = np.random.default_rng(5).permutation(len(texts))
    return [(int(i) * 3 + 1, texts[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("width", [2, 5])
def test_equals_brute_force(spark, rows, width):
    got = N.near_duplicates(frame(spark, rows), width=width).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, width, 80)


def test_group_larger_than_a_block_is_joined_without_its_pairs(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    rows = list(enumerate(family(7, 150, 26)))
    assert sorted(tuple(r) for r in N.near_duplicates(frame(spark, rows), width=2).collect()) == brute(rows, 2, 80)


def test_nulls_repeated_rows_and_empty_tables(spark):
    rows = [(None, "a b c"), (4, "a b c"), (4, "a b c"), (2, "A b C"), (9, None)]
    got = sorted((tuple(r) for r in N.near_duplicates(frame(spark, rows), width=2).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (4, 2, 2, False), (4, 2, 2, False), (2, 2, 2, True), (9, 0, 9, True)], key=str)
    assert N.near_duplicates(frame(spark, []), width=2).count() == 0


def test_registers_merge_and_estimate():
    r = np.random.default_rng(3)
    pool = r.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[1000:])
    ra, rb, ru = N.registers_of([a, b, np.union1d(a, b)], 1024)
    assert (N.merge(ra, rb) == ru).all()
    best, _ = N.joint_estimate(ra[None], rb[None], np.array([2000.]), np.array([2000.]), 0.8)
    assert abs(best[0] - 1 / 3) < 0.06


def test_bound_never_rules_out_a_link():
    texts = family(11, 40, 20)
    sets = [set(s.tolist()) for s in shingle_sets(Words(pa.array(texts)), 2)]
    own = [len(s - set().union(*(t for j, t in enumerate(sets) if j != i))) for i, s in enumerate(sets)]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i < j and 100 * len(a & b) >= 80 * len(a | b):
                assert N.bounded(np.array([len(a)]), np.array([own[i]]), np.array([len(b)]), np.array([own[j]]), 80)[0]


def test_components_of_a_long_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, x) for x in range(200, 260)] + [(7, 7), (None, 3), (200, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 5: 5, **{x: 5 for x in range(200, 260)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_judges_rows_by_key_and_text(spark):
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(3, base), (5, base), (5, "a text that nobody else has in this table at all"), (7, base + " thirteen"), (3, base), (3, base), (None, base), (8, None), (8, None), (9, ""), (10, "x"), (11, "x")]
    df = frame(spark, rows)
    out = N.one_of_each(df, width=5)
    assert out.columns == df.columns
    want = [(3, base), (5, "a text that nobody else has in this table at all"), (None, base), (8, None), (9, ""), (10, "x")]
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(want, key=str)
    assert N.one_of_each(frame(spark, [])).count() == 0
    clash = df.withColumnRenamed("n_shingles", "mark").withColumnRenamed("bucket", "kept")
    assert N.one_of_each(clash, width=5).columns == clash.columns and N.one_of_each(clash, width=5).count() == 6
