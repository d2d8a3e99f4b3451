import re

import numpy as np
import pytest

from postsieve.llm import decontaminate as D

SCHEMA = "doc_id long, text string, item_id string, shared string"
ITEMS = "item_id long, text string, doc_id string"


def words(t):
    return [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]


def brute(docs, items, width, percent):
    out = []
    for d, t, *_ in docs:
        for i, s, *_ in items:
            n = min(width, len(words(s)))
            grams = lambda x: {tuple(x[j:j + n]) for j in range(len(x) - n + 1)}  # noqa: E731,B023
            if n:
                item = grams(words(s))
                both = len(item & grams(words(t)))
                if 100 * both >= percent * len(item):
                    out.append((d, i, len(item), both))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [D.MAX_ITEM_BYTES, 300])
def test_equals_brute_force_in_one_block_and_in_many(spark, limit):
    r = np.random.default_rng(2)
    fresh = lambda n: [f"W{x}" for x in r.integers(0, 300, n)]
    items = [(k, " ".join(fresh(int(r.integers(1, 60)))), "x") for k in range(30)] + [(90, "a b", "x"), (91, "", "x"), (92, None, "x"), (None, "only One item", "x"), (5, "same again and again here", "x"), (5, "same again and again here", "x")]
    docs = []
    for k in range(80):
        w = fresh(int(r.integers(0, 300)))
        part = words(items[k % 30][1])
        for at in r.integers(0, max(1, len(part)), k % 4):
            part[at] = "CHANGED"
        w[len(w) // 2:len(w) // 2] = part
        docs.append((k, " ".join(w).upper() if k % 2 else " ".join(w), "x", "y"))
    docs += [(200, "a b", "x", "y"), (201, "x A B y only one ITEM", "x", "y"), (202, "", "x", "y"), (203, None, "x", "y"), (None, "a b c", "x", "y"), (3, docs[3][1], "x", "y"),
             (204, " ".join(fresh(40_000)) + " " + items[0][1], "x", "y")]
    got = D.contaminated(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS), max_item_bytes=limit).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute(docs, items, 5, 80)


def test_a_block_is_done_before_the_next_is_taken(spark, monkeypatch):
    import gc
    import weakref

    class Block(list):
        pass
    seen, blocks, write = [], D.item_blocks, getattr(D, "written", None)

    def watched(*how):
        for block in blocks(*how):
            gc.collect()
            assert not [x for x in seen if x() is not None]
            block = [Block(block)]
            seen.append(weakref.ref(block[0]))
            yield block.pop()
            assert len(done) == len(seen)
    done = []
    monkeypatch.setattr(D, "item_blocks", watched)
    monkeypatch.setattr(D, "written", lambda *how: done.append(1) or write(*how), raising=False)
    docs = spark.createDataFrame([(k, f"one two three {k}", "x", "y") for k in range(6)], SCHEMA)
    items = spark.createDataFrame([(k, f"two three {k}", "z") for k in range(6)], ITEMS)
    got = D.contaminated(docs, items, max_item_bytes=40).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(k, k) for k in range(6)] and len(seen) == 6


def test_clean_keeps_columns_and_null_keys(spark):
    docs = spark.createDataFrame([(1, "one two three four five six", "x", "y"), (2, "fine", "x", "y"), (None, "one two three four five six", "x", "y")], SCHEMA)
    items = spark.createDataFrame([(7, "One two three four five", "z")], ITEMS)
    out = D.clean(docs, items)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == {2, None}


def test_nothing_on_either_side(spark):
    docs, items = spark.createDataFrame([(1, "a b", "x", "y")], SCHEMA), spark.createDataFrame([(1, "a b", "z")], ITEMS)
    assert D.contaminated(docs, items.limit(0)).count() == 0 and D.contaminated(docs.limit(0), items).count() == 0
