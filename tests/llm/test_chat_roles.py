import itertools

import numpy as np
import pytest

from postsieve.llm import chat_roles as C

SCHEMA = "conv_id long, turn long, role string, text string, pos string, piece string"


def cheapest(roles, costs):
    """Cost of the best repair by trying every edit of every turn: relabel to each role, merge or open, and any insertions."""
    ins, best = C.insertions(costs["insert"]), np.inf
    for labels in itertools.product((1, 2, 3), repeat=len(roles)):
        for merges in itertools.product((False, True), repeat=len(roles)):
            state, cost = C.START, 0.0
            for r, b, m in zip(roles, labels, merges):
                cost += 0 if r == b else costs["relabel"]
                if m:
                    cost += costs["merge"] if state == b else np.inf
                else:
                    cost += min(ins[state, s] for s in range(4) if b in C.LEGAL[s])
                state = b
            best = min(best, cost + ins[state, C.ASSISTANT])
    return best


def paid(rows, costs):
    return sum(costs["insert"] * (r["action"] == "insert") + costs["merge"] * ("merge" in r["action"]) + costs["relabel"] * ("relabel" in r["action"]) for r in rows)


def legal(roles):
    return bool(roles) and all(b in C.LEGAL[a] for a, b in zip([C.START] + roles[:-1], roles)) and roles[-1] == C.ASSISTANT


def outcome(df):
    by = {}
    for r in sorted(df.collect(), key=lambda r: r["pos"]):
        by.setdefault(r["conv_id"], []).append(r)
    return by


@pytest.mark.parametrize("costs", [C.COSTS, {"merge": 3.0, "relabel": 1.0, "insert": 1.5}])
@pytest.mark.parametrize("chunk", [C.CHUNK, 2])
def test_repairs_are_legal_and_cheapest_whatever_the_chunks(spark, monkeypatch, costs, chunk):
    monkeypatch.setattr(C, "CHUNK", chunk)
    r = np.random.default_rng(4)
    names = ["system", " User", "ASSISTANT", "tool", None]
    convs = {i: [int(x) for x in r.integers(0, 5, int(r.integers(1, 5)))] for i in range(40)}
    rows = [(i, t, names[k], f"text {i} {t}", "x", "y") for i, ks in convs.items() for t, k in enumerate(ks)]
    got = outcome(C.repair(spark.createDataFrame(rows[::-1], SCHEMA), costs=costs))
    for i, ks in convs.items():
        turns = [C.ROLES.index(x["role"]) + 1 for x in got[i] if "merge" not in x["action"]]
        assert legal(turns), (i, got[i])
        assert [x["turn"] for x in got[i] if x["action"] != "insert"] == list(range(len(ks)))
        assert abs(paid(got[i], costs) - cheapest([k + 1 if k < 3 else 0 for k in ks], costs)) < 1e-9
        text = "".join(x["piece"] for x in got[i])
        assert text.count("<|end|>") == len(turns) and text.endswith("<|end|>\n") and text.startswith("<|")
        opened = [line[2:-2] for line in text.split("\n") if line.startswith("<|") and line != "<|end|>"]
        assert opened == [C.ROLES[s - 1] for s in turns]
        assert all(f"text {i} {t}" in text for t in range(len(ks)))


def test_a_long_conversation_spans_chunks(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 64)
    rows = [(1, t, "user" if t % 3 else "assistant", "x" * (20_000 if t == 5 else 3), "a", "b") for t in range(700)]
    got = outcome(C.repair(spark.createDataFrame(rows, SCHEMA)))[1]
    assert legal([C.ROLES.index(x["role"]) + 1 for x in got if "merge" not in x["action"]]) and len({x["pos"] for x in got}) == len(got)


def test_nulls_ties_repeats_and_nothing(spark):
    rows = [(None, 0, "user", None, "a", "b"), (None, 0, "user", None, "a", "b"), (2, None, "assistant", "late", "a", "b"), (2, 1, "user", "", "a", "b")]
    got = outcome(C.repair(spark.createDataFrame(rows, SCHEMA)))
    assert [x["action"] for x in got[None]] == ["keep", "merge", "insert"]
    assert [(x["turn"], x["role"]) for x in got[2]][-1][1] == "assistant" and len([x for x in got[2] if x["action"] != "insert"]) == 2
    assert C.repair(spark.createDataFrame([], SCHEMA)).count() == 0
