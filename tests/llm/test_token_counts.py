import numpy as np
import pytest

from postsieve.llm import token_counts as K
from postsieve.llm.queries import VOCABULARY

SCHEMA = "doc_id long, text string, source string, field string, start string"
TEXTS = ["one line", "two\nlines here", "\n\n  spaced \n\nout\n", "", None, "été naïve 日本語 text\nemoji 🙂🙂\n", "x" * 3000, "word " * 20_000, "a\n" * 500, "<|endoftext|> stays text"]


@pytest.mark.parametrize("rule", K.RULES)
def test_sections_sum_to_whole_documents_and_follow_the_rule(spark, rule):
    rows = [(i, t, s, "x", "y") for i, (t, s) in enumerate(zip(TEXTS, ["src", None, "a\nb"] * 4))] + [(0, TEXTS[0], "src", "x", "y"), (None, TEXTS[1], "", "x", "y")]
    got = K.count_tokens(spark.createDataFrame(rows, SCHEMA), VOCABULARY, fields=("source", "text"), rule=rule).collect()
    encoding, lengths = K.encoder(open(VOCABULARY, "rb").read(), K.PATTERN)
    for i, t, s, _, _ in rows[:len(TEXTS)]:
        mine = sorted((r for r in got if r["doc_id"] == i), key=lambda r: (["source", "text"].index(r["field"]), r["section"]))
        if i == 0:
            assert mine[::2] == mine[1::2]
            mine = mine[::2]
        whole = f"{s or ''}\n{t or ''}"
        ids = encoding.encode_ordinary(whole)
        assert sum(r["n_tokens"] for r in mine) == len(ids)
        for field, value in (("source", s or ""), ("text", t or "")):
            spans = [(r["start"], r["end"]) for r in mine if r["field"] == field]
            assert "".join(value[a:b] for a, b in spans) == value and [value[a:b] for a, b in spans] == (value.splitlines(keepends=True) if value else [""])
        # every token by itself
        sections = [v for x in (s or "", t or "") for v in (x.splitlines(keepends=True) or [""])]
        sections[len((s or "").splitlines() or [""]) - 1] += "\n"
        ends, want, at = np.cumsum([len(x.encode()) for x in sections]), [0] * len(sections), 0
        for token in ids:
            size = int(lengths[token])
            places = [int(np.searchsorted(ends, b, side="right")) for b in range(at, at + size)]
            want[places[0] if rule == "start" else places[-1] if rule == "end" else max(sorted(set(places)), key=places.count)] += 1
            at += size
        assert want == [r["n_tokens"] for r in mine]
    assert len([r for r in got if r["doc_id"] is None]) == 3


@pytest.mark.parametrize("blank", [" ", "\n", "\u3000", "\t ", "\r\n"])
def test_long_runs_of_blanks_are_encoded_as_the_encoder_does(monkeypatch, blank):
    ranks = open(VOCABULARY, "rb").read()
    encoding, _ = K.encoder(ranks, K.PATTERN)
    monkeypatch.setattr(K, "LONG_RUN", 5)
    for n in (3, 5, 6, 50, 400):
        run = blank * n
        for text in (run, "a" + run, run + "b", f"one{run}two {run}'s{run}9{run}\x1c{run}!{run}", f"x{run}\n{run}y{run} "):
            assert K.encode(text, ranks, K.PATTERN).tolist() == encoding.encode_ordinary(text)


def test_runs_of_millions(spark):
    n = 3_000_000
    rows = [(1, " " * n + "a"), (2, "!" * n), (3, "x" * n), (4, "b" + "\n " * 700_000)]
    got = K.count_tokens(spark.createDataFrame([(i, t, "", "x", "y") for i, t in rows], SCHEMA), VOCABULARY, fields=("text",))
    total = {r["doc_id"]: r["n"] for r in got.groupBy("doc_id").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    encoding, _ = K.encoder(open(VOCABULARY, "rb").read(), K.PATTERN)
    assert total[2] == len(encoding.encode_ordinary("!" * n)) and total[3] == len(encoding.encode_ordinary("x" * n))
    assert total[1] == len(K.encode(" " * n + "a", open(VOCABULARY, "rb").read(), K.PATTERN)) and set(total) == {1, 2, 3, 4}


def test_no_rows_and_a_wrong_rule(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert K.count_tokens(empty, VOCABULARY).count() == 0
    with pytest.raises(ValueError):
        K.count_tokens(empty, VOCABULARY, rule="half")
