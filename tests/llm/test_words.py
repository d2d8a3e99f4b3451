import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from postsieve.llm.words import WORD, Words, pieces, shingle_sets

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="aB \t\n\x0bé z", max_size=40), st.text(max_size=30)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_words_are_those_of_the_pattern(texts):
    words = Words(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        got = [words.word(i).decode() for i in range(words.first[k], words.first[k + 1])]
        assert got == re.findall(WORD, t or "")


@settings(max_examples=100, deadline=None)
@given(TEXT, st.integers(1, 4))
def test_windows_agree_exactly_where_words_agree(texts, width):
    words = Words(pa.array(texts, pa.string()))
    grams, at = words.windows(words.hashes(), width)
    spelled = [tuple(words.word(i + j) for j in range(width)) for i in at]
    owner = words.text_of(at)
    expected = [tuple(w[i:i + width]) for w in ([x.encode() for x in re.findall(WORD, t or "")] for t in texts) for i in range(len(w) - width + 1)]
    assert spelled == expected and list(owner) == sorted(owner)
    assert len(set(grams.tolist())) == len(set(spelled))


def test_long_words_hash_by_all_their_bytes():
    words = Words(pa.array(["a" * 50_001 + " " + "a" * 50_000 + "b " + "a" * 50_001]))
    h = words.hashes()
    assert h[0] == h[2] != h[1]


def test_short_texts_are_one_shingle_and_blank_ones_none():
    sets = shingle_sets(Words(pa.array(["one", "one two", "", None, " \n", "one two one two one"]), lower=True), 3)
    assert [len(s) for s in sets] == [1, 1, 0, 0, 0, 2]


def test_pieces_cut_by_bytes_and_keep_every_row():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 70, None, "y" * 50, "z"] * 5})
    parts = list(pieces([batch, batch.slice(0, 0)], "text", limit=100))
    assert sum(p.num_rows for p in parts) == 20 and len(parts) > 3
    assert np.concatenate([p.column(0).to_pylist() for p in parts]).tolist() == batch.column(0).to_pylist()
