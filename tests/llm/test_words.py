import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from changeloom.llm.words import ALNUM, GRAPHIC, LOWER, SAME, chunks, ngrams, ragged, words


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbZé9 \t\n\x0b_-", max_size=30)), max_size=8), st.integers(1, 40))
def test_words_are_those_of_bytes_split_and_equal_words_share_a_hash(texts, limit):
    got, hashes = [], {}
    for w in words(pa.array(texts, pa.string()), GRAPHIC, LOWER, limit):
        for k in range(len(w.first) - 1):
            own = [bytes(w.data[w.start[i] : w.end[i]]).lower() for i in range(w.first[k], w.first[k + 1])]
            got.append(own)
            for word, i in zip(own, range(w.first[k], w.first[k + 1]), strict=True):
                assert hashes.setdefault(word, w.hash[i]) == w.hash[i]
    assert got == [(t or "").encode().lower().split() for t in texts]
    assert len(set(hashes.values())) == len(hashes)


def test_many_words_have_distinct_hashes_wherever_they_stand():
    own = [f"w{k}x{k * k % 97}" for k in range(200_000)]
    found = [w.hash for w in words(pa.array([" ".join(own), *own[:1000]]), ALNUM, SAME)]
    assert len(np.unique(np.concatenate(found))) == len(own)


def test_ngrams_stay_within_documents():
    (w,) = words(pa.array(["a b c", "a b", "", "c a b c"]), GRAPHIC, SAME)
    found, inside = ngrams(w.hash, 3, w.first)
    assert inside.tolist() == [True, False, False, False, False, True, True]
    assert found[0] == found[6] != found[5]


def test_chunks_and_ragged():
    assert [row for row, _, _ in chunks(pa.array(["aa", "bb", None, "cccc"]), 4)] == [0, 3]
    assert ragged(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
