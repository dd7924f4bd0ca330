import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from llm import brute
from tickloom.llm import words as W
from tickloom.llm.fm_index import FMIndex

TEXT = st.one_of(st.none(), st.text(alphabet="aB1 \t\n\x0b.é😀_", max_size=30))


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=8), st.booleans())
def test_words_of_texts(texts, plain):
    found = W.split(pa.array(texts, pa.string()), W.PLAIN if plain else W.BLANK, fold=plain)
    data = found.data.tobytes()
    for i, text in enumerate(texts):
        want = brute.plain_words(text) if plain else brute.blank_words(text)
        span = range(found.first[i], found.first[i + 1])
        assert [data[found.start[k] : found.end[k]].decode() for k in span] == want
    everything = {}
    for k, h in enumerate(found.hash.tolist()):
        word = data[found.start[k] : found.end[k]]
        assert everything.setdefault(h, word) == word
    assert len(set(everything.values())) == len(everything)


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6), st.integers(1, 5))
def test_grams(texts, size):
    hashes, edges = W.grams(W.split(pa.array(texts, pa.string()), W.BLANK, fold=True), size)
    for i, text in enumerate(texts):
        assert len(set(hashes[edges[i] : edges[i + 1]].tolist())) == len(brute.shingles(text, size))


@settings(max_examples=100, deadline=None)
@given(
    st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=30), min_size=1, max_size=6),
    st.lists(st.lists(st.integers(0, 4), max_size=30), min_size=1, max_size=6),
    st.integers(2, 7),
)
def test_windows_of_streamed_texts(indexed, streamed, window):
    def laid(lists):
        return (
            np.array([x for own in lists for x in own], np.uint64),
            np.concatenate([[0], np.cumsum([len(own) for own in lists])]).astype(np.int64),
        )

    owner = np.arange(len(indexed)) * 10
    index = FMIndex(*laid(indexed), owner, window)
    words, edges = laid(streamed)
    found = index.windows(words, edges)
    for i, own in enumerate(streamed):
        for at in range(len(own)):
            wanted = [
                o
                for o, other in zip(owner, indexed)
                if len(own) - at >= window
                and any(other[k : k + window] == own[at : at + window] for k in range(len(other) - window + 1))
            ]
            cls = found[edges[i] + at]
            assert (cls >= 0) == bool(wanted)
            if wanted:
                assert index.least_owner[cls] == min(wanted)
