"""Token counts of the compiled transducer against the library that the model is made for."""

from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(library, texts):
    found = token_counts.transducer(PATH).counts(pa.array(texts, pa.string())).tolist()
    assert found == [len(library.encode(text or "")) for text in texts]


def test_odd_texts(library):
    long_words = ["a" * 20_000, "ab" * 9_000, "=-" * 5_000 + " " * 3_000 + "z", "tion" * 5_000, "漢字" * 4_000]
    runs = [" " * k for k in range(100)] + [" " * k + "the" for k in range(100)] + ["x" + " " * k + "\x00" for k in range(50)]
    marks = ["▁", " ▁ a▁b", "<s> </s><unk><0x41>", "a\x00b​\U0010ffff", "\r\n\t\v\f 　", "é", "😀😀 é"]
    same(library, [None, "", *long_words, *runs, *marks])


def test_chunks_and_starting_again(library, monkeypatch):
    """Short chunks without a run before them: every state is first guessed wrong and then added."""
    texts = ["internationalisation " * 20, "aaaa" * 100, "the cat\nsat  on the mat", "x" * 5]
    for chunk, before in ((1, 0), (3, 0), (7, 2), (64, 24)):
        monkeypatch.setattr(token_counts, "CHUNK", chunk)
        monkeypatch.setattr(token_counts, "BEFORE", before)
        same(library, texts)
    monkeypatch.setattr(token_counts, "STATES", 10)
    same(library, texts)
    same(library, texts[::-1])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("abehinorst  _▁=\n'é漢0😀"), max_size=300), max_size=8), st.text())
def test_any_texts(texts, other):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    same(library, [*texts, other])


def test_query(spark, documents, odd, none, library):
    for docs in (documents, odd):
        found = token_counts.count_tokens(docs, PATH, 100).collect()
        want = []
        for row in docs.collect():
            n = len(library.encode(row.text or ""))
            want.append((row.doc_id, len((row.text or "").encode()), n, n > 100))
        assert Counter(map(tuple, found)) == Counter(want)
    assert token_counts.count_tokens(none, PATH).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        token_counts.transducer(public_tokenizers.path("byte_bpe_50k.json"))
    for scores in ({"a▁": -1.0}, {"▁▁": 1.0, "ab": 0.0}):
        with pytest.raises(ValueError):
            token_counts.Transducer(scores)
