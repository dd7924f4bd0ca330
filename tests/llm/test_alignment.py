"""Token groups, links and counts of two vocabularies against a plain version over whole texts."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tickloom.llm import alignment

FIRST = public_tokenizers.path("byte_bpe_50k.json")
SECOND = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sides():
    one = Tokenizer.from_file(FIRST)
    one.encode_special_tokens = True
    letters = alignment.byte_of_letter()
    two = sentencepiece.SentencePieceProcessor(model_file=SECOND)

    def a(text):
        ids = one.encode(" " + text, add_special_tokens=False).ids
        return [(i, bytes(letters[c] for c in one.id_to_token(i))) for i in ids]

    def b(text):
        out = []
        for i in two.encode(text):
            piece = two.id_to_piece(i)
            out.append((i, bytes([int(piece[3:5], 16)]) if two.is_byte(i) else piece.replace("▁", " ").encode()))
        return out

    return a, b


def plain(rows, sides):
    kept, holders = [], Counter()
    for doc_id, text in rows:
        a, b = (side(text) for side in sides) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if b"".join(t for _, t in a) != whole or b"".join(t for _, t in b) != whole:
            a, b = [], []
        spans = []
        for tokens in (a, b):
            at, own = 0, []
            for i, t in tokens:
                own.append((at, at + len(t), i))
                at += len(t)
            spans.append(own)
        links, j = [], 0
        for s, e, i in spans[0]:
            while j < len(spans[1]) and spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((i, spans[1][k][2]))
                k += 1
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        sets, at = [], [0, 0]
        for cut in cuts:
            both = []
            for side, own in enumerate(spans):
                ids = []
                while at[side] < len(own) and own[at[side]][1] <= cut:
                    ids.append(str(own[at[side]][2]))
                    at[side] += 1
                both.append(",".join(ids))
            sets.append("|".join(both))
        kept.append((doc_id, len(a), len(b), cuts, links, ";".join(sets)))
        holders.update(set(links))
    most = {}
    for (i, _), n in holders.items():
        most[i] = max(n, most.get(i, 0))
    out = Counter()
    for doc_id, n_a, n_b, cuts, links, text in kept:
        best = sum(holders[pair] == most[pair[0]] for pair in links)
        total = sum(holders[pair] for pair in links)
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        out[(doc_id, n_a, n_b, len(cuts), len(links), best, total, digest)] += 1
    return out


ODD = [
    "", " ", "  ", " a", "a ", "a  ", "\n", "a\n\n b\t c", "a  b　 c  d\u0085 e", "x\x1c y\x1f z", "▁ a▁b c", "😀 \U0010ffff é",
    "<|endoftext|> and </s><unk>", "don't  won't\r\n 12345 ...!!! ", "word" * 3_000, "a" * 30_000, "= " * 3_000, " " * 3_000, "\x00 a\x00",
    "à côté é été", "the the the", "the the the",
]


def test_query(spark, documents, odd, none, sides):
    odd_texts = spark.createDataFrame(list(enumerate(ODD)), "doc_id bigint, text string")
    every = documents.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(odd_texts)
    for docs in (every, odd):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        found = alignment.align(docs, FIRST, SECOND)
        assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert Counter(map(tuple, found.collect())) == plain(rows, sides)
    assert alignment.align(none, FIRST, SECOND).count() == 0
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert {tuple(r)[1:] for r in alignment.align(empty, FIRST, SECOND).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_many_parts(spark, documents, sides, monkeypatch):
    """Counts are over all parts of all tasks."""
    real = alignment._match_parts

    def small(first, second):
        run = real(first, second)

        def small_parts(batches):
            alignment.PART = 3_000
            yield from run(batches)

        return small_parts

    monkeypatch.setattr(alignment, "_match_parts", small)
    docs = documents.select("doc_id", "text").repartition(5)
    rows = [tuple(r) for r in docs.collect()]
    assert Counter(map(tuple, alignment.align(docs, FIRST, SECOND).collect())) == plain(rows, sides)


@given(st.lists(st.integers(1, 5), min_size=1), st.lists(st.integers(1, 5), min_size=1))
def test_pointer_doubling(one, two):
    if sum(one) != sum(two):
        (one if sum(one) < sum(two) else two).append(abs(sum(one) - sum(two)))
    ends = [np.cumsum(one), np.cumsum(two)]
    cuts = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
    for own, group in zip(ends, alignment.groups(*ends)):
        assert group.tolist() == np.searchsorted(cuts, own).tolist()


def test_units_hold_the_texts():
    import pyarrow as pa

    data, start, end, text = alignment._units(pa.array([*ODD, None]))
    whole = [b"" for _ in [*ODD, None]]
    for s, e, t in zip(start, end, text):
        whole[t] += data[s:e].tobytes()
    assert whole == [(" " + t).encode() if t else b"" for t in [*ODD, None]]
