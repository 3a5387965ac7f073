import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandspark.llm.pieces import PieceModel, piece_digests
from strandspark.llm.q_pieces import vocabulary


@pytest.fixture(scope="module")
def m():
    return PieceModel(vocabulary())


def agrees(m, text):
    ids = m.library.encode(text, add_bos=True, add_eos=True)
    assert m.encode(text) == ids
    packed, decoded = m.encode_packed(text)
    assert packed == np.array(ids, "<u4").tobytes()
    assert decoded.decode() == m.library.decode(ids) == m.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "th", "the", "é", "▁", "😀", "\x00", "ñ", "ﬁ", "x" * 60, "ab" * 40, "<s>", "</s>", "<0x0A>", "⁇", "\ufffd", "\u0301", "\xa0", "\u2028"]), max_size=14).map("".join))
def test_same_as_library(m, text):
    agrees(m, text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(m, text):
    agrees(m, text.encode(errors="replace").decode())


def test_long_segments_use_the_heap(m):
    agrees(m, "internationalization" * 400)
    agrees(m, "ab" * 5000)


def test_full_table_is_cleared(m):
    small = PieceModel(vocabulary(), most_bytes=2000)
    for text in ("the cat sat on the mat and looked at it for a while", "entirely other words come here now, more than the table holds at once " * 3, "a \u2581 b"):
        assert small.encode(text) == m.library.encode(text, add_bos=True, add_eos=True)
        assert small.size == sum(map(small._bytes, small.table))
    assert len(small.table) < 20


def test_long_segments_are_not_kept(m):
    """Texts without a space of 20,000 characters; one comes twice."""
    small = PieceModel(vocabulary())
    for k in (1, 2, 2, 3):
        text = "xy" * 10_000 + str(k) + " end"
        assert small.encode(text) == m.library.encode(text, add_bos=True, add_eos=True)
        assert len(small.passing) == 1
    small.encode("end")
    assert small.passing == [] and all(len(s) < 10 for s in small.table) and small.size < 5000


def test_wrong_merge_is_noticed():
    bad = PieceModel(vocabulary())
    del bad.score["▁the"], bad.id["▁the"]
    with pytest.raises(AssertionError):
        bad.encode("the tall tower")


def test_documents(spark, docs, rows, no_docs, m):
    def want(x):
        ids = m.library.encode(x[1] or "", add_bos=True, add_eos=True)
        return x[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(m.library.decode(ids).encode()).hexdigest()

    assert sorted(map(tuple, piece_digests(docs, vocabulary()).collect()), key=str) == sorted(map(want, rows), key=str)
    assert piece_digests(no_docs, vocabulary()).collect() == []
