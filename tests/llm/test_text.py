"""Array kernels against plain Python."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fixtura.llm.text import code_points, letter_stream, pieces, words

TEXTS = st.lists(st.text(alphabet="ab cÉé.\n\t漢", max_size=30), max_size=6)


def _gaps(points):
    return (points == 32) | ((points >= 9) & (points <= 13))


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_follow_the_texts(texts):
    points, starts = code_points(texts)
    hashes, own = words(points, starts, _gaps(points))
    expected = [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    assert own.tolist() == [i for i, _ in expected]
    named = {}
    for h, (_, w) in zip(hashes.tolist(), expected):
        assert named.setdefault(w, h) == h
    assert len(set(named.values())) == len(named)


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_letter_stream_keeps_letters_and_single_spaces(texts):
    points, starts = letter_stream(texts)
    got = ["".join(map(chr, points[a:b])) for a, b in zip(starts[:-1], starts[1:])]
    assert got == [re.sub(r"[^a-zé漢]+", " ", f" {t.lower()} ") for t in texts]


def test_pieces_keep_order_and_read_none_as_empty():
    texts = ["a" * 7, None, "b" * 3, "", "c" * 20, "d"]
    assert [t for run in pieces(texts, 8) for t in run] == [t or "" for t in texts]
    assert list(pieces([])) == []
    assert words(*code_points([]), np.zeros(0, bool))[0].size == 0
