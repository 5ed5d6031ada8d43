"""Piece coding against an exhaustive search, and exact round trips."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitesieve.llm.pieces import Pieces, pieces_of
from sitesieve.llm.queries import model_path


@pytest.fixture(scope="module")
def pieces():
    return pieces_of(model_path("piece_bpe_32k.model"))


def best_sum(scores, unknown, text):
    """The largest sum of scores over all ways to cut `text`, by trying every piece at every end."""
    best = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            score = scores.get(text[start:end], unknown if end - start == 1 else None)
            if score is not None:
                best[end] = max(best[end], best[start] + score)
    return best[-1]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text("abc ", min_size=1, max_size=4), st.integers(-9, -1), max_size=12), st.text("abcd ", max_size=14))
def test_segmentation_has_the_largest_sum(vocabulary, text):
    vocabulary = vocabulary or {"a": -1}
    own = Pieces.__new__(Pieces)
    names = dict(enumerate(vocabulary))
    own.load(names, {i: float(vocabulary[n]) for i, n in names.items()}, {b: 1000 + b for b in range(256)})
    ids = own.segment(text) if text else []
    got = sum(own.unknown if i >= 1000 else vocabulary[names[i]] for i in ids)
    assert b"".join(own.bytes_of[i] for i in ids).decode() == text
    assert got == pytest.approx(best_sum(vocabulary, own.unknown, text) if text else 0.0)


def test_cut_parts_give_the_sum_of_the_whole(pieces):
    text = " the  quick   brown\nfox\n\n jumps over 12,345 lazy dogs"
    scores = {pieces.bytes_of[i].decode(): s for i, (_, s, i) in ((v[2], v) for _, v in pieces.automaton.items())}
    total = sum(scores.get(pieces.bytes_of[i].decode(errors="replace"), pieces.unknown) for i in pieces.encode(text))
    assert total == pytest.approx(best_sum(scores, pieces.unknown, " " + text))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    own = pieces_of(model_path("piece_bpe_32k.model"))
    assert own.decode(own.encode(text)) == text


@pytest.mark.parametrize("text", ["", " ", "  a", "▁ a▁", "\n", "a\n \nb", "<s></s><0x41>", "日本語 текст 🙂", "x" * 5000])
def test_round_trip_of_odd_texts(pieces, text):
    assert pieces.decode(pieces.encode(text)) == text


def test_null_has_no_ids(pieces):
    assert pieces.encode(None) == [] and pieces.decode([]) == ""
