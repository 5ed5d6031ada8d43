"""Hashes of words and word shingles, for whole batches of texts at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[128:] = True
_IN_WORD[ord("0") : ord("9") + 1] = True
_IN_WORD[ord("a") : ord("z") + 1] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as the longest chunk needs."""

    def __init__(self):
        self.up = self.down = np.ones(1, U)

    def reach(self, size: int) -> None:
        if len(self.up) < size:
            for name, factor in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, factor, U)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))


_POWERS = _Powers()


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text.

    Words are runs of digits, ASCII letters (lower-cased) and non-ASCII bytes. A word's hash is a
    polynomial in its bytes, read off running sums over the chunk.
    """
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    inside = _IN_WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[::2], edges[1::2]
    _POWERS.reach(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * _POWERS.up[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _POWERS.down[starts] + (ends - starts).astype(U))
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    per_text = np.diff(np.searchsorted(starts, text_ends), prepend=0)
    return hashes, per_text


def shingle_sets(texts: list[bytes], width: int):
    """(elements, weights, text number) of each text's distinct shingles with their number of occurrences.

    A text of fewer words than `width`, but not none, has one shingle of all its words.
    """
    words, per_text = word_hashes(texts)
    elements, weights, sizes = [], [], []
    stop = 0
    # shingles over the whole chunk; those that cross a text's end are left out below
    rolled = np.zeros(max(len(words) - width + 1, 0), U)
    for k in range(width):
        rolled = mix(rolled * U(31) + words[k : k + len(rolled)]) if len(rolled) else rolled
    for n in per_text:
        start, stop = stop, stop + n
        if n >= width:
            got, times = np.unique(rolled[start : stop - width + 1], return_counts=True)
        elif n:
            short = np.zeros(1, U)
            for w in words[start:stop]:
                short = mix(short * U(31) + w)
            got, times = mix(short + U(n)), np.ones(1, np.int64)
        else:
            got, times = np.zeros(0, U), np.zeros(0, np.int64)
        elements.append(got)
        weights.append(times)
        sizes.append(len(got))
    return np.concatenate(elements), np.concatenate(weights), np.repeat(np.arange(len(texts)), sizes)


def chunks(texts: list[bytes], size: int = CHUNK_BYTES):
    """`texts` in consecutive pieces of about `size` bytes; a longer text is a piece of its own."""
    piece, held = [], 0
    for t in texts:
        if piece and held + len(t) > size:
            yield piece
            piece, held = [], 0
        piece.append(t)
        held += len(t)
    if piece:
        yield piece
