"""SentencePiece encoding and decoding by a Viterbi search over an Aho-Corasick automaton of the pieces.

The automaton reads a text once. At each character it reports, through its output links, every piece that
ends there, longest first; each one relaxes the best score of that position. The segmentation has the
largest sum of piece scores; of equal sums the longer last piece wins. A character that is no piece is
encoded as its UTF-8 bytes. No piece spans a line end or has a space after another character, so a text is
cut there and each distinct part is searched once per worker. Decoding restores every text exactly.

Rules for odd rows: null and empty texts have no ids and decode to the empty text; rows are encoded one by
one, so ids may be null or repeated; other columns are kept out of the way.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = re.compile(r"\n| *[^ \n]+| +")
# Distinct parts a worker remembers before it starts afresh.
REMEMBERED = 200_000


class Pieces:
    """The vocabulary of a model file, its automaton, and encoders in both directions."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        names = {i: model.id_to_piece(i).replace("▁", " ") for i in plain}
        scores = {i: float(model.get_score(i)) for i in plain}
        self.load(names, scores, {int(model.id_to_piece(i)[1:-1], 16): i for i in ids if model.is_byte(i)})

    def load(self, names: dict[int, str], scores: dict[int, float], byte_ids: dict[int, int]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, name in names.items():
            self.automaton.add_word(name, (len(name), scores[i], i))
        self.automaton.make_automaton()
        self.single = {name for name in names.values() if len(name) == 1}
        usual = [s for s in scores.values() if s > -1e8]
        self.unknown = min(usual, default=0.0) - 10.0
        self.byte_ids = byte_ids
        self.bytes_of = {i: name.encode() for i, name in names.items()} | {i: bytes([b]) for b, i in byte_ids.items()}
        self.memory = _Memory(self)

    def segment(self, part: str) -> list[int]:
        """The ids of one part, by one pass of the automaton."""
        size = len(part)
        best = [0.0] + [-1e300] * size
        back: list = [None] * (size + 1)
        at = 0  # positions up to here are final, but for pieces still to come
        odd, done = [k for k, c in enumerate(part) if c not in self.single], 0
        for last, (length, score, i) in self.automaton.iter(part):
            while done < len(odd) and odd[done] < last:
                self._unknown_at(odd[done], best, back)
                done += 1
            end = last + 1
            total = best[end - length] + score
            if total > best[end]:
                best[end], back[end] = total, (length, i)
        for k in odd[done:]:
            self._unknown_at(k, best, back)
        ids, at = [], size
        while at:
            length, i = back[at]
            ids.append((i, at - length))
            at -= length
        out: list[int] = []
        for i, start in reversed(ids):
            if i is None:
                out.extend(self.byte_ids[b] for b in part[start].encode())
            else:
                out.append(i)
        return out

    def _unknown_at(self, k: int, best: list, back: list) -> None:
        total = best[k] + self.unknown
        if total > best[k + 1]:
            best[k + 1], back[k + 1] = total, (1, None)

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        if not text:
            return b""
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        return b"".join(map(self.memory.__getitem__, PARTS.findall(" " + text)))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<i4").tolist()

    def decode(self, ids) -> str:
        """The text of a list of ids; ids that stand for no text are skipped."""
        joined = b"".join([self.bytes_of.get(i, b"") for i in ids])
        return joined[1:].decode(errors="replace") if joined[:1] == b" " else joined.decode(errors="replace")


class _Memory(dict):
    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces

    def __missing__(self, part: str) -> bytes:
        got = np.array(self.pieces.segment(part), "<i4").tobytes()
        if len(part) <= 64:
            self[part] = got
        return got


@lru_cache(2)
def pieces_of(model_file: str) -> Pieces:
    return Pieces(model_file)


def recode(text: Column, model_file: str) -> Column:
    """A struct of the ids of a text, their CRC-32 (as little-endian 32-bit integers), and the text they decode to.

    Both directions run in one pass: ids go from one to the other as bytes and are never Python numbers
    of more than one text.
    """
    @F.arrow_udf("ids array<int>, ids_crc32 bigint, decoded string")
    def both(texts: pa.Array) -> pa.Array:
        pieces = pieces_of(model_file)
        coded, back = [], []
        for t in texts:
            coded.append(pieces.encode_bytes(t.as_py()))
            back.append(pieces.decode(np.frombuffer(coded[-1], "<i4").tolist()))
        sums = pa.array([zlib.crc32(c) for c in coded], pa.int64())
        ends = pa.array(np.cumsum([0] + [len(c) // 4 for c in coded]).astype("i4"))
        ids = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(coded), "<i4")))
        return pa.StructArray.from_arrays([ids, sums, pa.array(back, pa.string())], ["ids", "ids_crc32", "decoded"])

    return both(text)
