"""Periodic runs of words, found by recursive frequency splitting and a scan of lags.

A run is a stretch of consecutive words with smallest period q (words q apart are the same) of at least
max(`shortest`, 2 q) words that no neighbouring word extends with period q. Every word of a run occurs in it at least
twice. So a word that occurs once in a segment lies in no run there and splits it; the parts are counted and split
again until nothing changes, and parts shorter than a run can be are left out. A part that keeps nearly all words of its
segment is not split further: the scan is exact on any segment, so this bounds the work and changes no result.

The scan of a segment compares it with itself. Short lags are compared in full. A run of a longer period q repeats
every block of its first period, and among q words there is a whole block of b words at a multiple of b if
2 b <= q < 4 b: so, for each b, only blocks at multiples of b are compared, by numbers that stand for equal blocks, with
those 2 b to 4 b words behind. That is n comparisons twice for each doubling of b, so n log n for a segment of n words, however
long. What agrees is extended both ways to its full stretch.

Splitting counts the words of a whole Arrow batch in one go; a document never leaves its row.

Rules for odd rows: a null, empty or blank text has no words and no runs; repeated rows get the same result; long texts
are taken whole; other columns stay as they are, and an output name that they have makes an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SHORTEST = 12
# Lags up to this one are compared in full.
SHORT_LAGS = 15
# A part that lost less than one word in so many is scanned as it is.
PAYS = 64
# Words of whole rows that are split together, about; they bound the memory of a task beside its batch.
WORDS_AT_ONCE = 1 << 19
# Comparisons held in memory at a time.
CELLS = 1 << 22

RESULT = "struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def split_segments(
    ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, shortest: int = SHORTEST
) -> tuple[np.ndarray, np.ndarray]:
    """Parts of the segments [start, end) of `ids` that may hold runs; all segments are split in the same rounds."""
    kinds = int(ids.max()) + 1 if len(ids) else 1
    long = ends - starts >= shortest
    starts, ends = starts[long], ends[long]
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(starts):
        lengths = ends - starts
        offsets = np.cumsum(lengths) - lengths
        segment = np.repeat(np.arange(len(starts)), lengths)
        place = np.arange(len(segment)) + np.repeat(starts - offsets, lengths)
        _, inverse, count = np.unique(segment * kinds + ids[place], return_inverse=True, return_counts=True)
        kept = count[inverse] > 1
        edge = np.empty(len(kept) + 1, bool)  # whether a segment begins here
        edge[:-1] = False
        edge[offsets] = True
        edge[-1] = True
        first = kept & (edge[:-1] | ~np.concatenate(([False], kept[:-1])))
        last = kept & (edge[1:] | ~np.concatenate((kept[1:], [False])))
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        parent = segment[a]
        size = b - a
        enough = size >= shortest
        stays = enough & ((lengths[parent] - size) * PAYS < lengths[parent])
        done.append((place[a[stays]], place[a[stays]] + size[stays]))
        again = enough & ~stays
        starts = place[a[again]]
        ends = starts + size[again]
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([s for s, _ in done]), np.concatenate([e for _, e in done])


def _agreeing(left: np.ndarray, right: np.ndarray) -> int:
    """How many entries two arrays of the same length agree in from the front."""
    at, step = 0, 64
    while at < len(left):
        differ = left[at : at + step] != right[at : at + step]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + len(differ), step * 2
    return len(left)


def lag_runs(words: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a segment, by start, then period."""
    n = len(words)
    found: dict[tuple[int, int], int] = {}  # (start, end) -> smallest period, as shorter lags come first
    for q in range(1, min(SHORT_LAGS, n // 2) + 1):
        breaks = np.concatenate(([-1], np.flatnonzero(words[:-q] != words[q:]), [n - q]))
        length = np.diff(breaks) - 1 + q
        for k in np.flatnonzero(length >= max(shortest, 2 * q)).tolist():
            start = int(breaks[k]) + 1
            found.setdefault((start, start + int(length[k])), q)

    block, names = 1, np.unique(words, return_inverse=True)[1].astype(np.int64)
    while 4 * block <= n:
        # names[i] stands for the words from i on, as many as the block has
        if 2 * block > SHORT_LAGS:
            _scan_blocks(words, names, block, found, shortest)
        if len(names) <= block:
            break
        pairs = names[:-block] * (int(names.max()) + 1) + names[block:]
        names, block = np.unique(pairs, return_inverse=True)[1].astype(np.int64), 2 * block
    return sorted((start, end - start, q) for (start, end), q in found.items())


def _scan_blocks(words, names, block, found, shortest) -> None:
    """Add the runs with periods from 2 to 4 blocks (4 not included) to `found`."""
    n, width = len(words), 2 * block
    behind = np.concatenate((names, np.full(2 * width, -1)))
    anchors = np.arange(0, len(names), block)
    anchors = anchors[anchors + width < len(names)]
    at_once = max(1, CELLS // width)
    longer = [(s, e, p) for (s, e), p in found.items() if e - s >= width + block]
    reached: dict[int, int] = {}  # lag -> end of the last stretch
    for chunk in range(0, len(anchors), at_once):
        here = anchors[chunk : chunk + at_once]
        windows = np.lib.stride_tricks.sliding_window_view(behind, width)[here + width]
        row, lag = np.nonzero(windows == names[here][:, None])
        at, lag = here[row], lag + width
        fits = lag <= n // 2
        at, lag = at[fits], lag[fits]
        for start, end, period in longer:  # multiples of a period that is known already
            if not len(at):
                break
            new = (at < start) | (at + lag + block > end) | (lag % period != 0)
            at, lag = at[new], lag[new]
        order = np.lexsort((at, lag))
        for i, q in zip(at[order].tolist(), lag[order].tolist()):
            if i < reached.get(q, 0):
                continue
            back = _agreeing(words[:i][::-1], words[q : i + q][::-1])
            ahead = _agreeing(words[i : n - q], words[i + q :])
            reached[q] = i + ahead
            start, end = i - back, i + ahead + q
            if end - start >= max(shortest, 2 * q):
                found.setdefault((start, end), q)


def runs_of_lists(lists: pa.ListArray, shortest: int = SHORTEST) -> tuple[np.ndarray, list[tuple[int, int, int]], pa.Array]:
    """Rows, runs of those rows, and the words of every row without the repeats, joined by one space."""
    lists = pa.array(lists.to_pylist(), lists.type) if lists.null_count else lists
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    coded = flat.cast(pa.string()).dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    starts, ends = split_segments(ids, offsets[:-1], offsets[1:], shortest)
    rows: list[int] = []
    runs: list[tuple[int, int, int]] = []
    repeated = np.zeros(len(ids) + 1, np.int64)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    for at in np.argsort(starts, kind="stable").tolist():
        s, e, row = int(starts[at]), int(ends[at]), int(owner[at])
        for start, length, period in lag_runs(ids[s:e], shortest):
            rows.append(row)
            runs.append((s + start - int(offsets[row]), length, period))
            repeated[s + start + period] += 1
            repeated[s + start + length] -= 1
    kept = np.cumsum(repeated[:-1]) == 0
    left = np.concatenate(([0], np.cumsum(kept)))[offsets].astype(np.int32)
    words = flat.filter(pa.array(kept))
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left), words.cast(pa.string())), " ")
    return np.array(rows, np.int64), runs, collapsed


def find_runs(words: Column, shortest: int = SHORTEST) -> Column:
    """Of a list of words: its `runs` (start, length, period) by start, then period, and `collapsed`, the words
    that no run holds after its first period, joined by one space."""

    def results(lists: pa.ListArray) -> pa.StructArray:
        rows, runs, collapsed = runs_of_lists(lists, shortest)
        counts = np.bincount(rows, minlength=len(lists)) if len(rows) else np.zeros(len(lists), np.int64)
        offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        table = np.array(runs, np.int64).reshape(-1, 3)
        entries = pa.StructArray.from_arrays([pa.array(table[:, k]) for k in range(3)], names=["start", "length", "period"])
        nested = pa.ListArray.from_arrays(pa.array(offsets), entries)
        return pa.StructArray.from_arrays([nested, collapsed], names=["runs", "collapsed"])

    @F.arrow_udf(RESULT)
    def column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            if isinstance(lists, pa.ChunkedArray):
                lists = lists.combine_chunks()
            seen = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            share = seen // WORDS_AT_ONCE
            bounds = [0, *(np.flatnonzero(share[1:] != share[:-1]) + 1).tolist(), len(lists)]
            yield pa.concat_arrays([results(lists.slice(a, b - a)) for a, b in zip(bounds, bounds[1:])])

    return column(words)


def periodic_runs(documents: DataFrame, text_column: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """`documents` with `runs` and `collapsed`, the text without its repeats."""
    clash = {"runs", "collapsed"} & {c.lower() for c in documents.columns}
    if clash:
        raise ValueError(f"columns in the way: {sorted(clash)}")
    found = find_runs(words_of(F.col(text_column)), shortest)
    return documents.select("*", found.alias("runs_of_text")).select(*documents.columns, "runs_of_text.runs", "runs_of_text.collapsed")
