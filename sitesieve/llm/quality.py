"""Quality by a generalised additive model with pairwise interactions, scored from lookup tables.

Every document becomes a few dozen numbers about its characters, words and lines. Each number is put into
one of at most 64 bins. Boosting goes round the features: in every round a shallow tree of one feature is
fitted to what the model still gets wrong, and added to the feature's table. Then the pairs of features that
explain most of the rest get two-dimensional tables the same way. A score is the sum of one entry per
table. The tables are the whole model.

Rules for odd rows: null and empty texts have all numbers 0 and are scored like any other; ids may be null or
repeated (each row is scored); other columns are not looked at. Without labelled rows of both kinds every
score is the share of good rows (0 without labels).
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import bounded_sample, checked_broadcast

# Labelled documents that a model is fitted on at most.
SAMPLE_ROWS = 20_000
BINS = 64
PAIR_BINS = 12
ROUNDS, RATE = 150, 0.1
PAIRS, PAIR_ROUNDS = 6, 40
LEAST_ROWS = 8

FEATURES = (
    "log_chars", "log_words", "mean_word", "upper_share", "digit_share", "symbol_share", "space_share",
    "non_ascii_share", "bar_share", "bang_share", "hash_share", "comma_share", "period_share", "log_lines",
    "mean_line", "repeated_lines", "repeated_words", "top_word", "repeated_pairs", "long_words", "short_words",
    "capital_words", "marked_words", "word_pieces",
)
_CLASSES = (
    ("upper_share", "upper"), ("digit_share", "digit"), ("symbol_share", "symbol"), ("space_share", "space"),
    ("bar_share", "|"), ("bang_share", "!"), ("hash_share", "#$%&*@^~<>{}[]\\"), ("comma_share", ","), ("period_share", "."),
)


def _byte_classes() -> np.ndarray:
    table = np.zeros((256, len(_CLASSES) + 1))
    for k, (_, kind) in enumerate(_CLASSES):
        for b in range(128):
            c = chr(b)
            table[b, k] = {
                "upper": c.isupper(), "digit": c.isdigit(), "space": c.isspace(),
                "symbol": not c.isalnum() and not c.isspace() and b >= 32,
            }.get(kind, c in kind)
    table[128:, -1] = 1
    return table


_TABLE = _byte_classes()


def features_of(text: str | None) -> list[float]:
    """The numbers of one text, in the order of FEATURES."""
    if not text:
        return [0.0] * len(FEATURES)
    data = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _TABLE / len(data)
    shares = dict(zip([n for n, _ in _CLASSES], counts[:-1]))
    words = text.split()
    n = max(len(words), 1)
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x]
    line_count = max(len(lines), 1)
    pairs = set(zip(words, words[1:]))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    marked = sum(v for w, v in seen.items() if not w[-1].isalnum() and w[-1] not in ".,;:")
    capital = sum(v for w, v in seen.items() if w.isupper())
    values = dict(
        log_chars=np.log1p(len(text)), log_words=np.log1p(len(words)), mean_word=float(sizes.mean()),
        non_ascii_share=counts[-1], log_lines=np.log1p(len(lines)), mean_line=np.log1p(len(text) / line_count),
        repeated_lines=1 - len(set(lines)) / line_count, repeated_words=1 - len(seen) / n,
        top_word=max(seen.values(), default=0) / n, repeated_pairs=1 - len(pairs) / max(len(words) - 1, 1) if len(words) > 1 else 0.0,
        long_words=float((sizes >= 12).mean()), short_words=float((sizes <= 2).mean()), capital_words=capital / n,
        marked_words=marked / n, word_pieces=len(re.findall(r"[^\W\d_]+", text)) / n, **shares,
    )
    return [float(values[name]) for name in FEATURES]


def bin_edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Inner edges at quantiles; fewer where values repeat."""
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def _leaf(gradient, hessian):
    return -gradient / (hessian + 1.0)


def _gain(gradient, hessian):
    return gradient * gradient / (hessian + 1.0)


def shallow_tree(gradient: np.ndarray, hessian: np.ndarray, count: np.ndarray, leaves: int = 3) -> np.ndarray:
    """The values per bin of the best tree of at most `leaves` leaves, splitting one leaf at a time."""
    values = np.zeros(len(gradient))
    parts = [(0, len(gradient))]
    sums = [np.concatenate([[0.0], np.cumsum(x)]) for x in (gradient, hessian, count)]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for lo, hi in parts:
            cut = np.arange(lo + 1, hi)
            left = [s[cut] - s[lo] for s in sums]
            right = [s[hi] - s[cut] for s in sums]
            gain = _gain(*left[:2]) + _gain(*right[:2]) - _gain(sums[0][hi] - sums[0][lo], sums[1][hi] - sums[1][lo])
            gain = np.where((left[2] >= LEAST_ROWS) & (right[2] >= LEAST_ROWS), gain, 0)
            if len(cut) and gain.max() > best[0]:
                best = (gain.max(), (lo, hi), int(cut[gain.argmax()]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    for lo, hi in parts:
        values[lo:hi] = _leaf(sums[0][hi] - sums[0][lo], sums[1][hi] - sums[1][lo])
    return values


def quadrant_tree(gradient: np.ndarray, hessian: np.ndarray) -> tuple[np.ndarray, float]:
    """Values per cell of the best split of a table into four quadrants, and its gain."""
    def corner(x):
        return np.cumsum(np.cumsum(x, axis=0), axis=1)

    g, h = corner(gradient), corner(hessian)
    cells = lambda s: (  # noqa: E731 - upper left, upper right, lower left, lower right of every inner cut
        s[:-1, :-1], s[:-1, -1:] - s[:-1, :-1], s[-1:, :-1] - s[:-1, :-1], s[-1, -1] - s[:-1, -1:] - s[-1:, :-1] + s[:-1, :-1]
    )
    if min(g.shape) < 2:
        return np.zeros_like(gradient), 0.0
    gs, hs = cells(g), cells(h)
    gain = sum(_gain(a, b) for a, b in zip(gs, hs)) - _gain(g[-1, -1], h[-1, -1])
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    leaf = [_leaf(a[i, j], b[i, j]) for a, b in zip(gs, hs)]
    values = np.empty_like(gradient)
    values[: i + 1, : j + 1], values[: i + 1, j + 1 :] = leaf[0], leaf[1]
    values[i + 1 :, : j + 1], values[i + 1 :, j + 1 :] = leaf[2], leaf[3]
    return values, float(gain[i, j])


class QualityModel:
    """Bin edges and lookup tables of the features and of pairs of them."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.tables, self.pair_tables = None, {}
        self.share = float(y.mean()) if len(y) else 0.0
        if not 0 < self.share < 1:
            return
        self.base = float(np.log(self.share / (1 - self.share)))
        self.edges = [bin_edges(c, BINS) for c in x.T]
        self.pair_edges = [bin_edges(c, PAIR_BINS) for c in x.T]
        bins = self._bins(x, self.edges)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        z = np.full(len(y), self.base)
        counts = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, self.tables)]
        for _ in range(ROUNDS):
            for k, table in enumerate(self.tables):
                p = 1 / (1 + np.exp(-z))
                step = RATE * shallow_tree(
                    np.bincount(bins[k], p - y, len(table)), np.bincount(bins[k], p * (1 - p), len(table)), counts[k]
                )
                table += step
                z += step[bins[k]]
        self._fit_pairs(self._bins(x, self.pair_edges), y, z)

    def _fit_pairs(self, bins, y, z) -> None:
        shape = lambda i, j: (len(self.pair_edges[i]) + 1, len(self.pair_edges[j]) + 1)

        def sums(i, j, p):
            a, b = shape(i, j)
            cell = bins[i] * b + bins[j]
            return cell, np.bincount(cell, p - y, a * b).reshape(a, b), np.bincount(cell, p * (1 - p), a * b).reshape(a, b)

        p = 1 / (1 + np.exp(-z))
        every = [(i, j) for i in range(len(bins)) for j in range(i + 1, len(bins))]
        gains = {ij: quadrant_tree(*sums(*ij, p)[1:])[1] for ij in every}
        chosen = sorted(every, key=lambda ij: (-gains[ij], ij))[:PAIRS]
        self.pair_tables = {ij: np.zeros(shape(*ij)) for ij in chosen}
        for _ in range(PAIR_ROUNDS):
            for ij, table in self.pair_tables.items():
                p = 1 / (1 + np.exp(-z))
                cell, g, h = sums(*ij, p)
                step = RATE * quadrant_tree(g, h)[0]
                table += step
                z += step.ravel()[cell]

    @staticmethod
    def _bins(x: np.ndarray, edges) -> list[np.ndarray]:
        return [np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of rows of features: one addition per table."""
        if self.tables is None:
            return np.full(len(x), self.share)
        z = np.full(len(x), self.base)
        for table, b in zip(self.tables, self._bins(x, self.edges)):
            z += table[b]
        bins = self._bins(x, self.pair_edges)
        for (i, j), table in self.pair_tables.items():
            z += table[bins[i], bins[j]]
        return 1 / (1 + np.exp(-z))


def _features(texts: list[str | None]) -> np.ndarray:
    return np.array([features_of(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


def fit_quality(documents: DataFrame, labels: DataFrame, usable: Column | None = None) -> QualityModel:
    """A model from at most SAMPLE_ROWS labelled rows; features are taken where the texts are."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    known = (known if usable is None else known.filter(usable)).select("doc_id", F.col("quality").cast("double").alias("y")).distinct()
    drawn = bounded_sample(known, F.col("doc_id"), SAMPLE_ROWS)
    texts = documents.select("doc_id", "text").join(checked_broadcast(drawn), "doc_id")

    def run(batches):
        for batch in batches:
            x = _features(batch.column(1).to_pylist())
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(2), flat], ["y", "x"])

    # labels whose id several documents share count for each of them; the bound still holds
    rows = bounded_sample(
        texts.select("doc_id", "text", "y").mapInArrow(run, "y double, x array<double>"), F.col("x"), SAMPLE_ROWS
    ).collect()
    x = np.array([r["x"] for r in rows], np.float64).reshape(len(rows), len(FEATURES))
    return QualityModel(x, np.array([r["y"] for r in rows]))


def quality(text: Column, model: QualityModel) -> Column:
    """The score of a text; the whole text counts."""
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(_features(texts.to_pylist())), pa.float64())

    return score(text)
