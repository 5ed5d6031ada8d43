"""Toxicity by compression distance: two zstandard dictionaries, one trained on toxic text, one on ordinary text.

A text is cut at white space into windows of a few words. Each window is compressed with either dictionary;
how many bytes the toxic one saves over the ordinary one is the window's distance. Toxic documents are mostly
ordinary text, so two dictionaries trained on all of it would differ by chance more than by kind: each
dictionary holds what was trained on the words that its kind uses far more often, and what was trained on ordinary
text, at the same places. A document's largest distances, their means, and the shares of windows above thresholds
set on ordinary documents are calibrated to a probability on labelled rows no dictionary was trained on.

Rules for odd rows: null and empty texts have no windows and get the score of a document without any
distance; ids may be null or repeated (each row is scored); other columns are not looked at. Without
labelled rows of both kinds every score is the share of toxic rows (0 without labels).
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import bounded_sample, checked_broadcast

# Labelled documents that a model is fitted on at most, of either kind, and the longest of them in bytes.
SAMPLE_ROWS = 3000
SAMPLE_BYTES = 32_768
WINDOW = 40
# Bytes of the part that both dictionaries share, and of the part of their own.
SHARED, OWN = 16_384, 6144
# A word counts as a kind's own from this ratio of document shares on, if as many documents of the kind have it and
# chance gives such a split once in a thousand words (a chi-square of one degree of freedom).
LEAST_RATIO, LEAST_DOCUMENTS, LEAST_EVIDENCE = 4, 4, 10.83
LEVEL = 12
TOP = 5


def windows_of(text: str | None) -> list[bytes]:
    """Consecutive windows of about WINDOW bytes, cut at white space where there is some."""
    data = (text or "").lower().encode("utf-8", "replace")
    out, at = [], 0
    while at < len(data):
        end = at + WINDOW
        if end < len(data):
            space = data.find(b" ", end, end + WINDOW)
            end = space if space >= 0 else end
        out.append(data[at:end])
        at = end
    return out


class Compressors:
    """The two dictionaries, ready to compress."""

    def __init__(self, shared: bytes, toxic: bytes, ordinary: bytes):
        import zstandard

        size = max(len(toxic), len(ordinary))
        self.two = []
        for own in (toxic, ordinary):
            # the own part stands inside the content, behind the tables at the start
            content = shared[: -len(shared) // 2] + own.rjust(size, b"\0") + shared[-len(shared) // 2 :]
            dictionary = zstandard.ZstdCompressionDict(content)
            dictionary.precompute_compress(level=LEVEL)
            self.two.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False
            ).compress)

    def distances(self, windows: list[bytes]) -> np.ndarray:
        toxic, ordinary = self.two
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows], np.float64)


def features_of(distances: np.ndarray, thresholds) -> list[float]:
    """The TOP largest distances, means, and number and share of the windows that reach each threshold."""
    top = np.zeros(TOP)
    if not len(distances):
        distances = np.zeros(1)
    largest = np.sort(distances)[::-1][:TOP]
    top[: len(largest)] = np.maximum(largest, 0)
    above = [(distances >= t).mean() for t in thresholds]
    counts = [np.log1p((distances >= t).sum()) for t in thresholds]
    means = [distances.mean(), np.maximum(distances, 0).mean(), np.maximum(-distances, 0).mean()]
    return [float(v) for v in (*top, *means, *above, *counts, np.log1p(len(distances)))]


def _train(samples: list[bytes], size: int) -> bytes:
    import zstandard

    held = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(size, max(512, held // 2)), samples, k=32, d=6, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        # too little to train on: the samples themselves serve as the dictionary
        return b"".join(samples)[-size:] or b"\0" * 8


def bare(word: bytes) -> bytes:
    return word.strip(b".,;:!?")


def own_words(mine: list[list[bytes]], others: list[list[bytes]]) -> list[bytes]:
    """The words that documents of `mine` use far more often than those of `others`, those with most evidence last.

    What counts is the ratio of the shares of documents that have a word, and that the difference is no chance. A
    wrong label or a quotation lowers the ratio of a word a little; no single document removes it.
    """
    used, usual = (
        Counter(w for windows in documents for w in {bare(w) for x in windows for w in x.split()}) for documents in (mine, others)
    )
    share = len(mine) / (len(mine) + len(others))

    def evidence(n: int, m: int) -> float:
        if n < LEAST_DOCUMENTS or (n + 0.5) / (len(mine) + 1) < LEAST_RATIO * (m + 0.5) / (len(others) + 1):
            return 0.0
        # twice the logarithm of the likelihood ratio of the word's split against that of the documents
        total = n + m
        return 2 * float(n * np.log(n / total / share) + (m and m * np.log(m / total / (1 - share))))

    found = sorted((evidence(n, usual[w]), w) for w, n in used.items() if w)
    return [w for e, w in found if e >= LEAST_EVIDENCE]


def own_part(mine: list[list[bytes]], words: list[bytes]) -> bytes:
    """What the dictionary of `mine` holds of its own: trained on its own words, and those that training left out."""
    if not words:
        return _train([w for windows in mine for w in windows], OWN)
    known = set(words)
    samples = (b" ".join(bare(w) for x in windows for w in x.split() if bare(w) in known) for windows in mine)
    trained = _train([b" " + x + b" " for x in samples if x], OWN)
    missing = b"".join(b" " + w for w in words if w not in trained)[-OWN // 2 :]
    return (trained + missing + b" ")[-OWN:]


def without_copies(texts: list[str], kinds: list[int]) -> list[int]:
    """Places of the texts that are no near copies of earlier ones of their kind: groups of copies would pass for a kind's
    language. A text with a near copy of the other kind stays: what tells the two apart is what is to be learned."""
    runs = [_runs(text) for text in texts]
    repeated = np.zeros(len(texts), np.int64)
    for kind in set(kinds):
        mine = [k for k, other in enumerate(kinds) if other == kind]
        owner = np.repeat(np.array(mine, np.int32), [len(runs[k]) for k in mine])
        every = np.concatenate([runs[k] for k in mine])
        # by the leading bits of a run, so that little is sorted at once
        part = (every >> np.uint32(28)).astype(np.uint8)
        for high in range(16):
            here = np.flatnonzero(part == high)
            # texts come in order, so the first place of a run is its first text; all later ones repeat it
            _, first = np.unique(every[here], return_index=True)
            later = np.ones(len(here), bool)
            later[first] = False
            repeated += np.bincount(owner[here[later]], minlength=len(texts))
    return [k for k in range(len(texts)) if repeated[k] <= len(runs[k]) // 2]


def _runs(text: str) -> np.ndarray:
    """Checksums of the distinct runs of three words, ascending."""
    words = text.split()
    return np.unique(np.fromiter(
        (zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "replace")) for i in range(max(len(words) - 2, 1))), np.uint32
    ))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights (constant first) of a ridge logistic regression, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class ToxicityModel:
    """Fitted dictionaries, thresholds and calibration; small enough to travel with every task."""

    def __init__(self, texts: list[str], toxic: list[int], share: float):
        """`share` of all labelled rows is toxic; the texts are balanced and get weights to match."""
        self.share, self.weights = share, None
        single = without_copies(texts, toxic)
        texts, y = [texts[k] for k in single], np.array([toxic[k] for k in single])
        if not len(y) or y.min() == y.max():
            return
        windows = [windows_of(t) for t in texts]
        part = np.arange(len(y)) % 2 == 0
        kinds = [[windows[k] for k in np.flatnonzero(part & (y == kind))] for kind in (0, 1)]
        if not any(kinds[0]) or not any(kinds[1]):
            return
        toxic_words, ordinary_words = own_words(kinds[1], kinds[0]), own_words(kinds[0], kinds[1])
        # toxic words in ordinary documents (wrong labels, quotations) must not reach what both compress with
        known = set(toxic_words)
        plain = [[b" ".join(w for w in x.split(b" ") if bare(w) not in known) for x in d] for d in kinds[0]]
        self.dictionaries = (
            _train([x for d in plain for x in d], SHARED), own_part(kinds[1], toxic_words), own_part(plain, ordinary_words),
        )
        machine = Compressors(*self.dictionaries)
        usual = np.concatenate([machine.distances(windows[k]) for k in np.flatnonzero(~part & (y == 0))] or [np.zeros(1)])
        self.thresholds = sorted({*(float(np.quantile(usual, q)) for q in (0.9, 0.99, 0.999)), 2.0, 4.0}) if len(usual) else [2.0, 4.0]
        x = np.array([features_of(machine.distances(windows[k]), self.thresholds) for k in np.flatnonzero(~part)])
        target = y[~part]
        if target.min() == target.max():
            return
        self.centre, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        self.weights = fit_logistic((x - self.centre) / self.scale, target)
        # the sample holds as many of either kind: back to the share among all labelled rows
        sampled = target.mean()
        self.weights[0] += np.log(share / (1 - share)) - np.log(sampled / (1 - sampled))

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.share)
        machine = Compressors(*self.dictionaries)
        x = np.array([features_of(machine.distances(windows_of(t)), self.thresholds) for t in texts])
        x = x.reshape(len(texts), len(self.centre))
        z = self.weights[0] + ((x - self.centre) / self.scale) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_toxicity(documents: DataFrame, labels: DataFrame, usable: Column | None = None) -> ToxicityModel:
    """A model from a bounded sample of labelled rows: SAMPLE_ROWS of either kind, texts of SAMPLE_BYTES at most.

    `usable` (over columns of `labels`) leaves out rows that nothing may be learned from.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = (known if usable is None else known.filter(usable)).select("doc_id", "toxic").distinct()
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    rows = []
    # the sample is drawn before texts are fetched, with a reserve for labels without a fitting text
    for kind in counts:
        drawn = bounded_sample(known.filter(F.col("toxic") == kind), F.col("doc_id"), 2 * SAMPLE_ROWS)
        texts = documents.filter(F.octet_length("text") <= SAMPLE_BYTES).select("doc_id", "text").join(
            checked_broadcast(drawn), "doc_id"
        )
        rows += bounded_sample(texts, F.col("doc_id"), SAMPLE_ROWS).select("text", "toxic").collect()
    rows.sort(key=lambda r: (r["toxic"], r["text"]))
    return ToxicityModel([r["text"] for r in rows], [r["toxic"] for r in rows], counts.get(1, 0) / total if total else 0.0)


def toxicity(text: Column, model: ToxicityModel) -> Column:
    """The score of a text; the whole text counts."""
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(texts.to_pylist()), pa.float64())

    return score(text)
