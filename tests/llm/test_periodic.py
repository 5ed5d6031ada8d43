"""Periodic runs: the scan against all lags by definition, and the query against brute force on a whole table."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitesieve.llm import periodic, queries

SMALL = "/root/testdata/sf0.001"


def plain_runs(words, shortest=12):
    """All runs, every lag compared in full; a longer lag with the same stretch is not its smallest period."""
    code = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.array([code[w] for w in words], np.int64)
    n, found = len(ids), {}
    for q in range(1, n // 2 + 1):
        same = np.concatenate(([False], ids[:-q] == ids[q:], [False])).astype(np.int8)
        change = np.diff(same)
        for s, e in zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist()):
            if e - s + q >= max(shortest, 2 * q):
                found.setdefault((s, e + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_collapse(words, runs):
    gone = set()
    for s, n, q in runs:
        gone.update(range(s + q, s + n))
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(text, doc_id):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, words):
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *head, digest(lines), digest(plain_collapse(words, runs)))


def test_query_is_brute_force_on_a_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, queries.op11_periodic(spark, SMALL).collect()))
    assert got == sorted(expected(r["doc_id"], planted(r["text"], r["doc_id"])) for r in docs)
    assert sum(r[1] > 0 for r in got) >= len(docs) // 20


def random_words(rng, n):
    """Words with repeats of all kinds: few letters, squares of squares, runs that touch, runs inside runs."""
    kind = rng.integers(6)
    if kind == 0:
        return rng.integers(0, 2, n)
    if kind == 1:
        return rng.integers(0, 40, n)
    words = rng.integers(0, 1000, n)
    for _ in range(rng.integers(1, 6)):
        s, p = int(rng.integers(0, n)), int(rng.integers(1, max(2, n // 2)))
        for i in range(s + p, min(n, s + p * int(rng.integers(2, 6)) + int(rng.integers(0, p + 1)))):
            words[i] = words[i - p]
    return words


def test_scan_is_brute_force_on_random_words():
    rng = np.random.default_rng(3)
    for round_no in range(300):
        words = random_words(rng, int(rng.integers(1, 400)))
        assert periodic.lag_runs(words) == plain_runs(words.tolist()), (round_no, words.tolist())


def test_splitting_loses_no_run():
    rng = np.random.default_rng(4)
    for _ in range(150):
        lists = [random_words(rng, int(rng.integers(1, 300))) if rng.integers(8) else np.zeros(0, np.int64) for _ in range(5)]
        ids, sizes = np.concatenate(lists), [len(x) for x in lists]
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        starts, ends = periodic.split_segments(ids, bounds[:-1], bounds[1:])
        got = [[] for _ in lists]
        for s, e in zip(starts.tolist(), ends.tolist()):
            at = int(np.searchsorted(bounds, s, side="right")) - 1
            got[at] += [(s + a - int(bounds[at]), n, q) for a, n, q in periodic.lag_runs(ids[s:e])]
        assert [sorted(r) for r in got] == [plain_runs(x.tolist()) for x in lists]


def test_one_word_for_a_million_places_and_long_periods_stay_cheap():
    assert periodic.lag_runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    rng = np.random.default_rng(5)
    block = rng.integers(0, 30, 70_001)
    words = np.concatenate((block, block, block[:500]))
    found = [(s, n) for s, n, q in periodic.lag_runs(words) if q == 70_001]
    assert len(found) == 1 and found[0][0] == 0 and found[0][1] >= 140_502


def test_rare_words_end_segments():
    words = np.array([1, 2] * 8 + [9] + [3, 4, 5] * 5 + [8] + [6] * 11)
    starts, ends = periodic.split_segments(words, np.array([0]), np.array([len(words)]))
    assert sorted(zip(starts.tolist(), ends.tolist())) == [(0, 16), (17, 32)]


def test_odd_rows(spark):
    rows = [(1, None, "k"), (2, "", "k"), (3, " \t\n ", "k"), (None, "x " * 30, "k"), (4, "a b " * 6, None), (4, "a b " * 6, None),
            (5, "solo", "k"), (6, "p q r " * 5000, "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, words string")
    got = periodic.periodic_runs(docs)
    assert got.columns == ["doc_id", "text", "words", "runs", "collapsed"]
    by_text = {r["text"]: ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in got.collect()}
    assert by_text[None] == by_text[""] == by_text[" \t\n "] == ([], "")
    assert by_text["x " * 30] == ([(0, 30, 1)], "x") and by_text["a b " * 6] == ([(0, 12, 2)], "a b")
    assert by_text["solo"] == ([], "solo") and by_text["p q r " * 5000] == ([(0, 15000, 3)], "p q r")
    assert periodic.periodic_runs(docs.filter("doc_id = 99")).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs.withColumn("Runs", F.lit(1)))


def test_null_ids_are_left_as_they_are(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g h i j k l m n")], "doc_id bigint, text string")
    words = docs.select(queries.with_planted_repeats(periodic.words_of(F.col("text")), F.col("doc_id")).alias("w"))
    assert words.first()["w"] == list("abcdefghijklmn")
