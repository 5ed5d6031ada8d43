"""Metrics against brute force on random votes, with ties, rare labels and empty classes."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitesieve.operators import binary, confusion, multiclass, prcurve
from sitesieve.operators import votes as V


def plurality(labels):
    return Counter(labels).most_common(1)[0][0]


def clear(labels):
    top = Counter(labels).most_common(2)
    return len(top) < 2 or top[0][1] > top[1][1]


def brute_metrics(real, pred):
    """(population, metric, label) -> value, from the definitions."""
    universe = sorted({x for r in real for x in r} | set(pred))
    pops = {
        "all": [i for i, r in enumerate(real) if clear(r)],
        "unanimous": [i for i, r in enumerate(real) if len(set(r)) == 1],
        "controversial": [i for i, r in enumerate(real) if clear(r) and len(set(r)) > 1],
    }
    out = {}
    for name, rows in pops.items():
        truth, guess = [plurality(real[i]) for i in rows], [pred[i] for i in rows]
        f1, support = {}, Counter(truth)
        for c in universe:
            tp = sum(t == g == c for t, g in zip(truth, guess))
            denominator = truth.count(c) + guess.count(c)
            f1[c] = 2 * tp / denominator if denominator else 0.0
            out[name, "f1", c] = f1[c]
        out[name, "macro_f1", None] = sum(f1.values()) / len(universe)
        out[name, "weighted_f1", None] = sum(f1[c] * support[c] for c in universe) / len(rows) if rows else 0.0
        out[name, "accuracy", None] = sum(t == g for t, g in zip(truth, guess)) / len(rows) if rows else None
    contr = [i for i, r in enumerate(real) if len(set(r)) > 1]
    out["all", "included", None] = sum(p in r for p, r in zip(pred, real)) / len(real)
    out["controversial", "included", None] = (
        sum(pred[i] in real[i] for i in contr) / len(contr) if contr else None
    )
    return out


def frames(spark, real, pred):
    long = [(f"p{i}", j, x) for i, r in enumerate(real) for j, x in enumerate(r)]
    random.Random(1).shuffle(long)
    votes = spark.createDataFrame(long, "visit_id string, vote_ord bigint, label string")
    lists = spark.createDataFrame([(f"p{i}", r) for i, r in enumerate(real)], "visit_id string, labels array<string>")
    preds = spark.createDataFrame([(f"p{i}", p) for i, p in enumerate(pred)], "visit_id string, predicted_label string")
    return votes, lists, preds


def cases():
    rng = random.Random(7)
    for size, alphabet in ((60, "ABC"), (40, "ABCDE")):
        real = [[rng.choice(alphabet) for _ in range(rng.randint(1, 5))] for _ in range(size)]
        pred = [rng.choice(alphabet + "Z") for _ in range(size)]
        yield real, pred
    yield [["A"], ["A", "A"]], ["A", "B"]                # nothing controversial
    yield [["A", "B"], ["B", "A"]], ["A", "C"]           # only ties


@pytest.mark.parametrize("real,pred", list(cases()))
def test_multiclass_metrics(spark, real, pred):
    votes, lists, preds = frames(spark, real, pred)
    expected = brute_metrics(real, pred)
    for form in (votes, lists):
        got = {
            (r["population"], r["metric"], r["label"]): r["value"]
            for r in multiclass.evaluate_multiclass(form, preds).collect()
        }
        assert set(got) == set(expected)
        for key, value in expected.items():
            assert got[key] == pytest.approx(value), key


def test_comparison_pairs_metrics(spark):
    (real, pred), *_ = cases()
    other = pred[::-1]
    votes, _, preds = frames(spark, real, pred)
    _, _, preds2 = frames(spark, real, other)
    one, two = brute_metrics(real, pred), brute_metrics(real, other)
    rows = multiclass.compare_multiclass(votes, preds, preds2).collect()
    assert len(rows) == len(one)
    for r in rows:
        key = (r["population"], r["metric"], r["label"])
        assert (r["first"], r["second"]) == pytest.approx((one[key], two[key]))
        assert r["delta"] == pytest.approx(two[key] - one[key])
    summary = multiclass.compare_multiclass(votes, preds, preds2, details=False)
    assert summary.filter("metric = 'f1'").isEmpty()
    ordered = multiclass.report_order(multiclass.compare_multiclass(votes, preds, preds2)).collect()
    change = [abs(r["delta"]) for r in ordered if r["population"] == "all" and r["metric"] == "f1"]
    assert change == sorted(change, reverse=True)


def test_null_labels_are_a_vote_of_their_own(spark):
    votes = spark.createDataFrame(
        [("a", 0, None), ("a", 1, None), ("a", 2, "X"), ("b", 0, "X"), ("b", 1, None)],
        "visit_id string, vote_ord bigint, label string",
    )
    got = {r["visit_id"]: (r["top_label"], r["has_majority"], r["n_labels"]) for r in V.summarise_pages(votes).collect()}
    assert got == {"a": (None, True, 2), "b": ("X", False, 2)}
    lists = {r["visit_id"]: r["labels"] for r in V.fold_votes(votes).collect()}
    assert lists == {"a": [None, None, "X"], "b": ["X", None]}


def test_fold_and_unfold(spark):
    lists = spark.createDataFrame([("a", ["x", None, "x"]), ("b", ["y"])], "visit_id string, labels array<string>")
    assert {r["visit_id"]: r["labels"] for r in V.fold_votes(V.unfold_votes(lists)).collect()} == {
        "a": ["x", None, "x"], "b": ["y"]}


def test_ignored_labels(spark):
    lists = spark.createDataFrame(
        [("a", ["Skip", "x"]), ("b", ["Skip"]), ("c", [None, "Skip"])], "visit_id string, labels array<string>")
    kept = {r["visit_id"]: r["labels"] for r in V.drop_ignored_from_lists(lists, ["Skip"]).collect()}
    assert kept == {"a": ["x"], "c": [None]}
    assert V.drop_ignored(V.unfold_votes(lists), ["Skip"]).count() == 2


def test_misaligned_keys_are_found(spark):
    a = spark.createDataFrame([("x",), ("y",), ("y",)], "visit_id string")
    b = spark.createDataFrame([("x",), ("y",), ("z",)], "visit_id string")
    got = {tuple(r) for r in V.misaligned(a, b).collect()}
    assert got == {("y", 2, 1), ("z", 0, 1)}
    with pytest.raises(ValueError):
        V.require_aligned(a, b)


def brute_binary(real, pred):
    out = {}
    for name in ("all", "unanimous", "controversial"):
        tp = fp = fn = 0
        for votes, p in zip(real, pred):
            pos, n = sum(votes), len(votes)
            unanimous = pos in (0, n)
            if 2 * pos == n or (name == "unanimous" and not unanimous) or (name == "controversial" and unanimous):
                continue
            truth = 2 * pos > n
            tp, fp, fn = tp + (p and truth), fp + (p and not truth), fn + (not p and truth)
        nan = float("nan")
        if tp + fp == 0:
            values = (nan, nan, nan)
        else:
            values = (tp / (tp + fp), tp / (tp + fn) if tp + fn else None, 2 * tp / (2 * tp + fp + fn))
        out.update({(name, m): v for m, v in zip(("precision", "recall", "f1"), values)})
    return out


def binary_frames(spark, real, score, threshold=0.5):
    votes = spark.createDataFrame(
        [(f"p{i}", j, y) for i, r in enumerate(real) for j, y in enumerate(r)],
        "visit_id string, vote_ord bigint, y int")
    preds = spark.createDataFrame([(f"p{i}", s) for i, s in enumerate(score)], "visit_id string, prediction double")
    return votes, preds.withColumn("decision", F.col("prediction") > threshold)


@pytest.mark.parametrize("threshold", [0.5, 2.0])
def test_binary_metrics(spark, threshold):
    rng = random.Random(3)
    real = [[rng.randint(0, 1) for _ in range(rng.randint(1, 4))] for _ in range(50)]
    score = [rng.choice([0.1, 0.4, 0.6, 0.9]) for _ in real]
    votes, preds = binary_frames(spark, real, score, threshold)
    expected = brute_binary(real, [s > threshold for s in score])
    got = {(r["population"], r["metric"]): r["value"] for r in binary.evaluate_binary(votes, preds).collect()}
    assert set(got) == set(expected)
    for key, value in expected.items():
        if value is not None and math.isnan(value):
            assert math.isnan(got[key])
        else:
            assert got[key] == pytest.approx(value)


def test_binary_confusion_resolves_ties_by_first_vote(spark):
    votes, preds = binary_frames(spark, [[1, 0], [0, 1], [1], [0, 0, 1]], [0.9, 0.9, 0.1, 0.1])
    assert binary.confusion_binary(votes, preds).first().asDict() == {"tn": 1, "fp": 1, "fn": 1, "tp": 1}


def test_encode_binary_votes(spark):
    lists = spark.createDataFrame([("a", ["Yes", "No"]), ("b", ["Yes"])], "visit_id string, labels array<string>")
    got = sorted(tuple(r) for r in binary.encode_binary_votes(lists).collect())
    assert got == [("a", 0, 1), ("a", 1, 0), ("b", 0, 1)]
    with pytest.raises(ValueError):
        binary.encode_binary_votes(lists.filter("visit_id = 'b'"))


def brute_curve(pairs):
    total = sum(y for _, y in pairs)
    points = []
    for t in sorted({s for s, _ in pairs}, reverse=True):
        chosen = [y for s, y in pairs if s >= t]
        points.append((t, sum(chosen) / len(chosen), sum(chosen) / total if total else 1.0))
    return points


def brute_summary(points):
    previous, area = (1.0, 0.0), 0.0
    for _, p, r in points:
        area += (r - previous[1]) * (p + previous[0]) / 2
        previous = (p, r)
    f1 = [(2 * p * r / (p + r), -t, t, p, r) for t, p, r in points if p + r > 0]
    best = max(f1)
    return (area, best[0], best[2], best[3], best[4])


@pytest.mark.parametrize("rows_per_range", [500_000, 3])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pr_curve(spark, monkeypatch, rows_per_range, seed):
    """The curve does not depend on how many score ranges it is built from."""
    monkeypatch.setattr(prcurve, "ROWS_PER_RANGE", rows_per_range)
    rng = random.Random(seed)
    real = [[rng.randint(0, 1) for _ in range(rng.randint(1, 3))] for _ in range(80)]
    score = [round(rng.random(), 1 if seed == 1 else 3) for _ in real]
    votes, preds = binary_frames(spark, real, score)
    pairs = [(s, int(2 * sum(v) > len(v))) for s, v in zip(score, real) if 2 * sum(v) != len(v)]
    expected = brute_curve(pairs)
    got = prcurve.pr_curve(votes, preds).orderBy(F.desc_nulls_last("threshold")).collect()
    assert [x for r in got[:-1] for x in r] == pytest.approx([x for r in expected for x in r])
    assert tuple(got[-1]) == (None, 1.0, 0.0)
    assert tuple(prcurve.pr_summary(votes, preds).first()) == pytest.approx(brute_summary(expected))


def test_pr_area_uses_the_end_point(spark):
    scored = spark.createDataFrame([(0.9, 0), (0.9, 1), (0.5, 1), (0.1, 0)], "score double, y int")
    assert prcurve.summary_of(scored).first()["auc_pr"] == pytest.approx(2 / 3, abs=1e-4)


def test_pr_without_positive_pages(spark):
    scored = spark.createDataFrame([(0.9, 0), (0.5, 0)], "score double, y int")
    row = prcurve.summary_of(scored).first()
    assert row["auc_pr"] == pytest.approx(0.5) and row["best_f1"] == 0.0 and row["threshold"] == 0.5


def test_confusion_table(spark):
    real = [["A"], ["A"], ["A", "B"], ["B"], ["C"]]
    pred = ["A", "B", "A", "Z", "C"]
    votes, _, preds = frames(spark, real, pred)
    table = confusion.confusion_table(votes, preds)
    cells = {(r["true_label"], r["predicted_label"]): (r["n"], r["percent"]) for r in table.collect()}
    assert len(cells) == 9
    assert cells["A", "A"] == (2, pytest.approx(200 / 3)) and cells["A", "B"] == (1, pytest.approx(100 / 3))
    assert all(cells["B", p] == (0, 0.0) for p in "ABC")   # its only prediction is no true label
    ranks = {r["true_label"]: r["true_rank"] for r in table.collect()}
    assert ranks == {"A": 1, "B": 2, "C": 3}
    wide = confusion.confusion_matrix(table, ["A", "B", "C"]).collect()
    assert [r["true_label"] for r in wide] == ["A", "B", "C"] and wide[2]["C"] == 100.0
