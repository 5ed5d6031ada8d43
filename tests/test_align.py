"""Sets that have to hold the same pages: errors with the page's name, counts without another pass."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from sitesieve.operators import align, binary, confusion, ensemble, multiclass, prcurve

VOTES = [("a", 0, "X"), ("a", 1, "Y"), ("a", 2, "X"), ("b", 0, "Y"), ("c", 0, "X")]
PREDICTED = [("a", "X"), ("b", "X"), ("c", "X")]


def frames(spark, left_out=None, added=None):
    votes = spark.createDataFrame(VOTES, "visit_id string, vote_ord bigint, label string")
    rows = [r for r in PREDICTED if r[0] != left_out] + ([added] if added else [])
    predictions = spark.createDataFrame(rows, "visit_id string, predicted_label string")
    return votes, predictions


def reports(votes, predictions, other):
    lists = votes.groupBy("visit_id").agg(F.collect_list("label").alias("labels"))
    ones = votes.select("visit_id", "vote_ord", (F.col("label") == "X").cast("int").alias("y"))
    decided = predictions.select("visit_id", (F.col("predicted_label") == "X").alias("decision"), F.lit(0.5).alias("prediction"))
    return {
        "multiclass": multiclass.evaluate_multiclass(votes, predictions),
        "lists": multiclass.evaluate_multiclass(lists, predictions),
        "pair": multiclass.compare_multiclass(votes, other, predictions),
        "inclusion": multiclass.inclusion_rates(votes, predictions),
        "confusion": confusion.confusion_table(votes, predictions),
        "binary": binary.evaluate_binary(ones, decided),
        "curve": prcurve.scored_pages(ones, decided),
        "combine": ensemble.combine_predictions([other, predictions, other]),
    }


def test_same_pages_give_reports(spark):
    votes, predictions = frames(spark)
    for name, report in reports(votes, predictions, predictions).items():
        assert report.collect(), name


@pytest.mark.parametrize("case", [{"left_out": "b"}, {"added": ("d", "X")}, {"added": ("a", "Y")}, {"added": (None, "X")}])
def test_a_page_of_one_side_only_or_twice_is_named(spark, case):
    votes, predictions = frames(spark, **case)
    page = case.get("left_out") or case["added"][0] or "null"
    twice = case.get("added") == ("a", "Y")
    for name, report in reports(votes, predictions, frames(spark)[1]).items():
        if twice and name in ("confusion", "curve"):
            continue  # a page's second prediction is a second row there
        try:
            report.collect()
        except PySparkException as error:
            assert f"page {page}" in str(error), name
        else:
            pytest.fail(f"{name} does not look at page {page}")


def test_pages_without_votes_in_their_list_are_known_but_not_judged(spark):
    lists = spark.createDataFrame([("a", ["X"]), ("b", []), ("c", None)], "visit_id string, labels array<string>")
    judged = multiclass.judged_pages(lists, {"m": frames(spark)[1]}).collect()
    assert [(r["visit_id"], r["model"], r["included"]) for r in judged] == [("a", "m", True)]


def test_counts_come_with_the_join(spark, tmp_path):
    left = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4)], "visit_id string, x int")
    right = spark.createDataFrame([("c", 5), ("a", 6), ("z", 7)], "visit_id string, y int")
    left.write.parquet(str(tmp_path / "l"))
    right.write.parquet(str(tmp_path / "r"))
    seen = Observation()
    joined = align.counted(spark.read.parquet(str(tmp_path / "l")), spark.read.parquet(str(tmp_path / "r")), seen)
    assert joined._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 2
    assert {tuple(r) for r in joined.collect()} == {("a", 1, 6), ("c", 3, 5)}
    got = seen.get
    assert (got["matched"], got["only_left"], got["only_right"]) == (2, 2, 1)
    assert got["left_keys"] != got["right_keys"]
    again = Observation()
    align.counted(left.filter("x in (1, 3)"), right.filter("y < 7").orderBy("y"), again).collect()
    assert again.get["left_keys"] == again.get["right_keys"]
