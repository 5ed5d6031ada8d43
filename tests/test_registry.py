"""Every query with SQL equals it on the smallest tables; plans have the wanted shape."""

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from compare import connect, difference  # noqa: E402
from sitesieve.registry import inputs as I  # noqa: E402
from sitesieve.registry import queries as Q  # noqa: E402

SLOW = {"model_info"}


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n not in SLOW])
def test_query_equals_sql(spark, con, small, name):
    assert difference(con, entry.oracle_sql()[name], entry.queries()[name](spark, small)) is None


def test_entry_and_keys(spark):
    assert not entry.entry(spark).isEmpty()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_votes_and_predictions_meet_in_one_shuffle(spark, small):
    """Votes are shuffled per (page, label), then once on the page, together with the predictions."""
    from sitesieve.operators.multiclass import judged_pages
    from sitesieve.operators.votes import label_counts

    votes = I.votes(spark, small)
    preds = spark.createDataFrame([("a", "x")], "visit_id string, predicted_label string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(judged_pages(votes, {"m": preds}))
        assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2
        assert len(re.findall(r"Exchange hashpartitioning", plan_of(label_counts(votes)))) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scans_read_only_what_is_needed(spark, small):
    plan = plan_of(Q.votes_majority(spark, small))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "props" not in schema and "value" not in schema
    assert "ReadSchema: struct<doc_id:bigint,toxic:int>" in plan_of(I.visits_toxic(spark, small))


def test_top_k_does_not_sort_everything(spark, small):
    assert "TakeOrderedAndProject" in plan_of(Q.top_uncertain(spark, small))


def test_no_cross_joins(spark, small):
    light = [n for n in entry.oracle_sql() if n not in SLOW]
    for name in light:
        plan = plan_of(entry.queries()[name](spark, small))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
