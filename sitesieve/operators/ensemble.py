"""Voting over several prediction sets, and label distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .align import aligned, one_row_a_page


def _vote_column(df: DataFrame) -> str:
    return "predicted_label" if "predicted_label" in df.columns else "decision"


def combine_predictions(sets: list[DataFrame], majority_only: bool = False) -> DataFrame:
    """One prediction per page by plurality over k sets, joined on `visit_id`.

    On a tie the earliest set in the list decides, or the page is dropped with
    `majority_only`. Other columns come from the first set; scores that no
    longer belong to the voted value are dropped. A page that is not in all sets is an error.
    """
    key = _vote_column(sets[0])
    joined = sets[0].withColumn("vote_0", F.col(key))
    if len(sets) > 1:
        others = one_row_a_page({str(i): df for i, df in enumerate(sets[1:], 1)}, key)
        votes = {f"vote_{i}": F.col("answers")[i - 1][key] for i in range(1, len(sets))}
        joined = aligned(joined, others, names=("prediction", "prediction")).withColumns(votes).drop("answers")
    voted = vote_columns(joined, len(sets), key, majority_only)
    return voted.drop("entropy", *(["prediction"] if key == "decision" else []))


def vote_columns(ballots: DataFrame, k: int, name: str, majority_only: bool = False) -> DataFrame:
    """The plurality of the columns `vote_0` .. `vote_<k-1>` of a row as column `name`, in their place."""
    votes = [F.col(f"vote_{i}") for i in range(k)]

    def support(vote):
        return sum((v.eqNullSafe(vote).cast("int") for v in votes[1:]), votes[0].eqNullSafe(vote).cast("int"))

    counts = [support(v) for v in votes]
    top = F.greatest(*counts) if len(counts) > 1 else counts[0]
    choice = F.coalesce(*[F.when(c == top, F.struct(v.alias("v"))) for c, v in zip(counts, votes)])["v"]
    # the top votes belong to one value exactly if that value accounts for all of them
    holders = sum(((c == top).cast("int") for c in counts[1:]), (counts[0] == top).cast("int"))
    voted = ballots.withColumns({"_choice": choice, "_single": holders == top})
    if majority_only:
        voted = voted.filter("_single")
    return voted.withColumn(name, F.col("_choice")).drop("_choice", "_single", *[f"vote_{i}" for i in range(k)])


def label_distribution(predictions: DataFrame) -> DataFrame:
    """Count and percentage per predicted value, most frequent first."""
    key = _vote_column(predictions)
    counts = predictions.groupBy(F.col(key).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    share = 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())
    return counts.withColumn("percent", share).orderBy(F.desc("n"), "label")
