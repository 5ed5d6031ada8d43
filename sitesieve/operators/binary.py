"""Quality metrics of binary models against 0/1 votes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .align import aligned, one_row_a_page
from .multiclass import side_by_side
from .votes import unfold_votes


def encode_binary_votes(votes: DataFrame) -> DataFrame:
    """Textual votes to 0/1: of the two labels the lexicographically later one is positive.

    Raises unless exactly two labels occur (looks at no more than three values).
    """
    if "labels" in votes.columns:
        votes = unfold_votes(votes)
    labels = sorted(
        r["label"] for r in votes.filter(F.col("label").isNotNull()).select("label").distinct().limit(3).collect()
    )
    if len(labels) != 2:
        raise ValueError(f"binary evaluation needs exactly two labels, found {labels}")
    return votes.select(
        "visit_id", "vote_ord", (F.col("label") == F.lit(labels[1])).cast("int").alias("y")
    )


def binary_pages(votes: DataFrame) -> DataFrame:
    """Per page: number of votes and of positive votes, majority and unanimity flags."""
    pos, n = F.col("n_positive"), F.col("n_votes")
    return (
        votes.groupBy("visit_id")
        .agg(F.count(F.lit(1)).alias("n_votes"), F.sum("y").cast("bigint").alias("n_positive"))
        .withColumns(
            {
                "unanimous": (pos == 0) | (pos == n),
                "has_majority": 2 * pos != n,
                "positive": 2 * pos > n,
            }
        )
    )


def evaluate_binary_models(votes: DataFrame, predictions: dict[str, DataFrame]) -> DataFrame:
    """Precision, recall and F1 per model and population, from the `decision` column.

    All three are NaN where nothing was predicted positive; null where only
    their own denominator is zero.
    """
    pages = aligned(binary_pages(votes), one_row_a_page(predictions, "decision")).filter("has_majority")
    judged = pages.select("visit_id", "unanimous", "positive", F.explode("answers").alias("answer")).select(
        "visit_id", "unanimous", "positive", "answer.model", "answer.decision")
    decided, real = F.col("decision"), F.col("positive")
    cells = {"tp": decided & real, "fp": decided & ~real, "fn": ~decided & real}
    populations = {
        "all": F.lit(True), "unanimous": F.col("unanimous"), "controversial": ~F.col("unanimous"),
    }
    sums = [
        F.count_if(cell & member).alias(f"{p}_{c}")
        for p, member in populations.items() for c, cell in cells.items()
    ]

    def metrics_of(p: str):
        tp, fp, fn = (F.col(f"{p}_{c}").cast("double") for c in ("tp", "fp", "fn"))
        values = {
            "precision": F.try_divide(tp, tp + fp),
            "recall": F.try_divide(tp, tp + fn),
            "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
        }
        return [
            F.struct(
                F.lit(p).alias("population"), F.lit(name).alias("metric"),
                F.when(tp + fp == 0, F.lit(float("nan"))).otherwise(value).alias("value"),
            )
            for name, value in values.items()
        ]

    rows = F.array(*[row for p in populations for row in metrics_of(p)])
    return (
        judged.groupBy("model").agg(*sums)
        .select("model", F.explode(rows).alias("m"))
        .select("model", "m.population", "m.metric", F.lit(None).cast("string").alias("label"), "m.value")
    )


def evaluate_binary(votes: DataFrame, predictions: DataFrame) -> DataFrame:
    return evaluate_binary_models(votes, {"model": predictions}).select("population", "metric", "value")


def compare_binary(votes: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    metrics = evaluate_binary_models(votes, {"first": first, "second": second})
    return side_by_side(metrics).drop("label")


def confusion_binary(votes: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row of tn, fp, fn, tp. A tied page takes the label of its first vote."""
    pages = votes.groupBy("visit_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"), F.min_by("y", "vote_ord").alias("first_y")
    )
    real = F.when(2 * F.col("pos") == F.col("n"), F.col("first_y") == 1).otherwise(
        2 * F.col("pos") > F.col("n")
    )
    decided = F.col("decision")
    return (
        pages.withColumn("real", real)
        .join(predictions.select("visit_id", "decision"), "visit_id")
        .agg(
            F.count_if(~decided & ~F.col("real")).alias("tn"),
            F.count_if(decided & ~F.col("real")).alias("fp"),
            F.count_if(~decided & F.col("real")).alias("fn"),
            F.count_if(decided & F.col("real")).alias("tp"),
        )
    )
