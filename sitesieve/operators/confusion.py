"""Row-normalised multiclass confusion table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .align import aligned
from .votes import summarise_pages


def confusion_table(votes: DataFrame, predictions: DataFrame) -> DataFrame:
    """Cells `true_label, predicted_label, n, percent` in long form, zero cells included.

    The truth is the plurality label, first vote on ties. Only labels that are
    true somewhere count, so a prediction outside them leaves the row total.
    `true_rank` orders the labels from most to least frequent.
    """
    pages = summarise_pages(votes, every_page=True).select("visit_id", "n_votes", F.col("top_label").alias("true_label"))
    counts = (
        aligned(pages, predictions.select("visit_id", "predicted_label")).filter("n_votes > 0")
        .groupBy("true_label", "predicted_label").agg(F.count(F.lit(1)).alias("n"))
    )
    # class-sized tables from here on
    labels = counts.groupBy("true_label").agg(F.sum("n").alias("total")).select(
        "true_label",
        F.row_number().over(Window.orderBy(F.desc("total"), "true_label")).alias("true_rank"),
    )
    every_label = F.array_agg("true_label").over(Window.partitionBy())
    grid = labels.withColumn("every_label", every_label).select(
        "true_label", "true_rank", F.explode("every_label").alias("predicted_label")
    )
    cell = F.coalesce(F.col("n"), F.lit(0))
    row = Window.partitionBy("true_label")
    return (
        grid.join(counts, ["true_label", "predicted_label"], "left")
        .select(
            "true_label", "true_rank", "predicted_label", cell.alias("n"),
            F.coalesce(
                F.try_divide(F.lit(100.0) * cell, F.sum(cell).over(row)), F.lit(0.0)
            ).alias("percent"),
        )
    )


def confusion_matrix(table: DataFrame, labels: list[str]) -> DataFrame:
    """The wide form: one row per true label, one column per given label."""
    return (
        table.groupBy("true_label", "true_rank").pivot("predicted_label", labels)
        .agg(F.first("percent")).orderBy("true_rank").drop("true_rank")
    )
