"""Parquet and text files: pages, labels, votes, windows, predictions, gram counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import visits as V
from ..operators.votes import fold_votes
from ..schemas import GRAMS, PAGES, VOTE_LISTS, VOTES
from ..session import cut_lineage, release


def read_pages(spark: SparkSession, path: str, typed: bool = True) -> DataFrame:
    """Page rows; `typed` applies the fixed schema (absent columns read as null)."""
    return (spark.read.schema(PAGES) if typed else spark.read).parquet(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_vote_lists(spark: SparkSession, path: str, keyed: bool = True) -> DataFrame:
    """Vote lists per page; files without keys pair by position, see `zip_positional`."""
    return spark.read.schema(VOTE_LISTS if keyed else "labels array<string>").parquet(path)


def read_votes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VOTES).parquet(path)


def read_predictions(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """Predictions; with `column` only the key and that column are scanned."""
    df = spark.read.parquet(path)
    return df if column is None else df.select("visit_id", column)


def read_grams(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated `gram<TAB>count` lines without quoting."""
    return spark.read.csv(path, sep="\t", quote="", schema=GRAMS, encoding="UTF-8")


def write_training_set(rows: DataFrame, path_x: str, path_y: str) -> None:
    """Pages and labels of labelled rows as two Parquet data sets with one unique `row_id`.

    The numbered rows are written once; labels are a projection of what was
    written, so the two sets agree whatever happens between the writes.
    """
    numbered = cut_lineage(V.with_row_ids(rows))
    pages, labels = V.split_labels(numbered)
    pages.write.mode("overwrite").parquet(path_x)
    labels.write.mode("overwrite").parquet(path_y)
    release(numbered)


def write_prediction_set(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def write_test_set(votes: DataFrame, pages: DataFrame, path_x: str, path_y: str) -> None:
    """Pages without labels, and one vote list per page."""
    pages.drop("label").write.mode("overwrite").parquet(path_x)
    fold_votes(votes).write.mode("overwrite").parquet(path_y)


def write_windows(windows: DataFrame, path: str, append: bool = False) -> None:
    """Window rows, one directory per split so that a reader of one split skips the other."""
    writer = windows.write.mode("append" if append else "overwrite")
    if "split" in windows.columns:
        writer = writer.partitionBy("split")
    writer.parquet(path)


def read_windows(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if split is None else df.filter(F.col("split") == split)


def windows_of(windows: DataFrame, visit_id: str) -> DataFrame:
    """The rows of one page, found by a filter that reaches the scan."""
    return windows.filter(F.col("visit_id") == visit_id)


def write_predictions(predictions: DataFrame, path: str) -> None:
    predictions.write.mode("overwrite").parquet(path)
