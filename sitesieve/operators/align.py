"""Joins of sets that have to hold the same keys, checked in the join itself.

The join that is done anyway is a full outer one. A key that only one side has either stops the job with its name, or is
dropped and counted. Neither needs another pass over the inputs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

LEFT, RIGHT = "_in_left", "_in_right"
# Hexadecimal digits of a key's share in a fingerprint.
DIGITS = 12


def _outer(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.withColumn(LEFT, F.lit(True)).join(right.withColumn(RIGHT, F.lit(True)), key, "full_outer")


def aligned(left: DataFrame, right: DataFrame, key: str = "visit_id", names: tuple[str, str] = ("vote", "prediction")) -> DataFrame:
    """Join on a key that both sides must hold; running it raises at a key that one of them lacks."""
    shown = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    missing = F.when(F.col(LEFT).isNull(), F.concat(F.lit(f"no {names[0]} for page "), shown)).when(
        F.col(RIGHT).isNull(), F.concat(F.lit(f"no {names[1]} for page "), shown)
    )
    whole = F.when(missing.isNull(), F.lit(True)).otherwise(F.raise_error(missing).cast("boolean"))
    # a row number is never negative; but no later filter is moved below a column that holds one, where it
    # would remove the rows of one side before they are looked at
    seen = whole & (F.monotonically_increasing_id() >= 0)
    return _outer(left, right, key).withColumn(LEFT, seen).filter(LEFT).drop(LEFT, RIGHT)


def fingerprint(key: Column, there: Column) -> Column:
    """A sum over the keys that does not depend on their order; equal sets have equal sums."""
    number = F.conv(F.substring(F.md5(key.cast("string")), 1, DIGITS), 16, 10).cast("decimal(20,0)")
    return F.sum(F.when(there, number))


def counted(left: DataFrame, right: DataFrame, observation: Observation, key: str = "visit_id") -> DataFrame:
    """Join on the keys that both sides hold; when it has run, `observation` tells how many keys there were:
    `matched`, `only_left`, `only_right`, and a fingerprint of either key set."""
    in_left, in_right = F.col(LEFT).isNotNull(), F.col(RIGHT).isNotNull()
    joined = _outer(left, right, key).observe(
        observation,
        F.count_if(in_left & in_right).alias("matched"), F.count_if(~in_right).alias("only_left"),
        F.count_if(~in_left).alias("only_right"),
        fingerprint(F.col(key), in_left).alias("left_keys"), fingerprint(F.col(key), in_right).alias("right_keys"),
    )
    return joined.filter(in_left & in_right).drop(LEFT, RIGHT)


def refused_unless(holds: Column, what: str) -> Column:
    """True where `holds`; raises with `what` and the page where it does not."""
    page = F.coalesce(F.col("visit_id").cast("string"), F.lit("null"))
    return F.when(holds, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{what} for page "), page)).cast("boolean"))


def answer_columns(models: list[str], column: str) -> list[Column]:
    """Aggregates over rows (model, `column`) of one page: how many rows each model has, and its answer."""
    is_of = [F.col("model") == name for name in models]
    return [F.count_if(of).alias(f"_n{i}") for i, of in enumerate(is_of)] + [
        F.max(F.when(of, F.col(column))).alias(f"_a{i}") for i, of in enumerate(is_of)]


def complete(pages: DataFrame, models: list[str], column: str) -> DataFrame:
    """Pages with `answer_columns` as one list `answers` of (model, `column`); raises unless every model has one row."""
    once = reduce(lambda a, b: a & b, [F.col(f"_n{i}") == 1 for i in range(len(models))])
    answers = F.array(*[F.struct(F.lit(name).alias("model"), F.col(f"_a{i}").alias(column)) for i, name in enumerate(models)])
    rest = [c for c in pages.columns if c[:2] not in ("_n", "_a")]
    return pages.filter(refused_unless(once, "not one prediction of every model")).select(*rest, answers.alias("answers"))


def one_row_a_page(predictions: dict[str, DataFrame], column: str) -> DataFrame:
    """(visit_id, answers): per page the answer of every model; raises where one has no or more than one row."""
    frames = [df.select("visit_id", column, F.lit(name).alias("model")) for name, df in predictions.items()]
    models = list(predictions)
    return complete(reduce(DataFrame.unionByName, frames).groupBy("visit_id").agg(*answer_columns(models, column)), models, column)
