"""Votes of several annotators per page.

Votes come in two shapes: long (`visit_id, vote_ord, label`, one row per vote)
and lists (`visit_id, labels`). The long shape is the one to use at scale: it
is aggregated per (page, label) before any shuffle on the page, so a page that
holds a large part of all votes shrinks to one row per label on the map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import votes as on_lists


def unfold_votes(lists: DataFrame) -> DataFrame:
    """Vote lists to long votes; `vote_ord` is the position in the list."""
    return lists.select("visit_id", F.posexplode("labels").alias("vote_ord", "label")).withColumn(
        "vote_ord", F.col("vote_ord").cast("bigint")
    )


def fold_votes(votes: DataFrame) -> DataFrame:
    """Long votes to one list per page in vote order, null labels kept.

    The list is the shape of the exchange file; evaluation does not need it.
    """
    pair = F.struct("vote_ord", "label")
    return votes.groupBy("visit_id").agg(
        F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["label"]).alias("labels")
    )


def drop_ignored(votes: DataFrame, ignored: list[str]) -> DataFrame:
    """Votes without the ignored labels; pages left with none disappear by themselves."""
    if not ignored:
        return votes
    return votes.filter(F.col("label").isNull() | ~F.col("label").isin(ignored))


def drop_ignored_from_lists(lists: DataFrame, ignored: list[str]) -> DataFrame:
    """The same on vote lists: filter each list, then drop the empty ones."""
    kept = F.filter("labels", lambda x: x.isNull() | ~x.isin(list(ignored)))
    return lists.withColumn("labels", kept if ignored else F.col("labels")).filter(
        F.size("labels") > 0
    )


def label_counts(votes: DataFrame) -> DataFrame:
    """Votes and first vote position per (page, label)."""
    return votes.groupBy("visit_id", "label").agg(
        F.count(F.lit(1)).alias("n"), F.min("vote_ord").alias("first_ord")
    )


def page_summary_columns():
    """Aggregates over the `label_counts` rows of one page.

    Labels are ranked by votes, then by first position. The leader is compared
    with the label that ranks first when positions are reversed: they are the
    same label exactly if nobody else has as many votes. Rows without `n` are no votes.
    """
    voted = F.col("n").isNotNull()
    return [
        F.sum("n").alias("n_votes"),
        F.count("n").alias("n_labels"),
        F.max("n").alias("top_votes"),
        F.min_by("label", F.when(voted, F.struct(-F.col("n"), "first_ord", "label"))).alias("top_label"),
        F.max_by("label", F.when(voted, F.struct("n", "first_ord", "label"))).alias("last_leader"),
    ]


def with_page_flags(pages: DataFrame) -> DataFrame:
    return pages.withColumns(
        {
            "has_majority": F.col("top_label").eqNullSafe(F.col("last_leader")),
            "unanimous": F.col("n_labels") == 1,
        }
    ).drop("last_leader")


def summarise_pages(votes: DataFrame, every_page: bool = False) -> DataFrame:
    """Per page: vote and label counts, top label, plurality and unanimity flags.

    Of vote lists, `every_page` keeps pages without a vote as well, and adds the distinct labels as `votes_seen`.
    """
    if "labels" in votes.columns:
        listed = votes.select("visit_id", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))
        if not every_page:
            listed = listed.filter(F.size("labels") > 0)
        seen = [F.array_distinct("labels").alias("votes_seen")] if every_page else []
        ranked = listed.select(
            "visit_id", F.size("labels").alias("n"), on_lists.ranked(F.col("labels")).alias("ranked"), *seen
        )
        top, runner_up = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1))
        return ranked.select(
            "visit_id",
            F.col("n").cast("bigint").alias("n_votes"),
            F.size("ranked").cast("bigint").alias("n_labels"),
            (-top["votes"]).cast("bigint").alias("top_votes"),
            top["label"].alias("top_label"),
            (runner_up.isNull() | (top["votes"] < runner_up["votes"])).alias("has_majority"),
            (F.size("ranked") == 1).alias("unanimous"),
            *(["votes_seen"] if every_page else []),
        )
    return with_page_flags(label_counts(votes).groupBy("visit_id").agg(*page_summary_columns()))


def distinct_labels(votes: DataFrame, *predictions: DataFrame) -> DataFrame:
    """Every label that occurs in a vote or in a prediction."""
    if "labels" in votes.columns:
        seen = votes.select(F.explode("labels").alias("label"))
    else:
        seen = votes.select("label")
    for frame in predictions:
        seen = seen.unionByName(frame.select(F.col("predicted_label").alias("label")))
    return seen.distinct()


def misaligned(left: DataFrame, right: DataFrame, key: str = "visit_id") -> DataFrame:
    """Keys that are missing on one side or occur twice, with their row counts."""
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    counts = sides.groupBy(key).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))
    return counts.filter((F.col("n_left") != 1) | (F.col("n_right") != 1))


def require_aligned(left: DataFrame, right: DataFrame, key: str = "visit_id") -> None:
    """Raise if the two sets do not hold the same unique keys (runs one job)."""
    sample = misaligned(left, right, key).limit(5).collect()
    if sample:
        raise ValueError(f"keys without exactly one partner, for example: {sample}")
