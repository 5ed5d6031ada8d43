"""Inputs of the right shape, derived from the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


# A published byte-pair vocabulary; it is read where it is installed.
SUBWORDS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """`doc_id, text` over all cores, for the jobs that take texts apart."""
    return spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")


def page_features(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as page features; words that end a sentence stand in for linked hosts."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text", "source", "n_chars")
    return spread(docs, "doc_id").select(
        F.col("doc_id").cast("string").alias("visit_id"),
        F.concat(F.lit("site"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang")).alias("domain_name"),
        F.col("text").alias("body_text"),
        F.coalesce("source", F.lit("")).alias("meta_text"),
        F.regexp_extract_all(F.col("text"), F.lit(r"[A-Za-z]+\."), F.lit(0)).alias("external_hosts"),
        F.col("n_chars").alias("nb_letters"),
    )


def narrow_features(spark: SparkSession, folder: str) -> DataFrame:
    return page_features(spark, folder).drop("external_hosts")


def visits_quality(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("quality") == 1, "Good").otherwise("Poor")
    return table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("visit_id"), label.alias("label"))


def visits_toxic(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("toxic") == 1, "Toxic").otherwise("Clean")
    return table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("visit_id"), label.alias("label"))


def visits_both(spark: SparkSession, folder: str) -> DataFrame:
    """One of four labels per labelled document."""
    quality = F.when(F.col("quality") == 1, "Good").otherwise("Poor")
    toxic = F.when(F.col("toxic") == 1, "Toxic").otherwise("Clean")
    return table(spark, folder, "labels").select(
        F.col("doc_id").cast("string").alias("visit_id"), F.concat_ws("/", quality, toxic).alias("label")
    )


def _user_days(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.col("ts").cast("date").cast("string")).alias("visit_id"),
        F.col("event_id").alias("vote_ord"), F.col("event_type").alias("label"), "value",
    )


def votes(spark: SparkSession, folder: str) -> DataFrame:
    """Event types as votes on a user's day, in event order."""
    return _user_days(spark, folder).select("visit_id", "vote_ord", "label")


def model_predictions(spark: SparkSession, folder: str) -> list[DataFrame]:
    """Three models: label of the highest value, of the lowest value, and of the latest event."""
    days = _user_days(spark, folder)
    orders = [
        F.struct(-F.col("value"), "vote_ord"), F.struct("value", "vote_ord"), F.struct(-F.col("vote_ord")),
    ]
    return [
        days.groupBy("visit_id").agg(F.min_by("label", order).alias("predicted_label")) for order in orders
    ]


def usual_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """A model that knows users, not days: the label of the highest value a user ever had, for each day."""
    events = table(spark, folder, "events")
    usual = events.groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("value"), "event_id")).alias("predicted_label"))
    day = F.concat_ws("-", F.col("user_id").cast("string"), F.col("ts").cast("date").cast("string"))
    return events.select("user_id", day.alias("visit_id")).distinct().join(usual, "user_id").select("visit_id", "predicted_label")


def binary_votes(spark: SparkSession, folder: str) -> DataFrame:
    positive = F.col("label").isin("purchase", "signup").cast("int")
    return _user_days(spark, folder).select("visit_id", "vote_ord", positive.alias("y"))


def binary_scores(spark: SparkSession, folder: str) -> DataFrame:
    top = F.max("value")
    return _user_days(spark, folder).groupBy("visit_id").agg((top / (top + 1.0)).alias("prediction"))


def mean_scores(spark: SparkSession, folder: str) -> DataFrame:
    low = F.min("value")
    return _user_days(spark, folder).groupBy("visit_id").agg((low / (low + 1.0)).alias("prediction"))


def logits(spark: SparkSession, folder: str) -> DataFrame:
    """All dimensions of a vector as class scores."""
    scores = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, folder, "embeddings").select("vec_id", scores.alias("logits"))


def hosts_of_pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(
        F.col("page_id").cast("string").alias("visit_id"), F.expr("try_parse_url(url, 'HOST')").alias("domain_name")
    )


def linked_suppliers(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """Orders as pages that link to the hosts of their suppliers: (`visit_id, term, tf`, number of pages)."""
    lines = spread(table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey"), "l_orderkey")
    host = F.concat(F.lit("supplier"), F.col("l_suppkey").cast("string"), F.lit(".example"))
    counts = lines.groupBy(F.col("l_orderkey").alias("visit_id"), host.alias("term")).agg(
        F.count(F.lit(1)).alias("tf")
    )
    return counts, lines.select("l_orderkey").distinct().count()


def vote_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Three votes per labelled document, stored as a list."""
    good = lambda c: F.when(c, "Good").otherwise("Poor")
    third = F.when(F.col("doc_id") % 3 == 0, "Skip").otherwise(good(F.col("doc_id") % 5 > 0))
    return table(spark, folder, "labels").select(
        F.col("doc_id").cast("string").alias("visit_id"),
        F.array(good(F.col("quality") == 1), good(F.col("toxic") == 0), third).alias("labels"),
    )


def list_predictions(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("doc_id") % 4 == 0, "Poor").when(F.col("doc_id") % 4 == 1, "Skip").otherwise("Good")
    return table(spark, folder, "labels").select(
        F.col("doc_id").cast("string").alias("visit_id"), label.alias("predicted_label")
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Scoring requests over all pages, 25 to a request; some leave out ids or hosts, some are malformed."""
    job = F.floor(F.col("page_id") / 25)
    host = F.coalesce(F.expr("try_parse_url(url, 'HOST')"), F.lit(""))
    pages = table(spark, folder, "pages").select(
        job.alias("job"), "page_id", host.alias("domain_name"), F.col("html").alias("body_text"),
        F.col("url").alias("meta_text"),
    )
    folded = pages.groupBy("job").agg(
        F.array_sort(F.collect_list(F.struct("page_id", "domain_name", "body_text", "meta_text"))).alias("p")
    )
    none = F.array().cast("array<string>")
    take = lambda c: F.transform("p", lambda x: x[c].cast("string"))
    short = lambda values: F.slice(values, 1, F.size(values) - 1)
    meta = F.when(F.col("job") % 7 == 3, short(take("meta_text"))).otherwise(take("meta_text"))
    body = F.when(F.col("job") % 7 == 5, short(take("body_text"))).otherwise(take("body_text"))
    return folded.select(
        F.when(F.col("job") % 5 == 4, "m2").otherwise("m1").alias("model"), F.concat(F.lit("job"), F.col("job").cast("string")).alias("job_id"),
        F.when(F.col("job") % 2 == 0, none).otherwise(take("page_id")).alias("visit_id"),
        take("domain_name").alias("domain_name"), body.alias("body_text"), meta.alias("meta_text"),
        F.when(F.col("job") % 3 == 0, none).otherwise(take("meta_text")).alias("external_hosts"),
    )
