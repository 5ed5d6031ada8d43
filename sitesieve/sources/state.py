"""Stored models: preparation state and classifier in one directory of tables."""

from __future__ import annotations

import json

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession

from ..operators.gramfilter import fit_bits
from ..plans.classifier import PageClassifier
from ..plans.datasets import Preparation
from ..plans.features import FeatureState


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def save_bundle(
    spark: SparkSession, preparation: Preparation, classifier: PageClassifier | None, path: str
) -> None:
    """Write vocabulary, host terms and grams as tables, everything small as JSON, the model as ML model."""
    features = preparation.features
    meta = {
        "labels": preparation.labels,
        "gram_total": preparation.gram_total,
        "window_size": preparation.window_size,
        "numeric": features.numeric,
        "components": features.components,
    }
    _write(preparation.vocabulary, f"{path}/vocabulary")
    _write(preparation.grams, f"{path}/grams")
    _write(fit_bits(preparation.grams), f"{path}/gram_filter")
    if features.terms is not None:
        _write(features.terms, f"{path}/terms")
    if classifier is not None:
        classifier.model.write().overwrite().save(f"{path}/model")
        meta["classifier"] = {
            "buckets": classifier.buckets, "seed": classifier.seed,
            "extra_width": classifier.extra_width, "threshold": classifier.threshold, "history": classifier.history,
        }
    _write(spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1), f"{path}/meta")


def load_bundle(spark: SparkSession, path: str) -> tuple[Preparation, PageClassifier | None]:
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
    terms = spark.read.parquet(f"{path}/terms") if meta["components"] else None
    preparation = Preparation(
        FeatureState(meta["numeric"], terms, meta["components"]),
        spark.read.parquet(f"{path}/vocabulary"),
        meta["labels"],
        spark.read.parquet(f"{path}/grams"),
        meta["gram_total"],
        meta["window_size"],
        spark.read.parquet(f"{path}/gram_filter"),
    )
    stored = meta.get("classifier")
    if stored is None:
        return preparation, None
    model = LogisticRegressionModel.load(f"{path}/model")
    return preparation, PageClassifier(model, meta["labels"], **stored)
