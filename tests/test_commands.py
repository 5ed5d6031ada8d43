"""The commands, one after the other, as a user would run them."""

from pyspark.sql import functions as F

from sitesieve.__main__ import main
from test_pipeline import SCHEMA, page_rows


def test_from_tables_to_reports(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    from sitesieve.schemas import INTEGER_COLUMNS, NUMERIC_FEATURES

    pages = spark.createDataFrame(page_rows(60), SCHEMA)
    wide = pages.drop("label").withColumns(
        {c: F.lit(1).cast("bigint") for c in [*NUMERIC_FEATURES, *INTEGER_COLUMNS] if c != "nb_imgs"})
    wide.createOrReplaceTempView("all_pages")
    pages.select("visit_id", "label").createOrReplaceTempView("labelled")
    spark.createDataFrame([("shop", 50.0), ("site", 60.0)], "gram string, n double").write.csv(at("grams"), sep="\t")

    run = lambda *argv: main(list(argv), spark)
    run("dataset-train", at("x"), at("y"), "labelled", "--features", "all_pages")
    run("dataset-test", at("tx"), at("ty"), "labelled", "labelled", "--features", "all_pages")
    run("dataset-predict", at("px"), "labelled", "--features", "all_pages")
    run("preprocess-train", at("x"), at("y"), at("prepared"), "--grams", at("grams"), "--components", "2", "--split", "0.25")
    run("model-train", at("prepared"), at("model"), "--reg", "0.1", "--max-iter", "15")
    run("preprocess-predict", at("px"), at("model"), at("inputs"))
    for out in ("p1", "p2", "p3"):
        run("model-predict", at("inputs"), at("model"), at(out), "--entropies")
    run("combine", at("voted"), at("p1"), at("p2"), at("p3"), "--delete-if-no-majority")
    run("sort", at("p1"), at("asked"), "--take", "7")
    assert spark.read.parquet(at("voted")).count() == 60 and spark.read.parquet(at("asked")).count() == 7

    capsys.readouterr()
    run("model-info", at("model"))
    run("distribution", at("voted"))
    run("results", at("ty"), at("p1"), at("p2"), "--no-details")
    run("results", at("ty"), at("voted"))
    run("confusion", at("ty"), at("voted"))
    printed = capsys.readouterr().out
    assert "multi" in printed and "weighted_f1" in printed and "true_rank" in printed

    truth = spark.read.parquet(at("ty")).filter("labels[0] <> 'Blog'")
    truth.write.parquet(at("ty2"))
    scores = truth.select("visit_id", F.when(F.col("labels")[0] == "Shop", 0.9).otherwise(0.2).alias("prediction"))
    scores.withColumn("decision", F.col("prediction") > 0.5).write.parquet(at("b"))
    run("results-binary", at("ty2"), at("b"))
    run("results-binary", at("ty2"), at("b"), at("b"))
    run("confusion-binary", at("ty2"), at("b"))
    run("pr", at("ty2"), at("b"), "--curve", at("curve"))
    printed = capsys.readouterr().out
    assert spark.read.parquet(at("curve")).count() == 3
    assert "auc_pr" in printed and "precision" in printed and "20\t0\t0\t20" in printed
