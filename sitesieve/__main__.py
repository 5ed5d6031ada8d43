"""Commands over stored data sets: `spark-submit sitesieve/__main__.py <command> ...`.

Paths are folders of Parquet tables. Database tables are read when `--env PREFIX`
names the environment variables of a connection, catalog tables otherwise.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

if __package__ in (None, ""):  # started as a file
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesieve.operators import binary, confusion, ensemble, multiclass, prcurve, ranking, visits
from sitesieve.operators.subwords import read_subwords
from sitesieve.operators.votes import require_aligned
from sitesieve.plans import classifier as C
from sitesieve.plans import datasets
from sitesieve.schemas import HOST_COMPONENTS, VALIDATION_FRACTION
from sitesieve.session import build_session, clear_cuts, cut_lineage
from sitesieve.sources import files, state
from sitesieve.sources.tables import database_options


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sitesieve")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str, **options) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        for arg in positional:
            p.add_argument(arg.rstrip("*?"), nargs={"*": "+", "?": "?"}.get(arg[-1]))
        for flag, settings in options.items():
            p.add_argument("--" + flag.replace("_", "-"), **settings)
        return p

    source = {"features": {"required": True}, "env": {"default": None}}
    command("dataset-train", "out_x", "out_y", "tables*", **source)
    command("dataset-test", "out_x", "out_y", "tables*", **source)
    command("dataset-predict", "out_x", "tables*", **source)
    command(
        "preprocess-train", "in_x", "in_y", "out", grams={"required": True},
        split={"type": float, "default": VALIDATION_FRACTION},
        components={"type": int, "default": HOST_COMPONENTS}, positional={"action": "store_true"},
        gram_total={"type": float, "default": None}, subwords={"default": None},
    )
    command("preprocess-predict", "in_x", "model", "out")
    command(
        "model-train", "inputs", "out", seed={"type": int, "default": 0},
        reg={"type": float, "nargs": "+", "default": [0.01, 0.1]}, max_iter={"type": int, "default": 30},
    )
    command("model-predict", "data", "model", "out", entropies={"action": "store_true"})
    command("model-info", "model")
    command("combine", "out", "predictions*", delete_if_no_majority={"action": "store_true"})
    command("distribution", "predictions")
    command("sort", "in_path", "out", take={"type": int, "default": None})
    command("results", "true_y", "first", "second?", no_details={"action": "store_true"})
    command("results-binary", "true_y", "first", "second?")
    command("pr", "true_y", "predictions", curve={"default": None, "metavar": "OUT"})
    command("confusion", "true_y", "predictions")
    command("confusion-binary", "true_y", "predictions")
    return top


def _show(df: DataFrame) -> None:
    """Print every row of a report, one line each, tabs between the columns."""
    print("\t".join(df.columns))
    for row in df.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    command = args.command
    if command.startswith("dataset-"):
        options = database_options(args.env) if args.env else None
        if command == "dataset-train":
            datasets.build_training_set(spark, args.tables, args.features, args.out_x, args.out_y, options)
        elif command == "dataset-test":
            datasets.build_test_set(spark, args.tables, args.features, args.out_x, args.out_y, options)
        else:
            datasets.build_prediction_set(spark, args.tables, args.features, args.out_x, options)
    elif command == "preprocess-train":
        _preprocess_train(spark, args)
    elif command == "preprocess-predict":
        preparation, _ = state.load_bundle(spark, args.model)
        pages = files.read_pages(spark, args.in_x, typed=False)
        datasets.prepare_inputs(pages, preparation).write.mode("overwrite").parquet(args.out)
    elif command == "model-train":
        preparation, _ = state.load_bundle(spark, f"{args.inputs}/state")
        inputs = spark.read.parquet(f"{args.inputs}/pages")
        model = C.fit_classifier(
            inputs, preparation.labels, "row_id", [{"regParam": r} for r in args.reg],
            max_iter=args.max_iter, seed=args.seed,
        )
        state.save_bundle(spark, preparation, model, args.out)
    elif command == "model-predict":
        _, model = state.load_bundle(spark, args.model)
        predictions = C.predict(model, spark.read.parquet(args.data), args.entropies)
        files.write_predictions(predictions, args.out)
    elif command == "model-info":
        _show(C.model_info(spark, state.load_bundle(spark, args.model)[1]))
    elif command == "combine":
        sets = [files.read_predictions(spark, p) for p in args.predictions]
        for other in sets[1:]:
            require_aligned(sets[0], other)
        files.write_predictions(ensemble.combine_predictions(sets, args.delete_if_no_majority), args.out)
    elif command == "distribution":
        _show(ensemble.label_distribution(files.read_predictions(spark, args.predictions)))
    elif command == "sort":
        ranked = ranking.rank_uncertain(files.read_predictions(spark, args.in_path), args.take)
        files.write_predictions(ranked, args.out)
    else:
        _evaluate(spark, args)


def _preprocess_train(spark: SparkSession, args: argparse.Namespace) -> None:
    pages, labels = files.read_pages(spark, args.in_x, typed=False), files.read_labels(spark, args.in_y)
    if args.positional:
        rows = visits.zip_positional(pages, labels.select("label"))
    else:
        key = "row_id" if "row_id" in pages.columns and "row_id" in labels.columns else "visit_id"
        require_aligned(pages, labels, key)
        rows = pages.join(labels.select(key, "label"), key)
    if "row_id" not in rows.columns:
        rows = cut_lineage(visits.with_row_ids(rows))
    grams = files.read_grams(spark, args.grams)
    options = {} if args.gram_total is None else {"gram_total": args.gram_total}
    if args.subwords:
        options["subwords"] = read_subwords(spark, args.subwords)
    inputs, preparation = datasets.prepare_training(
        rows, grams, "row_id", fraction=args.split, components=args.components, **options
    )
    inputs.write.mode("overwrite").partitionBy("split").parquet(f"{args.out}/pages")
    state.save_bundle(spark, preparation, None, f"{args.out}/state")


def _evaluate(spark: SparkSession, args: argparse.Namespace) -> None:
    votes = files.read_vote_lists(spark, args.true_y)

    def judged(path: str, column: str) -> DataFrame:
        """Predictions of exactly the pages that were voted on."""
        predictions = files.read_predictions(spark, path, column)
        require_aligned(votes, predictions)
        return predictions

    if args.command == "results":
        first = judged(args.first, "predicted_label")
        if args.second is None:
            report = multiclass.evaluate_multiclass(votes, first, not args.no_details)
        else:
            second = judged(args.second, "predicted_label")
            report = multiclass.compare_multiclass(votes, first, second, not args.no_details)
        _show(multiclass.report_order(report))
    elif args.command == "confusion":
        table = confusion.confusion_table(votes, judged(args.predictions, "predicted_label"))
        _show(table.orderBy("true_rank", F.desc("n"), "predicted_label"))
    else:
        encoded = binary.encode_binary_votes(votes)
        if args.command == "results-binary":
            first = judged(args.first, "decision")
            if args.second is None:
                _show(binary.evaluate_binary(encoded, first))
            else:
                _show(binary.compare_binary(encoded, first, judged(args.second, "decision")))
        elif args.command == "confusion-binary":
            _show(binary.confusion_binary(encoded, judged(args.predictions, "decision")))
        else:
            scores = judged(args.predictions, "prediction")
            _show(prcurve.pr_summary(encoded, scores))
            if args.curve:
                files.write_predictions(prcurve.pr_curve(encoded, scores), args.curve)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _parser().parse_args(argv)
    session = spark or build_session()
    try:
        run(session, args)
    finally:
        if spark is None:
            clear_cuts(session)
            session.stop()


if __name__ == "__main__":
    main()
