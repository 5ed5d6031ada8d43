"""Preparation, classifier, stored state, rounds, requests and the stream."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitesieve.operators import tokens
from sitesieve.plans import classifier as C
from sitesieve.plans import datasets, features, rounds
from sitesieve.sources import files, requests, state, tables
from sitesieve.streaming import requests as stream

TOPICS = {"Shop": "buy cart price order", "News": "today report election match", "Blog": "my thoughts diary travel"}


def page_rows(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = list(TOPICS)[i % 3]
        words = [rng.choice(TOPICS[label].split() + ["the", "a"]) for _ in range(rng.randint(3, 60))]
        hosts = [f"{label.lower()}{rng.randint(0, 4)}.be" for _ in range(rng.randint(0, 4))]
        rows.append((f"v{seed}-{i}", f"{label.lower()}site{i % 5}.be", " ".join(words), "", hosts, i % 7, label))
    return rows


SCHEMA = ("visit_id string, domain_name string, body_text string, meta_text string, "
          "external_hosts array<string>, nb_imgs bigint, label string")


@pytest.fixture(scope="module")
def prepared(spark):
    rows = spark.createDataFrame(page_rows(90), SCHEMA)
    grams = spark.createDataFrame(
        [("shop", 50.0), ("site", 60.0), ("news", 40.0), ("blog", 40.0), ("shop site", 9.0)], "gram string, n double")
    inputs, preparation = datasets.prepare_training(
        rows, grams, numeric=["nb_imgs"], components=3, gram_total=1000.0, window_size=16, fraction=0.3,
        svd_iterations=2,
    )
    inputs = inputs.persist()
    model = C.fit_classifier(
        inputs, preparation.labels, candidates=[{"regParam": 0.1}, {"regParam": 0.1}], buckets=256, max_iter=20)
    return rows, inputs, preparation, model


def test_training_preparation(prepared):
    rows, inputs, preparation, _ = prepared
    assert preparation.labels == ["Blog", "News", "Shop"]
    data = inputs.collect()
    assert len(data) == 90 and sum(r["split"] == "val" for r in data) == 27
    assert {len(r["windows"]) for r in data} == {1, 2}
    assert all(len(w["input_ids"]) == 16 for r in data for w in r["windows"])
    extra = np.array([r["extra_features"] for r in data])
    assert extra.shape == (90, 4)
    assert np.allclose(extra.mean(0), 0, atol=1e-9) and np.allclose(extra.std(0), 1)
    labels = {r["visit_id"]: r["label"] for r in rows.collect()}
    assert all(preparation.labels[r["y"]] == labels[r["visit_id"]] for r in data)


def test_two_rows_of_one_label_give_one_row_on_each_side(spark):
    rows = spark.createDataFrame(
        [("1", "test.be", "This is a sentence.", "Hello", ["x.be"], 1, "A"),
         ("2", "cool.be", "And another one.", "Example", ["y.be"], 2, "A")], SCHEMA)
    grams = spark.createDataFrame([("test", 5.0)], "gram string, n double")
    inputs, preparation = datasets.prepare_training(
        rows, grams, fraction=0.5, numeric=["nb_imgs"], components=1)
    got = inputs.collect()
    assert sorted(r["split"] for r in got) == ["train", "val"] and {r["y"] for r in got} == {0}
    assert preparation.labels == ["A"]


def test_a_gram_filter_is_built_once(spark, monkeypatch):
    from sitesieve.operators import gramfilter, segment

    rows = spark.createDataFrame(page_rows(40), SCHEMA)
    grams = spark.createDataFrame([("shop", 50.0), ("site", 60.0), ("news", 40.0)], "gram string, n double")
    monkeypatch.setattr(segment, "BROADCAST_GRAMS", 0)
    built, real = [], gramfilter.GramFilter.fit.__func__
    monkeypatch.setattr(gramfilter.GramFilter, "fit", classmethod(lambda cls, *a, **k: built.append(1) or real(cls, *a, **k)))
    _, preparation = datasets.prepare_training(rows, grams, numeric=["nb_imgs"], components=0, gram_total=1000.0, window_size=16)
    datasets.prepare_inputs(rows.drop("label"), preparation)
    assert built == [1]


def test_labels_travel_to_the_pages(spark, monkeypatch):
    from sitesieve.registry import queries

    seen = []
    monkeypatch.setattr(queries.datasets, "prepare_training", lambda rows, grams, **k: seen.append(rows) or (rows, None))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, _, pool = queries._prepared(spark, "/root/testdata/sf0.001", queries.I.visits_both)
        for df in (seen[0], pool):
            assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_features_by_projection_equal_features_by_joins(spark, prepared):
    rows, _, preparation, _ = prepared
    from sitesieve.operators.visits import basic_columns

    pages = basic_columns(spark.createDataFrame(page_rows(40, 5), SCHEMA))
    local = features.transform_features(pages, preparation.features)
    joined = features.transform_features(pages, preparation.features, broadcast_terms=0)
    read = lambda df: {r["visit_id"]: r["extra_features"] for r in df.collect()}
    a, b = read(local), read(joined)
    assert len(a) == 40 and set(a) == set(b)
    assert all(a[k] == pytest.approx(b[k]) for k in a)


def test_model_beats_the_majority_class(prepared):
    _, _, _, model = prepared
    assert model.history[0]["score"] > 0.9 and len(model.history) == 2
    assert model.threshold is None


def test_prediction_columns_and_window_mean(spark, prepared):
    _, inputs, preparation, model = prepared
    pages = C.page_probabilities(model, inputs).select("visit_id", "windows", "extra_features", "probs").collect()
    assert all(sum(r["probs"]) == pytest.approx(1) for r in pages)
    # the mean over windows is what scoring each window as a page of its own gives
    single = inputs.select(
        F.col("visit_id"), F.posexplode("windows").alias("no", "w"), "extra_features"
    ).select("visit_id", F.array("w").alias("windows"), "extra_features")
    by_page = {}
    for r in C.page_probabilities(model, single).collect():
        by_page.setdefault(r["visit_id"], []).append(r["probs"])
    for r in pages:
        assert r["probs"] == pytest.approx(np.mean(by_page[r["visit_id"]], axis=0).tolist())
    out = C.predict(model, inputs, include_entropy=True)
    assert out.columns == ["visit_id", "predicted_label", "entropy", "true_label"]
    assert out.filter("entropy < 0 or entropy > ln(3)").isEmpty()


def test_prediction_needs_no_shuffle(spark, prepared):
    """Scan, segmentation, features, windows and scoring run as one stage."""
    rows, _, preparation, model = prepared
    pages = spark.createDataFrame(page_rows(20, 3), SCHEMA).drop("label")
    plan = C.predict(model, datasets.prepare_inputs(pages, preparation))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_binary_model_and_info(spark):
    rows = spark.createDataFrame(page_rows(90), SCHEMA).filter("label <> 'Blog'")
    grams = spark.createDataFrame([("shop", 50.0)], "gram string, n double")
    inputs, preparation = datasets.prepare_training(
        rows, grams, numeric=["nb_imgs"], components=0, window_size=16, fraction=0.3)
    model = C.fit_classifier(inputs, preparation.labels, candidates=[{"regParam": 0.1}], buckets=64)
    info = C.model_info(spark, model).first()
    assert (info["kind"], info["n_labels"]) == ("binary", 2) and 0 < info["threshold"] < 1
    assert C.predict(model, inputs).columns == ["visit_id", "prediction", "decision", "true_label"]
    assert model.history[0]["score"] > 0.9
    labelled = rounds.pseudo_labels(C.predict(model, inputs), preparation.labels)
    assert {r["label"] for r in labelled.collect()} <= {"News", "Shop"}


def test_rounds(spark, prepared):
    rows, inputs, preparation, model = prepared
    pool = spark.createDataFrame(page_rows(30, 8), SCHEMA).drop("label")
    unlabelled = datasets.prepare_inputs(pool, preparation).persist()
    fresh, models = rounds.self_distill(
        inputs, unlabelled, preparation.labels, candidates=[{"regParam": 0.1}], buckets=256, max_iter=10)
    assert len(models) == 3 and fresh.columns == ["visit_id", "label"] and fresh.count() > 20
    asked = rounds.most_uncertain(model, unlabelled, 5)
    entropies = [r["entropy"] for r in asked.collect()]
    assert len(entropies) == 5 and entropies == sorted(entropies, reverse=True)
    grown, rest = rounds.absorb_labels(rows, pool, asked.select("visit_id", F.lit("Shop").alias("label")))
    assert grown.count() == 95 and rest.count() == 25


def test_stored_bundle_predicts_the_same(spark, prepared, tmp_path):
    _, inputs, preparation, model = prepared
    state.save_bundle(spark, preparation, model, str(tmp_path / "bundle"))
    loaded, again = state.load_bundle(spark, str(tmp_path / "bundle"))
    assert (again.labels, again.threshold, again.history) == (model.labels, model.threshold, model.history)
    pages = spark.createDataFrame(page_rows(20, 4), SCHEMA).drop("label", "nb_imgs")
    first = C.predict(model, datasets.prepare_inputs(pages, preparation), True)
    second = C.predict(again, datasets.prepare_inputs(pages, loaded), True)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, second.collect()))


# --- requests and stream ------------------------------------------------------


def request(job, **changes):
    body = {
        "job_id": job, "model": "m", "domain_name": ["test1.de", "test2.de"],
        "body_text": ["buy cart", "my diary"], "meta_text": ["meta1", "meta2"], "visit_id": [], "external_hosts": [],
    }
    body.update(changes)
    return body


BAD = [
    ("body_text", ["only one"]), ("meta_text", ["meta2"]), ("visit_id", ["one"]), ("external_hosts", ["aaa"]),
]


def request_frame(spark, folder, bodies):
    folder.mkdir(exist_ok=True)
    for i, body in enumerate(bodies):
        (folder / f"r{i}.json").write_text(json.dumps(body))
    return requests.read_requests(spark, str(folder))


def test_request_defaults(spark, tmp_path):
    df = request_frame(spark, tmp_path / "in", [request("j")])
    got = [(r["pos"], r["visit_id"], r["external_hosts"]) for r in requests.explode_requests(df).collect()]
    assert got == [(0, "test1.de-0", []), (1, "test2.de-1", [])]
    assert requests.rejected_requests(df).isEmpty()


@pytest.mark.parametrize("field,value", BAD)
def test_requests_of_unequal_length_are_rejected(spark, tmp_path, field, value):
    df = request_frame(spark, tmp_path / "in", [request("j", **{field: value}), request("ok")])
    assert [(r["job_id"], r["reason"]) for r in requests.rejected_requests(df).collect()] == [
        ("j", f"{field} is not as long as domain_name")]
    assert {r["job_id"] for r in requests.explode_requests(df).collect()} == {"ok"}


def test_responses(spark):
    rows = spark.createDataFrame(
        [("j", 1, "b", "Y"), ("j", 0, "a", "X")], "job_id string, pos int, visit_id string, predicted_label string")
    assert json.loads(requests.fold_responses(rows).first()["response"]) == {"visit_id": ["a", "b"], "category": ["X", "Y"]}
    binary = rows.drop("predicted_label").withColumns({"prediction": F.lit(0.5), "decision": F.lit(True)})
    assert json.loads(requests.fold_responses(binary).first()["response"]) == {
        "visit_id": ["a", "b"], "prediction": [0.5, 0.5], "decision": [True, True]}


def test_no_request_vanishes(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [json.dumps(request("ok")), "no json", '{"job_id": "x", "model": "m"}', json.dumps(request("")), json.dumps(request("j", model=None))]
    (folder / "a.json").write_text("\n".join(lines), encoding="utf-8")
    df = requests.read_requests(spark, str(folder))
    refused = {(r["job_id"], r["reason"], r["bad_line"]) for r in requests.rejected_requests(df).collect()}
    assert refused == {
        (None, "unreadable line", "no json"), ("x", "no domain_name", None), ("", "no job_id", None), ("j", "no model", None)}
    assert {r["job_id"] for r in requests.explode_requests(df).collect()} == {"ok"}


def test_stream_equals_batch_and_repeats_are_harmless(spark, prepared, tmp_path):
    _, _, preparation, model = prepared
    bodies = [request("007"), request("1e3", visit_id=["x", "y"], external_hosts=["shop1.be blog2.be", ""]),
              request("bad", meta_text=[]), request("other", model="m2"), request("lost", model="none")]
    batch = request_frame(spark, tmp_path / "in", bodies)
    columns = ["job_id", "pos", "visit_id", "predicted_label"]
    rows = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    expected = {name: rows(stream.score_requests(batch.filter(F.col("model") == name), preparation, model)) for name in ("m", "m2")}
    assert [len(v) for v in expected.values()] == [4, 2]
    paths = [str(tmp_path / p) for p in ("results", "rejects", "checkpoint")]
    models = {name: (preparation, model) for name in expected}

    def run(checkpoint):
        query = stream.score_stream(
            stream.request_stream(spark, str(tmp_path / "in"), 1), models, paths[0], paths[1], checkpoint)
        query.awaitTermination()
        return {name: rows(stream.read_results(spark, paths[0], name)) for name in models}

    assert run(paths[2]) == expected
    # a second run from an empty checkpoint repeats the same batches
    assert run(paths[2] + "2") == expected
    assert {(r["job_id"], r["reason"]) for r in spark.read.parquet(paths[1]).collect()} == {
        ("bad", "meta_text is not as long as domain_name"), ("lost", "unknown model")}
    answers = {r["job_id"]: json.loads(r["response"]) for r in stream.responses(spark, paths[0], "m").collect()}
    assert set(answers) == {"007", "1e3"} and answers["1e3"]["visit_id"] == ["x", "y"]


# --- sources ------------------------------------------------------------------


def test_table_names_and_database_options(spark):
    for bad in ("a b", "x;drop", "", "a-b", "t)"):
        with pytest.raises(ValueError):
            tables.check_table_name(bad)
    assert tables.check_table_name("schema.visits_1") == "schema.visits_1"
    env = {"PG_HOST": "h", "PG_USER": "u", "PG_PASS": "p"}
    options = tables.database_options("PG", "pages", env)
    assert options["url"] == "jdbc:postgresql://h:5432/pages" and options["fetchsize"] == "1000"
    for missing in env:
        with pytest.raises(RuntimeError):
            tables.database_options("PG", "pages", {k: v for k, v in env.items() if k != missing})


def test_data_sets_from_named_tables(spark, tmp_path):
    spark.createDataFrame([("1", "A"), ("1", "B"), ("2", "Skip")], "visit_id string, label string").createOrReplaceTempView("some_visits")
    wide = spark.createDataFrame([("1", "a.be"), ("2", "b.be")], "visit_id string, domain_name string")
    from sitesieve.schemas import INTEGER_COLUMNS

    wide.withColumns({c: F.lit(1.0) for c in INTEGER_COLUMNS}).createOrReplaceTempView("page_table")
    x, y = str(tmp_path / "x"), str(tmp_path / "y")
    datasets.build_training_set(spark, ["some_visits"], "page_table", x, y)
    assert spark.read.parquet(x).count() == spark.read.parquet(y).count() == 3
    datasets.build_prediction_set(spark, ["some_visits", "some_visits"], "page_table", x)
    assert spark.read.parquet(x).count() == 6 and dict(spark.read.parquet(x).dtypes)[INTEGER_COLUMNS[0]] == "bigint"
    datasets.build_test_set(spark, ["some_visits"], "page_table", x, y)
    assert [(r["visit_id"], r["labels"]) for r in files.read_vote_lists(spark, y).collect()] == [("1", ["A", "B"])]
    assert [r["visit_id"] for r in spark.read.parquet(x).collect()] == ["1"]


def test_gram_files_and_window_tables(spark, tmp_path):
    (tmp_path / "grams.txt").write_text('the\t23135851162\n"quoted\t5\nof the\t2.5\n', encoding="utf-8")
    got = {r["gram"]: r["n"] for r in files.read_grams(spark, str(tmp_path / "grams.txt")).collect()}
    assert got == {"the": 23135851162.0, '"quoted': 5.0, "of the": 2.5}
    pages = spark.createDataFrame([("a", "train", "x y"), ("b", "val", "y " * 30)], "visit_id string, split string, text string")
    vocabulary = tokens.fit_vocabulary(pages, "text")
    rows = tokens.window_rows(tokens.with_windows(pages, vocabulary, "visit_id", "text", 8))
    path = str(tmp_path / "windows")
    files.write_windows(rows, path)
    files.write_windows(rows, path, append=True)
    stored = files.read_windows(spark, path, "val")
    assert stored.count() == 4 and files.windows_of(stored, "b").count() == 4
    plan = files.windows_of(stored, "b")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(visit_id), EqualTo(visit_id,b)]" in plan and "PartitionFilters: [isnotnull(split" in plan
