"""One query per operator over the standard tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, text
from ..operators import align, binary, confusion, ensemble, hosts, multiclass, numeric, prcurve, ranking
from ..operators import scoring, segment, split, subwords, tokens, visits
from ..operators import votes as V
from ..plans import classifier as C
from ..plans import datasets, rounds, skew
from ..session import cut_lineage, shared_folder, spread
from ..sources import requests as R
from ..sources import windowstore
from ..streaming import jobs
from ..streaming import requests as stream
from . import inputs as I

THRESHOLD = 0.98
IGNORED = ["Clean"]
# Labels of up to this many pages travel to the pages (some 140 bytes each).
MOST_LABELLED = 1_500_000
SCALED_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _r(column, name: str):
    return F.round(column, 6).alias(name)


# --- data sets --------------------------------------------------------------


def _visit_tables(s: SparkSession, d: str) -> list[DataFrame]:
    return [I.visits_quality(s, d), I.visits_toxic(s, d)]


def training_rows(s, d):
    return visits.training_rows(_visit_tables(s, d), I.narrow_features(s, d), ["nb_letters"])


def prediction_rows(s, d):
    return visits.prediction_rows(_visit_tables(s, d), I.narrow_features(s, d), ["nb_letters"])


def test_set_votes(s, d):
    votes = visits.testset_votes(_visit_tables(s, d), I.narrow_features(s, d), IGNORED)
    return votes.select("visit_id", "vote_ord.table_no", "label")


def test_set_lists(s, d):
    votes = visits.testset_votes(_visit_tables(s, d), I.narrow_features(s, d), IGNORED)
    return V.fold_votes(votes).select("visit_id", F.array_join("labels", "|").alias("labels"))


def test_set_pages(s, d):
    features = I.narrow_features(s, d)
    votes = visits.testset_votes(_visit_tables(s, d), features, IGNORED)
    return visits.testset_pages(votes, features, ["nb_letters"])


def normalise_columns(s, d):
    features = I.narrow_features(s, d).withColumns(
        {"nb_letters": F.col("nb_letters").cast("double"), "facebook_links": F.lit("x")}
    )
    return visits.normalise_columns(features, ["nb_letters"])


def drop_ignored_lists(s, d):
    lists = V.drop_ignored_from_lists(I.vote_lists(s, d), ["Skip", "Poor"])
    return lists.select("visit_id", F.array_join("labels", "|").alias("labels"))


def absorb_labels(s, d):
    labelled = I.visits_quality(s, d)
    pool = I.narrow_features(s, d).select("visit_id", "domain_name")
    fresh = I.visits_toxic(s, d)
    grown, rest = rounds.absorb_labels(labelled, pool, fresh)
    counts = grown.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(F.lit("labelled").alias("part"), "label", "n")
    left = rest.agg(F.count(F.lit(1)).alias("n")).select(F.lit("pool").alias("part"), F.lit("").alias("label"), "n")
    return counts.unionByName(left)


# --- votes and evaluation ---------------------------------------------------

_PAGE = ["visit_id", "n_votes", "n_labels", "top_votes", "top_label", "has_majority", "unanimous"]


def votes_majority(s, d):
    return V.summarise_pages(I.votes(s, d)).select(*_PAGE)


def list_majority(s, d):
    return V.summarise_pages(I.vote_lists(s, d)).select(*_PAGE)


def encode_binary_votes(s, d):
    tables = [I.visits_quality(s, d).withColumn("vote_ord", F.lit(0).cast("bigint"))]
    return binary.binary_pages(binary.encode_binary_votes(visits.union_visits(tables)))


def _metrics(df, *values):
    return df.select("population", "metric", F.coalesce("label", F.lit("")).alias("label"), *[_r(F.col(v), v) for v in values])


def multiclass_metrics(s, d):
    first, _, _ = I.model_predictions(s, d)
    return _metrics(multiclass.evaluate_multiclass(I.votes(s, d), first), "value")


def multiclass_metrics_lists(s, d):
    return _metrics(multiclass.evaluate_multiclass(I.vote_lists(s, d), I.list_predictions(s, d)), "value")


def inclusion_rate(s, d):
    rates = multiclass.inclusion_rates(I.votes(s, d), I.usual_predictions(s, d))
    return rates.select(*[_r(F.col(c), c) for c in rates.columns])


def compare_models(s, d):
    first, second, _ = I.model_predictions(s, d)
    return _metrics(multiclass.compare_multiclass(I.votes(s, d), first, second), "first", "second", "delta")


def _decided(scores):
    return scores.withColumn("decision", F.col("prediction") > THRESHOLD)


def binary_metrics(s, d):
    out = binary.evaluate_binary(I.binary_votes(s, d), _decided(I.binary_scores(s, d)))
    return out.select("population", "metric", _r(F.col("value"), "value"))


def compare_binary(s, d):
    out = binary.compare_binary(
        I.binary_votes(s, d), _decided(I.binary_scores(s, d)), _decided(I.mean_scores(s, d))
    )
    return out.select("population", "metric", *[_r(F.col(c), c) for c in ("first", "second", "delta")])


def pr_curve(s, d):
    out = prcurve.pr_curve(I.binary_votes(s, d), I.binary_scores(s, d))
    return out.select(*[_r(F.col(c), c) for c in ("threshold", "precision", "recall")])


def pr_summary(s, d):
    out = prcurve.pr_summary(I.binary_votes(s, d), I.binary_scores(s, d))
    return out.select(*[_r(F.col(c), c) for c in out.columns])


def confusion_table(s, d):
    first, _, _ = I.model_predictions(s, d)
    out = confusion.confusion_table(I.votes(s, d), first)
    return out.withColumn("percent", F.round("percent", 6))


def confusion_matrix(s, d):
    first, _, _ = I.model_predictions(s, d)
    wide = confusion.confusion_matrix(
        confusion.confusion_table(I.votes(s, d), first), ["click", "error", "purchase", "signup", "view"]
    )
    return wide.select("true_label", *[_r(F.col(c), c) for c in wide.columns if c != "true_label"])


def confusion_binary(s, d):
    return binary.confusion_binary(I.binary_votes(s, d), _decided(I.binary_scores(s, d)))


# --- predictions ------------------------------------------------------------


def unmatched_pages(s, d):
    """Voted pages and pages of a model that has seen only some days: counts and key sets, from the join itself."""
    pages = V.summarise_pages(I.votes(s, d)).select("visit_id", "top_label")
    first, _, _ = I.model_predictions(s, d)
    some = first.filter(~F.col("visit_id").endswith("1")).unionByName(
        first.filter(F.col("visit_id").endswith("2")).withColumn("visit_id", F.concat("visit_id", F.lit("x"))))
    seen = Observation()
    agreeing = align.counted(pages, some, seen).agg(F.count_if(F.col("top_label") == F.col("predicted_label")).alias("n")).first()["n"]
    got = seen.get
    row = (got["matched"], got["only_left"], got["only_right"], str(got["left_keys"]), str(got["right_keys"]), agreeing)
    return s.createDataFrame([row], "matched long, only_votes long, only_predictions long, vote_keys string, prediction_keys string, agreeing long")


def label_distribution(s, d):
    first, _, _ = I.model_predictions(s, d)
    return ensemble.label_distribution(first).withColumn("percent", F.round("percent", 6))


def combine_predictions(s, d):
    return ensemble.combine_predictions(I.model_predictions(s, d))


def combine_majority_only(s, d):
    return ensemble.combine_predictions(I.model_predictions(s, d), majority_only=True)


def combine_decisions(s, d):
    high, low = _decided(I.binary_scores(s, d)), _decided(I.mean_scores(s, d))
    middle = high.withColumn("decision", F.col("prediction") > 0.99)
    return ensemble.combine_predictions([high, low, middle])


def _entropies(s, d):
    probs = arrays.softmax(F.col("logits"))
    return I.logits(s, d).select(F.col("vec_id").cast("string").alias("visit_id"), arrays.entropy(probs).alias("entropy"))


def rank_uncertain(s, d):
    return ranking.rank_uncertain(_entropies(s, d)).withColumn("entropy", F.round("entropy", 6))


def top_uncertain(s, d):
    return ranking.rank_uncertain(_entropies(s, d), take=50).withColumn("entropy", F.round("entropy", 6))


def recombine_windows(s, d):
    windows = I.logits(s, d).select(
        F.floor(F.col("vec_id") / 2).alias("page_id"), arrays.softmax(F.col("logits")).alias("probs")
    )
    pages = scoring.recombine_windows(windows, "page_id")
    return pages.select(
        "page_id", arrays.argmax(F.col("probs")).cast("bigint").alias("class_index"),
        _r(F.array_max("probs"), "top_probability"), _r(arrays.entropy(F.col("probs")), "entropy"),
    )


def binary_decisions(s, d):
    scores = I.binary_scores(s, d)
    probs = F.array(1.0 - F.col("prediction"), F.col("prediction"))
    out = scoring.to_predictions(
        scores.select("visit_id", probs.alias("probs")), ["No", "Yes"], threshold=THRESHOLD
    )
    return out.withColumn("prediction", F.round("prediction", 6))


# --- text and tokens --------------------------------------------------------


def domain_strip(s, d):
    names = I.hosts_of_pages(s, d).unionByName(I.narrow_features(s, d).select("visit_id", "domain_name"))
    stripped = text.strip_last_label(F.col("domain_name"))
    return names.select(
        "visit_id", "domain_name", stripped.alias("stripped"), text.letters_and_digits(stripped).alias("clean")
    )


def hosts_join(s, d):
    pages = I.page_features(s, d)
    return pages.select("visit_id", text.join_list(F.col("external_hosts")).alias("hosts"))


def count_tag(s, d):
    pages = I.table(s, d, "pages")
    return pages.select(
        "page_id", text.count_tag(F.col("html"), "<").alias("n_open"), text.count_tag(F.col("html"), "p").alias("n_p")
    )


def model_text(s, d):
    pages = I.narrow_features(s, d).withColumn("domain_segmented", text.strip_last_label(F.col("domain_name")))
    return visits.with_model_text(pages).select("visit_id", "model_text")


def text_chunks(s, d):
    words = F.split("text", " ")
    parts = I.documents(s, d).select("doc_id", F.posexplode(arrays.chunks(words, 100)).alias("chunk_no", "part"))
    return parts.select(
        "doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"),
        F.size("part").cast("bigint").alias("n"), F.array_join("part", " ").alias("chunk"),
    )


def vocabulary(s, d):
    return tokens.fit_vocabulary(I.documents(s, d), "text").select(
        "token", "n", F.col("token_id").cast("bigint").alias("token_id")
    )


def token_windows(s, d):
    docs = I.documents(s, d)
    return _window_sums(tokens.with_windows(docs, tokens.fit_vocabulary(docs, "text"), "doc_id", "text"))


def token_windows_joined(s, d):
    """The way of a vocabulary that is too large for a broadcast."""
    docs = I.documents(s, d)
    return _window_sums(tokens.with_windows(docs, tokens.fit_vocabulary(docs, "text"), "doc_id", "text", limit=0))


def subword_windows(s, d):
    """Windows of a fixed subword vocabulary: no unknown tokens, and no branch by the vocabulary's size."""
    return _window_sums(subwords.SubwordWindows(subwords.read_subwords(s, I.SUBWORDS)).add(I.documents(s, d), "doc_id", "text"))


def subword_vocabulary(s, d):
    """How often the texts use each piece."""
    counts = subwords.count_subwords(I.documents(s, d), subwords.read_subwords(s, I.SUBWORDS))
    return counts.select(F.col("token_id").cast("bigint").alias("token_id"), F.hex("piece").alias("piece"), "n")


def _window_sums(pages):
    rows = tokens.window_rows(pages)
    ids, zero = F.col("input_ids"), F.lit(0).cast("bigint")
    weighted = F.transform(ids, lambda t, i: t.cast("bigint") * (i + 1))
    return rows.select(
        "doc_id", F.col("window_no").cast("bigint").alias("window_no"),
        F.aggregate("attention_mask", zero, lambda a, x: a + x).alias("n_visible"),
        F.size(ids).cast("bigint").alias("width"),
        F.element_at(ids, 2).cast("bigint").alias("second_id"),
        F.aggregate(weighted, zero, lambda a, x: a + x).alias("checksum"),
    )


def gram_counts(s, d):
    return tokens.count_grams(I.documents(s, d), "text")


def _grams(s, d):
    grams = cut_lineage(tokens.count_grams(I.documents(s, d), "text"))
    return grams, grams.filter(F.instr("gram", " ") == 0).agg(F.sum("n").alias("n")).first()["n"]


def segment_domains(s, d):
    return segment.segment_domains(I.hosts_of_pages(s, d), *_grams(s, d))


def segment_domains_filtered(s, d):
    """The way of a gram table that is too large for a broadcast: its filter first."""
    return segment.segment_domains(I.hosts_of_pages(s, d), *_grams(s, d), broadcast_grams=0)


def segment_domains_lists(s, d):
    """The way of names that need more grams than a broadcast may hold."""
    return segment.segment_domains(I.hosts_of_pages(s, d), *_grams(s, d), broadcast_grams=0, broadcast_found=0)


def window_store(s, d):
    """Two committed appends with one between them that never is, then one row in seven by its number."""
    store = windowstore.WindowStore(s, f"{shared_folder(s)}/windows-{uuid.uuid4().hex}")
    chunks = text_chunks(s, d)
    even = F.col("doc_id") % 2 == 0
    store.append(chunks.filter(even), ["doc_id", "chunk_no"])
    chunks.write.parquet(f"{store.path}/data/00000001-broken")
    store.append(chunks.filter(~even), ["doc_id", "chunk_no"])
    numbers = s.range(0, len(store), 7).select(F.col("id").alias("row_no"))
    return store.take(numbers).select("row_no", "doc_id", "chunk_no", "n", "chunk")


# --- features ---------------------------------------------------------------


def _measures(s, d):
    columns = ["l_orderkey", "l_partkey", *SCALED_COLUMNS]
    rows = spread(I.table(s, d, "lineitem").select(*columns), "l_orderkey")
    return rows.withColumn("l_discount", F.nullif("l_discount", F.lit(0.0)))


def numeric_state(s, d):
    state = numeric.fit_numeric(_measures(s, d), SCALED_COLUMNS)
    rows = [(r["name"], float(r["median"]), float(r["mean"]), float(r["std"])) for r in state]
    out = s.createDataFrame(rows, "name string, median double, mean double, std double")
    return out.select("name", *[_r(F.col(c), c) for c in ("median", "mean", "std")])


def impute_scale(s, d):
    rows = _measures(s, d)
    state = numeric.fit_numeric(rows, SCALED_COLUMNS)
    values = numeric.scaled(rows, state)
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        *[F.round(c, 6).alias(f"z_{n}") for n, c in zip(SCALED_COLUMNS, values)],
    )


def tfidf(s, d):
    pages = I.documents(s, d).select("doc_id", F.col("text").alias("hosts"))
    counts = cut_lineage(hosts.term_counts(pages, "doc_id"))
    idf = cut_lineage(hosts.fit_idf(counts, pages.count()))
    return hosts.tfidf(counts, idf, "doc_id").withColumn("w", F.round("w", 6))


def host_idf(s, d):
    counts, n_pages = I.linked_suppliers(s, d)
    return hosts.fit_idf(counts, n_pages).withColumn("idf", F.round("idf", 6))


def host_svd(s, d):
    counts, n_pages = I.linked_suppliers(s, d)
    counts = cut_lineage(counts)
    idf = cut_lineage(hosts.fit_idf(counts, n_pages))
    entries = cut_lineage(hosts.tfidf(counts, idf, "visit_id"))
    space = hosts.fit_svd(entries, "visit_id", idf)
    return hosts.project(entries, space.vectors, "visit_id", idf.select("term", F.col("df").alias("n")))


def stratified_split(s, d):
    rows = split.stratified_split(I.visits_both(s, d), ["visit_id"])
    return rows.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


def label_index(s, d):
    out = datasets.label_dictionary(I.votes(s, d))
    return out.withColumn("label_index", F.col("label_index").cast("bigint"))


# --- models -----------------------------------------------------------------


def _prepared(s: SparkSession, d: str, visits_of) -> tuple[DataFrame, datasets.Preparation, DataFrame]:
    """Prepared labelled pages, the fitted preparation, and all unlabelled pages."""
    features = I.page_features(s, d)
    visits_made = visits_of(s, d)
    # pages stay where they are while the labels fit a checked broadcast
    rows = skew.lookup_join(features, visits_made, "visit_id", broadcast_rows=MOST_LABELLED, heavy=None)
    grams = cut_lineage(tokens.count_grams(I.documents(s, d), "text"))
    total = grams.filter(F.instr("gram", " ") == 0).agg(F.sum("n").alias("n")).first()["n"]
    inputs, preparation = datasets.prepare_training(
        rows, grams, numeric=["nb_letters"], gram_total=total,
    )
    labelled = visits_made.select("visit_id").distinct()
    if skew.fits_broadcast(labelled, MOST_LABELLED):
        labelled = F.broadcast(labelled)
    pool = features.join(labelled, "visit_id", "left_anti")
    return cut_lineage(inputs), preparation, pool


def fit_predict(s, d):
    inputs, preparation, pool = _prepared(s, d, I.visits_both)
    model = C.fit_classifier(inputs, preparation.labels)
    return C.predict(model, datasets.prepare_inputs(pool, preparation), include_entropy=True)


def model_info(s, d):
    inputs, preparation, _ = _prepared(s, d, I.visits_quality)
    info = C.model_info(s, C.fit_classifier(inputs, preparation.labels))
    return info.select("kind", "n_labels", F.col("threshold").between(0.0, 1.0).alias("has_threshold"))


def self_distill(s, d):
    inputs, preparation, pool = _prepared(s, d, I.visits_both)
    unlabelled = datasets.prepare_inputs(pool, preparation)
    fresh, _ = rounds.self_distill(inputs, unlabelled, preparation.labels)
    grown, _ = rounds.absorb_labels(I.visits_both(s, d), pool, fresh)
    return grown


def active_round(s, d):
    inputs, preparation, pool = _prepared(s, d, I.visits_both)
    model = C.fit_classifier(inputs, preparation.labels)
    return rounds.most_uncertain(model, datasets.prepare_inputs(pool, preparation), 100)


# --- requests ---------------------------------------------------------------


def explode_requests(s, d):
    rows = R.explode_requests(I.requests(s, d))
    return rows.withColumns(
        {"external_hosts": F.array_join("external_hosts", " "), "pos": F.col("pos").cast("bigint")}
    )


def rejected_requests(s, d):
    return R.rejected_requests(I.requests(s, d))


def fold_responses(s, d):
    rows = R.explode_requests(I.requests(s, d))
    scored = rows.select(
        "job_id", "pos", "visit_id", F.concat(F.lit("L"), (F.length("body_text") % 3).cast("string")).alias("predicted_label")
    )
    return R.fold_responses(scored)


def score_stream(s, d):
    inputs, preparation, _ = _prepared(s, d, I.visits_both)
    model = C.fit_classifier(inputs, preparation.labels)
    base = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    I.requests(s, d).write.mode("overwrite").json(f"{base}/in")
    query = stream.score_stream(
        stream.request_stream(s, f"{base}/in"), {"m1": (preparation, model), "m2": (preparation, model)},
        f"{base}/results", f"{base}/rejects", f"{base}/checkpoint",
    )
    query.awaitTermination()
    parts = [stream.read_results(s, f"{base}/results", m).drop("batch_id").withColumn("model", F.lit(m)) for m in ("m1", "m2")]
    return parts[0].unionByName(parts[1])


def stream_responses(s, d):
    """Responses of a stream of request files: some jobs come in two parts, all requests come twice, in two runs."""
    base = f"{shared_folder(s)}/jobs-{uuid.uuid4().hex}"
    wanted = I.requests(s, d)

    def run():
        read = stream.request_stream(s, f"{base}/in")
        label = F.concat(F.lit("L"), (F.length("body_text") % 3).cast("string"))
        pages = R.explode_requests(read, counted=True).withColumn("predicted_label", label)
        # every third page of every second job waits for the second run
        late = (F.crc32("job_id") % 2 == 0) & (F.col("pos") % 3 == 1)
        seen = pages.filter(~late | F.lit(len(runs) > 0))
        jobs.start_responses(
            jobs.job_events(seen, R.rejected_requests(read)), f"{base}/responses", f"{base}/checkpoint"
        ).awaitTermination()
        runs.append(True)

    runs = []
    for _ in range(2):
        wanted.write.mode("append").json(f"{base}/in")
        run()
    return s.read.schema(jobs.RESPONSES).parquet(f"{base}/responses").select("job_id", "status", "part", "response")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        training_rows, prediction_rows, test_set_votes, test_set_lists, test_set_pages,
        normalise_columns, drop_ignored_lists, absorb_labels, votes_majority, list_majority,
        encode_binary_votes, multiclass_metrics, multiclass_metrics_lists, inclusion_rate,
        compare_models, binary_metrics, compare_binary, pr_curve, pr_summary, confusion_table,
        confusion_matrix, confusion_binary, unmatched_pages, label_distribution, combine_predictions,
        combine_majority_only, combine_decisions, rank_uncertain, top_uncertain,
        recombine_windows, binary_decisions, domain_strip, hosts_join, count_tag, model_text,
        text_chunks, window_store, vocabulary, token_windows, token_windows_joined, subword_windows, subword_vocabulary, gram_counts, segment_domains,
        segment_domains_filtered, segment_domains_lists, numeric_state,
        impute_scale, tfidf, host_idf, host_svd, stratified_split, label_index, fit_predict,
        model_info, self_distill, active_round, explode_requests, rejected_requests,
        fold_responses, score_stream, stream_responses,
    )
}
