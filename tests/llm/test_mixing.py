"""Mixing: the query against SQL, targets against a plain reading, odd rows, and the emitted documents."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import connect, difference
from sitesieve.llm import mixing, queries, sql

SMALL = "/root/testdata/sf0.001"


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Shares by weight; what is above a limit is shared out again among the others, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        shares = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / shares for s in names}
        above = {s for s in names if s not in full and target[s] > most * sizes[s]}
        if not above:
            return target
        full |= above


def test_query_is_its_sql(spark):
    assert difference(connect(SMALL), sql.MIXING, queries.op12_mixing(spark, SMALL)) is None


def test_targets_of_odd_sources(spark):
    rng = np.random.default_rng(1)
    for _ in range(4):
        sizes = {s: int(rng.integers(0, 10 ** rng.integers(1, 6))) for s in ["b", "a", "", None, "Z", "é", "z", "𝒳", "aa"]}
        rows = [(s, n) for s, n in sizes.items()]
        sized = spark.createDataFrame(rows, "source string, size bigint")
        got = mixing.source_targets(sized.select(mixing.source_key(F.col("source")).alias("source_key"), "size")).collect()
        want = plain_targets(sizes)
        assert {r["source_key"]: r["target"] for r in got} == pytest.approx(
            {("1" if s is None else "0" + s): t for s, t in want.items()})
        assert sum(r["target"] for r in got) == pytest.approx(sum(sizes.values()))
        assert all(r["rate"] <= 3 for r in got)


def test_all_sources_at_their_limit(spark):
    sized = spark.createDataFrame([("0a", 10), ("0b", 30)], "source_key string, size bigint")
    assert {r["source_key"]: r["target"] for r in mixing.source_targets(sized, most=1).collect()} == {"0a": 10.0, "0b": 30.0}


def test_a_hot_source_of_many_documents_comes_near_its_target(spark):
    docs = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 40 + 1).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    plan = mixing.mix_plan(docs)
    sums = plan.groupBy("source_size", "target").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).collect()
    assert len(sums) == 8 and all(abs(r["taken"] - r["target"]) < 0.04 * r["target"] for r in sums)
    assert plan.filter("copies > 3").count() == 0
    assert Counter(map(tuple, plan.collect())) == Counter(map(tuple, mixing.mix_plan(docs.repartition(7)).collect()))


ODD = [(1, "one two", "a"), (1, "one two", "a"), (1, "other words", "a"), (2, None, "a"), (3, " \t ", None), (None, "no id", None),
       (None, None, None), (4, "w " * 5000, "long"), (5, "x\ty\x0bz", ""), (6, "nbsp stays one", "b")]


def test_odd_rows_and_clashing_columns(spark):
    schema = "doc_id bigint, text string, source string"
    docs = spark.createDataFrame(ODD, schema)
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == len(ODD)
    assert sorted(r["size"] for r in plan) == [0, 0, 0, 2, 2, 2, 2, 2, 3, 5000]
    assert all(r["copies"] == 0 for r in plan if r["size"] == 0)
    twins = [r["copies"] for r in plan if r["doc_id"] == 1 and r["size"] == 2]
    assert len(twins) == 3
    wide = spark.createDataFrame([r + (7, 8, 0.5, 9, 1, 0.1, 2) for r in ODD],
                                 schema + ", source_key int, size int, draw double, copies int, Copy int, rate double, target int")
    emitted = mixing.mix(wide)
    assert emitted.columns == wide.columns
    got = Counter((r["doc_id"], r["text"]) for r in emitted.collect())
    assert set(got) <= {(d, t) for d, t, _ in ODD if t and t.strip()}
    by_size = Counter()
    for r in emitted.collect():
        by_size[r["doc_id"]] += 1
    plan_copies = Counter()
    for r in plan:
        plan_copies[r["doc_id"]] += r["copies"]
    assert by_size == +plan_copies
    none = spark.createDataFrame([], schema)
    assert mixing.mix_plan(none).count() == 0 and mixing.mix(none).count() == 0


def test_no_python_on_the_main_path(spark):
    plan = mixing.mix(spark.read.parquet(f"{SMALL}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
