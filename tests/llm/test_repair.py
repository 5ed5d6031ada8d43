"""Conversation repair: tables against an exhaustive search, the query against SQL, and conversations in many pieces."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import connect, difference
from sitesieve.llm import queries, repair, sql

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def cheapest(rows):
    """(cost, audit, repaired rows) by trying all edits; `rows` are (role, text, fault)."""
    best = {0: (0, "", ())}

    def inserted(ways):
        out = dict(ways)
        for _ in range(3):
            for place, (cost, audit, made) in list(out.items()):
                to, role = (3, "assistant") if place == 2 else (2, "user")
                way = (cost + 2, audit + "I", made + (f"{role}:",))
                out[to] = min(out.get(to, way), way)
        return out

    for role, text, fault in rows:
        after = {}

        def offer(place, way):
            after[place] = min(after.get(place, way), way)

        for place, (cost, audit, made) in inserted(best).items():
            offer(place, (cost + 3, audit + "D", made))
            if fault in (1, 2):
                continue
            extra = fault == 3
            to, new = (3, "assistant") if place == 2 else (2, "user")
            offer(to, (cost + 2 + extra, audit + "R", made + (f"{new}:{text}",)))
            kept = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(role[:1], {}).get(place)
            if kept is not None:
                offer(kept, (cost + extra, audit + "K", made + (f"{role}:{text}",)))
        best = after
    return min(w for p, w in inserted(best).items() if p in (0, 3))


def test_tables_are_an_exhaustive_search():
    rng, t = random.Random(1), repair.tables()
    for _ in range(3000):
        rows = [(rng.choice(["user", "assistant", "system", "tool", " "]), f"t{i}", rng.choice([0, 0, 0, 1, 2, 3]))
                for i in range(rng.randrange(0, 24))]
        symbols = repair.symbols_of([r for r, _, _ in rows], np.array([f for _, _, f in rows], np.int64))
        letters, place, cost = t.trace(symbols, t.end, repair.START)
        audit = "".join(letters) + t.closing[place]
        roles, texts = repair._lines(letters, t.closing[place], repair.START, [r for r, _, _ in rows], [x for _, x, _ in rows])
        made = tuple(f"{r}:{x}" for r, x in zip(roles, texts))
        assert (cost, audit, made) == cheapest(rows), rows


def test_effects_of_pieces_put_together_are_the_whole():
    rng, t = np.random.default_rng(2), repair.tables()
    for _ in range(300):
        symbols = rng.integers(0, repair.SYMBOLS, rng.integers(0, 40))
        cuts = np.sort(rng.integers(0, len(symbols) + 1, 3))
        parts = np.split(symbols, cuts)
        vector, total, behind = t.end, 0, []
        for part in reversed(parts):
            after, amount, _ = t.effect(part)
            behind.append(vector)
            total, vector = total + amount[vector], after[vector]
        place, letters = repair.START, []
        for part, v in zip(parts, reversed(behind)):
            got, to, _ = t.trace(part, v, place)
            assert to == t.effect(part)[2][v * repair.PLACES + place]
            letters, place = letters + got, to
        whole = t.trace(symbols, t.end, repair.START)
        assert (letters, place, total + t.vectors[vector][repair.START]) == whole


def test_query_is_its_sql(spark):
    assert difference(connect(SMALL), sql.REPAIR, queries.op13_repair(spark, SMALL)) is None


def odd_rows(seed=7):
    rng = random.Random(seed)
    texts = ["Yes.", "yes", "No!", "  ", "", None, "é。", "cut off,", "really?\n", "tab.\t\x0b", "nbsp. ", "sep. "]
    rows = []
    for conv in [None, *range(40)]:
        for i in range(rng.randrange(1, 30)):
            turn = rng.choice([None, i, i, i + rng.randrange(3), 5])
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", None, "u", "", "User"]), rng.choice(texts)))
    rows += [(1000, i, "user" if i % 2 == 0 else "assistant", f"line {i}" + "." * (i % 3 > 0)) for i in range(250)]
    rows += [(1001, 3, "user", "the very same.")] * 60 + [(1002, i, "user", "the same again.") for i in range(70)]
    return rows


@pytest.fixture(scope="module")
def odd_folder(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(odd_rows(), SCHEMA).coalesce(1).write.parquet(str(folder / "conversations.parquet"))
    return str(folder)


def odd_sql(folder):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    return con


def test_odd_rows_are_the_sql(spark, odd_folder):
    assert difference(odd_sql(odd_folder), sql.REPAIR, queries.op13_repair(spark, odd_folder)) is None


def test_conversations_in_many_pieces_are_the_sql(spark, odd_folder):
    rows = queries.damaged(spark.read.parquet(f"{odd_folder}/conversations.parquet"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        made = repair.Repair(rows, piece_rows=8)
        assert made.parts.groupBy("conv_id").count().agg(F.max("count")).first()[0] > 10
        assert difference(odd_sql(odd_folder), sql.REPAIR, made.report()) is None
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def test_rows_of_the_repair(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi!"), (1, 2, "user", "Hi!"), (2, 0, "system", "Be kind."), (3, None, None, None)]
    made = repair.Repair(spark.createDataFrame([r + ("x",) for r in rows], SCHEMA + ", key string"))
    got = {}
    for r in made.rows().orderBy("conv_id", "piece", "at").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert got == {1: [("user", ""), ("assistant", "Hello."), ("user", "Hi!"), ("assistant", "")]}
    report = {r["conv_id"]: r for r in made.report().collect()}
    assert set(report) == {1, 2, 3}
    assert report[2]["audit"] == "D" and report[3]["audit"] == "D" and report[3]["gaps"] == 0
    empty = hashlib.sha256(b"").hexdigest()
    assert report[2]["repaired_sha256"] == report[3]["repaired_sha256"] == empty
    assert report[1]["duplicate"] == 1 and report[1]["audit"] == cheapest([("assistant", "Hello.", 0), ("user", "Hi!", 0), ("user", "Hi!", 2)])[1]


def test_empty_table(spark):
    made = repair.Repair(spark.createDataFrame([], SCHEMA))
    assert made.report().count() == 0 and made.rows().count() == 0
