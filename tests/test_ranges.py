"""Planned database reads, without a server: the texts asked, conditions that part all rows, and who uses them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sitesieve.plans import datasets
from sitesieve.schemas import INTEGER_COLUMNS
from sitesieve.sources import ranges


@pytest.fixture()
def base():
    con = duckdb.connect()
    con.execute("CREATE SCHEMA s")
    con.execute("CREATE TABLE s.visits AS SELECT CAST(i * 7 % 1000 AS VARCHAR) visit_id, 'L' || i % 3 AS label FROM range(1000) t(i)")
    con.execute("INSERT INTO s.visits VALUES (NULL, 'none'), ('it''s', 'quote'), ('é', 'accent')")
    con.execute("CREATE TABLE s.more AS SELECT 'hot' visit_id, 'H' AS label FROM range(500)")
    con.execute("CREATE TABLE s.pages AS SELECT DISTINCT visit_id, length(visit_id) nb FROM (FROM s.visits UNION ALL FROM s.more)")
    return con


def asked(con):
    """The database's answers; its own words for an ordered set of texts and for quantiles of texts."""

    def fetch(sql):
        plain = sql.replace('COLLATE "C"', "")
        if "percentile_disc" in plain:
            shares = plain[plain.index("ARRAY[") + 5 : plain.index("])") + 1]
            keys = plain[plain.index("FROM (") + 5 :]
            return con.execute(f"SELECT unnest(quantile_disc(visit_id, {shares})) FROM {keys}").fetchall()
        return con.execute(plain).fetchall()

    return fetch


def test_ranges_part_all_rows(base):
    keys = ranges.keys_subquery(["s.visits", "s.more"])
    conditions = ranges.plan_ranges(keys, "visit_id", asked(base), rows_per_range=100)
    assert 8 <= len(conditions) <= 16  # the hot key is one range, not several empty ones
    plain = [c.replace(' COLLATE "C"', "") for c in conditions]
    counts = [base.execute(f"SELECT count(*) FROM ({keys}) k WHERE {c}").fetchone()[0] for c in plain]
    assert sum(counts) == 1503 and max(counts) <= 700 and min(counts) > 0
    assert ranges.plan_ranges(keys, "visit_id", asked(base)) == ["1 = 1"]


def test_conditions():
    assert ranges.range_predicates("k", []) == ["1 = 1"]
    assert ranges.range_predicates("k", [20, 10, 10, None]) == ["k < 10 OR k IS NULL", "k >= 10 AND k < 20", "k >= 20"]
    first, last = ranges.range_predicates("k", ["it's"])
    assert first.startswith("CAST(k AS text)") and first.endswith("< 'it''s' OR k IS NULL") and last.endswith(">= 'it''s'")
    for bad in ("a b", "x;drop"):
        with pytest.raises(ValueError):
            ranges.range_predicates(bad, [1])
        with pytest.raises(ValueError):
            ranges.joined_subquery([bad], "f")
    with pytest.raises(TypeError):
        ranges.literal(b"x")


def test_the_database_joins(base):
    rows = base.execute(ranges.joined_subquery(["s.visits", "s.more"], "s.pages")).fetchall()
    assert len(rows) == 1502 and sum(r[-1] == 1 for r in rows) == 500  # a null id meets nothing
    assert len(base.execute(ranges.joined_subquery(["s.more"], "s.pages", labelled=False)).description) == 3


def test_commands_read_in_ranges(spark, tmp_path, monkeypatch):
    seen = {}

    def read(session, subquery, predicates, options):
        seen.update(subquery=subquery, predicates=predicates, url=options["url"])
        rows = session.createDataFrame([("1", "a.be", "A", 0), ("2", "b.be", "B", 1)], "visit_id string, domain_name string, label string, table_no int")
        rows = rows if "label" in subquery else rows.drop("label")
        return rows.withColumns({c: F.lit(1.0) for c in INTEGER_COLUMNS})

    monkeypatch.setattr(ranges, "read_ranges", read)
    monkeypatch.setattr(ranges, "database_fetch", lambda s, o: lambda sql: [(3_500_000,)] if sql.startswith("SELECT count") else [("1",), ("2",), ("2",)])
    options = {"url": "jdbc:postgresql://h/x", "user": "u"}
    x, y = str(tmp_path / "x"), str(tmp_path / "y")
    datasets.build_training_set(spark, ["s.v", "s.w"], "s.f", x, y, options)
    assert len(seen["predicates"]) == 3 and "JOIN s.f h" in seen["subquery"] and "1 AS table_no FROM s.w" in seen["subquery"]
    assert {(r["visit_id"], r["label"]) for r in spark.read.parquet(y).collect()} == {("1", "A"), ("2", "B")}
    datasets.build_prediction_set(spark, ["s.v"], "s.f", x, options)
    assert "label" not in spark.read.parquet(x).columns and spark.read.parquet(x).count() == 2
