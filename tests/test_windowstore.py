"""The window store: committed appends, rows by number, and writers in each other's way."""

import pytest
from pyspark.sql import functions as F

from sitesieve.sources.windowstore import AppendConflict, WindowStore


def test_rows_by_number_over_appends(spark, tmp_path):
    store = WindowStore(spark, str(tmp_path / "store"))
    assert store.commits() == [] and len(store) == 0
    with pytest.raises(IndexError):
        store.row(0)
    numbers = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.array("id", "id").alias("ids"))
    assert store.append(numbers.repartition(5), ["k"]) == 0
    spark.range(50).select(F.col("id").alias("k"), F.array("id").alias("ids")).write.parquet(f"{store.path}/data/00000001-broken")
    assert len(store) == 1000  # what is not committed is not there
    more = spark.range(30).select((F.col("id") + 5000).alias("k"), F.array("id").alias("ids"))
    assert store.append(more, ["k"]) == 1
    assert len(store) == 1030
    assert [store.row(n).first()["k"] for n in (0, 567, 999, 1000, 1029)] == [0, 567, 999, 5000, 5029]
    assert sorted(r["k"] for r in store.between(997, 1002).collect()) == [997, 998, 999, 5000, 5001]
    assert sorted((r["row_no"], r["k"]) for r in store.read().select("row_no", "k").collect())[1000:1002] == [(1000, 5000), (1001, 5001)]
    assert len(store.row(567).inputFiles()) == 1 < len(store.read().inputFiles())
    with pytest.raises(IndexError):
        store.row(1030)


def test_one_of_two_writers_wins(spark, tmp_path):
    first, second = (WindowStore(spark, str(tmp_path / "store")) for _ in range(2))
    seen = len(second.commits())
    first.append(spark.range(3), ["id"])
    with pytest.raises(AppendConflict):
        second.append(spark.range(100, 103), ["id"], expected=seen)
    assert sorted(r["id"] for r in second.read().collect()) == [0, 1, 2]
    # a writer that lost between looking and creating the commit
    with pytest.raises(AppendConflict):
        second._commit(0, "x")
    second.append(spark.range(100, 103), ["id"])
    assert len(first) == 6 and first.row(4).first()["id"] == 101
