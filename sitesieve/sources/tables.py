"""Tables of a database or of the session catalog."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

_TABLE_NAME = re.compile(r"[\w_.]+")


def check_table_name(name: str) -> str:
    """Allow letters, digits, underscores and dots only."""
    if not _TABLE_NAME.fullmatch(name):
        raise ValueError(f"not a table name: {name!r}")
    return name


def database_options(
    prefix: str,
    database: str = "postgres",
    env: Mapping[str, str] | None = None,
    fetch_rows: int = 1000,
) -> dict[str, str]:
    """JDBC options from `<prefix>_HOST`, `_PORT`, `_DB`, `_USER` and `_PASS`.

    Host, user and password are required; the port defaults to 5432. `fetch_rows`
    bounds what the driver library buffers per round trip.
    """
    env = os.environ if env is None else env

    def required(name: str) -> str:
        value = env.get(f"{prefix}_{name}")
        if value is None:
            raise RuntimeError(f"environment variable {prefix}_{name} is not set")
        return value

    host, user, password = required("HOST"), required("USER"), required("PASS")
    port = env.get(f"{prefix}_PORT") or "5432"
    name = env.get(f"{prefix}_DB") or database
    return {
        "url": f"jdbc:postgresql://{host}:{port}/{name}",
        "user": user,
        "password": password,
        "driver": "org.postgresql.Driver",
        "fetchsize": str(fetch_rows),
    }


def read_table(
    spark: SparkSession,
    name: str,
    options: Mapping[str, str] | None = None,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 64,
) -> DataFrame:
    """A catalog table or view, or a database table when JDBC `options` are given.

    With a numeric partition column and its bounds the database is read in
    parallel ranges; filters and column lists are pushed down by Spark.
    """
    check_table_name(name)
    if options is None:
        return spark.table(name)
    reader = spark.read.format("jdbc").options(**options).option("dbtable", name)
    if partition_column is not None:
        if bounds is None:
            raise ValueError("a partition column needs bounds")
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", str(bounds[0])).option("upperBound", str(bounds[1]))
            .option("numPartitions", str(partitions))
        )
    return reader.load()
