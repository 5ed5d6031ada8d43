"""Parallel reads of a database: the database joins visits and features, and is read in ranges of equal size.

The join is a subquery on the database's side, so only the rows that are wanted cross the wire. The bounds of the
ranges are quantiles that the database works out over that subquery's key; every range is one predicate and one
connection. Ranges cover all rows once: below the first bound with null keys, between two bounds, from the last one on.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from .tables import check_table_name

# Rows that one connection should read, about.
ROWS_PER_RANGE = 1_000_000
MOST_RANGES = 1_000
Fetch = Callable[[str], list[tuple]]


def joined_subquery(visit_tables: list[str], features: str, labelled: bool = True) -> str:
    """SQL of the rows of all visit tables with the features of their pages, each table numbered."""
    label = ", v.label" if labelled else ""
    inner = " UNION ALL ".join(
        f"SELECT CAST(visit_id AS text) AS visit_id{', label' if labelled else ''}, {number} AS table_no FROM {check_table_name(name)}"
        for number, name in enumerate(visit_tables)
    )
    return (
        f"SELECT h.*{label}, v.table_no FROM ({inner}) v "
        f"JOIN {check_table_name(features)} h ON CAST(h.visit_id AS text) = v.visit_id"
    )


def keys_subquery(visit_tables: list[str]) -> str:
    """SQL of the keys that the join is read by."""
    return " UNION ALL ".join(f"SELECT CAST(visit_id AS text) AS visit_id FROM {check_table_name(n)}" for n in visit_tables)


def bounds_query(keys: str, column: str, ranges: int) -> str:
    """SQL of the inner bounds of ranges that hold equally many keys."""
    shares = ", ".join(repr(i / ranges) for i in range(1, ranges))
    return f'SELECT unnest(percentile_disc(ARRAY[{shares}]) WITHIN GROUP (ORDER BY {check_table_name(column)} COLLATE "C")) AS bound FROM ({keys}) k'


def count_query(keys: str) -> str:
    return f"SELECT count(*) AS n FROM ({keys}) k"


def literal(value) -> str:
    """A bound as SQL; texts are quoted."""
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        raise TypeError(f"no bound: {value!r}")
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def range_predicates(column: str, bounds: list) -> list[str]:
    """One condition per range; together they hold for every row once. Equal bounds (a hot key) make one."""
    column = check_table_name(column)
    inner = sorted({b for b in bounds if b is not None})
    if not inner:
        return ["1 = 1"]
    text = f'CAST({column} AS text) COLLATE "C"' if isinstance(inner[0], str) else column
    marks = [literal(b) for b in inner]
    between = [f"{text} >= {a} AND {text} < {b}" for a, b in zip(marks, marks[1:])]
    return [f"{text} < {marks[0]} OR {column} IS NULL", *between, f"{text} >= {marks[-1]}"]


def plan_ranges(keys: str, column: str, fetch: Fetch, rows_per_range: int = ROWS_PER_RANGE) -> list[str]:
    """Conditions of the ranges to read, from two small questions to the database."""
    n = int(fetch(count_query(keys))[0][0])
    ranges = min(MOST_RANGES, -(-n // rows_per_range))
    if ranges <= 1:
        return ["1 = 1"]
    return range_predicates(column, [row[0] for row in fetch(bounds_query(keys, column, ranges))])


def database_fetch(spark: SparkSession, options: Mapping[str, str]) -> Fetch:
    """Rows of a small query, asked of the database itself."""
    return lambda sql: [tuple(r) for r in spark.read.format("jdbc").options(**options).option("query", sql).load().collect()]


def read_ranges(spark: SparkSession, subquery: str, predicates: list[str], options: Mapping[str, str]) -> DataFrame:
    """The rows of a subquery, one partition and connection per condition."""
    properties = {k: v for k, v in options.items() if k != "url"}
    return spark.read.jdbc(options["url"], f"({subquery}) AS wanted", predicates=predicates, properties=properties)


def read_joined(
    spark: SparkSession, visit_tables: list[str], features: str, options: Mapping[str, str], labelled: bool = True,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Visits with the features of their pages, joined by the database and read in ranges of the visit id."""
    predicates = plan_ranges(keys_subquery(visit_tables), "visit_id", database_fetch(spark, options), rows_per_range)
    return read_ranges(spark, joined_subquery(visit_tables, features, labelled), predicates, options)
