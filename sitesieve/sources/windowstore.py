"""A growing table of rows with numbers: appends are committed, and any row is read by its number without a scan.

An append writes files into a folder of its own, then how many rows each file has, and at last one small commit file
that only one writer can create. What was written without a commit is never read. Numbers go on where the append
before ended: in the order of the files, and in a file in the order of its rows. A row is found through the
counts, and read from its file alone.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.skew import fits_broadcast

ROW = "row_no"
# Numbers up to this many travel to the rows; more are joined.
MOST_NUMBERS = 5_000_000


class AppendConflict(RuntimeError):
    """Another writer has committed in the meantime."""


@dataclass
class Part:
    """A committed file: its place, the number of its first row, and how many it has."""

    path: str
    first: int
    rows: int


class WindowStore:
    """Rows below one folder that every executor can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def commits(self) -> list[str]:
        """Names of the committed appends, in order."""
        path, files = self._at("commits")
        if not files.exists(path):
            return []
        return sorted(f.getPath().getName() for f in files.listStatus(path))

    def append(self, rows: DataFrame, order: list[str], expected: int | None = None) -> int:
        """Add rows, numbered in the given order; the number of the commit.

        `expected` is how many commits the caller has seen; with another number of them, or if another
        writer is faster, nothing is added and `AppendConflict` is raised.
        """
        number = len(self.commits()) if expected is None else expected
        name = f"{number:08d}-{uuid.uuid4().hex}"
        rows.orderBy(*order).write.parquet(f"{self.path}/data/{name}")
        # the counts stand in the files' footers: no column is read
        counts = self.spark.read.schema(rows.schema).parquet(f"{self.path}/data/{name}").groupBy(
            F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n"))
        counts.coalesce(1).write.parquet(f"{self.path}/counts/{name}")
        self._commit(number, name)
        return number

    def _commit(self, number: int, name: str) -> None:
        if len(self.commits()) != number:
            raise AppendConflict(f"commit {number} is taken")
        path, files = self._at(f"commits/{number:08d}")
        try:
            made = files.create(path, False)
        except Exception as error:  # the file is there already
            raise AppendConflict(f"commit {number} is taken") from error
        made.write(bytearray(name.encode()))
        made.close()

    def _name(self, commit: str) -> str:
        return self.spark.read.text(f"{self.path}/commits/{commit}").first()["value"]

    def parts(self) -> list[Part]:
        """All committed files with the numbers of their rows: one small entry for each file."""
        found, first = [], 0
        for commit in self.commits():
            name = self._name(commit)
            counts = self.spark.read.schema("file string, n long").parquet(f"{self.path}/counts/{name}").collect()
            for row in sorted(counts, key=lambda r: r["file"]):
                found.append(Part(f"{self.path}/data/{name}/{row['file']}", first, row["n"]))
                first += row["n"]
        return found

    def __len__(self) -> int:
        return sum(p.rows for p in self.parts())

    def _numbered(self, parts: list[Part]) -> DataFrame:
        files = self.spark.read.parquet(*[p.path for p in parts]).select(
            "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_index"))
        firsts = self.spark.createDataFrame([(p.path.rsplit("/", 1)[1], p.first) for p in parts], "_file string, _first long")
        joined = files.join(F.broadcast(firsts), "_file")  # one row for each file read
        return joined.withColumn(ROW, F.col("_first") + F.col("_index")).drop("_file", "_index", "_first")

    def read(self) -> DataFrame:
        """All committed rows with their numbers."""
        return self._numbered(self.parts())

    def between(self, start: int, end: int) -> DataFrame:
        """Rows `start` to `end`, the last not included; only files that hold some of them are read."""
        parts = [p for p in self.parts() if p.first < end and p.first + p.rows > start]
        if not parts:
            raise IndexError(f"no rows from {start} to {end}")
        return self._numbered(parts).filter((F.col(ROW) >= start) & (F.col(ROW) < end))

    def row(self, number: int) -> DataFrame:
        """One row, from its file alone."""
        return self.between(number, number + 1)

    def take(self, numbers: DataFrame) -> DataFrame:
        """The rows of a table of numbers (`row_no`); rows stay where they are if the numbers fit a broadcast."""
        wanted = numbers.select(ROW).distinct()
        return self.read().join(F.broadcast(wanted) if fits_broadcast(wanted, MOST_NUMBERS) else wanted, ROW)
