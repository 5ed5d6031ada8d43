"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.skew import fits_broadcast
from ..session import cut_lineage

# Rows of a written table that are worth a file and a task of their own, if they are some hundred bytes wide.
ROWS_OF_FILE = 50_000
# Texts that a Python worker takes out of an Arrow batch at a time.
ROWS_AT_ONCE = 256


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def text_key(text: Column) -> Column:
    """A hash that, next to an id, tells rows apart that share the id; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def checked_broadcast(df: DataFrame) -> DataFrame:
    """`df` with a broadcast hint if its counted rows and bytes are within the limits, else as it is."""
    return F.broadcast(df) if fits_broadcast(df) else df


def slices(batch, rows: int = ROWS_AT_ONCE):
    """An Arrow batch or array in parts of a few rows, so that a Python worker holds few texts as objects at a time."""
    for k in range(0, max(len(batch), 1), rows):
        yield batch.slice(k, rows)


def cut_few(df: DataFrame, rows: int, of_file: int = ROWS_OF_FILE, of_core: int = 1) -> DataFrame:
    """`cut_lineage` of at most `rows` rows, in no more files than these rows, or `of_core` to a core, ask for.

    A shuffle of few rows has as many partitions as one of many, and a file costs a task more than a few rows do.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return cut_lineage(df.coalesce(max(of_core * cores, -(-rows // of_file))))


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: one in five by the checksum of the id's text."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0, F.lit(False))


def bounded_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """At most `rows` rows of `df`, those with the smallest hash of `key`; the same rows at every run."""
    return df.withColumn("_order", F.xxhash64(key)).orderBy("_order").limit(rows).drop("_order")


def spare(name: str, *frames: DataFrame) -> str:
    """A column name like `name` that none of the frames has, in any case of letters."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_rows(left: DataFrame, right: DataFrame, how: str = "inner", keys: tuple[str, ...] = ("doc_id", "text_key")) -> DataFrame:
    """Join on keys of which any may be null; a null equals a null. Columns of the left come first."""
    names = {k: spare(f"right_{k}", left, right) for k in keys}
    renamed = right.withColumnsRenamed(names)
    on = [F.col(k).eqNullSafe(F.col(names[k])) for k in keys]
    return left.join(renamed, on, how).drop(*names.values())
