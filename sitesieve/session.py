"""Session settings the jobs rely on, and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "sitesieve", **conf: str) -> SparkSession:
    """A session with the settings the jobs are tuned for; `conf` overrides them.

    Keys use `__` for dots, e.g. `spark__sql__shuffle__partitions="2000"`.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # page texts are wide: small Arrow batches bound the memory of a Python worker
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app_name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by `spark.checkpoint.dir`.

    A machine-local folder is made up only for a local master with nothing set.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made_up = tempfile.mkdtemp(prefix="sitesieve-")
    spark.sparkContext.setCheckpointDir(made_up)
    return made_up


def open_shared(uri: str):
    """File system and path of a file in the shared folder."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def cut_folder(spark: SparkSession) -> str:
    """The folder of all tables and files of this application, see `clear_cuts`."""
    return f"{shared_folder(spark).rstrip('/')}/sitesieve-{spark.sparkContext.applicationId}"


def spread(df: DataFrame, key: str) -> DataFrame:
    """`df` over all cores if its files have fewer splits than there are cores, else unchanged.

    Large inputs have splits enough and are not moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and continue from there.

    Unlike a row checkpoint the written table keeps column pruning and known
    sizes, and it is computed once. It survives the loss of any executor. All
    tables of an application lie below one folder, to be removed after it.
    """
    spark = df.sparkSession
    path = f"{cut_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    cut = spark.read.schema(df.schema).parquet(path)
    cut.cut_path = path
    return cut


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared one, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(cut: DataFrame) -> None:
    """Delete the table behind a frame made by `cut_lineage`, once nothing reads it any more."""
    remove(cut.sparkSession, cut.cut_path)


def clear_cuts(spark: SparkSession) -> None:
    """Delete all tables this application wrote with `cut_lineage`."""
    remove(spark, cut_folder(spark))
