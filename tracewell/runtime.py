"""Session helpers: the shared folder for intermediate tables, and table access."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only a single-machine session (``local[..]``) may leave it unset; it then gets a temporary folder,
    removed at exit. A cluster without the setting is an error, because a machine-local folder would
    lose intermediate tables together with an executor.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="tracewell-")
        atexit.register(shutil.rmtree, _LOCAL_FOLDERS[app], True)
    return _LOCAL_FOLDERS[app]


def _scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tracewell/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one intermediate table of this application in the shared folder."""
    return f"{_scratch(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application; results that were not written elsewhere are gone with them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read of files, not a recomputation, and values that
    depend on the physical layout (such as ``monotonically_increasing_id``) are frozen.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def big_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join of two tables that grow with the data: always by sorted shuffles, which spill.

    Catalyst guesses sizes from files, before rows are multiplied or unpacked; the hint keeps such a guess
    from turning a growing table into a broadcast. AQE still splits skewed partitions.
    """
    return left.join(right.hint("merge"), on, how)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
