"""Tables between steps, written to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local master gets a temporary folder, and any other an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:  # the setting itself cannot be changed in a session
        _own[app] = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return _own[app]


def _at(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession) -> str:
    """This application's folder for intermediate tables in the shared folder; what is left of it goes when the driver's process ends."""
    path = f"{shared_dir(spark)}/lodestone/{spark.sparkContext.applicationId}"
    files, at = _at(spark, path)
    if not files.exists(at):
        files.mkdirs(at)
        files.deleteOnExit(at)
    return path


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """df written once as Parquet in the shared folder and read back: a lineage cut that outlives executors."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables that no plan reads any more."""
    for path in paths:
        files, at = _at(spark, path)
        files.delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that still read them must have been written before."""
    remove(spark, scratch(spark))
