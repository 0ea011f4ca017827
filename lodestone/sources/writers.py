"""Sinks: JSON records, parameter write-back, report files."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def swapped(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Let write fill a folder beside path, then put it in path's place.

    A write that fails leaves what path held. Between the two renames path is missing for a moment, and the old folder then still stands beside
    it, so nothing is lost when the driver ends there.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path
    tag = uuid.uuid4().hex
    new, old, here = at(f"{path}.new-{tag}"), at(f"{path}.old-{tag}"), at(path)
    files = here.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        write(str(new.toString()))
    except BaseException:
        files.delete(new, True)
        raise
    if files.exists(here) and not files.rename(here, old):
        raise OSError(f"cannot move {path} away")
    if not files.rename(new, here):
        raise OSError(f"cannot move the new records to {path}")
    files.delete(old, True)


def write_records(records: DataFrame, path: str) -> None:
    """One JSON record a line, see swapped."""
    swapped(records.sparkSession, path, lambda to: records.select(F.col("record").alias("value")).write.text(to))


#: The folder of a table's versions: one empty file each, named by number and by the folder that holds the rows.
VERSIONS = "_versions"


def _files(spark: SparkSession, path: str) -> tuple:
    """Hadoop's Path class and the file system of path."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at, at(path).getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Number and folder of all committed versions of path, oldest first; none where nothing was committed."""
    at, files = _files(spark, path)
    here = at(f"{path}/{VERSIONS}")
    names = [x.getPath().getName() for x in files.listStatus(here)] if files.exists(here) else []
    return sorted((int(n), tag) for n, tag in (x.split("-", 1) for x in names))


def current(spark: SparkSession, path: str) -> str:
    """The folder that holds the rows of path's newest version."""
    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(f"{path} has no committed version")
    return f"{path}/{found[-1][1]}"


def committed(spark: SparkSession, path: str, write: Callable[[str], None], keep: int = 2) -> str:
    """Let write fill a new folder below path and make it the current version; returns the folder.

    One step commits: an empty file is made under VERSIONS whose name says number and folder. Until it is there, readers that follow current see the version before,
    then the new one, and never none; nothing that a reader may hold is moved. A write that fails leaves what was current; a driver that ends before the step leaves a folder that no version
    names. The newest `keep` versions stay, so that who has just looked one up can read on. Of two writers at once, both commit and the higher name is current.
    """
    at, files = _files(spark, path)
    tag = f"v{uuid.uuid4().hex}"
    try:
        write(f"{path}/{tag}")
    except BaseException:
        files.delete(at(f"{path}/{tag}"), True)
        raise
    number = max((n for n, _ in versions(spark, path)), default=0) + 1
    files.create(at(f"{path}/{VERSIONS}/{number:010d}-{tag}"), False).close()
    for n, old in versions(spark, path)[: -max(1, keep)]:
        files.delete(at(f"{path}/{VERSIONS}/{n:010d}-{old}"), False)
        files.delete(at(f"{path}/{old}"), True)
    return f"{path}/{tag}"


def write_back(records: DataFrame, targets: DataFrame, path: str) -> str:
    """(revit_id, parameter) of every record whose target is not read-only, as a new version of path, see committed; returns its folder."""
    open_targets = targets.where(~F.coalesce("read_only", F.lit(False))).select("revit_id")
    kept = records.join(open_targets, "revit_id", "left_semi").select("revit_id", F.col("record").alias("parameter"))
    return committed(records.sparkSession, path, kept.write.parquet)


def write_report(path: str, html: str, markdown: str) -> str:
    """The report in the form that the path's ending asks for; returns what was written."""
    kind = "markdown" if path.lower().endswith((".md", ".markdown")) else "html"
    Path(path).write_text(markdown if kind == "markdown" else html)
    return kind
