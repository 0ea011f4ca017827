"""Broadcasting behind a check of size."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow side is broadcast: some tens of MB.
MOST_ROWS = 200_000


def small(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """df marked for broadcast when it has at most `most` rows; a larger one stays as it is, for Spark to shuffle or to cut into a distributed product."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Bytes up to which Spark may broadcast a side that nobody counted. It goes by the compressed bytes of files and shuffles, before lists are exploded: its own limit of 10 MB let sides
#: of 200 MB into the driver, several at a time.
UNASKED, THRESHOLD = 1 << 18, "spark.sql.autoBroadcastJoinThreshold"
_lock, _held = Lock(), {"runs": 0, "before": ""}


@contextmanager
def few_broadcasts(spark: SparkSession, most: int = UNASKED) -> Iterator[None]:
    """While it is held, Spark broadcasts sides of at most `most` bytes unasked, or fewer if so set; the session's own setting comes back when the last run that holds it ends."""
    with _lock:
        _held["runs"] += 1
        if _held["runs"] == 1:
            _held["before"] = spark.conf.get(THRESHOLD)
            if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(_held["before"]) > most:
                spark.conf.set(THRESHOLD, str(most))
    try:
        yield
    finally:
        with _lock:
            _held["runs"] -= 1
            if not _held["runs"]:
                spark.conf.set(THRESHOLD, _held["before"])
