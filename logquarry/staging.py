"""Tables written in the middle of a plan, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under spark.checkpoint.dir and read it back, so that what follows may read it more than once.

    What nothing reads any more can be given to ``discard``; the rest is deleted when the process ends.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="logquarry-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/logs-{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    for df in frames:
        _delete(df._settled_at)


def _delete(path: str) -> None:
    spark = _written.pop(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def sweep() -> None:
    """Delete every settled table of this process. Results that read them must have been consumed."""
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # the session may have ended
            return
