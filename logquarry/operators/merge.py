"""Several logs read as one, in the order things happened."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.operators.ordered import global_running, running_max, with_row


def merged(df: DataFrame, labels: DataFrame) -> DataFrame:
    """(merge_key, file_idx, number, raw) of parsed files, to be ordered by the first three.

    A file keeps its own order: a line's key is the latest time so far in its file, lines before the first time take
    that, and files without a time come last. ``labels`` is (file_id, label), one row a file.
    """
    file = df.groupBy("file_id").agg(F.min_by("time", F.when(F.col("time").isNotNull(), F.col("number"))).alias("first_time"))
    widest = labels.agg(F.max(F.length("label")).alias("width"))
    names = with_row(labels, widest).join(file, "file_id")
    df = running_max(df, "passed", F.col("time")).join(names, "file_id")
    last = F.lit(2**63 - 1)
    line = F.concat(F.rpad("label", F.col("width"), F.lit(" ")), F.lit(" | "), F.col("text"))
    return df.select(
        F.coalesce("passed", "first_time", last).alias("merge_key"), "file_idx", "number", "file_id", line.alias("raw")
    )


def untimed(df: DataFrame) -> DataFrame:
    """(file_id): files without a single time."""
    return df.groupBy("file_id").agg(F.count("time").alias("n")).where("n = 0").select("file_id")


def placed(merged_lines: DataFrame) -> DataFrame:
    """Merged lines with their place in the whole, from 1."""
    out = global_running(merged_lines, ["merge_key", "file_idx", "number"], F.lit(1), "place")
    return out.withColumn("place", (F.col("place") + 1).cast("long"))


def renumbered(merged_lines: DataFrame, name: str = "merged") -> DataFrame:
    """Merged lines as raw lines of one file."""
    return placed(merged_lines).select(
        F.lit(name).alias("file_id"), F.lit(0).alias("file_idx"), F.col("place").alias("number"), "raw"
    )
