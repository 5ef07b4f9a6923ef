"""Timeline, error groups and sections of a log that grows, from small tables that each micro-batch adds to.

A batch of parsed lines gives partial results that merge: entries per slot of time and level, the first lines of ERROR
entries (an entry may be cut by a batch), and the stretches between marks of sections. Each batch's are written under its
number, so a batch that is done again after a failure takes its own place. ``timeline``, ``groups`` and ``sections`` merge
what is there; they read the partial tables alone, never the lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logquarry.operators import aggregates as agg

TIMELINE = "slot long, errors long, warnings long, total long"
ERRORS = "file_id string, at long, number long, sig string, sample string, source string, time long"
STRETCHES = "file_id string, at long, mark string, title string, lines long, errors long, first_lines long, first_errors long, end long"


class Recomputed:
    """The partial tables under ``path``, a folder that driver and executors share. ``slot_ms``: the timeline's slots."""

    def __init__(self, spark: SparkSession, path: str, slot_ms: int = 1_000):
        self.spark, self.path, self.slot_ms = spark, path.rstrip("/"), slot_ms

    def follow(self, parsed: DataFrame, checkpoint: str) -> StreamingQuery:
        """Keep the tables up with a parsed stream."""
        return parsed.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).start()

    def add(self, lines: DataFrame, batch_id: int) -> None:
        """The partial results of one batch of parsed lines."""
        lines = lines.persist()
        try:
            for name, made in (("timeline", self._slots(lines)), ("errors", self._errors(lines)), ("sections", self._stretches(lines))):
                made.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch_id}")
        finally:
            lines.unpersist()

    def _slots(self, lines: DataFrame) -> DataFrame:
        slot = F.floor(F.col("time") / self.slot_ms).alias("slot")
        kinds = {"errors": F.col("level") == "ERROR", "warnings": F.col("level") == "WARN"}
        counts = [F.count_if(c).alias(n) for n, c in kinds.items()]
        return lines.where("time IS NOT NULL").groupBy(slot).agg(*counts, F.count("*").alias("total"))

    def _errors(self, lines: DataFrame) -> DataFrame:
        near = lines.where("level = 'ERROR' AND entry_id > 0 AND number - entry_id <= 3")
        return agg.error_lines(near, F.col("entry_id"))

    def _stretches(self, lines: DataFrame) -> DataFrame:
        """Lines from one mark to the next, within the batch; those before its first mark go with an earlier one."""
        starts, ends, title = agg.section_marks(F.col("text"))
        mark = F.when(starts, "start").when(ends, "end")
        lines = lines.select("file_id", "number", "level", "continuation", mark.alias("mark"), title.alias("title"))
        so_far = Window.partitionBy("file_id").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
        lines = lines.withColumn("since", F.last(F.when(F.col("mark").isNotNull(), F.col("number")), ignorenulls=True).over(so_far))
        error = (F.col("level") == "ERROR") & ~F.col("continuation") & ~F.col("mark").eqNullSafe(F.lit("start"))
        first = F.col("number") == F.col("since")
        return lines.groupBy("file_id", "since").agg(
            F.min("number").alias("at"),
            F.max("mark").alias("mark"),
            F.max(F.when(F.col("mark") == "start", F.col("title"))).alias("title"),
            F.count("*").alias("lines"),
            F.count_if(error).alias("errors"),
            F.count_if(first).alias("first_lines"),
            F.count_if(error & first).alias("first_errors"),
            F.max("number").alias("end"),
        ).drop("since")

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema + ", batch long").parquet(f"{self.path}/{name}").drop("batch")

    def timeline(self) -> DataFrame:
        """(slot, from_ms, errors, warnings, total): entries per slot, those without any left out."""
        names = ("errors", "warnings", "total")
        merged = self._read("timeline", TIMELINE).groupBy("slot").agg(*[F.sum(n).alias(n) for n in names])
        return merged.select("slot", (F.col("slot") * self.slot_ms).alias("from_ms"), *names)

    def groups(self) -> DataFrame:
        """The error groups so far, as ``error_groups`` gives them."""
        return agg.groups_of(agg.entries_of(self._read("errors", ERRORS)))

    def sections(self) -> DataFrame:
        """The sections so far, as ``sections`` gives them."""
        rows = self._read("sections", STRETCHES)
        order = Window.partitionBy("file_id").orderBy("at")
        last = {"start": order.rowsBetween(Window.unboundedPreceding, 0), "end": order.rowsBetween(Window.unboundedPreceding, -1)}
        seen = {k: F.last(F.when(F.col("mark") == k, F.col("at")), ignorenulls=True).over(w) for k, w in last.items()}
        rows = rows.withColumns({"start": seen["start"], "ended": seen["end"]})
        rows = rows.where("start IS NOT NULL AND (ended IS NULL OR ended < start)")
        is_end = F.col("mark").eqNullSafe(F.lit("end"))
        return rows.groupBy("file_id", "start").agg(
            F.max("title").alias("title"),
            F.max(F.when(is_end, F.col("at")).otherwise(F.col("end"))).alias("end"),
            F.sum(F.when(is_end, F.col("first_errors")).otherwise(F.col("errors"))).alias("errors"),
            F.sum(F.when(is_end, F.col("first_lines")).otherwise(F.col("lines"))).alias("lines"),
        )
