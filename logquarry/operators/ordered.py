"""State carried along the lines of a file: the building block of parsing, entries, sections and repeats.

All ordered operators here ask one question: what was the last non-null value so far? With ``chunk`` (a column that
cuts each file into runs of lines) the answer is found inside each run first; one row a run then carries the state from
run to run, and is joined back. No task has to hold a whole file, and the joined side has one row a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquarry.staging import settled

CHUNK = "chunk"


def with_chunks(df: DataFrame, lines: int) -> DataFrame:
    """Cut files into runs of ``lines`` lines; 0 leaves each file whole."""
    return df.withColumn(CHUNK, F.floor((F.col("number") - 1) / lines)) if lines else df


def carry(
    df: DataFrame, values: dict[str, tuple[Column, bool]], order: str = "number", backward: bool = False
) -> DataFrame:
    """``df`` with columns of the last non-null value of each expression; (expression, whether this row's own counts).

    backward: the next non-null value instead.
    """
    step = F.col(order).desc() if backward else F.col(order).asc()
    chunked = CHUNK in df.columns
    keys = ["file_id", CHUNK] if chunked else ["file_id"]
    events = {f"event_{k}": v for k, (v, _) in values.items()}
    df = df.withColumns(events)
    rows = Window.partitionBy(*keys).orderBy(step)
    ends = {True: 0, False: -1}
    local = {
        k: F.last(f"event_{k}", ignorenulls=True).over(rows.rowsBetween(Window.unboundedPreceding, ends[own]))
        for k, (_, own) in values.items()
    }
    out = df.withColumns(local)
    if chunked:
        pick = F.min_by if backward else F.max_by
        state = df.groupBy(*keys).agg(
            *[pick(f"event_{k}", F.when(F.col(f"event_{k}").isNotNull(), F.col(order))).alias(f"event_{k}") for k in values]
        )
        runs = Window.partitionBy("file_id").orderBy(F.col(CHUNK).desc() if backward else F.col(CHUNK))
        runs = runs.rowsBetween(Window.unboundedPreceding, -1)
        state = state.select(*keys, *[F.last(f"event_{k}", ignorenulls=True).over(runs).alias(f"before_{k}") for k in values])
        out = out.join(state, keys).withColumns({k: F.coalesce(k, f"before_{k}") for k in values})
        out = out.drop(*[f"before_{k}" for k in values])
    return out.drop(*events)


def _running(df: DataFrame, name: str, value: Column, total, order: str) -> DataFrame:
    if CHUNK not in df.columns:
        w = Window.partitionBy("file_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, total(value).over(w))
    keys = ["file_id", CHUNK]
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    runs = Window.partitionBy("file_id").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    state = df.groupBy(*keys).agg(total(value).alias("n")).select(*keys, total("n").over(runs).alias("runs_before"))
    return df.withColumn(name, total(value).over(w)).join(state, keys)


def running_count(df: DataFrame, name: str, flag: Column, order: str = "number") -> DataFrame:
    """``df`` with the number of rows so far, this one included, where ``flag`` holds."""
    out = _running(df, name, F.when(flag, 1).otherwise(0), F.sum, order)
    if CHUNK in df.columns:
        out = out.withColumn(name, F.col(name) + F.coalesce("runs_before", F.lit(0))).drop("runs_before")
    return out


def running_max(df: DataFrame, name: str, value: Column, order: str = "number") -> DataFrame:
    """``df`` with the largest value so far, this row's included."""
    out = _running(df, name, value, F.max, order)
    if CHUNK in df.columns:
        out = out.withColumn(name, F.greatest(name, "runs_before")).drop("runs_before")
    return out


def steps_down(df: DataFrame, name: str, value: str, least: int) -> DataFrame:
    """``df`` with how often, up to a row, the column ``value`` fell by more than ``least`` from one non-null to the next."""
    keys = ["file_id", CHUNK] if CHUNK in df.columns else ["file_id"]
    rows = Window.partitionBy(*keys).orderBy("number")
    df = df.withColumn("value_before", F.last(value, ignorenulls=True).over(rows.rowsBetween(Window.unboundedPreceding, -1)))
    down = F.when(F.col("value_before") - F.col(value) > least, 1).otherwise(0)
    out = df.withColumn(name, F.sum(down).over(rows.rowsBetween(Window.unboundedPreceding, 0)))
    if CHUNK in df.columns:
        at = F.when(F.col(value).isNotNull(), F.col("number"))
        state = df.groupBy(*keys).agg(
            F.min(at).alias("first_at"),
            F.min_by(value, at).alias("first"),
            F.max_by(value, at).alias("last"),
            F.sum(down).alias("n"),
        )
        runs = Window.partitionBy("file_id").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        entered = F.when(F.last("last", ignorenulls=True).over(runs) - F.col("first") > least, 1).otherwise(0)
        state = state.withColumn("entered", entered)
        state = state.select(
            *keys, "first_at", "entered", F.coalesce(F.sum(F.col("n") + F.col("entered")).over(runs), F.lit(0)).alias("n_before")
        )
        inside = F.when(F.col("number") >= F.col("first_at"), F.col("entered")).otherwise(0)
        out = out.join(state, keys).withColumn(name, F.col(name) + F.col("n_before") + inside)
        out = out.drop("first_at", "entered", "n_before")
    return out.drop("value_before")


def with_hits(df: DataFrame, match: Column) -> DataFrame:
    """``df`` with is_match, place (the row's number among those given), and the places of the last matching row before
    it and of the next one from it on."""
    keys = ["file_id", CHUNK] if CHUNK in df.columns else ["file_id"]
    rows, back = Window.partitionBy(*keys).orderBy("number"), Window.partitionBy(*keys).orderBy(F.desc("number"))
    df = df.withColumn("is_match", F.coalesce(match, F.lit(False))).withColumn("place", F.row_number().over(rows).cast("long"))
    hit = F.when(F.col("is_match"), F.col("place"))
    out = df.withColumns(
        {
            "hit_before": F.max(hit).over(rows.rowsBetween(Window.unboundedPreceding, -1)),
            "hit_after": F.min(hit).over(back.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    if CHUNK in df.columns:
        state = df.groupBy(*keys).agg(F.count("*").alias("n"), F.max(hit).alias("last"), F.min(hit).alias("first"))
        above = Window.partitionBy("file_id").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        below = Window.partitionBy("file_id").orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
        state = state.withColumn("start", F.coalesce(F.sum("n").over(above), F.lit(0)))
        state = state.select(
            *keys,
            "start",
            F.max(F.col("start") + F.col("last")).over(above).alias("last_above"),
            F.min(F.col("start") + F.col("first")).over(below).alias("first_below"),
        )
        out = out.join(state, keys).withColumns(
            {
                "place": F.col("place") + F.col("start"),
                "hit_before": F.coalesce(F.col("hit_before") + F.col("start"), "last_above"),
                "hit_after": F.coalesce(F.col("hit_after") + F.col("start"), "first_below"),
            }
        )
        out = out.drop("start", "last_above", "first_below")
    return out


def global_running(df: DataFrame, order: list[str], amount: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over all rows before each, in the order of ``order``, whole numbers only.

    Rows are dealt over ordered partitions; each sums up its own, after what the partitions before it hold.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.withColumn(name, amount).repartitionByRange(n, *order).sortWithinPartitions(*order)
    df = settled(df.withColumn("part", F.spark_partition_id()), "ordered")
    rows = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = df.groupBy("part").agg(F.sum(name).alias("held"))
    before = F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.coalesce(F.sum(name).over(rows), F.lit(0))
    return df.withColumn(name, own).join(parts, "part").withColumn(name, F.col(name) + F.col("before")).drop("part", "before")


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """``df`` with the columns of a table of one row at most, which goes to every task; without it, no rows."""
    return df.withColumn("one_row", F.lit(1)).join(F.broadcast(row.withColumn("one_row", F.lit(1))), "one_row").drop("one_row")
