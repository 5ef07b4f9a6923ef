"""Comparison of two logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions.text import normalize_line, normalize_whitespace
from logquarry.staging import settled


def compare_key(text: Column, volatile: bool = False, spaces: bool = False) -> Column:
    """What two lines are compared by: times, ids and durations, or white space, may be left aside."""
    text = normalize_line(text) if volatile else text
    return normalize_whitespace(text) if spaces else text


def line_changes(before: DataFrame, after: DataFrame, volatile: bool = False, spaces: bool = False) -> DataFrame:
    """(line, before, after): how often each kind of line stands in either log, where that differs."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(compare_key(F.col("text"), volatile, spaces).alias("line")).agg(F.count("*").alias(name))

    both = counted(before, "before").join(counted(after, "after"), "line", "full")
    both = both.select("line", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("before", "after")])
    return both.where("before <> after")


def json_leaves(df: DataFrame) -> DataFrame:
    """(id, path, value) of the leaves of JSON documents (id, json); arrays by index, empty ones as leaves.

    Each round opens one level for all documents; there are as many rounds as the deepest one has levels.
    """
    rows = df.select("id", F.lit("$").alias("path"), F.try_parse_json("json").alias("v"))
    leaves = None
    while True:
        kind = F.schema_of_variant("v")
        is_object, is_array = kind.startswith("OBJECT<") & (kind != "OBJECT<>"), kind.startswith("ARRAY<") & (kind != "ARRAY<VOID>")
        inside = F.coalesce(is_object | is_array, F.lit(False))
        opened = settled(rows.select("id", "path", F.to_json("v").alias("value"), inside.alias("inside")), "json-level")
        done = opened.where("NOT inside").select("id", "path", "value")
        leaves = done if leaves is None else leaves.union(done)
        inner = opened.where("inside")
        if inner.isEmpty():
            return leaves
        parts = inner.select("id", "path", F.parse_json("value").alias("v")).lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()))
        plain = F.col("key").rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*\z")
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos"), F.lit("]")))
        step = step.when(plain, F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit('["'), "key", F.lit('"]')))
        rows = parts.select("id", F.concat("path", step).alias("path"), F.col("value").alias("v"))


def json_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, path, kind, before, after) of the leaves that were added, removed or changed between JSON documents (id, json)."""
    a = json_leaves(before).withColumnRenamed("value", "before")
    b = json_leaves(after).withColumnRenamed("value", "after")
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    both = a.join(b, ["id", "path"], "full").where("NOT before <=> after")
    return both.select("id", "path", kind.alias("kind"), "before", "after")
