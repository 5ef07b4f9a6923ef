"""Filters over the line table. Each takes and gives a DataFrame; what belongs to one entry stays or goes together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions.fields import meets, mentions
from logquarry.functions.regex_risk import regex_risk
from logquarry.functions.text import kind
from logquarry.operators.ordered import carry, with_hits
from logquarry.operators.parse import with_timed_entries
from logquarry.plans.search import Condition


def by_fields(df: DataFrame, conditions: list[Condition]) -> DataFrame:
    """Entries whose first line meets every condition; lines before any entry go."""
    if not conditions:
        return df
    met = meets(conditions[0])
    for c in conditions[1:]:
        met = met & meets(c)
    out = carry(df, {"entry_met": (F.when(~F.col("continuation"), met), True)})
    return out.where("entry_met").drop("entry_met")


def without_words(df: DataFrame, words: list[str], case_sensitive: bool = False) -> DataFrame:
    """Without lines that hold a word, and without timed entries whose first line does."""
    if not words:
        return df
    df = with_timed_entries(df).withColumn("has_word", mentions(F.col("text"), words, case_sensitive))
    start = F.when(F.col("number") == F.col("timed_entry_id"), F.col("has_word"))
    df = carry(df, {"entry_out": (start, True)})
    return df.where("NOT has_word AND NOT coalesce(entry_out, false)").drop("has_word", "entry_out")


def with_kinds(df: DataFrame) -> DataFrame:
    """With each line's kind: its level and what its text is like."""
    return df.withColumn("kind", kind(F.col("text"), F.col("level"), F.col("json").isNotNull()))


def without_kinds(df: DataFrame, kinds: DataFrame) -> DataFrame:
    """Without timed entries whose first line is of one of ``kinds`` (kind)."""
    df = with_kinds(with_timed_entries(df))
    muted = kinds.select("kind").distinct().withColumn("muted", F.lit(True))
    df = df.join(muted, "kind", "left")
    start = F.when(F.col("number") == F.col("timed_entry_id"), F.coalesce("muted", F.lit(False)))
    df = carry(df, {"entry_out": (start, True)})
    return df.where("NOT coalesce(entry_out, false)").drop("kind", "muted", "entry_out")


def kind_entries(df: DataFrame) -> DataFrame:
    """(kind, entries): how many timed entries are of each kind."""
    starts = with_kinds(with_timed_entries(df)).where(F.col("number") == F.col("timed_entry_id"))
    return starts.groupBy("kind").agg(F.count("*").alias("entries"))


def in_time_range(df: DataFrame, start: int, stop: int) -> DataFrame:
    """Lines whose entry time is in [start, stop); lines before the first time go."""
    return df.where((F.col("entry_time") >= start) & (F.col("entry_time") < stop))


def from_sources(df: DataFrame, only: list[str] | None = None, hidden: list[str] | None = None) -> DataFrame:
    """Lines of the sources asked for; lines without a source stay."""
    keep = F.lit(True)
    if only is not None:
        keep = keep & F.col("source").isin(list(only))
    if hidden:
        keep = keep & ~F.col("source").isin(list(hidden))
    return df.where(F.col("source").isNull() | keep)


def of_levels(levels: list[str] | None, unknown: bool = True) -> Column:
    if levels is None:
        return F.lit(True) if unknown else F.col("level").isNotNull()
    return F.when(F.col("level").isNull(), F.lit(unknown)).otherwise(F.col("level").isin(list(levels)))


def matcher(query: str, regex: bool = False, case_sensitive: bool = False) -> Column:
    """Whether a line's text has the query; a regex that may run without end is refused."""
    if not query:
        return F.lit(True)
    if regex:
        if problem := regex_risk(query):
            raise ValueError(problem)
        return F.col("text").rlike(query if case_sensitive else f"(?iu){query}")
    return mentions(F.col("text"), [query], case_sensitive)


def with_context(df: DataFrame, match: Column, context: int = 0) -> DataFrame:
    """Matching lines with ``context`` lines around each, of the lines given.

    is_context marks lines that do not match; gap_above the first line after lines that were left out.
    """
    if context <= 0:
        return df.where(match).withColumns({"is_context": F.lit(False), "gap_above": F.lit(False)})
    df = with_hits(df, match)
    since, until = F.col("place") - F.col("hit_before"), F.col("hit_after") - F.col("place")
    df = df.where((since <= context) | (until <= context))
    # The line above is shown if a hit is near it in turn; without a hit before it, no line is shown above a gap.
    above = F.coalesce((since - 1 <= context) | (until + 1 <= context), F.lit(False))
    gap = F.col("hit_before").isNotNull() & ~above
    return df.withColumns({"is_context": ~F.col("is_match"), "gap_above": gap}).drop(
        "is_match", "place", "hit_before", "hit_after"
    )


def fold_sections(df: DataFrame, sections: DataFrame, opened: list[int] = ()) -> DataFrame:
    """Without the lines inside closed sections (file_id, start, end); each section's first line stays."""
    closed = sections.where((F.col("end") > F.col("start")) & ~F.col("start").isin(list(opened)))
    ends = closed.select("file_id", F.col("start").alias("number"), F.col("end").alias("section_end"))
    df = carry(df.join(ends, ["file_id", "number"], "left"), {"inside_to": (F.col("section_end"), False)})
    return df.where("inside_to IS NULL OR number > inside_to").drop("section_end", "inside_to")


def jump(df: DataFrame, current: int, match: Column, forward: bool = True) -> DataFrame:
    """(file_id, number): the next matching line after ``current``, or before it; around the end if there is none."""
    n = F.when(match, F.col("number"))
    if forward:
        to = F.coalesce(F.min(F.when(F.col("number") > current, n)), F.min(n))
    else:
        to = F.coalesce(F.max(F.when(F.col("number") < current, n)), F.max(n))
    return df.groupBy("file_id").agg(to.alias("number"))


def line_range(df: DataFrame, first: int, last: int) -> DataFrame:
    return df.where(F.col("number").between(first, last))

