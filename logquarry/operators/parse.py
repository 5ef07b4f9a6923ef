"""Raw lines to the line table: level, time, gap, source, JSON fields, continuation and secret flags.

What one line tells is a set of Column expressions (and one Arrow-batched function for JSON records). What depends on
earlier lines (level carried forward, gaps, days of time-only lines, key blocks) is carried by ``ordered.carry``.
JSON records over several lines become one entry (``json_blocks``), at the cost of two passes where a line may open one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.functions.levels import detect_level, usable_levels
from logquarry.functions.records import json_record
from logquarry.functions.secrets import PEM_BEGIN, PEM_END, has_secret
from logquarry.functions.text import split_source, strip_ansi
from logquarry.functions.times import DAY_MS, parse_timestamp, time_of_day
from logquarry.operators.json_blocks import OPENER, with_json_blocks
from logquarry.operators.ordered import CHUNK, carry, steps_down, with_chunks
from logquarry.options import ParseOptions
from logquarry.staging import discard, settled

# What continues an entry, what starts a step of a build, and a bare Java exception.
CONTINUATION = (
    r'^(\s+at\s|\s+\.\.\.\s\d+\s(more|common frames)|Caused by:|Suppressed:|\s+File ".*", line \d+'
    r"|Traceback \(most recent call last\)|goroutine \d+ \[|\t)"
)
STEP = r"^(?:\[Pipeline\] |\+ |##\[(?:end)?group\]|::(?:end)?group::)"
EXCEPTION = r'^(?:Exception in thread "[^"]*" )?(?:[a-z_$][\w$]*\.)+[A-Z][\w$]*(?:Exception|Error)(?![A-Za-z0-9_])(?::|\z)'

COLUMNS = (
    "file_id", "file_idx", "number", "text", "level", "continuation", "time", "gap", "json", "secret", "secret_block",
    "source", "entry_id", "timed_entry_id", "entry_time",
)


def _classified(lines: DataFrame, options: ParseOptions, keep: tuple[str, ...] = ()) -> DataFrame:
    """What each line tells by itself, and the columns to ``keep``."""
    raw = F.col("plain")
    custom = usable_levels(options.custom_levels)
    source, size = split_source(raw)
    key = raw.contains(" KEY-----")
    begin = raw.rlike(PEM_BEGIN) & ~raw.rlike(PEM_END)
    df = lines.withColumn("plain", strip_ansi(F.col("raw")))
    df = df.withColumns({"source": source, "prefix": size})
    df = df.withColumn("rest", F.substr(raw, F.col("prefix") + 1))
    rest = F.col("rest")
    df = df.withColumn("record", json_record(rest, {k.lower(): v for k, v in custom.items()}))
    is_json = F.col("record.json").isNotNull()
    shown = F.when(is_json, F.col("record.text")).otherwise(rest)
    df = df.withColumns(
        {
            "is_json": is_json,
            "text": F.concat(F.substr(raw, F.lit(1), F.col("prefix")), shown),
            "level_text": F.when(is_json, F.col("record.level_text")).otherwise(rest),
            "time_text": F.when(is_json, F.col("record.time_text")).otherwise(rest),
        }
    )
    return df.select(
        "file_id",
        "file_idx",
        "number",
        *([CHUNK] if CHUNK in df.columns else []),
        *keep,
        "plain",
        "text",
        "source",
        "is_json",
        F.col("record.json").alias("json"),
        F.when(key, F.when(begin, True).when(raw.rlike(PEM_END), False)).alias("key_marker"),
        (~F.col("is_json") & rest.rlike(CONTINUATION)).alias("continues"),
        (~F.col("is_json") & raw.contains("{") & raw.rlike(OPENER) & ~rest.rlike(CONTINUATION)).alias("is_opener"),
        F.coalesce("record.level", detect_level(F.col("level_text"), custom)).alias("own_level"),
        F.coalesce("record.time", parse_timestamp(F.col("time_text"), options.default_year)).alias("full_time"),
        F.when(~F.col("is_json") & rest.rlike(r"\A\[?\d\d:"), time_of_day(rest)).alias("clock"),
        F.when(rest.rlike(STEP), "step").when(rest.rlike(EXCEPTION), "exception").alias("role"),
        has_secret(F.col("text"), options.secret_patterns).alias("secret"),
    )


def parse(lines: DataFrame, options: ParseOptions = ParseOptions(), keep: tuple[str, ...] = ()) -> DataFrame:
    """The line table of ``lines`` (file_id, file_idx, number, raw).

    keep: columns of ``lines`` that the table has as well, such as raw, so that nothing is joined back to its lines.

    Beside what a line shows, it has the entry it belongs to: ``entry_id`` is the number of the line that starts it,
    ``timed_entry_id`` the same where lines without a time belong to the timed entry above, ``entry_time`` the last time.
    """
    chunked = options.chunk_lines > 0
    df = with_chunks(lines, options.chunk_lines)
    if chunked:  # A chunk's lines meet before they are read, so reading them is dealt over as many tasks as what follows.
        df = df.repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file_id", CHUNK)
    df = _classified(df, options, keep)
    has_keys = has_blocks = has_clocks = True
    written = []
    if chunked:  # What a log does not have is not carried along.
        df = settled(df, "classified")
        written.append(df)
        has_keys, has_blocks, has_clocks = df.agg(
            *[F.coalesce(F.bool_or(c), F.lit(False)) for c in (F.col("key_marker").isNotNull(), F.col("is_opener"), F.col("clock").isNotNull())]
        ).first()
    has_blocks &= options.json_blocks
    if has_keys:
        df = carry(df, {"in_key": (F.col("key_marker"), False)})
        df = df.withColumn("in_key", F.coalesce("in_key", F.lit(False)))
    else:
        df = df.withColumn("in_key", F.lit(False))
    if has_blocks:
        if has_keys:  # Without keys the table written first is read again as it is.
            df = settled(df, "keys")
            written.append(df)
        df = with_json_blocks(df, options, usable_levels(options.custom_levels))
    inside = F.col("in_key")
    end = F.coalesce(~F.col("key_marker"), F.lit(False))
    df = df.withColumns(
        {
            "continuation": inside | F.col("continues"),
            "secret_block": inside & ~end,
            "secret": F.when(inside, ~end).otherwise(F.col("secret")),
            "source": F.when(~inside, F.col("source")),
            "json": F.when(~inside, F.col("json")),
            "text": F.when(inside, F.col("plain")).otherwise(F.col("text")),
        }
    )
    head = ~F.col("continuation")
    df = df.withColumn("clock", F.when(head & F.col("full_time").isNull(), F.col("clock")))
    df = steps_down(df, "days", "clock", DAY_MS // 2) if has_clocks else df.withColumn("days", F.lit(0))
    day = (F.lit(options.base_day).cast("long") + F.col("days")) * DAY_MS
    df = df.withColumns(
        {
            "own_level": F.when(head, F.col("own_level")),
            "time": F.when(head, F.coalesce("full_time", day + F.col("clock"))),
        }
    ).drop("plain", "key_marker", "in_key", "continues", "is_opener", "clock", "days", "full_time")
    if chunked and (has_keys or has_blocks or has_clocks):
        df = settled(df, "timed")
        discard(*written)

    told = head & (F.col("own_level").isNotNull() | F.col("time").isNotNull())
    at = F.col("number").alias("at")
    none = F.lit(None).cast("string")
    set_level = F.when(told, F.struct(at, F.col("own_level").alias("level"))).when(
        head & (F.col("role") == "step"), F.struct(at, none.alias("level"))
    )
    df = carry(
        df,
        {
            "level_set": (set_level, True),
            "exception_at": (F.when(head & ~told & (F.col("role") == "exception"), F.col("number")), True),
            "last_time": (F.col("time"), False),
            "entry_time": (F.col("time"), True),
            "entry_id": (F.when(head, F.col("number")), True),
            "timed_at": (F.when(head & F.col("time").isNotNull(), F.col("number")), True),
        },
    )
    thrown = F.col("exception_at").isNotNull() & (
        F.col("level_set").isNull() | (F.col("exception_at") > F.col("level_set.at"))
    )
    df = df.withColumns(
        {
            "level": F.coalesce("level_set.level", F.when(thrown, "ERROR")),
            "gap": F.col("time") - F.col("last_time"),
            "entry_id": F.coalesce("entry_id", F.lit(0)),
            "timed_entry_id": F.coalesce("timed_at", "entry_id", F.lit(0)),
        }
    )
    return df.select(*COLUMNS, *keep, *([CHUNK] if chunked else []))


def with_timed_entries(df: DataFrame) -> DataFrame:
    """timed_entry_id anew, for a line table of which lines were left out.

    Heads without a time belong to the timed entry above; only where there is none yet do they start one.
    """
    head = ~F.col("continuation")
    df = carry(
        df,
        {
            "timed_at": (F.when(head & F.col("time").isNotNull(), F.col("number")), True),
            "head_at": (F.when(head, F.col("number")), True),
        },
    )
    return df.withColumn("timed_entry_id", F.coalesce("timed_at", "head_at", F.lit(0))).drop("timed_at", "head_at")
