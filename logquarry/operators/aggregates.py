"""Aggregates over the line table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquarry.functions.fields import field, line_keys, numeric, whole_token
from logquarry.functions.levels import LEVELS
from logquarry.functions.records import js_number
from logquarry.functions.text import TRACE_HEX, UUID, signature, trim, without_source
from logquarry.operators.ordered import carry, global_running, with_hits, with_row
from logquarry.plans.search import condition_key, condition_value
from logquarry.staging import settled

FRAMES = 3
# Names of fields that hold an id, and the columns a table starts with.
ID_KEY = (
    r"(?i)\A(?:x[_.-]?)?(?:trace|span|request|req|correlation|transaction|txn|session|order|job|user|tenant)[_.-]?id\z"
)
TABLE_COLUMNS = (
    ("@timestamp", "timestamp", "time", "ts"),
    ("level", "severity", "lvl"),
    ("service", "logger", "app", "component"),
    ("message", "msg", "event"),
)
# Names of fields that hold a duration, or a name worth filtering by, in the order they are tried.
DURATION_KEYS = ("duration", "took", "elapsed", "latency")
NAME_KEYS = ("service", "method", "logger", "app", "user")
# How sections of a build log start and end.
_STAMP = r"^(?:\d{4}-\d{2}-\d{2}T[\d:.]+Z\s)?"
SECTION_START = _STAMP + r"(?:##\[group\]|::group::)(.*)\z"
SECTION_END = _STAMP + r"(?:##\[endgroup\]|::endgroup::)\s*\z"


def level_counts(df: DataFrame) -> DataFrame:
    """(level, lines): every level and UNKNOWN, with 0 where there is none. One pass, one row a task."""
    names = (*LEVELS, "UNKNOWN")
    level = F.coalesce("level", F.lit("UNKNOWN"))
    counts = df.agg(*[F.count_if(level == n).alias(n) for n in names])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.col(n).alias("lines")) for n in names])).alias("c")).select("c.*")


def secret_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if("secret").alias("secrets"))


def timeline(df: DataFrame, buckets: int = 80) -> DataFrame:
    """(bucket, from_ms, to_ms, errors, warnings, total): entries per time slice; no rows for under two distinct times."""
    timed = df.where("time IS NOT NULL").select("time", "level")
    span = timed.agg(F.min("time").alias("lo"), F.max("time").alias("hi")).where("lo < hi")
    size = (F.col("hi") - F.col("lo")) / buckets
    slot = F.least(F.lit(buckets - 1), F.floor((F.col("time") - F.col("lo")) / size)).cast("int")
    # The span is one row, so it goes to every task.
    counts = (
        with_row(timed, span)
        .groupBy(slot.alias("bucket"))
        .agg(
            F.count_if(F.col("level") == "ERROR").alias("errors"),
            F.count_if(F.col("level") == "WARN").alias("warnings"),
            F.count("*").alias("total"),
        )
    )
    slots = span.select(F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), "lo", size.alias("size"))
    none = F.lit(0).cast("long")
    return slots.join(counts, "bucket", "left").select(
        "bucket",
        (F.col("lo") + F.col("bucket") * F.col("size")).alias("from_ms"),
        (F.col("lo") + (F.col("bucket") + 1) * F.col("size")).alias("to_ms"),
        *[F.coalesce(c, none).alias(c) for c in ("errors", "warnings", "total")],
    )


def _values(df: DataFrame, key: str) -> DataFrame:
    return df.where("NOT continuation").select(field(key).alias("value")).where("value IS NOT NULL")


def top_values(df: DataFrame, key: str, top: int = 10) -> DataFrame:
    """(value, count): the most common values of a field among entries; ties in Unicode order."""
    counts = _values(df, key).groupBy("value").agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), F.collate("value", "UNICODE"), "value").limit(top)


def numeric_stats(df: DataFrame, key: str) -> DataFrame:
    """One row (count, min, median, p95, p99, max, duration) by nearest rank; none for text or under two numbers."""
    v = _values(df, key).withColumn("n", numeric(F.col("value")))
    unit = F.col("n").isNotNull() & trim(F.col("value")).rlike(r"(?i)[a-zµ]\z")
    # One row a distinct value; ranks are sums of their counts, so no task sorts all values.
    counted = settled(v.groupBy("n").agg(F.count("*").alias("times"), F.bool_or(unit).alias("unit")), "values")
    known = F.col("n").isNotNull()
    whole = counted.agg(
        F.sum("times").alias("total"), F.coalesce(F.sum(F.when(known, F.col("times"))), F.lit(0)).alias("count"), F.bool_or("unit").alias("duration")
    )
    ranked = with_row(global_running(counted.where(known), ["n"], F.col("times"), "below"), whole)

    def rank(p: float, name: str) -> Column:
        reached = F.col("below") + F.col("times") >= F.greatest(F.lit(1), F.ceil(F.col("count") * p))
        return F.min(F.when(reached, F.col("n"))).alias(name)

    out = ranked.groupBy("total", "count", "duration").agg(
        F.min("n").alias("min"), rank(0.5, "median"), rank(0.95, "p95"), rank(0.99, "p99"), F.max("n").alias("max")
    )
    out = out.where((F.col("count") >= 2) & (F.col("count") >= F.col("total") * 0.8))
    return out.select("count", "min", "median", "p95", "p99", "max", "duration")


def error_entries(df: DataFrame) -> DataFrame:
    """(key, file_id, at, sample, source, time): ERROR entries and what makes them the same error.

    The key is the head's signature and those of its first frames. An entry is at most four short rows here, so grouping
    entries moves no whole trace.
    """
    df = carry(df, {"entry": (F.when(~F.col("continuation"), F.struct("number", "level")), True)})
    near = df.where("entry.level = 'ERROR' AND number - entry.number <= 3")
    return entries_of(error_lines(near, F.col("entry.number")))


def error_lines(near: DataFrame, head: Column) -> DataFrame:
    """(file_id, at, number, sig, sample, source, time): what makes an error, from the first lines of ERROR entries."""
    rest = without_source(F.col("text"))
    own = {"sample": rest, "source": F.col("source"), "time": F.col("time")}
    return near.select(
        "file_id", head.alias("at"), "number", signature(rest).alias("sig"), *[F.when(F.col("number") == head, c).alias(n) for n, c in own.items()]
    )


def entries_of(lines: DataFrame) -> DataFrame:
    """The entries that ``error_lines`` belong to, each with its key."""
    entries = lines.groupBy("file_id", "at").agg(
        F.array_sort(F.collect_list(F.struct("number", "sig"))).alias("sigs"), *[F.max(c).alias(c) for c in ("sample", "source", "time")]
    )
    key = F.array_join(F.transform("sigs", lambda s: s["sig"]), "\n")
    return entries.select(key.alias("key"), "file_id", "at", "sample", "source", "time")


def error_groups(df: DataFrame) -> DataFrame:
    """(key, sample, count, first_line, sources, first, last): the groups of ``error_entries``."""
    return groups_of(error_entries(df))


def groups_of(entries: DataFrame) -> DataFrame:
    place = F.struct("file_id", "at")
    # Sources in the order they were first seen: one row a source and group, then one a group.
    by_source = (
        entries.groupBy("key", "source")
        .agg(
            F.count("*").alias("n"),
            F.min(F.struct(place.alias("place"), "sample")).alias("head"),
            F.min("time").alias("first"),
            F.max("time").alias("last"),
        )
    )
    seen = F.struct(F.col("head.place").alias("place"), "source")
    return by_source.groupBy("key").agg(
        F.min("head")["sample"].alias("sample"),
        F.sum("n").alias("count"),
        F.min("head")["place"]["at"].alias("first_line"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("source").isNotNull(), seen))), lambda s: s["source"]).alias("sources"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
    )


def sorted_groups(groups: DataFrame, order: str = "count") -> DataFrame:
    """Largest first, or in the order they first happened: by time where every group has one, else by line."""
    line = F.col("first_line")
    if order == "count":
        return groups.orderBy(F.desc("count"), line)
    untimed = groups.agg(F.count_if(F.col("first").isNull()).alias("untimed"))
    ordered = with_row(groups, untimed)
    return ordered.orderBy(F.when(F.col("untimed") == 0, F.col("first")), line).drop("untimed")


def top_groups(groups: DataFrame, order: str = "count", limit: int = 50) -> DataFrame:
    """The groups that a panel shows; ``is_earliest`` marks the first error of the whole log, if there are several groups."""
    groups = settled(groups, "groups")
    first = sorted_groups(groups, "first").limit(1).select(F.col("key").alias("earliest_key"))
    whole = with_row(groups.agg(F.count("*").alias("n_groups")), first)
    shown = sorted_groups(groups, order).limit(limit)
    marked = with_row(shown, whole).withColumn("is_earliest", (F.col("key") == F.col("earliest_key")) & (F.col("n_groups") > 1))
    return sorted_groups(marked.drop("n_groups", "earliest_key"), order)


def group_lines(df: DataFrame, groups: DataFrame) -> DataFrame:
    """The entries of error groups, with their continuation lines."""
    heads = error_entries(df).join(groups.select("key"), "key", "left_semi")
    # A row an entry, which Spark would take for as small as the compressed files it was read from.
    entries = heads.select("file_id", F.col("at").alias("entry_id")).hint("merge")
    return df.join(entries, ["file_id", "entry_id"], "left_semi")


def error_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(change, key, sample, count): error groups that are added or gone, or the same, between two logs."""
    a, b = error_groups(before), error_groups(after)
    names = ["key", "sample", "count"]
    parts = [
        b.join(a, "key", "left_anti").select(F.lit("added").alias("change"), *names),
        a.join(b, "key", "left_anti").select(F.lit("gone").alias("change"), *names),
        b.join(a, "key", "left_semi").select(F.lit("same").alias("change"), *names),
    ]
    return parts[0].union(parts[1]).union(parts[2])


def collapse_repeats(df: DataFrame) -> DataFrame:
    """Runs of equal entries as their first entry; ``repeat`` on its head says how many there were.

    Entries are equal if their lines' signatures are, in order: two sums of hashes of a line's place in its entry and
    its signature, which add up chunk by chunk, so that an entry of any length is never held whole. Lines before any
    head are an entry as well.
    """
    names = df.columns
    df = with_hits(df, ~F.col("continuation"))
    entry = F.coalesce(F.when(F.col("is_match"), F.col("place")), "hit_before", F.lit(0))
    df = df.withColumns({"entry": entry, "nth": F.col("place") - entry}).drop("is_match", "place", "hit_before", "hit_after")
    sig = signature(F.col("text"))
    sums = [F.sum(F.xxhash64(F.lit(seed), "nth", sig).cast("decimal(38,0)")).alias(f"sum_{seed}") for seed in (1, 2)]
    keys = ["file_id", *(["chunk"] if "chunk" in names else [])]
    entries = df.groupBy("file_id", "entry").agg(
        *sums, F.count("*").alias("lines"), F.min("number").alias("number"), *[F.min(k).alias(k) for k in keys[1:]]
    )
    sig = F.struct("lines", "sum_1", "sum_2").alias("sig")
    entries = settled(entries.select(*keys, "entry", "number", sig), "entries")
    entries = carry(entries, {"sig_before": (F.col("sig"), False)})
    new = F.coalesce(F.col("sig") != F.col("sig_before"), F.lit(True))
    entries = carry(entries, {"run": (F.when(new, F.col("number")), True)})
    runs = entries.groupBy("file_id", "run").agg(F.count("*").alias("repeat"), F.min_by("entry", "number").alias("entry"))
    # Nearly a row an entry, which Spark would take for as small as the compressed files it was read from.
    out = df.join(runs.hint("merge"), ["file_id", "entry"])
    repeat = F.when(F.col("number") == F.col("run"), F.col("repeat")).otherwise(1).alias("repeat")
    return out.select(*names, repeat)


def section_marks(text: Column) -> tuple[Column, Column, Column]:
    """(whether a line starts a section, whether it ends one, the title of one that starts)."""
    rest = without_source(text)
    starts = rest.rlike(SECTION_START)
    return starts, rest.rlike(SECTION_END) & ~starts, trim(F.regexp_extract(rest, SECTION_START, 1))


def sections(df: DataFrame) -> DataFrame:
    """(file_id, start, title, end, errors, lines): the sections of a build log; a new one ends the one before."""
    starts, ends, title = section_marks(F.col("text"))
    df = df.withColumns({"is_start": starts, "is_end": ends})
    df = carry(
        df,
        {
            "start": (F.when(F.col("is_start"), F.col("number")), True),
            "ended": (F.when(F.col("is_end"), F.col("number")), False),
        },
    )
    member = F.col("start").isNotNull() & (F.col("ended").isNull() | (F.col("ended") < F.col("start")))
    error = (F.col("level") == "ERROR") & ~F.col("continuation") & ~F.col("is_start")
    return df.where(member).groupBy("file_id", "start").agg(
        F.max(F.when(F.col("is_start"), title)).alias("title"),
        F.max("number").alias("end"),
        F.count_if(error).alias("errors"),
        F.count("*").alias("lines"),
    )


def trace(df: DataFrame, value: str) -> DataFrame:
    """One row (entries, sources, first, last): where an id appears, as a whole token, among entries."""
    hits = df.where(~F.col("continuation") & whole_token(F.col("text"), value))
    by_source = hits.groupBy("source").agg(
        F.count("*").alias("n"), F.min("number").alias("at"), F.min("time").alias("first"), F.max("time").alias("last")
    )
    seen = F.when(F.col("source").isNotNull(), F.struct("at", "source"))
    return by_source.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("entries"),
        F.transform(F.array_sort(F.collect_list(seen)), lambda s: s["source"]).alias("sources"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
    )


def line_ids(df: DataFrame) -> DataFrame:
    """(file_id, number, ids): up to six ids (key, value) of a line: fields named as ids, UUIDs and trace ids in its text."""
    text = without_source(F.col("text"))
    named = F.filter(line_keys(), lambda k: k.rlike(ID_KEY))
    from_json = F.transform(named, lambda k: F.struct(k.alias("key"), F.call_function("get_json_object", F.col("json"), F.concat(F.lit("$['"), k, F.lit("']"))).alias("value")))
    pair = F.lit(r'=("(?:[^"\\]|\\.)*"|[^\s,)}]*)')
    from_text = F.transform(
        named,
        lambda k: F.struct(k.alias("key"), F.regexp_replace(F.get(F.regexp_extract_all(F.col("text"), F.concat(F.lit(r"(?:^|[\s,{(])\Q"), k, F.lit(r"\E"), pair), F.lit(1)), F.lit(0)), '^"|"$', "").alias("value")),
    )

    def found(regex: str, key: str) -> Column:
        hits = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
        return F.transform(hits, lambda v: F.struct(F.lit(key).alias("key"), v.alias("value")))

    ids = F.concat(F.when(F.col("json").isNotNull(), from_json).otherwise(from_text), found(UUID, "id"), found(TRACE_HEX, "trace"))
    ids = F.transform(ids, lambda s: F.struct(s["key"].alias("key"), trim(s["value"]).alias("value")))
    ids = F.filter(ids, lambda s: s["value"].isNotNull() & F.length(s["value"]).between(2, 100))
    df = df.withColumn("all_ids", ids)
    first = F.filter("all_ids", lambda s, i: F.array_position(F.transform("all_ids", lambda x: x["value"]), s["value"]) == i + 1)
    return df.select("file_id", "number", F.slice(first, 1, 6).alias("ids"))


def common_fields(df: DataFrame, sample: int = 500) -> DataFrame:
    """(key, entries): field names among each file's first lines, most common first."""
    heads = df.where((F.col("number") <= sample) & ~F.col("continuation"))
    keys = F.when(F.col("json").isNotNull(), F.json_object_keys("json")).otherwise(line_keys())
    rows = heads.select("number", F.posexplode(keys).alias("pos", "key"))
    counts = rows.groupBy("key").agg(F.count("*").alias("entries"), F.min(F.struct("number", "pos")).alias("at"))
    return counts.orderBy(F.desc("entries"), "at").drop("at")


def suggested_condition(df: DataFrame) -> str | None:
    """A field condition worth trying on a log, from its common fields and, for plain names, its first 500 lines."""
    wanted = {"status", *DURATION_KEYS, "level", *NAME_KEYS}
    have = {r["key"] for r in common_fields(df).where(F.col("key").isin(*wanted)).collect()}
    if "status" in have:
        return "status>=500"
    for key in DURATION_KEYS:
        if key in have:
            return f"{key}>1s"
    if "level" in have:
        return "level=error"
    key = next((k for k in NAME_KEYS if k in have), None)
    if key is None:
        return None
    values = df.where(F.col("number") <= 500).select("number", field(key).alias("value"))
    row = values.where(F.col("value").rlike(r"\A[A-Za-z0-9_.@/:-]+\z")).orderBy("number").first()
    return row and f"{key}={row['value']}"


def stat_condition(key: str, value: str | float, duration: bool | None = None) -> str:
    """The condition that a value (text) or a percentile (number; whether it is a duration) of a field stands for."""
    if isinstance(value, str):
        return f"{condition_key(key)}={condition_value(value)}"
    return f"{condition_key(key)}>={js_number(value)}{'ms' if duration else ''}"


def json_share(df: DataFrame) -> DataFrame:
    """One row (mostly_json): whether half of the entries are JSON records."""
    heads = df.where("NOT continuation")
    return heads.agg(F.coalesce(F.avg(F.col("json").isNotNull().cast("int")) >= 0.5, F.lit(False)).alias("mostly_json"))


def default_columns(df: DataFrame) -> list[str]:
    """The first of each list of preferred columns that the first 200 lines have."""
    keys = df.where((F.col("number") <= 200) & F.col("json").isNotNull()).select(F.explode(F.json_object_keys("json")).alias("k"))
    names = {n for group in TABLE_COLUMNS for n in group}
    have = {r["k"] for r in keys.where(F.col("k").isin(*names)).distinct().collect()}
    return [next(n for n in group if n in have) for group in TABLE_COLUMNS if have & set(group)]


def sources(df: DataFrame) -> DataFrame:
    """(source, first_line) in the order first seen."""
    return df.where("source IS NOT NULL").groupBy("source").agg(F.min("number").alias("first_line")).orderBy("first_line")


def minimap(df: DataFrame, rows: int) -> DataFrame:
    """(row, marks): for each of ``rows`` slices of the log, 1 for warnings, 2 for errors, OR-ed."""
    bits = F.when(F.col("level") == "ERROR", 2).when(F.col("level") == "WARN", 1).otherwise(0)
    total = df.groupBy("file_id").agg(F.max("number").alias("n"))
    out = df.join(total, "file_id").withColumn("row", F.floor((F.col("number") - 1) / F.col("n") * rows))
    return out.groupBy("file_id", "row").agg(F.bit_or(bits).alias("marks")).where("marks > 0")


def range_summary(df: DataFrame, first: int, last: int) -> DataFrame:
    """One row (lines, span_ms): lines of a range and the time from its first to its last entry."""
    part = df.where(F.col("number").between(first, last))
    return part.agg(
        F.count("*").alias("lines"),
        (F.max_by("entry_time", "number") - F.min_by("entry_time", "number")).alias("span_ms"),
    )


def status_counts(df: DataFrame, total: DataFrame) -> DataFrame:
    """One row (shown, total, hidden) for a filtered table and the whole one."""
    shown = df.agg(F.count_if(~F.coalesce("is_context", F.lit(False))).alias("shown") if "is_context" in df.columns else F.count("*").alias("shown"))
    whole = total.agg(F.count("*").alias("total"))
    return with_row(shown, whole).withColumn("hidden", F.col("total") - F.col("shown"))


def bookmark_rows(df: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """(number, note, text, time, since_ms): bookmarked lines, their entry's time and the pause since the last timed one.

    Bookmarks (number, note) are made by hand, so they and what is made of them are few.
    """
    head = F.struct("number", "time")
    df = carry(df, {"entry": (F.when(~F.col("continuation"), head), True)})
    rows = df.join(bookmarks.select("number", "note"), "number").select("number", "note", "text", F.col("entry.time").alias("time"))
    w = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("since_ms", F.col("time") - F.last("time", ignorenulls=True).over(w))
