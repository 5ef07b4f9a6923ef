"""Timestamps of log lines, as Column expressions that give milliseconds since 1970 (bigint)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logquarry.functions.levels import bound

DAY_MS = 86_400_000
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
_MON = rf"({'|'.join(MONTHS)})"
_END = "(?![A-Za-z0-9_])"
# The formats of timestamps, in the order they are tried, and where their parts are: year, month, day,
# hour, minute, second, fraction, zone, half of the day, kind.
FORMATS = (
    (
        r"(\d{4})[-/](\d{2})[-/](\d{2})[T ](\d{2}):(\d{2}):(\d{2})(?:[.,](\d{1,9}))?(Z|[+-]\d{2}:?\d{2})?",
        "$1|$2|$3|$4|$5|$6|$7|$8||iso",
    ),
    (rf"(\d{{2}})/{_MON}/(\d{{4}}):(\d{{2}}):(\d{{2}}):(\d{{2}})(?: ([+-]\d{{4}}))?", "$3|$2|$1|$4|$5|$6||$7||"),
    (
        rf"(\d{{2}})[- ]{_MON}[- ](\d{{4}}) (\d{{2}}):(\d{{2}}):(\d{{2}})(?:\.(\d{{1,3}}))?",
        "$3|$2|$1|$4|$5|$6|$7|||",
    ),
    (
        rf"\[(?:[A-Z][a-z]{{2}} )?{_MON} (\d{{2}}) (\d{{2}}):(\d{{2}}):(\d{{2}})(?:\.(\d{{1,3}})\d*)? (\d{{4}})\]",
        "$7|$1|$2|$3|$4|$5|$6|||",
    ),
    (rf"^{_MON} (\d{{1,2}}), (\d{{4}}) (\d{{1,2}}):(\d{{2}}):(\d{{2}}) ([AP]M){_END}", "$3|$1|$2|$4|$5|$6|||$7|"),
    (r"^[IWEF](\d{2})(\d{2}) (\d{2}):(\d{2}):(\d{2})\.(\d{3})\d{3}\s", "|$1|$2|$3|$4|$5|$6|||"),
    (rf"^(?:<\d{{1,3}}>)?{_MON} {{1,2}}(\d{{1,2}}) (\d{{2}}):(\d{{2}}):(\d{{2}}){_END}", "|$1|$2|$3|$4|$5||||"),
    (rf"^(\d{{2}})-(\d{{2}}) (\d{{2}}):(\d{{2}}):(\d{{2}})\.(\d{{3}}){_END}", "|$1|$2|$3|$4|$5|$6|||"),
    (rf"^\s*(\d{{10}}(?:\.\d+)?|\d{{13}}){_END}", "$1|||||||||epoch"),
)
# What every format has, and the commonest one.
_ANY_TIME = r"\d\d:\d\d|\d{10}"
_ISO = FORMATS[0][0]
_ZONE = r"(?:Z|[+-]\d{2}:?\d{2})\z"
TIME_ONLY = r"^\[?(\d{2}):(\d{2}):(\d{2})(?:[.,](\d{1,3})\d*)?(?=[\s\]])"


def _millis(fraction: Column) -> Column:
    """Milliseconds of a fraction's digits, cut, not rounded."""
    return F.coalesce(F.substring(F.rpad(fraction, 3, "0"), 1, 3).try_cast("bigint"), F.lit(0))


def _value(p: Column, default_year: int) -> Column:
    """Milliseconds of the parts of a timestamp. Days of ISO dates must exist; those of other formats roll over."""
    kind, half = F.get(p, F.lit(9)), F.get(p, F.lit(8))

    def number(i: int) -> Column:
        return F.get(p, F.lit(i)).try_cast("int")

    name = F.instr(F.lit("".join(MONTHS)), F.get(p, F.lit(1)))
    year, month = F.coalesce(number(0), F.lit(default_year)), F.coalesce(number(1), F.floor((name + 2) / 3).cast("int"))
    day, mi, s = number(2), number(4), number(5)
    h = F.when(half == "", number(3)).otherwise(number(3) % 12 + F.when(half == "PM", 12).otherwise(0))
    ms = _millis(F.get(p, F.lit(6)))
    zone = F.replace(F.get(p, F.lit(7)), F.lit(":"), F.lit(""))
    zh, zm = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 4, 2).try_cast("int")
    offset = F.when(zh.isNull(), 0).otherwise(F.when(zone.startswith("-"), -1).otherwise(1) * (zh * 60 + zm))
    first = F.make_date(year + F.floor((month - 1) / 12).cast("int"), F.pmod(month - 1, F.lit(12)) + 1, F.lit(1))
    days = F.unix_date(first).cast("bigint") + day - 1
    time = days * DAY_MS + ((h * 60 + mi) * 60 + s) * 1000 + ms - offset * 60_000
    real = month.between(1, 12) & (day >= 1) & (day <= F.day(F.last_day(first))) & (mi < 60) & (s < 60)
    real = real & ((h < 24) | ((h == 24) & (mi == 0) & (s == 0) & (ms == 0))) & F.coalesce((zh < 24) & (zm < 60), F.lit(True))
    raw = F.get(p, F.lit(0))
    epoch = F.when(F.length(raw) == 13, raw.try_cast("double")).otherwise(raw.try_cast("double") * 1000)
    return (
        F.when(kind == "epoch", F.when((epoch >= 978_307_200_000) & (epoch < 4_102_444_800_000), F.floor(epoch + 0.5)))
        .when((kind != "iso") | real, time)
        .cast("bigint")
    )


def parse_timestamp(text: Column, default_year: int) -> Column:
    """The first timestamp in a line's first 80 characters, or null; no zone means UTC.

    An ISO time is read by a cast; all else, and what the cast refuses, part by part.
    """

    def parts(head: Column) -> Column:
        found = [F.get(F.regexp_extract_all(head, F.lit(regex), F.lit(0)), F.lit(0)) for regex, _ in FORMATS]
        return F.split(F.coalesce(*[F.regexp_replace(f, regex, by) for f, (regex, by) in zip(found, FORMATS)]), r"\|", -1)

    def quick(iso: Column) -> Column:
        return F.unix_millis(F.when(iso.rlike(_ZONE), iso).otherwise(F.concat(iso, F.lit("Z"))).try_cast("timestamp"))

    head = F.substring(text, 1, 80)
    iso = F.translate(F.regexp_extract(head, _ISO, 0), "/,", "-.")
    whole = bound(bound(head, parts), lambda p: _value(p, default_year))
    return F.when(head.rlike(_ANY_TIME), F.coalesce(bound(iso, quick), whole))


def time_of_day(text: Column) -> Column:
    """Milliseconds since midnight of a line that starts with a time and no date, or null."""

    def value(found: Column) -> Column:
        def digits(at: int) -> Column:
            return F.substring(found, at, 2).try_cast("bigint")

        h, mi, s = digits(1), digits(4), digits(7)
        ms = _millis(F.substring(found, 10, 3))
        return F.when((h <= 23) & (mi <= 59) & (s <= 60), ((h * 60 + mi) * 60 + s) * 1000 + ms)

    head = F.substring(text, 1, 20)
    found = F.regexp_extract(head, TIME_ONLY, 0)
    return F.when(head.rlike(TIME_ONLY), bound(F.replace(found, F.lit("["), F.lit("")), value))


def format_time(ms: Column, zone: str | None = None) -> Column:
    """yyyy-MM-dd HH:mm:ss.SSSZ in UTC, or with its offset in a time zone. The session's time zone must be UTC."""
    if zone is None:
        return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss.SSS'Z'")
    local = F.from_utc_timestamp(F.timestamp_millis(ms), zone)
    minutes = F.floor((F.unix_millis(local) - ms) / 60_000)
    sign = F.when(minutes < 0, "-").otherwise("+")
    clock = F.format_string("%02d:%02d", F.floor(F.abs(minutes) / 60), F.abs(minutes) % 60)
    return F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss.SSS"), sign, clock)


def format_gap(ms: Column) -> Column:
    """+250ms, +5.5s, +2m5s, +1.5h; a minus sign before gaps back in time."""
    n = F.abs(F.floor(ms + 0.5)).cast("bigint")
    sign = F.when(ms < 0, "−").otherwise("+")

    def tenths(x: Column) -> Column:
        return F.concat(F.floor(x / 10).cast("string"), F.lit("."), (x % 10).cast("string"))

    t, sec = F.floor(n / 100), F.floor(n / 1000)
    shown = (
        F.when(n < 1000, F.concat(n.cast("string"), F.lit("ms")))
        .when(t < 600, F.concat(tenths(t), F.lit("s")))
        .when(sec < 3600, F.concat(F.floor(sec / 60).cast("string"), F.lit("m"), (sec % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(tenths(F.floor(n / 360_000)), F.lit("h")))
    )
    return F.when(ms.isNull(), "").otherwise(F.concat(sign, shown))


def format_duration(ms: Column) -> Column:
    """0.4ms, 120ms, 1.2s, 3.5m, 2h; the unit is chosen after rounding."""

    def rounded(x: Column, places: int) -> Column:
        shown = F.format_string(f"%.{places}f", F.floor(x * 10**places + 0.5) / 10**places)
        return F.regexp_replace(F.regexp_replace(shown, r"(\.\d*?)0+\z", "$1"), r"\.\z", "")

    def below(x: Column, limit: int) -> Column:
        return F.abs(F.floor(x * 10 + 0.5) / 10) < limit

    ms = ms.cast("double")
    return (
        F.when(F.abs(ms) < 1, F.concat(rounded(ms, 3), F.lit("ms")))
        .when(below(ms, 1000), F.concat(rounded(ms, 1), F.lit("ms")))
        .when(below(ms / 1000, 60), F.concat(rounded(ms / 1000, 1), F.lit("s")))
        .when(below(ms / 60_000, 60), F.concat(rounded(ms / 60_000, 1), F.lit("m")))
        .otherwise(F.concat(rounded(ms / 3_600_000, 1), F.lit("h")))
    )
