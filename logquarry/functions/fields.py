"""Fields of log lines: JSON keys and paths, key=value pairs, level and pod."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from logquarry.functions.levels import bound, named
from logquarry.functions.text import trim
from logquarry.plans.search import Condition

# How a pair looks, the units of durations, and other names of levels.
PAIR = r'(?:^|[\s,{(])([A-Za-z_@][\w.@-]*)=("(?:[^"\\]|\\.)*"|[^\s,)}]*)'
UNITS = {"ns": 1e-6, "us": 1e-3, "µs": 1e-3, "ms": 1.0, "s": 1000.0, "m": 60_000.0, "h": 3_600_000.0}
LEVEL_NAMES = {"err": "error", "fatal": "error", "critical": "error", "warning": "warn", "dbg": "debug"}
_NUMBER = r"\A(-?\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h)?\z"


def _path(parts: list[str]) -> str:
    return "$" + "".join(f"['{p}']" for p in parts)


def _json_field(record: Column, key: str) -> Column:
    found = [F.get_json_object(record, _path([key]))] if "'" not in key else []
    if "." in key and "'" not in key:
        found.append(F.get_json_object(record, _path(key.split("."))))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _plain_field(text: Column, key: str) -> Column:
    pair = rf'(?:^|[\s,{{(]){re.escape(key)}=("(?:[^"\\]|\\.)*"|[^\s,)}}]*)'
    raw = F.when(text.rlike(pair), F.regexp_extract(text, pair, 1))
    inner = F.regexp_replace(F.substr(raw, F.lit(2), F.length(raw) - 2), r"\\(.)", "$1")
    return F.when(raw.rlike(r'(?s)\A".*"\z') & (F.length(raw) >= 2), inner).otherwise(raw)


def field(key: str) -> Column:
    """A field's value as text, or null: of the record, of the text's pairs, or the line's own level or pod."""
    own = {"level": F.col("level"), "pod": F.col("source")}.get(key, F.lit(None).cast("string"))
    value = _json_field(F.col("json"), key)
    if key == "level":
        number = value.rlike(r"\A-?\d+(?:\.\d+)?\z") & ~F.col("json").rlike(r'"level":"')
        value = F.when(F.col("json").isNotNull() & number & F.col("level").isNotNull(), F.col("level")).otherwise(value)
    return F.coalesce(value, _plain_field(F.col("text"), key), own)


def plain_keys(text: Column) -> Column:
    """The distinct keys of a text's pairs, in their order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(PAIR), F.lit(1)))


def line_keys() -> Column:
    """A line's field names: of its record or its pairs, and pod."""
    keys = F.when(F.col("json").isNotNull(), F.json_object_keys("json")).otherwise(plain_keys(F.col("text")))
    return F.when(F.col("source").isNotNull(), F.concat(keys, F.array(F.lit("pod")))).otherwise(keys)


def numeric(value: Column) -> Column:
    """A number, durations in milliseconds; null for other text."""

    def read(v: Column) -> Column:
        unit = F.regexp_extract(v, _NUMBER, 2)
        scale = F.when(unit == "", 1.0).otherwise(named_number(unit))
        return F.when(v.rlike(_NUMBER), F.regexp_extract(v, _NUMBER, 1).try_cast("double") * scale)

    return bound(trim(value), read)


def named_number(unit: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, scale in UNITS.items():
        out = F.when(unit == name, scale).otherwise(out)
    return out


def _literal_number(text: str) -> float | None:
    found = re.fullmatch(r"(-?\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h)?", text.strip(), re.ASCII)
    return found and float(found[1]) * (UNITS[found[2]] if found[2] else 1)


def meets(condition: Condition) -> Column:
    """Whether a line meets a condition, never null. A missing field only meets !=."""
    wanted = _literal_number(condition.value)

    def test(actual: Column) -> Column:
        if condition.op in ("=", "!="):
            text, want = F.lower(actual), condition.value.lower()
            if condition.key == "level":
                text, want = F.coalesce(named(text, LEVEL_NAMES), text), LEVEL_NAMES.get(want, want)
            if "*" in want and not condition.exact:
                equal = text.rlike(r"\A" + ".*".join(re.escape(p) for p in want.split("*")) + r"\z")
            else:
                equal = text == want
            if wanted is not None:
                equal = equal | F.coalesce(numeric(actual) == wanted, F.lit(False))
            equal = F.coalesce(equal, F.lit(False))
            return equal if condition.op == "=" else ~equal
        if wanted is None:
            return F.lit(False)
        n = numeric(actual)
        kept = {">": n > wanted, ">=": n >= wanted, "<": n < wanted, "<=": n <= wanted}[condition.op]
        return F.coalesce(kept, F.lit(False))

    return bound(field(condition.key), test)


def mentions(text: Column, words: list[str], case_sensitive: bool = False) -> Column:
    """Whether a text holds any of the words."""
    out = F.lit(False)
    for w in words:
        out = out | (text.contains(w) if case_sensitive else F.lower(text).contains(w.lower()))
    return out


def whole_token(text: Column, value: str) -> Column:
    return text.contains(value) & text.rlike(rf"(?<![A-Za-z0-9_-]){re.escape(value)}(?![A-Za-z0-9_-])")

