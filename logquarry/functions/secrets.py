"""Credentials in log lines: a flag, a mask and spans, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from logquarry.functions.levels import bound
from logquarry.functions.regex_risk import regex_risk

MASK = "********"
RANGES = "array<struct<start: int, end: int>>"
# Each pattern's first group is what stays before the secret; the second, if any, what stays after it.
_PLACEHOLDER = r"(?!\$\{|\{\{|<|%\(|\*\*\*)"
_NAME = r"(?:password|passwd|pwd|secret|secret[_-]?key|access[_-]?key|api[_-]?key|access[_-]?token|refresh[_-]?token|auth[_-]?token|token|private[_-]?key|client[_-]?secret)"
PATTERNS = (
    r"((?<![A-Za-z0-9])(?:AKIA|ASIA))[A-Z0-9]{16}(?![A-Z0-9])",
    r"((?<![A-Za-z0-9])gh[pousr]_)[A-Za-z0-9]{20,}",
    r"((?<![A-Za-z0-9])github_pat_)[A-Za-z0-9_]{20,}",
    r"((?<![A-Za-z0-9])glpat-)[A-Za-z0-9_-]{20,}",
    r"((?<![A-Za-z0-9])xox[abprs]-)[A-Za-z0-9-]{10,}",
    r"((?<![A-Za-z0-9])[sr]k_(?:live|test)_)[A-Za-z0-9]{16,}",
    r"((?<![A-Za-z0-9])AIza)[A-Za-z0-9_-]{35}",
    r"((?<![A-Za-z0-9])eyJ)[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    r"([a-z][a-z0-9+.-]*://[^\s:/@]+:)" + _PLACEHOLDER + r"\S+(@[^\s@]+)",
    r"(?i)(authorization[\"']?\s*[:=]\s*[\"']?(?:basic|bearer)\s+)[A-Za-z0-9+/=._~-]{6,}",
    rf"(?i)((?<![A-Za-z0-9]){_NAME}[\"']?\s*[:=]\s*\")" + _PLACEHOLDER + r"(?:[^\"\\]|\\.){4,}(\")",
    rf"(?i)((?<![A-Za-z0-9]){_NAME}[\"']?\s*[:=]\s*')" + _PLACEHOLDER + r"(?:[^'\\]|\\.){4,}(')",
    rf"(?i)((?<![A-Za-z0-9])(?:[A-Za-z0-9]+[_-])*{_NAME}\s*[:=]\s*)(?![\"'])" + _PLACEHOLDER + r"[^\s\"'&}]{4,}",
)
# What a text, in lower case, must hold for the pattern at the same place to match.
_HINTS = (
    ("akia", "asia"), ("gh",), ("github_pat_",), ("glpat-",), ("xox",), ("k_live_", "k_test_"), ("aiza",), ("eyj",), ("://",),
    ("authorization",), *[("password", "passwd", "pwd", "secret", "key", "token")] * 3,
)
PEM_BEGIN = r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"
PEM_END = r"-----END (?:[A-Z]+ )*PRIVATE KEY-----"


def _own(patterns: tuple[str, ...]) -> tuple[str, ...]:
    for p in patterns:
        if problem := regex_risk(p):
            raise ValueError(f"{p}: {problem}")
        re.compile(p)
    return patterns


def has_secret(text: Column, own: tuple[str, ...] = (), case_sensitive: bool = False) -> Column:
    """Whether a text holds a secret; case_sensitive: the names of credentials count in lower case alone."""
    low = F.lower(text)
    out = text.contains("-----BEGIN") & text.rlike(PEM_BEGIN)
    for hints, group in _by_hints(case_sensitive):
        some = low.contains(hints[0])
        for hint in hints[1:]:
            some = some | low.contains(hint)
        found = text.rlike(group[0])
        for regex in group[1:]:
            found = found | text.rlike(regex)
        out = out | (some & found)
    for regex in _own(own):
        out = out | text.rlike(regex)
    return out


def _rules(case_sensitive: bool) -> list[str]:
    return [p.removeprefix("(?i)") if case_sensitive else p for p in PATTERNS]


def _by_hints(case_sensitive: bool = False) -> list[tuple[tuple[str, ...], list[str]]]:
    groups: dict[tuple[str, ...], list[str]] = {}
    for hints, regex in zip(_HINTS, _rules(case_sensitive), strict=True):
        groups.setdefault(hints, []).append(regex)
    return list(groups.items())


def mask_secrets(text: Column, own: tuple[str, ...] = (), case_sensitive: bool = False) -> Column:
    """Every secret as a fixed mask, whatever its length; public prefixes stay.

    case_sensitive: the names of credentials count in lower case alone.
    """
    for regex in _rules(case_sensitive):
        text = F.regexp_replace(text, regex, f"$1{MASK}" + ("$2" if re.compile(regex).groups > 1 else ""))
    for regex in _own(own):
        text = F.regexp_replace(text, regex, MASK)
    return text


def find_secrets(text: Column, own: tuple[str, ...] = ()) -> Column:
    """(start, end) of the secrets in a text, by code points from 0, in order; those that overlap or touch are one.

    The public prefix of a secret and what closes it stay outside, as they do in ``mask_secrets``.
    """
    low = F.lower(text)
    none = F.array().cast(RANGES)
    found = none
    for hints, group in _by_hints():
        some = low.contains(hints[0])
        for hint in hints[1:]:
            some = some | low.contains(hint)
        for regex in group:
            found = F.concat(found, F.when(some, _places(text, regex, re.compile(regex).groups)).otherwise(none))
    for regex in _own(own):
        found = F.concat(found, _places(text, f"({regex})", 0))
    return F.aggregate(F.array_sort(found), none, _joined)


def _places(text: Column, regex: str, kept: int) -> Column:
    """Where the matches stand; a first group and a second, as many as ``kept``, are left out at their start and end.

    The pieces between matches and the matches themselves take turns, so their lengths tell where each match stands.
    """
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(RANGES).alias("out"))

    def ranges(read: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(read["between"], i))
            end = start + F.length(F.get(read["matches"], i))
            a = start + (F.length(F.get(read["group0"], i)) if kept > 0 else 0)
            b = end - (F.length(F.get(read["group1"], i)) if kept > 1 else 0)
            one = F.array(F.struct(a.cast("int").alias("start"), b.cast("int").alias("end")))
            return F.struct(end.alias("at"), F.concat(acc["out"], one).alias("out"))

        places = F.transform(read["matches"], lambda m, i: i)
        return F.filter(F.aggregate(places, zero, step, lambda acc: acc["out"]), lambda r: r["end"] > r["start"])

    read = F.struct(
        F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("matches"),
        F.split(text, regex, -1).alias("between"),
        *[F.regexp_extract_all(text, F.lit(regex), F.lit(i + 1)).alias(f"group{i}") for i in range(kept)],
    )
    return bound(read, ranges)


def _joined(out: Column, r: Column) -> Column:
    last = F.get(out, F.size(out) - 1)
    wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
    apart = (F.size(out) == 0) | (last["end"] < r["start"])
    return F.when(apart, F.concat(out, F.array(r))).otherwise(F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(wider)))


def displayed(text: Column, secret_block: Column, own: tuple[str, ...] = ()) -> Column:
    return F.when(secret_block, "****").otherwise(mask_secrets(text, own))
