"""Log levels as Column expressions."""

from __future__ import annotations

import re
from functools import reduce
from itertools import chain
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The level words and what each means.
LEVELS = ("ERROR", "WARN", "INFO", "DEBUG", "TRACE")
ALIASES = {
    "ERROR": "ERROR",
    "ERR": "ERROR",
    "FATAL": "ERROR",
    "SEVERE": "ERROR",
    "CRITICAL": "ERROR",
    "PANIC": "ERROR",
    "EMERG": "ERROR",
    "EMERGENCY": "ERROR",
    "CRIT": "ERROR",
    "FAIL": "ERROR",
    "FAILED": "ERROR",
    "FAILURE": "ERROR",
    "WARN": "WARN",
    "WARNING": "WARN",
    "INFO": "INFO",
    "NOTICE": "INFO",
    "DEBUG": "DEBUG",
    "DBG": "DEBUG",
    "DBUG": "DEBUG",
    "FINE": "DEBUG",
    "TRACE": "TRACE",
    "TRCE": "TRACE",
    "VERBOSE": "TRACE",
    "FINER": "TRACE",
    "FINEST": "TRACE",
}
SYSLOG_NAMES = {
    "emerg": "ERROR",
    "alert": "ERROR",
    "crit": "ERROR",
    "error": "ERROR",
    "err": "ERROR",
    "warning": "WARN",
    "warn": "WARN",
    "notice": "INFO",
    "info": "INFO",
    "debug": "DEBUG",
    "trace": "TRACE",
}
SYSLOG_SEVERITIES = ("ERROR", "ERROR", "ERROR", "ERROR", "WARN", "INFO", "INFO", "DEBUG")
LETTERS = {"V": "TRACE", "D": "DEBUG", "I": "INFO", "W": "WARN", "E": "ERROR", "F": "ERROR"}

_WORDS = "|".join(ALIASES)
_S = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
_LEADING_TIME = (
    r"^\[?\d{4}[-/]\d\d[-/]\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?\]?[\t ]+(?:(?:stdout|stderr) [FP] )?"
)
# What a line with any of the words above holds in lower case, a line that one of the shapes below may stand in front of.
# Both are looked for once a line, before the words and shapes themselves.
_STEMS = {w.lower() for w in ALIASES} | set(SYSLOG_NAMES)
_ANY_WORD = sorted(w for w in _STEMS if not any(v in w for v in _STEMS - {w}))
_IN_FRONT = r"^(?:[IWEF]\d{4} |\[\d\d:|\d+:[XCSM] |npm |::|\d+ \[)"
_WORD, _FRONT = "word", "front"
# Formats that name the level in their own way, in the order they are tried; what a line must have or hold
# to be of one.
_SHAPES = (
    (r"^([IWEF])\d{4} \d\d:\d\d:\d\d\.\d{6}\s", {"I": "INFO", "W": "WARN", "E": "ERROR", "F": "ERROR"}, _FRONT),
    (
        r"^\[\d\d:\d\d:\d\d(?:\.\d+)? (VRB|DBG|INF|WRN|ERR|FTL)\]",
        {"VRB": "TRACE", "DBG": "DEBUG", "INF": "INFO", "WRN": "WARN", "ERR": "ERROR", "FTL": "ERROR"},
        _FRONT,
    ),
    (rf"(?:^|\s)[\w-]+\.({_WORDS}):", ALIASES, _WORD),
    (r"\[(alert)\] \d+#\d+: ", SYSLOG_NAMES, "[alert] "),
    (r"\[[\w-]+:(emerg|alert|crit|error|warn|notice|info|debug|trace)\d?\]", SYSLOG_NAMES, _WORD),
    (
        r"^\d+:[XCSM] \d\d [A-Z][a-z]{2} \d{4} \d\d:\d\d:\d\d\.\d{3} ([.\-*#]) ",
        {".": "DEBUG", "-": "DEBUG", "*": "INFO", "#": "WARN"},
        _FRONT,
    ),
    (
        r"^npm (ERR!|error|WARN|warn|notice)(?=\s|\z)",
        {"ERR!": "ERROR", "error": "ERROR", "WARN": "WARN", "warn": "WARN", "notice": "INFO"},
        _FRONT,
    ),
    (r"^::(error|warning|notice|debug)(?=[ :])", SYSLOG_NAMES, _FRONT),
    (
        r"\bPHP (Fatal error|Parse error|Recoverable fatal error|Warning|Deprecated|Notice):",
        {
            "Fatal error": "ERROR",
            "Parse error": "ERROR",
            "Recoverable fatal error": "ERROR",
            "Warning": "WARN",
            "Deprecated": "WARN",
            "Notice": "INFO",
        },
        "PHP ",
    ),
    (r"(?:^|\s)(LOG): {2}", {"LOG": "INFO"}, "LOG:  "),
    (r"^\d+ \[(Note|System)\] ", {"Note": "INFO", "System": "INFO"}, _FRONT),
)
# Where a level word counts as one, and what else tells a level.
_UPPER = rf"(?:^|[\s\[(|:=<])({_WORDS})(?=\z|[\s\]):|,>/])"
_CONTEXT = (
    rf"(?iu)(?<![A-Za-z0-9_])level[\"']?\s*[=:]\s*[\"']?({_WORDS})(?![A-Za-z0-9_])",
    rf"(?iu)[\[<(]({_WORDS})[\]>)]",
)
_START = (rf"(?iu)^[\s│╷╵]*({_WORDS})(?=:\s|\s*\z)", rf"^({_WORDS.lower()})(?=\t)")
_DIAGNOSTICS = (
    r"(?:^|:\s)(fatal error|error|warning)(?=:\s|\[[A-Z]\d+\]|\s[A-Z]{2,}\d+:)",
    r"^\s+\d+:\d+\s+(error|warning)\s{2,}",
)
_ACCESS = (
    r'"(?:GET|HEAD|POST|PUT|PATCH|DELETE|OPTIONS|CONNECT|TRACE|PROPFIND) \S+ HTTP/\d(?:\.\d)?" (\d)\d\d(?=\s|\z)'
)
_PRIORITY = r"^<(\d{1,3})>"
_ANDROID = (
    r"^\s*([VDIWEF])/[\w.$-]+\s*(?:\(\s*\d+\))?\s*:",
    r"^\d\d-\d\d \d\d:\d\d:\d\d\.\d{3}\s+\d+\s+\d+\s+([VDIWEF])\s",
)
_LETTER = r"^.{0,40}?\[([VDIWEF])\]\s"


def _found(text: Column, regex: str) -> Column:
    """What the first group matched, or null; asking for it and for its absence would search the text twice."""
    return F.get(F.regexp_extract_all(text, F.lit(regex), F.lit(1)), F.lit(0))


def named(word: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*table.items())]), word)


def usable_levels(custom: dict[str, str]) -> dict[str, str]:
    return {w.strip(): v for w, v in custom.items() if re.fullmatch(r"[\w.-]+", w.strip(), re.ASCII) and v in LEVELS}


def bound(value: Column, use) -> Column:
    """use(value) with ``value`` computed once, however often it is used, which also keeps generated code small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def detect_level(text: Column, custom: dict[str, str] | None = None) -> Column:
    """The level that a line tells, or null."""
    own = usable_levels(custom or {})

    def looked_at(head: Column) -> Column:
        message = F.when(head.rlike(r"^\[?\d"), F.regexp_replace(head, _LEADING_TIME, "")).otherwise(head)
        # Letters beyond ASCII may count as a word's letters where case does not matter.
        word = bound(F.lower(head), lambda low: reduce(or_, [low.contains(w) for w in _ANY_WORD])) | (F.length(head) != F.octet_length(head))
        return F.struct(head.alias("head"), message.alias("message"), word.alias(_WORD))

    def read(p: Column) -> Column:
        return bound(p["message"].rlike(_IN_FRONT), lambda front: _level(p, front, F.substring(text, 1, 2000), own))

    return bound(bound(F.substring(text, 1, 200), looked_at), read)


def _level(p: Column, front: Column, request: Column, own: dict[str, str]) -> Column:
    head, message, some_word = p["head"], p["message"], p[_WORD]
    steps: list[Column] = []
    if own:
        words = "|".join(w.replace(".", r"\.") for w in own)
        word = F.coalesce(
            _found(head, rf"(?:^|[\s\[(|:=<])({words})(?=\z|[\s\]):|,>])"),
            _found(head, r"(?iu)(?<![A-Za-z0-9_])level[\"']?\s*[=:]\s*[\"']?([\w.-]+)"),
        )
        steps.append(named(F.lower(word), {w.lower(): v for w, v in own.items()}))
    for regex, table, needed in _SHAPES:
        may = {_WORD: some_word, _FRONT: front}.get(needed)
        steps.append(F.when(message.contains(needed) if may is None else may, named(_found(message, regex), table)))
    word = F.coalesce(
        _found(head, _UPPER), *[_found(head, r) for r in _CONTEXT], *[_found(message, r) for r in _START]
    )
    steps.append(F.when(some_word, named(F.upper(word), ALIASES)))
    diagnostic = F.coalesce(*[_found(message, r) for r in _DIAGNOSTICS])
    steps.append(F.when(some_word, bound(diagnostic, lambda d: F.when(d == "warning", "WARN").when(d.isNotNull(), "ERROR"))))
    android = F.when(head.contains("/"), _found(head, _ANDROID[0])), F.when(head.rlike(r"^\d\d-"), _found(head, _ANDROID[1]))
    steps.append(named(F.coalesce(*android, F.when(head.contains("]"), _found(head, _LETTER))), LETTERS))
    access = bound(
        _found(request, _ACCESS),
        lambda d: F.when(d == "5", "ERROR").when(d == "4", "WARN").when(d.isNotNull(), "INFO"),
    )
    steps.append(F.when(request.contains("HTTP/"), access))
    priority = _found(head, _PRIORITY).cast("int")
    severity = F.get(F.array(*[F.lit(x) for x in SYSLOG_SEVERITIES]), priority % 8)
    steps.append(F.when(head.startswith("<") & (priority < 192), severity))
    return F.coalesce(*steps)
