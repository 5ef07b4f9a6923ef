"""Small text tools that need a token-by-token reader: JSON layout, JWTs and timestamps, as batched functions."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from logquarry.functions import text as tx
from logquarry.functions.records import js_json, strict_json
from logquarry.functions.secrets import mask_secrets

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[^\s"{}\[\],:]+|[{}\[\],:]')


def _tokens(text: str) -> list[str]:
    strict_json(text)
    return _TOKEN.findall(text)


def format_json(text: str) -> str:
    """Two spaces a level; numbers and strings stay as they are written."""
    out, depth, tokens = [], 0, _tokens(text)
    for i, t in enumerate(tokens):
        before = tokens[i - 1] if i else ""
        if t in "}]":
            depth -= 1
            out.append(t if before in ("{", "[") else "\n" + "  " * depth + t)
        elif t == ",":
            out.append(t)
        elif t == ":":
            out.append(": ")
        else:
            out.append(("\n" + "  " * depth if before in ("{", "[", ",") and before else "") + t)
        depth += t in ("{", "[")
    return "".join(out)


def minify_json(text: str) -> str:
    return "".join(_tokens(text))


def canonical_json(text: str) -> str:
    """Keys sorted, two spaces a level."""
    value = json.loads(text, parse_float=_Literal, parse_int=_Literal)
    return format_json(_sorted(value))


class _Literal(str):
    """A number as it is written."""


def _sorted(value) -> str:
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_sorted(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return f"[{','.join(map(_sorted, value))}]"
    return value if isinstance(value, _Literal) else js_json(value)


def preview_json(text: str, size: int = 80) -> str:
    one = minify_json(canonical_json(text))
    return one if len(one) <= size else one[: size - 1] + "…"


def decode_jwt(text: str) -> tuple[dict, dict]:
    parts = re.sub(r"(?i)\A\s*bearer\s+", "", text).strip().split(".")
    if len(parts) != 3:
        raise ValueError("a JWT has three parts")
    pads = (p + "=" * (-len(p) % 4) for p in parts[:2])
    head, payload = (json.loads(base64.urlsafe_b64decode(p)) for p in pads)
    return head, payload


def describe_jwt(text: str, now_ms: int) -> str:
    """Header, payload, and the times among its claims; whether it has expired at ``now_ms``."""
    head, payload = decode_jwt(text)
    out = ["Header:", format_json(js_json(head)), "", "Payload:", format_json(js_json(payload))]
    notes = []
    for claim, name in (("iat", "Issued"), ("nbf", "Not before"), ("exp", "Expires")):
        value = payload.get(claim)
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            ms = value if value > 1e11 else value * 1000
            expired = f" ({'expired' if ms < now_ms else 'valid'})" if claim == "exp" else ""
            notes.append(f"{name}: {_iso(ms)}{expired}")
    return "\n".join([*out, *([""] if notes else []), *notes])


def _iso(ms: float) -> str:
    return (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(milliseconds=int(ms // 1))).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def convert_timestamp(text: str) -> str:
    """A Unix time as a date, its unit told by its size; or an ISO date as Unix times."""
    text = text.strip()
    if re.fullmatch(r"-?\d{1,19}(\.\d+)?", text, re.ASCII):
        value = float(text)
        size = abs(value)
        if size < 1e11:
            unit, ms = "seconds", value * 1000
        elif size < 1e14:
            unit, ms = "milliseconds", value
        elif size < 1e17:
            unit, ms = "microseconds", value / 1000
        else:
            unit, ms = "nanoseconds", int(float(text)) / 1e6 if "." in text else int(text) // 1000 / 1000
        return f"UTC:   {_iso(ms)}\n(read as {unit})"
    when = datetime.fromisoformat(text)
    when = when if when.tzinfo else when.replace(tzinfo=UTC)
    ms = round(when.timestamp() * 1000)
    return f"seconds: {ms // 1000}\nmillis:  {ms}\nUTC:     {_iso(ms)}"


def _batched(tool: Callable[[str], str]) -> Callable[[Column], Column]:
    """A Column function that is null where the tool refuses the text."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else tool(text)
        except (ValueError, KeyError, OverflowError, RecursionError):
            return None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run


def tool(name: str, now_ms: int = 0) -> Callable[[Column], Column] | None:
    """A text tool by its id: a function from a text Column to a text Column, or None."""
    batched = {
        "json-format": format_json,
        "json-minify": minify_json,
        "json-canonical": canonical_json,
        "jwt-decode": lambda t: describe_jwt(t, now_ms),
        "timestamp": convert_timestamp,
    }
    if name in batched:
        return _batched(batched[name])
    return {"mask-secrets": mask_secrets, **tx.apply_tools()}.get(name)
