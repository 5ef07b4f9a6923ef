"""A view of a log: everything that narrows it, as one value that can be written as a link and applied to a table."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.operators import aggregates, filters
from logquarry.plans.search import read_search

LINK_LEVELS = ("ERROR", "WARN", "INFO", "DEBUG", "TRACE", "OTHER")


@dataclass(frozen=True)
class View:
    line: int | None = None
    line_end: int | None = None
    levels: tuple[str, ...] | None = None
    query: str = ""
    regex: bool = False
    case_sensitive: bool = False
    time_range: tuple[int, int] | None = None
    pods: tuple[str, ...] | None = None
    hidden_pods: tuple[str, ...] | None = None
    mutes: tuple[int, ...] | None = None

    @staticmethod
    def from_link(link: str) -> View | None:
        """The view of a link's part after #, or None if that is no view."""
        parts = link.removeprefix("#").split("&")
        got: dict[str, object] = {}
        ours = False
        if found := re.fullmatch(r"L(\d{1,9})(?:-L?(\d{1,9}))?", parts[0], re.ASCII):
            a, b = int(found[1]), int(found[2] or found[1])
            if a and b:
                got["line"], got["line_end"] = min(a, b), max(a, b) if a != b else None
            parts, ours = parts[1:], True
        bounds: dict[str, int] = {}
        for part in parts:
            key, eq, value = part.partition("=")
            if not eq or not re.fullmatch("[a-z]+", key):
                return None
            names = tuple(map(_decoded, value.split(","))) if value else ()
            if key == "levels":
                wanted = {n.upper() for n in names}
                got["levels"] = tuple(n for n in LINK_LEVELS if n in wanted)
            elif key == "q":
                got["query"] = _decoded(value)
            elif key in ("re", "case"):
                got["regex" if key == "re" else "case_sensitive"] = value == "1"
            elif key in ("from", "to"):
                if re.fullmatch(r"\d{1,15}", value, re.ASCII):
                    bounds[key] = int(value)
                else:
                    bounds.pop(key, None)
            elif key in ("pods", "hide"):
                got["pods" if key == "pods" else "hidden_pods"] = names
            elif key == "mute":
                numbers = (int(n) for n in value.split(",") if re.fullmatch(r"\d{1,9}", n, re.ASCII))
                got["mutes"] = tuple(n for n in numbers if n)
            else:
                continue
            ours = True
        if bounds.get("to", 0) > bounds.get("from", math.inf):
            got["time_range"] = (bounds["from"], bounds["to"])
        return View(**got) if ours else None

    def to_link(self) -> str:
        parts = []
        if self.line:
            a, b = sorted((self.line, self.line_end or self.line))
            parts.append(f"L{a}" if a == b else f"L{a}-L{b}")
        if self.levels is not None:
            parts.append(f"levels={','.join(self.levels)}")
        if self.query:
            parts += [f"q={_encoded(self.query)}", *["re=1"] * self.regex, *["case=1"] * self.case_sensitive]
        if self.time_range:
            parts += [f"from={math.ceil(self.time_range[0])}", f"to={math.ceil(self.time_range[1])}"]
        if self.pods is not None:
            parts.append(f"pods={','.join(map(_encoded, self.pods))}")
        elif self.hidden_pods:
            parts.append(f"hide={','.join(map(_encoded, self.hidden_pods))}")
        if self.mutes:
            parts.append(f"mute={','.join(map(str, self.mutes))}")
        return "#" + "&".join(parts) if parts else ""


def _encoded(value: str) -> str:
    return quote(value.encode("utf-8", "replace"), safe="-_.~:/=")


def _decoded(value: str) -> str:
    try:
        return unquote(value, errors="strict") if not re.search(r"%(?![0-9A-Fa-f]{2})", value) else value
    except UnicodeDecodeError:
        return value


def apply_view(df: DataFrame, view: View, context: int = 0, collapse: bool = False) -> DataFrame:
    """The lines a view shows: time, sources, mutes, conditions, excluded words, then levels and text with context."""
    whole = df
    if view.time_range:
        df = filters.in_time_range(df, *view.time_range)
    df = filters.from_sources(df, view.pods, view.hidden_pods)
    if view.mutes:
        muted = filters.with_kinds(whole).where(F.col("number").isin(list(view.mutes))).select("kind")
        df = filters.without_kinds(df, muted)
    text = view.query
    if not view.regex:
        search = read_search(view.query)
        df = filters.by_fields(df, list(search.conditions))
        df = filters.without_words(df, list(search.exclude), view.case_sensitive)
        text = search.text
    named = None if view.levels is None else [n for n in view.levels if n != "OTHER"]
    shown = filters.of_levels(named, unknown=view.levels is None or "OTHER" in view.levels)
    df = filters.with_context(df, shown & filters.matcher(text, view.regex, view.case_sensitive), context if text else 0)
    return aggregates.collapse_repeats(df) if collapse else df
