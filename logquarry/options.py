"""What a parse or a view can be told."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ParseOptions:
    """custom_levels: own level words. default_year: for formats without a year. base_day: for lines with only a time,
    days since 1970. secret_patterns: own secret regexes. chunk_lines: a file is cut into chunks of so many lines, whose
    carried state is joined back, so that no task holds a whole file; 0 keeps each file, if known to be small, in one
    window partition. json_blocks: JSON objects printed over several lines are one entry each; lines from one that may
    open such an object on are shuffled once more."""

    custom_levels: dict[str, str] = field(default_factory=dict)
    default_year: int = 2026
    base_day: int = 20_454
    secret_patterns: tuple[str, ...] = ()
    chunk_lines: int = 10_000
    json_blocks: bool = True
