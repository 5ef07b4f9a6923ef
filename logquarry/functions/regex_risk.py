"""A check of user regexes before they run on every line."""

from __future__ import annotations

from re import _constants as C
from re import _parser


def regex_risk(source: str) -> str | None:
    """Why a regex may backtrack without end: a repeated group that itself holds a variable repeat; or null.

    The regex is parsed, so classes and escapes are read as what they are.
    """
    try:
        tree = _parser.parse(source)
    except Exception as e:
        return f"not a regex: {e}"
    nested = "nested quantifiers like (a+)+ may run without end"
    return nested if _repeats(tree, inside=False) else None


def _repeats(items, inside: bool) -> bool:
    """Whether a variable repeat stands in a group that is repeated."""
    for op, arg in items:
        if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, body = arg
            variable = high is C.MAXREPEAT or (high != low and high > 1)
            if inside and variable:
                return True
            group = len(body) != 1 or body[0][0] not in (C.LITERAL, C.NOT_LITERAL, C.IN, C.ANY)
            if _repeats(body, inside or (group and (high is C.MAXREPEAT or high > 1))):
                return True
        elif op is C.SUBPATTERN:
            if _repeats(arg[3], inside):
                return True
        elif op is C.BRANCH:
            if any(_repeats(b, inside) for b in arg[1]):
                return True
        elif op in (C.ASSERT, C.ASSERT_NOT):
            if _repeats(arg[1], inside):
                return True
    return False
