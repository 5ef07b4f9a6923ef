"""The search language: field=value conditions, -words to leave out, and text."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

_QUOTED = r'"(?:[^"\\]|\\.)*"'
_WORD = re.compile(rf'(?:[^\s"]+|{_QUOTED})+')
_CONDITION = re.compile(rf"^({_QUOTED}|[A-Za-z_@][A-Za-z0-9_.@-]*)(!=|>=|<=|=|>|<)({_QUOTED}|\S+)\Z")


@dataclass(frozen=True)
class Condition:
    """exact: the value was quoted, so a star in it is a star."""

    key: str
    op: str
    value: str
    exact: bool = False


@dataclass(frozen=True)
class Search:
    conditions: tuple[Condition, ...] = ()
    exclude: tuple[str, ...] = ()
    text: str = ""


def _is_quoted(word: str) -> bool:
    return len(word) >= 2 and word[0] == word[-1] == '"'


def _unquoted(word: str) -> str:
    if not _is_quoted(word):
        return word
    try:
        return json.loads(word)
    except ValueError:
        return word[1:-1]


def condition_key(key: str) -> str:
    return key if re.fullmatch(r"[A-Za-z_@][A-Za-z0-9_.@-]*", key) else json.dumps(key, ensure_ascii=False)


def condition_value(value: str) -> str:
    return json.dumps(value, ensure_ascii=False) if value == "" or re.search(r'[\s"*]', value) else value


def read_condition(word: str) -> Condition | None:
    found = _CONDITION.match(word)
    return found and Condition(_unquoted(found[1]), found[2], _unquoted(found[3]), _is_quoted(found[3]))


def field_conditions(query: str) -> list[Condition] | None:
    """The conditions of a query that holds nothing else, or None."""
    read = [read_condition(w) for w in _WORD.findall(query.strip())]
    return read if read and None not in read else None


def read_search(query: str) -> Search:
    """Conditions, words to leave out and text, in any mix; a query of text alone stays as it was typed."""
    conditions, exclude, text = [], [], []
    for word in _WORD.findall(query.strip()):
        if condition := read_condition(word):
            conditions.append(condition)
        elif re.match(r"-[^-\d]", word) and _unquoted(word[1:]):
            exclude.append(_unquoted(word[1:]))
        else:
            text.append(word)
    if not conditions and not exclude:
        return Search(text=query)
    return Search(tuple(conditions), tuple(exclude), " ".join(text))
