"""JSON objects printed over several lines, against a plain reading of each place and over own records."""

import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logquarry.operators import json_blocks as jb
from logquarry.operators import parse as parsing
from logquarry.operators.parse import parse
from logquarry.options import ParseOptions
from logquarry.sources.lines import from_text

RECORD = """2027-02-01 08:15:00 INFO queue ready
{
  "time": "2027-02-01T08:15:04.250Z",
  "severity": "warn",
  "msg": "disk almost full",
  "disk": {
    "path": "/var/}{",
    "free": [1, 2.5]
  }
}
2027-02-01 08:15:05 DEBUG checked"""


def table(spark, text, chunk=3, **how):
    return parse(from_text(spark, text), ParseOptions(chunk_lines=chunk, **how)).orderBy("number").collect()


@pytest.mark.parametrize("chunk", [0, 2, 100])
def test_a_record_over_several_lines_is_one_entry(spark, chunk):
    got = table(spark, RECORD, chunk)
    assert got[1]["text"] == '2027-02-01T08:15:04.250Z warn disk almost full {"disk":{"path":"/var/}{","free":[1,2.5]}}'
    assert [r["level"] for r in got] == ["INFO", *["WARN"] * 9, "DEBUG"]
    assert [r["continuation"] for r in got] == [False, False, *[True] * 8, False]
    assert [r["gap"] for r in got] == [None, 4250, *[None] * 8, 750]
    assert [r["entry_id"] for r in got] == [1, *[2] * 9, 11]
    assert [r["continuation"] for r in table(spark, RECORD, chunk, json_blocks=False)][2] is False


def test_records_after_a_text_and_what_is_none(spark):
    got = table(spark, '2027-02-01 08:00:00 ERROR answer: {\n  "code": 503,\n  "tries": [\n    1\n  ]\n}')
    assert got[0]["text"].endswith("answer: {") and json.loads(got[0]["json"]) == {"code": 503, "tries": [1]}
    assert [(r["level"], r["continuation"]) for r in got] == [("ERROR", False), *[("ERROR", True)] * 5]
    got = table(spark, "2027-02-01 08:00:00 WARN dump {\n  code: 503\n}\n2027-02-01 08:00:01 INFO fine")
    assert [(r["json"], r["continuation"]) for r in got] == [(None, False), (None, True), (None, True), (None, False)]
    got = table(spark, "2027-02-01 08:00:00 INFO block {\n2027-02-01 08:00:02 WARN slow\nrest of it")
    assert [(r["level"], r["continuation"], r["gap"]) for r in got] == [("INFO", False, None), ("WARN", False, 2000), ("WARN", False, None)]


def test_a_given_up_block_is_ordinary_lines_and_may_hold_others(spark):
    got = table(spark, 'start {\n  {\n    "a": 1\n  }\n  {"b": 2}\nnext')
    assert [r["continuation"] for r in got] == [False, False, True, True, False, False]
    assert [r["json"] for r in got] == [None, '{"a":1}', None, None, '{"b":2}', None]


def test_the_end_of_the_log_leaves_a_block_open(spark):
    got = table(spark, 'x\n{\n  "a": 1,\n  {"b": 2}\n\n  "c": 3')
    assert [r["continuation"] for r in got] == [False, False, True, True, True, True]
    assert [r["json"] for r in got] == [None] * 6 and got[3]["text"] == '  {"b": 2}'


LINES = st.lists(st.sampled_from(["{", "}", "  {", "  }", "  x", "", "a", "a {", '  "', '  "{', '  \\\\"}', '  "a\\\\', "  ]", "  [[", " {}", "  }}"]), max_size=30)


def open_brackets(text):
    outside = re.sub(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)', "", text, flags=re.DOTALL)
    return sum(outside.count(c) for c in "{[") - sum(outside.count(c) for c in "}]")


def plain_blocks(lines, most):
    """By trying every line in turn and counting brackets in all the text so far."""
    out, i = [], 0
    while i < len(lines):
        first = lines[i].strip()
        end = None
        if first[:1] == "{" or first[-1:] == "{":
            text = lines[i][lines[i].index("{") :]
            if open_brackets(text) > 0:
                end = -len(lines) if len(lines) - i - 1 <= most else None
                for j in range(i + 1, len(lines)):
                    text += lines[j]
                    if j - i > most or not re.match(r"[\s}\]]|\Z", lines[j]):
                        end = None
                        break
                    if open_brackets(text) <= 0:
                        end = j + 1
                        break
        if end is not None:
            out.append((i + 1, end))
        i = abs(end) if end is not None else i + 1
    return out


@settings(max_examples=400, deadline=None)
@given(LINES, st.integers(1, 6), st.integers(1, 8))
def test_blocks_of_pieces(lines, piece, most):
    most = min(piece, most)
    entry, got = 1, []
    for lo in range(0, len(lines), piece):
        own = lines[lo : lo + piece + most + 1]
        rows = [(lo + i + 1, t, jb.opening(t)[0] > 0, bool(re.match(r"[\s}\]]|\Z", t))) for i, t in enumerate(own)]
        found = jb.ends(rows, lo + piece, most)
        heads, exits = jb.left_at(found, lo + piece)
        got += jb.chosen(heads, [found[h] for h in heads], entry)
        k = next((k for k, h in enumerate(heads) if h >= entry), None)
        entry = entry if k is None else max(entry, exits[k])
    assert got == plain_blocks(lines, most)


@pytest.mark.parametrize("piece", [7, 10_000])
def test_a_file_of_indented_lines_is_dealt_into_pieces(spark, piece, monkeypatch):
    monkeypatch.setattr(jb.with_json_blocks, "__defaults__", (piece, 6))
    r = random.Random(2)
    lines = [r.choice(["  {", "  }", '  "a": 1,', '  "b": 2', "  [", "  ]", "  {", "  },", ""]) for _ in range(300)]
    if piece == 7:
        r.shuffle(lines)
    got = table(spark, "\n".join(lines) + "\n", 11)
    inside = {n for i, end in plain_blocks(lines, 6) for n in range(i + 1, abs(end) + 1)}
    assert [r["number"] for r in got if r["continuation"]] == sorted(inside)


@pytest.mark.parametrize("key", [False, True])
def test_blocks_write_the_whole_table_twice_unless_there_are_keys(spark, monkeypatch, key):
    written, settled = [], parsing.settled
    monkeypatch.setattr(parsing, "settled", lambda df, name: written.append(name) or settled(df, name))
    pem = "\n-----BEGIN PRIVATE KEY-----\n{\n}\n-----END PRIVATE KEY-----" if key else ""
    got = table(spark, RECORD + pem)
    assert written == ["classified", *["keys"] * key, "timed"]
    assert [r["continuation"] for r in got] == [False, False, *[True] * 8, False, *[False, True, True, True][: 4 * key]]


def test_blocks_are_joined_without_a_broadcast(spark, monkeypatch):
    """A table of a row a line or a row a block is no small one, however small its compressed files are."""
    plans = []
    monkeypatch.setattr(jb, "patched", lambda df, *rest: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df.select("none"))
    with pytest.raises(Exception, match="none"):
        table(spark, RECORD)
    assert plans[0].count("strategy=merge") >= 2
