"""Runs of equal entries, also of entries too long for one chunk."""

import pytest

from logquarry.operators.aggregates import collapse_repeats, group_lines
from logquarry.operators.parse import parse
from logquarry.options import ParseOptions
from logquarry.sources.lines import from_text


def collapsed(spark, text, chunk):
    lines = parse(from_text(spark, text), ParseOptions(chunk_lines=chunk))
    return [(r["number"], r["repeat"]) for r in collapse_repeats(lines).orderBy("number").collect()]


@pytest.mark.parametrize("chunk", [0, 2, 3, 1000])
def test_entries_are_equal_line_by_line_in_order(spark, chunk):
    one, two = "ERROR x 1\n\tat a\n\tat b\n", "ERROR x 2\n\tat b\n\tat a\n"
    assert collapsed(spark, "\tat head\n" + one * 3 + two * 2 + one, chunk) == [
        (1, 1), (2, 3), (3, 1), (4, 1), (11, 2), (12, 1), (13, 1), (17, 1), (18, 1), (19, 1),
    ]


def test_a_huge_entry(spark):
    entry = "ERROR boom\n" + "".join(f"\tat frame.{'abcdefg'[i % 7]}\n" for i in range(60_000))
    got = collapsed(spark, entry + entry + "INFO x\n", 10_000)
    assert len(got) == 60_002 and got[0] == (1, 2) and got[-1] == (120_003, 1)


def test_entries_are_joined_without_a_broadcast(spark):
    lines = parse(from_text(spark, "ERROR a 1\nERROR b 2\nERROR a 3\n"))
    groups = spark.createDataFrame([("none",)], "key string")
    for df in (collapse_repeats(lines), group_lines(lines, groups)):
        assert "strategy=merge" in df._jdf.queryExecution().optimizedPlan().toString()
