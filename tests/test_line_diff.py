"""Ordered line diff, changed words and the layout for reading, against brute force and own examples."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logquarry.functions.edits import compared, edit_script
from logquarry.functions.spans import changed_spans
from logquarry.operators import line_diff as ld


def frame(spark, lines, pair=None, step=1):
    rows = [(pair or "", i * step + 1, t) for i, t in enumerate(lines)]
    return spark.createDataFrame(rows, "pair string, number long, text string").repartition(3)


def script_of(spark, a, b, **how):
    rows = ld.line_diff(frame(spark, a), frame(spark, b), **how).orderBy("step").collect()
    assert len({r["step"] for r in rows}) == len(rows)
    return rows


def check(rows, a, b, key=lambda x: x or ""):
    """Every line of both sides once, in order, and only equal ones as the same."""
    assert [r["left"] for r in rows if r["left"] is not None] == list(range(1, len(a) + 1))
    assert [r["right"] for r in rows if r["right"] is not None] == list(range(1, len(b) + 1))
    for r in rows:
        assert (r["kind"] == "add") == (r["left"] is None) and (r["kind"] == "del") == (r["right"] is None)
        if r["kind"] == "same":
            assert key(a[r["left"] - 1]) == key(b[r["right"] - 1])


def least_changes(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(row[j] if x == y else 1 + min(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14))
def test_edit_scripts_are_least(a, b):
    ops, rough = compared(a, b, 1000)
    assert not rough and sum(kind != "same" for kind, _, _ in ops) == least_changes(a, b)
    x = y = 0
    for kind, p, q in ops:
        x, y = x + (kind != "add"), y + (kind != "del")
        assert (x, y) == (p, q) and (kind != "same" or a[x - 1] == b[y - 1])
    assert (x, y) == (len(a), len(b))


def test_edit_scripts_have_a_limit():
    assert edit_script(list("abc"), list("xyz"), 5) is None
    ops, rough = compared(list("habct"), list("hxyzt"), 5)
    assert rough and [k for k, _, _ in ops] == ["same", *["del"] * 3, *["add"] * 3, "same"]


@settings(max_examples=200, deadline=None)
@given(st.permutations(list(range(12))))
def test_longest_run_and_heaviest_path(values):
    kept = ld.longest_run(np.array(values))
    best = [1] * len(values)
    for i in range(len(values)):
        best[i] = 1 + max([best[j] for j in range(i) if values[j] < values[i]], default=0)
    assert len(kept) == max(best) and all(np.diff(np.array(values)[kept]) > 0) and all(np.diff(kept) > 0)
    cells = [(i // 3, v // 3, 1 + v % 4) for i, v in enumerate(values)]
    cells = [(r, c, sum(w for x, y, w in cells if (x, y) == (r, c))) for r, c in sorted({x[:2] for x in cells})]
    path = ld.heaviest_path(cells)
    assert all(p[0] <= q[0] and p[1] <= q[1] for p, q in zip(path, path[1:]))
    weigh = {}
    for r, c, w in cells:
        weigh[r, c] = w + max([weigh[x] for x in weigh if x[0] <= r and x[1] <= c], default=0)
    assert sum(w for r, c, w in cells if (r, c) in set(path)) == max(weigh.values())


def logs(seed, n=400):
    r = random.Random(seed)
    a = [r.choice(["tick", "tock", f"job {i} done", f"job {i} failed", None, "  "]) for i in range(n)]
    b = list(a)
    for _ in range(25):
        at = r.randrange(len(b))
        match r.randrange(4):
            case 0:
                del b[at]
            case 1:
                b.insert(at, r.choice(["tick", f"new {r.random()}"]))
            case 2:
                b[at] = f"changed {at}"
            case 3:
                b.insert(r.randrange(len(b)), b.pop(at))  # a line that moved
    return a, b


@pytest.mark.parametrize("how", [{}, {"gap_lines": 5}, {"block_lines": 40}, {"gap_lines": 8, "block_lines": 15}])
def test_scripts_of_logs(spark, how):
    a, b = logs(1)
    rows = script_of(spark, a, b, **how)
    check(rows, a, b)
    changes = sum(r["kind"] != "same" for r in rows)
    least = least_changes([x or "" for x in a], [x or "" for x in b])
    assert changes >= least and (how or changes <= least * 1.3)


def test_gaps_without_anchors_keep_their_ends(spark):
    a, b = ["x"] * 30 + ["y"] * 20, ["x"] * 30 + ["z", "z"] + ["y"] * 15
    rows = script_of(spark, a, b, gap_lines=4)
    check(rows, a, b)
    kinds = [r["kind"] for r in rows]
    assert kinds == ["same"] * 30 + ["del"] * 5 + ["add"] * 2 + ["same"] * 15
    assert all(r["approximate"] == (r["kind"] != "same") for r in rows)
    rows = script_of(spark, ["x"] * 9, ["x"] * 12, gap_lines=4)
    check(rows, ["x"] * 9, ["x"] * 12)
    assert sum(r["kind"] == "same" for r in rows) == 9


def test_too_many_changes_count_as_replaced(spark):
    a, b = ["head", *[f"a{i % 7}" for i in range(40)], "tail"], ["head", *[f"b{i % 9}" for i in range(50)], "tail"]
    rows = script_of(spark, a, b, max_edits=10)
    check(rows, a, b)
    assert [r["kind"] for r in rows] == ["same", *["del"] * 40, *["add"] * 50, "same"]
    got = ld.summary(ld.line_diff(frame(spark, a), frame(spark, b), max_edits=10)).first()
    assert tuple(got) == ("", 50, 40, True)


def test_small_and_empty_logs(spark):
    assert [r["kind"] for r in script_of(spark, ["one", "two", "three"], ["one", "TWO", "three", "four"])] == ["same", "del", "add", "same", "add"]
    assert [r["kind"] for r in script_of(spark, ["a"], [])] == ["del"]
    assert [r["kind"] for r in script_of(spark, [], ["a", "a"])] == ["add", "add"]
    assert script_of(spark, [], []) == []


def test_volatile_parts_and_numbers_with_gaps(spark):
    a = ["2026-01-04T10:00:00Z run 1 took 15 ms", "end"]
    b = ["2026-02-09T11:30:00Z run 1 took 3 s", "more", "end"]
    rows = ld.line_diff(frame(spark, a, step=10), frame(spark, b), volatile=True).orderBy("step").collect()
    assert [(r["kind"], r["left"], r["right"]) for r in rows] == [("same", 1, 1), ("add", None, 2), ("same", 11, 3)]


def test_a_pair_without_a_name(spark):
    made = [spark.createDataFrame([(None, i + 1, t) for i, t in enumerate(x)], "pair string, number long, text string") for x in ("abc", "axc")]
    assert [tuple(r)[:5] for r in ld.line_diff(*made).orderBy("step").collect()] == [
        ("", 2, "same", 1, 1), ("", 3, "del", 2, None), ("", 4, "add", None, 2), ("", 6, "same", 3, 3),
    ]


def test_many_pairs_at_once(spark):
    sides = {p: logs(p, 60) for p in range(5)}
    before = after = None
    for p, (a, b) in sides.items():
        x, y = frame(spark, a, f"p{p}"), frame(spark, b, f"p{p}")
        before, after = (x, y) if before is None else (before.union(x), after.union(y))
    rows = ld.line_diff(before, after).orderBy("pair", "step").collect()
    for p, (a, b) in sides.items():
        check([r for r in rows if r["pair"] == f"p{p}"], a, b)


def test_a_long_log_with_three_changes(spark):
    def log(changed):
        t = F.concat(F.lit("INFO processed job "), F.col("id").cast("string"))
        t = F.when(changed & (F.col("id") == 50_000), "ERROR job 50000 failed").otherwise(t)
        one = F.when(changed & (F.col("id") == 70_000), F.array(t, F.lit("WARN retrying"))).otherwise(F.array(t))
        rows = spark.range(100_000).select("id", F.posexplode(one).alias("nth", "text"))
        number = F.col("id") + 1 + F.when(changed & (F.col("id") > 70_000), 1).otherwise(0) + F.col("nth")
        return rows.select(number.alias("number"), "text")

    script = ld.line_diff(log(F.lit(False)), log(F.lit(True)), block_lines=30_000)
    assert [tuple(r) for r in script.where("kind <> 'same'").orderBy("step").select("kind", "left", "right").collect()] == [
        ("del", 50_001, None),
        ("add", None, 50_001),
        ("add", None, 70_002),
    ]
    assert script.count() == 100_002


# --- changed words


def words_changed(spark, a, b, volatile=False):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(changed_spans(F.col("a"), F.col("b"), volatile).alias("s")).first()["s"]
    return [[tuple(x) for x in side] for side in row]


def test_changed_words(spark):
    assert words_changed(spark, "Passed: 20 of 30", "Passed: 21 of 30, 2 left") == [[(8, 10)], [(8, 10), (16, 24)]]
    assert words_changed(spark, "same line", "same line") == [[], []]
    assert words_changed(spark, "a  b", "a b") == [[], []]
    assert words_changed(spark, "k=1 z", "k=22 z") == [[(2, 3)], [(2, 4)]]
    a, b = "2026-10-03T09:00:20Z step 4 took 9 ms", "2026-11-04T11:30:20Z step 5 took 31 ms"
    assert words_changed(spark, a, b)[0][0] == (0, 20)
    assert (26, 27) in words_changed(spark, a, b, volatile=True)[0] and (0, 20) not in words_changed(spark, a, b, volatile=True)[0]


def test_lines_too_long_or_too_different_get_one_range(spark):
    a, b = "x " * 1100 + "1", "x " * 1100 + "2"
    assert words_changed(spark, a, b) == [[(2200, 2201)], [(2200, 2201)]]
    a, b = " ".join(f"a{i}" for i in range(150)), " ".join(f"b{i}" for i in range(150))
    assert words_changed(spark, a, b) == [[(0, len(a) - 3)], [(0, len(b) - 3)]]


# --- layout


def test_hunks(spark):
    a = [f"line {i}" for i in range(30)]
    b = list(a)
    b[10:12] = ["line ten", "line 11 changed", "extra"]
    del b[-1]
    script = ld.with_texts(ld.line_diff(frame(spark, a), frame(spark, b)), frame(spark, a), frame(spark, b))
    rows = ld.hunks(script, context=2).orderBy("step").collect()
    assert [(r["kind"], r["left"], r["right"], r["folded"]) for r in rows] == [
        ("fold", 1, 1, 8),
        ("same", 9, 9, 0),
        ("same", 10, 10, 0),
        ("del", 11, None, 0),
        ("del", 12, None, 0),
        ("add", None, 11, 0),
        ("add", None, 12, 0),
        ("add", None, 13, 0),
        ("same", 13, 14, 0),
        ("same", 14, 15, 0),
        ("fold", 15, 16, 13),
        ("same", 28, 29, 0),
        ("same", 29, 30, 0),
        ("del", 30, None, 0),
    ]
    spans = {(r["kind"], r["left"], r["right"]): r["spans"] for r in rows}
    assert [tuple(s) for s in spans["del", 11, None]] == [(5, 7)] and [tuple(s) for s in spans["add", None, 11]] == [(5, 8)]
    assert [tuple(s) for s in spans["add", None, 12]] == [(8, 15)] and spans["del", 12, None] == []
    assert spans["add", None, 13] is None and spans["del", 30, None] is None


def test_lines_of_one_pair_meet_its_values_in_many_tasks(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(60_000).select(F.lit("p").alias("pair"), F.lit(0).alias("side"), F.col("id").alias("at"))
        values = spark.range(1).select(F.lit("p").alias("pair"), F.lit(60_001).alias("l1"))
        joined = ld._with_values(rows, values, ["pair"]).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(r["n"] for r in joined) == 60_000 and max(r["n"] for r in joined) < 60_000
