"""An ordered comparison of logs: an edit script that holds every line of both sides once, in order.

Lines that stand once on either side are anchors; of these the longest run that keeps its order on both sides is found,
over a grid of blocks where a log is long. What lies between two anchors is a gap. Long gaps are looked through for
anchors of their own; short ones go to Myers' algorithm, each in one task's memory; a long gap without anchors keeps its
common start and end, and what is between counts as replaced. No task holds a whole log.

A pair of logs has a name, the column ``pair``, so that many are compared at once; without it, or null, it is ''.
A line's ``step`` is its place on the left plus its place on the right, counting what came before it, so a script is put
in order by (pair, step).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions.edits import compared
from logquarry.functions.spans import changed_spans
from logquarry.operators.diff import compare_key
from logquarry.operators.ordered import carry, running_count, with_chunks, with_hits
from logquarry.staging import settled

#: Changes within a gap beyond which it counts as replaced.
MAX_EDITS = 1_000
#: Lines of a gap that one task may hold; lines of a grid's block; blocks a side; rounds of anchors.
GAP_LINES, BLOCK_LINES, MAX_BLOCKS, ROUNDS = 20_000, 200_000, 2_000, 3
CHUNK_LINES = 10_000
CONTEXT = 3
_GAP = ["pair", "l0", "r0", "l1", "r1"]
SCRIPT = "pair string, kind string, left_at long, right_at long, approximate boolean"


def longest_run(values: np.ndarray) -> np.ndarray:
    """Places of a longest strictly increasing subsequence."""
    ends: list[int] = []
    at: list[int] = []
    before = np.full(len(values), -1, np.int64)
    for i, v in enumerate(values.tolist()):
        k = bisect_left(ends, v)
        before[i] = at[k - 1] if k else -1
        if k == len(ends):
            ends.append(v)
            at.append(i)
        else:
            ends[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = int(before[i])
    return np.array(out[::-1], np.int64)


def heaviest_path(cells: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Of (row, column, weight) the cells of the heaviest path on which neither row nor column ever falls."""
    columns = sorted({c for _, c, _ in cells})
    size = len(columns)
    tree: list[tuple[int, int]] = [(0, -1)] * (size + 1)
    best: list[tuple[int, int]] = []
    cells = sorted(cells)
    for i, (_, column, weight) in enumerate(cells):
        place = k = bisect_left(columns, column) + 1
        top = (0, -1)
        while k:
            top = max(top, tree[k])
            k &= k - 1
        best.append((top[0] + weight, top[1]))
        while place <= size:
            tree[place] = max(tree[place], (best[i][0], i))
            place += place & -place
    out, i = [], max(range(len(cells)), key=lambda i: best[i][0]) if cells else -1
    while i >= 0:
        out.append(cells[i][:2])
        i = best[i][1]
    return out[::-1]


def _pair(df: DataFrame) -> Column:
    return F.coalesce(F.col("pair").cast("string"), F.lit("")) if "pair" in df.columns else F.lit("")


def _side(df: DataFrame, side: int, volatile: bool, spaces: bool) -> DataFrame:
    pair = _pair(df)
    key = compare_key(F.coalesce("text", F.lit("")), volatile, spaces)
    rows = df.select(pair.alias("pair"), F.lit(side).alias("side"), F.col("number").cast("long").alias("number"), key.alias("key"))
    rows = rows.withColumn("file_id", F.concat("pair", F.lit("\n"), "side"))
    return running_count(with_chunks(rows, CHUNK_LINES), "at", F.lit(True)).withColumn("at", F.col("at").cast("long")).drop("chunk")


def _with_values(rows: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the ``values`` of their ``keys``, one row a key. All lines of a log may share a key, so its values
    meet one row for each run of places first, and the lines meet these."""
    rows = rows.withColumn("run", F.floor(F.col("at") / CHUNK_LINES))
    runs = rows.select(*keys, "side", "run").distinct().join(values, keys)
    return rows.join(runs, [*keys, "side", "run"]).drop("run")


def _anchors(rows: DataFrame) -> DataFrame:
    """(gap, l, r): lines that stand once on either side of their gap."""
    left, right = F.when(F.col("side") == 0, F.col("at")), F.when(F.col("side") == 1, F.col("at"))
    sums = rows.groupBy(*_GAP, "key").agg(F.count(left).alias("n"), F.count(right).alias("m"), F.min(left).alias("l"), F.min(right).alias("r"))
    return sums.where("n = 1 AND m = 1").select(*_GAP, "l", "r")


def _in_order(anchors: DataFrame, block_lines: int) -> DataFrame:
    """The anchors of a longest run; over a grid of blocks, where a gap has several, of the heaviest path's."""
    widest = F.greatest(F.col("l1") - F.col("l0"), F.col("r1") - F.col("r0"))
    blocks = F.least(F.ceil(widest / block_lines), F.lit(MAX_BLOCKS))
    anchors = anchors.withColumns(
        {
            "row": F.floor((F.col("l") - F.col("l0") - 1) * blocks / (F.col("l1") - F.col("l0"))),
            "column": F.floor((F.col("r") - F.col("r0") - 1) * blocks / (F.col("r1") - F.col("r0"))),
        }
    )
    schema = anchors.schema

    def of(order: str, value: str):
        def keep(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(order)
            return pdf.iloc[longest_run(pdf[value].to_numpy())]

        return keep

    def path(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = heaviest_path(list(zip(pdf["row"].tolist(), pdf["column"].tolist(), pdf["count"].tolist())))
        out = pd.DataFrame(kept, columns=["row", "column"])
        return out.assign(**{c: pdf[c].iat[0] for c in _GAP})[["row", "column", *_GAP]]

    if (anchors.agg(F.max(widest)).first()[0] or 0) > block_lines:
        anchors = settled(anchors, "anchors")
        cells = anchors.groupBy(*_GAP, "row", "column").count()
        places = "row long, column long, pair string, l0 long, r0 long, l1 long, r1 long"
        anchors = anchors.join(cells.groupBy(*_GAP).applyInPandas(path, places), [*_GAP, "row", "column"])
        anchors = anchors.select(*schema.names).groupBy(*_GAP, "row").applyInPandas(of("l", "r"), schema)
    return anchors.groupBy(*_GAP, "column").applyInPandas(of("r", "l"), schema).select(*_GAP, "l", "r")


def _split(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """``rows`` without the chosen anchors, each with the gap between anchors that it is in now."""
    mate = F.struct("l", "r")
    marks = chosen.select(*_GAP, F.lit(0).alias("side"), F.col("l").alias("at"), mate.alias("mate")).union(
        chosen.select(*_GAP, F.lit(1), "r", mate)
    )
    rows = rows.join(marks.select("pair", "side", "at", "mate"), ["pair", "side", "at"], "left")
    gap = F.concat_ws("\n", "pair", "side", "l0")
    rows = with_chunks(rows.withColumn("file_id", gap).withColumn("number_in_log", F.col("number")).withColumn("number", F.col("at")), CHUNK_LINES)
    rows = carry(rows, {"above": (F.col("mate"), False)})
    rows = carry(rows, {"below": (F.col("mate"), False)}, backward=True).where("mate IS NULL")
    return rows.select(
        "pair", "side", "at", F.col("number_in_log").alias("number"), "key",
        F.coalesce("above.l", "l0").alias("l0"), F.coalesce("above.r", "r0").alias("r0"),
        F.coalesce("below.l", "l1").alias("l1"), F.coalesce("below.r", "r1").alias("r1"),
    )


def _one_sided(rows: DataFrame) -> DataFrame:
    """Rows that count as removed, then added."""
    left = F.col("side") == 0
    return rows.select(
        "pair",
        F.when(left, "del").otherwise("add").alias("kind"),
        F.when(left, F.col("at")).otherwise(F.col("l1") - 1).alias("left_at"),
        F.when(left, F.col("r0")).otherwise(F.col("at")).alias("right_at"),
        ((F.col("l1") - F.col("l0") > 1) & (F.col("r1") - F.col("r0") > 1)).alias("approximate"),
    )


def _short(rows: DataFrame, most: int) -> DataFrame:
    """Edit scripts of gaps that fit in a task's memory, gap after gap in a sorted stream."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, sides, out = None, ([], []), []

        def script() -> Iterator[tuple]:
            if key:
                ops, rough = compared(*sides, most)
                for kind, x, y in ops:
                    yield (key[0], kind, key[1] + x, key[2] + y, rough and kind != "same")

        for pdf in batches:
            for pair, l0, r0, side, line in zip(pdf["pair"], pdf["l0"], pdf["r0"], pdf["side"], pdf["key"]):
                if (pair, l0, r0) != key:
                    out += script()
                    key, sides = (pair, l0, r0), ([], [])
                    if len(out) >= 10_000:
                        yield pd.DataFrame(out, columns=_columns(SCRIPT))
                        out = []
                sides[side].append(line)
        out += script()
        yield pd.DataFrame(out, columns=_columns(SCRIPT)).astype({"left_at": "int64", "right_at": "int64", "approximate": bool})

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "pair", "l0", "r0").sortWithinPartitions("pair", "l0", "r0", "side", "at")
    return dealt.select("pair", "l0", "r0", "side", "key").mapInPandas(compare, SCRIPT)


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _long(rows: DataFrame) -> DataFrame:
    """Long gaps without anchors: the common start and end are the same lines, the rest is replaced."""
    left = F.col("side") == 0
    rows = rows.withColumns(
        {
            "ahead": F.when(left, F.col("at") - F.col("l0")).otherwise(F.col("at") - F.col("r0")),
            "behind": F.when(left, F.col("l1") - F.col("at")).otherwise(F.col("r1") - F.col("at")),
        }
    )
    gap = ["pair", "l0", "r0"]

    def differing(place: str, name: str) -> DataFrame:
        met = rows.groupBy(*gap, place).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b"))
        return met.groupBy(*gap).agg(F.min(F.when(~((F.col("n") == 2) & (F.col("a") == F.col("b"))), F.col(place))).alias(name))

    shorter = F.least(F.col("l1") - F.col("l0"), F.col("r1") - F.col("r0")) - 1
    start = F.coalesce(F.col("first_ahead") - 1, shorter)
    end = F.least(F.coalesce(F.col("first_behind") - 1, shorter), shorter - start)
    differ = differing("ahead", "first_ahead").join(differing("behind", "first_behind"), gap)
    rows = _with_values(rows, differ, gap)
    rows = rows.withColumns({"start": start, "end": end})
    head, tail = F.col("ahead") <= F.col("start"), F.col("behind") <= F.col("end")
    same = rows.where(left & (head | tail)).select(
        "pair",
        F.lit("same").alias("kind"),
        F.col("at").alias("left_at"),
        F.when(head, F.col("r0") + F.col("ahead")).otherwise(F.col("r1") - F.col("behind")).alias("right_at"),
        F.lit(False).alias("approximate"),
    )
    between = {"l0": F.col("l0") + F.col("start"), "r0": F.col("r0") + F.col("start"), "l1": F.col("l1") - F.col("end"), "r1": F.col("r1") - F.col("end")}
    return same.union(_one_sided(rows.where(~head & ~tail).withColumns(between)))


def line_diff(
    before: DataFrame,
    after: DataFrame,
    volatile: bool = False,
    spaces: bool = False,
    max_edits: int = MAX_EDITS,
    gap_lines: int = GAP_LINES,
    block_lines: int = BLOCK_LINES,
) -> DataFrame:
    """(pair, step, kind, left, right, approximate): the edit script of logs (number, text; pair); lines by their number.

    kind: same, del (a line of ``before``) or add; ``left`` and ``right`` are the numbers of the lines, null on the other
    side. ``approximate`` marks changed lines of a gap too different for a least script. Null texts count as empty.
    """
    rows = settled(_side(before, 0, volatile, spaces).union(_side(after, 1, volatile, spaces)), "sides")
    numbers = rows.select("pair", "side", "at", "number")
    totals = rows.groupBy("pair").agg(*[(F.max(F.when(F.col("side") == s, F.col("at")).otherwise(0)) + 1).alias(c) for s, c in ((0, "l1"), (1, "r1"))])
    zero = F.lit(0).cast("long")
    rows = _with_values(rows.drop("file_id"), totals, ["pair"]).withColumns({"l0": zero, "r0": zero})
    script = None
    is_short = (F.col("l1") - F.col("l0") + F.col("r1") - F.col("r0") - 2 <= gap_lines) | (F.col("l1") - F.col("l0") == 1) | (F.col("r1") - F.col("r0") == 1)
    for _ in range(ROUNDS):
        chosen = settled(_in_order(_anchors(rows), block_lines), "chosen")
        rows = settled(_split(rows, chosen), "gaps")
        same = chosen.select("pair", F.lit("same").alias("kind"), F.col("l").alias("left_at"), F.col("r").alias("right_at"), F.lit(False).alias("approximate"))
        lone = (F.col("l1") - F.col("l0") == 1) | (F.col("r1") - F.col("r0") == 1)
        done = same.union(_one_sided(rows.where(lone))).union(_short(rows.where(is_short & ~lone), max_edits))
        script = done if script is None else script.union(done)
        rows = rows.where(~is_short)
        if chosen.isEmpty() or rows.isEmpty():
            break
    script = script.union(_long(rows))
    return _numbered(script, numbers)


def _numbered(script: DataFrame, numbers: DataFrame) -> DataFrame:
    """Places become the numbers that lines have in their logs."""
    for side, name, other in ((0, "left", "add"), (1, "right", "del")):
        own = numbers.where(F.col("side") == side).select("pair", F.col("at").alias("own_at"), F.col("number").alias(name))
        # Lines of the other side, of which many may share a place here, are dealt by their step.
        place = F.when(F.col("kind") != other, F.col(f"{name}_at")).otherwise(-1 - F.col("left_at") - F.col("right_at"))
        script = script.withColumn("own_at", place).join(own, ["pair", "own_at"], "left").drop("own_at")
    return script.select(
        "pair",
        (F.col("left_at") + F.col("right_at")).alias("step"),
        "kind",
        F.when(F.col("kind") != "add", F.col("left")).alias("left"),
        F.when(F.col("kind") != "del", F.col("right")).alias("right"),
        "approximate",
    )


def with_texts(script: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """``script`` with left_text and right_text, null where a row has no line on that side."""
    for df, name in ((before, "left"), (after, "right")):
        pair = _pair(df)
        own = df.select(pair.alias("pair"), F.col("number").cast("long").alias(name), F.coalesce("text", F.lit("")).alias(f"{name}_text"))
        # Rows without a line on this side are dealt by their step.
        script = script.withColumn("apart", F.when(F.col(name).isNull(), F.col("step")).otherwise(-1)).withColumnRenamed(name, "found")
        own = own.withColumn("apart", F.lit(-1).cast("long")).withColumn("found", F.col(name)).drop(name)
        script = script.withColumn("at", F.coalesce("found", F.lit(0)))
        script = script.join(own.withColumnRenamed("found", "at"), ["pair", "at", "apart"], "left").drop("at", "apart").withColumnRenamed("found", name)
    return script


def hunks(script: DataFrame, context: int = CONTEXT, volatile: bool = False) -> DataFrame:
    """A script for reading: changes with ``context`` lines around them, other lines folded, changed words marked.

    ``script`` has the lines' texts. Rows: (pair, step, kind, left, right, text, folded, spans); kind ``fold`` stands for
    ``folded`` unchanged lines. A run of removed lines and the run of added ones right after it are paired line by line;
    ``spans`` are the words in which a line differs from its partner.
    """
    rows = script.withColumn("file_id", F.col("pair")).withColumn("number", F.col("step"))
    rows = with_hits(with_chunks(rows, CHUNK_LINES), F.col("kind") != "same")
    near = F.col("is_match") | (F.col("place") - F.col("hit_before") <= context) | (F.col("hit_after") - F.col("place") <= context)
    rows = rows.withColumn("row_kind", F.when(F.coalesce(near, F.lit(False)), F.col("kind")).otherwise("fold"))
    rows = carry(rows, {"kind_before": (F.col("row_kind"), False)})
    rows = rows.withColumn("is_start", ~F.col("row_kind").eqNullSafe(F.col("kind_before")))
    rows = carry(rows, {"run_start": (F.when(F.col("is_start"), F.col("place")), True), "run_kind": (F.when(F.col("is_start"), F.col("kind_before")), True)})
    rows = settled(running_count(rows, "run", F.col("is_start")), "runs")
    nth = (F.col("place") - F.col("run_start")).alias("nth")
    partner = rows.where("row_kind = 'add' AND run_kind = 'del'").select("pair", (F.col("run") - 1).alias("run"), nth, F.col("step").alias("add_step"), F.col("right_text").alias("new_text"))
    removed = rows.where("row_kind = 'del'").select("pair", "run", nth, F.col("step").alias("del_step"), F.col("left_text").alias("old_text"))
    both = removed.join(partner, ["pair", "run", "nth"]).withColumn("spans", changed_spans(F.col("old_text"), F.col("new_text"), volatile))
    both = settled(both.select("pair", "del_step", "add_step", "spans"), "partners")
    marks = both.select("pair", F.col("del_step").alias("step"), F.col("spans.before").alias("spans")).union(
        both.select("pair", "add_step", "spans.after")
    )
    shown = rows.where("row_kind <> 'fold'").join(marks, ["pair", "step"], "left")
    zero = F.lit(0).cast("long")
    shown = shown.select("pair", "step", "kind", "left", "right", F.coalesce("left_text", "right_text").alias("text"), zero.alias("folded"), "spans")
    folded = (
        rows.where("row_kind = 'fold'")
        .groupBy("pair", "run")
        .agg(F.min("step").alias("step"), F.min("left").alias("left"), F.min("right").alias("right"), F.count("*").alias("folded"))
    )
    nothing = F.lit(None).cast("string")
    return shown.union(
        folded.select("pair", "step", F.lit("fold"), "left", "right", nothing, "folded", F.lit(None).cast(shown.schema["spans"].dataType))
    )


def summary(script: DataFrame) -> DataFrame:
    """(pair, added, removed, approximate): how many lines differ."""
    return script.groupBy("pair").agg(
        F.count(F.when(F.col("kind") == "add", 1)).alias("added"),
        F.count(F.when(F.col("kind") == "del", 1)).alias("removed"),
        F.max("approximate").alias("approximate"),
    )
