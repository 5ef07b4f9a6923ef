"""Results kept up with a growing log, batch by batch, against the batch operators over all lines."""

import random

import pytest
from pyspark.sql import functions as F

from logquarry.operators import aggregates as agg
from logquarry.operators.parse import parse
from logquarry.options import ParseOptions
from logquarry.sources.lines import from_text
from logquarry.streaming.follow import parse_stream
from logquarry.streaming.recompute import Recomputed
from logquarry.streaming.tail import tail


def log(seed):
    r = random.Random(seed)
    out = []
    for i in range(120):
        match r.randrange(7):
            case 0:
                out.append(f"##[group]Step {i}")
            case 1:
                out.append("##[endgroup]")
            case 2:
                out += [f"2027-02-01T08:{i // 60:02d}:{i % 60:02d}Z ERROR broken {i}", *["\tat x.Y(Z.java:1)"] * r.randrange(6)]
            case 3:
                out += ["plain", "ERROR without a time", "  more of it"]
            case _:
                out.append(f"[pod/p{i % 3}/c] 2027-02-01T08:{i // 60:02d}:{i % 60:02d}Z {r.choice(['WARN', 'INFO'])} n={i}")
    return out


def plain(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def check(kept, lines):
    names = ("key", "sample", "count", "first_line", "sources", "first", "last")
    assert plain(kept.groups(), *names) == plain(agg.error_groups(lines), *names)
    names = ("start", "title", "end", "errors", "lines")
    assert plain(kept.sections(), *names) == plain(agg.sections(lines), *names)
    slots = lines.where("time IS NOT NULL").groupBy(F.floor(F.col("time") / 1000)).agg(
        F.count_if(F.col("level") == "ERROR"), F.count_if(F.col("level") == "WARN"), F.count("*")
    )
    assert plain(kept.timeline(), "slot", "errors", "warnings", "total") == plain(slots, *slots.columns)


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_add_up(spark, tmp_path, seed):
    text = "\n".join(log(seed)) + "\n"
    lines = parse(from_text(spark, text), ParseOptions(chunk_lines=0))
    rows = lines.orderBy("number").collect()
    kept = Recomputed(spark, str(tmp_path / "kept"))
    cuts = sorted(random.Random(seed).sample(range(1, len(rows)), 6))
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        batch = spark.createDataFrame(rows[a:b], lines.schema)
        kept.add(batch, i)
        if i == 3:
            kept.add(batch, i)  # done again after a failure
    check(kept, lines)


def test_results_keep_up_with_a_growing_file(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    path, made = tmp_path / "logs" / "a.log", log(3)
    path.write_text("")
    kept = Recomputed(spark, str(tmp_path / "kept"))
    query = kept.follow(parse_stream(tail(spark, str(path.parent))), str(tmp_path / "check"))
    try:
        for a, b in ((0, 50), (50, 51), (51, len(made))):
            with open(path, "a") as f:
                f.write("".join(x + "\n" for x in made[a:b]))
            query.processAllAvailable()
    finally:
        query.stop()
    check(kept, parse(from_text(spark, "\n".join(made) + "\n"), ParseOptions(chunk_lines=0)))
