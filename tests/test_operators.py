import pytest
from pyspark.sql import functions as F

from logquarry import sql
from logquarry.operators import aggregates as agg
from logquarry.operators import diff, filters, limited, merge, sinks
from logquarry.operators.parse import parse
from logquarry.options import ParseOptions
from logquarry.plans.search import read_condition
from logquarry.plans.view import View, apply_view
from logquarry.sources.lines import SCHEMA, from_text, from_texts
from logquarry.streaming.follow import OUTPUT, level_windows, parse_stream

TEXT = """2026-03-01 10:00:00 INFO GET /healthz id=12
2026-03-01 10:00:01 ERROR charge 17 failed took=1.5s
\tat Pay.charge(Pay.java:42)
\tat Pay.run(Pay.java:7)
2026-03-01 10:00:02 ERROR charge 18 failed took=0.5s
\tat Pay.charge(Pay.java:42)
\tat Pay.run(Pay.java:7)
note of the entry above
2026-03-01 10:00:03 WARN slow 3f2504e0-4f89-11d3-9a0c-0305e82c3301 user_id=77
2026-03-01 10:00:04 INFO GET /healthz id=13
##[group] Build
2026-03-01 10:00:05 ERROR other
##[endgroup]
after
"""


def numbers(df):
    return [r["number"] for r in df.orderBy("number").collect()]


def log(spark, chunk=4, text=TEXT):
    return parse(from_text(spark, text), ParseOptions(chunk_lines=chunk))


def test_filters_agree_for_whole_files_and_chunks(spark):
    for chunk in (0, 3):
        df = log(spark, chunk)
        assert numbers(filters.by_fields(df, [read_condition("took>1s")])) == [2, 3, 4]
        assert numbers(filters.without_words(df, ["charge 17"])) == [1, *range(5, 15)]
        assert numbers(filters.without_words(df, ["pay.run"])) == [1, 2, 3, 5, 6, *range(8, 15)]
        kinds = filters.with_kinds(df.where("number = 1")).select("kind")
        assert numbers(filters.without_kinds(df, kinds)) == [*range(2, 10), 12, 13, 14]
        shown = filters.with_context(df, F.col("text").contains("slow"), 1)
        assert [(r["number"], r["is_context"], r["gap_above"]) for r in shown.orderBy("number").collect()] == [
            (8, True, False), (9, False, False), (10, True, False),
        ]
        two = filters.with_context(df, F.col("number").isin(1, 9), 1)
        assert [(r["number"], r["gap_above"]) for r in two.orderBy("number").collect()] == [(1, False), (2, False), (8, True), (9, False), (10, False)]
        found = agg.sections(df)
        assert [tuple(r) for r in found.select("title", "start", "end", "errors").collect()] == [("Build", 11, 13, 1)]
        assert numbers(filters.fold_sections(df, found)) == [*range(1, 12), 14]
        assert numbers(filters.fold_sections(df, found, [11])) == list(range(1, 15))
        runs = agg.collapse_repeats(df).where("repeat > 1")
        assert [(r["number"], r["repeat"]) for r in runs.collect()] == [(2, 2)]
        repeated = log(spark, chunk, "INFO a 1\nINFO a 2\n\tat x 1\nINFO a 3\n\tat x 2\nINFO a 4\n")
        assert [(r["number"], r["repeat"]) for r in agg.collapse_repeats(repeated).orderBy("number").collect()] == [
            (1, 1), (2, 2), (3, 1), (6, 1),
        ]


def test_aggregates(spark):
    df = log(spark)
    groups = agg.sorted_groups(agg.error_groups(df)).collect()
    assert [(g["count"], g["first_line"], g["sample"]) for g in groups] == [
        (2, 2, "2026-03-01 10:00:01 ERROR charge 17 failed took=1.5s"),
        (1, 8, "note of the entry above"),
        (1, 12, "2026-03-01 10:00:05 ERROR other"),
    ]
    assert [g["first_line"] for g in agg.sorted_groups(agg.error_groups(df), "first").collect()] == [2, 8, 12]
    assert numbers(agg.group_lines(df, agg.error_groups(df).where("count = 2"))) == [2, 3, 4, 5, 6, 7]
    stats = agg.numeric_stats(df, "took").first()
    assert (stats["count"], stats["min"], stats["p95"], stats["duration"]) == (2, 500.0, 1500.0, True)
    assert agg.numeric_stats(df, "nothing").count() == 0
    ids = {r["number"]: [tuple(i) for i in r["ids"]] for r in agg.line_ids(df).collect()}
    assert ids[9] == [("user_id", "77"), ("id", "3f2504e0-4f89-11d3-9a0c-0305e82c3301")]
    assert agg.trace(df, "77").first()["entries"] == 1 and agg.trace(df, "7").first()["entries"] == 0
    assert agg.secret_count(df).first()[0] == 0
    assert agg.timeline(df.limit(0)).count() == 0
    assert agg.timeline(df, 5).agg(F.sum("total")).first()[0] == 6
    assert [tuple(r) for r in agg.common_fields(df).collect()][0] == ("id", 2)
    assert agg.range_summary(df, 2, 9).first()[:] == (8, 2000)
    assert agg.json_share(df).first()[0] is False
    jump = filters.jump(df, 5, F.col("level") == "ERROR").first()["number"]
    heads = filters.jump(df, 8, (F.col("level") == "ERROR") & ~F.col("continuation")).first()["number"]
    assert (jump, heads, filters.jump(df, 12, F.col("number") == 2).first()["number"]) == (6, 12, 2)
    records = log(spark, text='{"ts":1772359200,"level":"info","service":"a","msg":"x"}\n')
    assert agg.default_columns(records) == ["ts", "level", "service", "msg"]
    assert agg.status_counts(df.limit(3), df).first()[:] == (3, 14, 11)


def test_groups_of_a_panel(spark):
    shown = agg.top_groups(agg.error_groups(log(spark)), limit=2).collect()
    assert [(g["count"], g["is_earliest"]) for g in shown] == [(2, True), (1, False)]
    assert [g["is_earliest"] for g in agg.top_groups(agg.error_groups(log(spark, text="ERROR x\n"))).collect()] == [False]


def test_conditions_to_try(spark):
    assert agg.suggested_condition(log(spark)) == "took>1s"
    assert agg.suggested_condition(log(spark, text="a status=200\n")) == "status>=500"
    assert agg.suggested_condition(log(spark, text='a service="x y"\nb service=pay\n')) == "service=pay"
    assert agg.suggested_condition(log(spark, text="nothing\n")) is None
    assert agg.stat_condition("took", 1500.0, True) == "took>=1500ms"
    assert agg.stat_condition("a b", 'x"y') == '"a b"="x\\"y"'


def test_a_search_is_given_up_in_time(spark):
    df = log(spark)
    assert numbers(limited.regex_search(df, r"charge 1\d", seconds=120)) == [2, 5]
    slow = spark.range(8).select(F.expr("reflect('java.lang.Thread', 'sleep', CAST(60000 AS BIGINT))"))
    with pytest.raises(TimeoutError):
        limited.within(spark, 1, slow.collect)
    assert limited.within(spark, 60, df.count) == 14


def test_error_diff(spark):
    before = log(spark)
    after = log(spark, text=TEXT.replace("other", "brand new"))
    got = {(r["change"], r["sample"].split(" ", 2)[-1]) for r in agg.error_diff(before, after).collect()}
    assert got == {
        ("added", "ERROR brand new"), ("gone", "ERROR other"), ("same", "ERROR charge 17 failed took=1.5s"), ("same", "the entry above"),
    }


def test_merge_by_time(spark):
    files = [
        ("a.log", 0, "head\n2026-03-01 10:00:00 a1\n\tat x\n2026-03-01 10:00:02 a2\n2026-03-01 10:00:01 late\n"),
        ("b.log", 1, "2026-03-01 10:00:01 b1\n2026-03-01 10:00:02 b2\n"),
        ("c.log", 2, "no time\n"),
    ]
    texts = spark.createDataFrame(files, "file_id string, file_idx int, text string")
    labels = texts.select("file_id", F.col("file_id").alias("label"))
    for chunk in (0, 2):
        df = parse(from_texts(texts), ParseOptions(chunk_lines=chunk))
        out = merge.renumbered(merge.merged(df, labels)).orderBy("number").collect()
        assert [r["raw"].split(" | ")[1].split(" ")[-1] for r in out] == ["head", "a1", "x", "b1", "a2", "late", "b2", "time"]
        assert [r["number"] for r in out] == list(range(1, 9))
        assert [r["file_id"] for r in merge.untimed(df).collect()] == ["c.log"]


def test_sinks(spark, tmp_path):
    df = log(spark)
    sinks.write_text(df, str(tmp_path / "text"))
    assert sorted(spark.read.text(str(tmp_path / "text")).select("value").toPandas()["value"]) == sorted(TEXT.splitlines())
    sinks.write_csv(df, ["level", "id,x"], str(tmp_path / "csv"))
    rows = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "csv").glob("part-*")))
    assert rows.startswith('level,"id,x"\r\nINFO,\r\n') and rows.endswith("\r\n")
    marks = spark.createDataFrame([(9, ""), (2, "first")], "number long, note string")
    report = sinks.bookmark_report(df, marks, "Case", "http://x")
    assert report.splitlines()[2] == "- **[L2](http://x#L2)** · 2026-03-01 10:00:01.000Z — first"
    assert "(+2.0s)" in report


def test_json_diff(spark):
    a = spark.createDataFrame([(1, '{"a":1,"b":{"c":[1,2]},"k d":1}')], "id int, json string")
    b = spark.createDataFrame([(1, '{"b":{"c":[1,3,4]},"a":1,"k d":2}')], "id int, json string")
    got = {(r["path"], r["kind"], r["before"], r["after"]) for r in diff.json_changes(a, b).collect()}
    assert got == {("$.b.c[1]", "changed", "2", "3"), ("$.b.c[2]", "added", None, "4"), ('$["k d"]', "changed", "1", "2")}


def test_views(spark):
    df = log(spark)
    view = View(levels=("ERROR",), query="charge -took=0.5s", time_range=(0, 1 << 60))
    assert numbers(apply_view(df, view)) == [2, 3]
    assert numbers(apply_view(df, View(query="pay.charge"), context=1)) == [2, 3, 4, 5, 6, 7]
    assert numbers(apply_view(df, View(mutes=(1,), levels=("INFO", "OTHER")))) == [13, 14]
    assert apply_view(df, View(), collapse=True).count() == 11


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT log_signature('a 12'), log_mask('token=abcdefg'), log_url_encode('a b'), log_quote_csv('=x')").first()
    assert tuple(row) == ("a #", "token=********", "a%20b", "'=x")
    sql.register_lines(log(spark), "log_lines")
    assert spark.sql("SELECT count(*) FROM log_lines WHERE level = 'ERROR'").first()[0] == 8


def test_streamed_lines_parse_as_in_batch(spark, tmp_path):
    lines = from_text(spark, TEXT + "-----BEGIN PRIVATE KEY-----\nabc\n-----END PRIVATE KEY-----\n23:00:00 x\n01:00:00 y\n")
    rows = [tuple(r) for r in lines.orderBy("number").collect()]
    for i in range(0, len(rows), 4):
        spark.createDataFrame(rows[i : i + 4], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("file_idx")
    query = parse_stream(stream).writeStream.format("memory").queryName("followed").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    names = [c.split()[0] for c in OUTPUT.split(", ")]
    got = spark.table("followed").orderBy("number").select(names).collect()
    want = parse(lines).orderBy("number").select(names).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    assert level_windows(parse(lines)).agg(F.sum("lines")).first()[0] == 8

