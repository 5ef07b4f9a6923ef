import gzip

import pytest
from pyspark.sql import functions as F

from logquarry.operators.parse import COLUMNS, parse
from logquarry.options import ParseOptions
from logquarry.plans.registry import QUERIES
from logquarry.sources import lines as src

LEVELS = [
    ("2026-03-01 10:00:00,123 - app - ERROR - it broke", "ERROR", 1772359200123),
    ("2026-03-01T10:00:00.5+02:00 warn: slow", "WARN", 1772352000500),
    ("2026-02-30 10:00:00 INFO no such day", "INFO", None),
    ("W0301 10:00:00.000000       1 x.go:7] deprecated", "WARN", 1772359200000),
    ("[10:00:03 VRB] tick", "TRACE", 20454 * 86_400_000 + 36_003_000),
    ("prod.CRITICAL: boom", "ERROR", None),
    ('1.2.3.4 - - [01/Mar/2026:10:00:00 +0100] "GET /a HTTP/1.1" 404 1', "WARN", 1772355600000),
    ("<27>Mar  1 10:00:00 host app: x", "ERROR", 1772359200000),
    ("[01-Mar-2026 10:00:00 UTC] PHP Notice:  hm", "INFO", 1772359200000),
    ("[Sun Mar 01 10:00:00.250000 2026] [core:error] no", "ERROR", 1772359200250),
    ("Mar 1, 2026 10:00:00 PM a.B run", None, 1772402400000),
    ("7:M 01 Mar 2026 10:00:00.001 # low", "WARN", 1772359200001),
    ("03-01 10:00:00.004  12  34 E Tag: no", "ERROR", 1772359200004),
    ("1772359200 start", None, 1772359200000),
    ("npm ERR! code", "ERROR", None),
    ("src/a.c:1:2: warning: unused", "WARN", None),
    ("no error here", None, None),
    ("level=debug x=1", "DEBUG", None),
]


def table(spark, text, options=ParseOptions()):
    return parse(src.from_text(spark, text), options).orderBy("number").collect()


def test_levels_and_times_of_single_lines(spark):
    rows = spark.createDataFrame([(f"f{i:02d}", i, 1, line) for i, (line, _, _) in enumerate(LEVELS)], src.SCHEMA)
    got = parse(rows).orderBy("file_idx").collect()
    assert [(r["level"], r["time"]) for r in got] == [(lv, t) for _, lv, t in LEVELS]


TEXT = """2026-03-01 10:00:00 INFO start
2026-03-01 10:00:01 ERROR failed
\tat a.B.c(B.java:1)
Caused by: x
plain line
+ mvn test
java.lang.IllegalStateException: boom
2026-03-01 10:00:00 DEBUG back in time
-----BEGIN RSA PRIVATE KEY-----
2026-03-01 10:00:09 ERROR inside
-----END RSA PRIVATE KEY-----
{"level":50,"msg":"hi","ts":1772359210,"b":1.50}
password = hunter22222
"""


@pytest.mark.parametrize("chunk", [0, 1, 3, 100])
def test_what_is_carried_along_lines(spark, chunk):
    got = table(spark, TEXT, ParseOptions(chunk_lines=chunk))
    assert [r["level"] for r in got] == [
        "INFO", "ERROR", "ERROR", "ERROR", "ERROR", None, "ERROR", "DEBUG", "DEBUG", "DEBUG", "DEBUG", "ERROR", "ERROR",
    ]
    assert [r["gap"] for r in got] == [None, 1000, None, None, None, None, None, -1000, None, None, None, 10000, None]
    assert [r["continuation"] for r in got] == [n in (3, 4, 10, 11) for n in range(1, 14)]
    assert [r["entry_id"] for r in got] == [1, 2, 2, 2, 5, 6, 7, 8, 9, 9, 9, 12, 13]
    assert [r["timed_entry_id"] for r in got] == [1, 2, 2, 2, 2, 2, 2, 8, 8, 8, 8, 12, 12]
    assert [r["number"] for r in got if r["secret"]] == [9, 10, 13]
    assert [r["number"] for r in got if r["secret_block"]] == [10]
    assert got[11]["text"] == '2026-03-01T10:00:10.000Z ERROR hi {"b":1.5}'


def test_times_without_dates_go_over_midnight(spark):
    got = table(spark, "23:59:59.500 a\n00:00:01 b\n00:00:00 c\n")
    assert [r["gap"] for r in got] == [None, 1500, -1000]


def test_sources_and_custom_levels(spark):
    got = table(spark, "[pod/a-1/web] ERROR x\nweb-2  | WARN y\nw.log | ALERT z\n", ParseOptions(custom_levels={"ALERT": "WARN"}))
    assert [(r["source"], r["level"]) for r in got] == [("a-1/web", "ERROR"), ("web-2", "WARN"), ("w.log", "WARN")]


def test_empty_text_has_no_lines(spark):
    assert table(spark, "") == []
    assert parse(src.from_text(spark, "x")).columns == [*COLUMNS, "chunk"]
    assert parse(src.from_text(spark, "x"), ParseOptions(chunk_lines=0)).columns == list(COLUMNS)


def test_files_are_numbered_over_splits(spark, tmp_path):
    for name in ("a.log", "b.log"):
        (tmp_path / name).write_text("".join(f"{name} {i}\r\n" for i in range(1, 3001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = src.read_files(spark, [str(tmp_path)])
        wrong = got.where(~F.col("raw").endswith(F.concat(F.lit(" "), F.col("number").cast("string"))))
        assert (got.count(), wrong.count()) == (6000, 0)
        assert got.select("file_id", "file_idx").distinct().count() == 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_gzip_is_told_by_its_bytes(spark, tmp_path):
    (tmp_path / "x.log").write_bytes(gzip.compress(b"one\ntwo"))
    (tmp_path / "y.log").write_bytes(b"\xffthree\r\n\n")
    got = src.read_any(spark, [str(tmp_path)]).orderBy("file_id", "number").collect()
    assert [r["raw"] for r in got] == ["one", "two", "�three", ""]


def test_log_sniffing_labels_and_growth(spark):
    texts = spark.createDataFrame([("a", "INFO x\nb\nWARN y\n"), ("b", "x\ny\nz"), ("c", "INFO x")], "file_id string, text string")
    got = {r["file_id"]: r["is_log"] for r in src.looks_like_log(texts).collect()}
    assert got == {"a": True, "b": False, "c": False}
    assert src.file_labels(["app.log.gz", "APP.log", "my build", "..."]) == ["app.log", "APP-2.log", "my_build.log", "log.log"]
    assert src.appended_text("ab\n", "ab\ncd\nef") == ("cd\n", 6)
    assert src.appended_text("ab", "ab") == ("", 2)
    assert src.appended_text("ab", "x") is None


@pytest.mark.parametrize("chunk", [0, 2])
def test_raw_lines_stay_with_what_was_read_from_them(spark, chunk):
    raw = ["\x1b[31mERROR\x1b[0m a", "{", '  "level": "warn"', "}", "-----BEGIN RSA PRIVATE KEY-----", "\x1b[1mMII", "-----END RSA PRIVATE KEY-----"]
    lines = src.from_text(spark, "\n".join(raw))
    got = parse(lines, ParseOptions(chunk_lines=chunk), keep=("raw",)).orderBy("number").collect()
    assert [r["raw"] for r in got] == raw and got[0]["text"] == "ERROR a" and got[1]["level"] == "WARN"
    assert "raw" not in parse(lines, ParseOptions(chunk_lines=chunk)).columns


def test_coloured_lines_are_not_joined_to_themselves(spark):
    """A side made of every line looked small enough to broadcast, by the size of the compressed table."""
    plan = QUERIES["log_ansi_colours"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "props" not in plan
