"""Growing logs: the tailing source, and blocks cut at any batch border, against the batch parse."""

import random
import uuid

from logquarry.operators.parse import parse
from logquarry.options import ParseOptions
from logquarry.sources.lines import SCHEMA, from_text
from logquarry.streaming.follow import OUTPUT, parse_stream
from logquarry.streaming.tail import TailReader, tail

NAMES = [c.split()[0] for c in OUTPUT.split(", ")]
LOG = """2027-02-01 08:15:00 INFO queue ready
-----BEGIN RSA PRIVATE KEY-----
MIIEow{
-----END RSA PRIVATE KEY-----
{
  "time": "2027-02-01T08:15:04.250Z",
  "severity": "warn",
  "msg": "disk almost full",
  "free": [1,
    2.5]
}
  at indented.Frame(X.java:1)
2027-02-01 08:15:05 DEBUG state {
  {"inner": 1}
  {
    "inner": 2
  }
2027-02-01 08:15:07 ERROR answer: {
  "code": 503
}
plain
"""


def in_batch(spark, text):
    return [tuple(r) for r in parse(from_text(spark, text), ParseOptions(chunk_lines=0)).select(*NAMES[1:]).orderBy("number").collect()]


def started(stream, options=ParseOptions()):
    name = f"followed_{uuid.uuid4().hex}"
    return name, parse_stream(stream, options).writeStream.format("memory").queryName(name).outputMode("append").start()


def rows(spark, name):
    return [tuple(r) for r in spark.table(name).orderBy("number").select(*NAMES[1:]).collect()]


def test_blocks_cut_at_every_border_parse_as_in_batch(spark, tmp_path):
    lines = from_text(spark, LOG).collect()
    cuts = sorted(random.Random(5).sample(range(1, len(lines)), 9))
    name, query = started(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path)).drop("file_idx"))
    try:
        for a, b in zip([0, *cuts], [*cuts, len(lines)]):
            spark.createDataFrame(lines[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path))
            query.processAllAvailable()
        assert rows(spark, name) == in_batch(spark, LOG)
    finally:
        query.stop()


def test_an_open_block_waits_for_its_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text('INFO one\n{\n  "level": "error",\n')
    name, query = started(tail(spark, str(tmp_path)))
    try:
        query.processAllAvailable()
        assert [r[1] for r in rows(spark, name)] == ["INFO one"]
        with open(tmp_path / "a.log", "a") as f:
            f.write('  "msg": "x"\n}\nhalf a li')
        query.processAllAvailable()
        assert [(r[0], r[2]) for r in rows(spark, name)] == [(1, "INFO"), (2, "ERROR"), (3, "ERROR"), (4, "ERROR"), (5, "ERROR")]
    finally:
        query.stop()


def test_a_growing_file_gives_the_rows_of_the_batch_parse(spark, tmp_path):
    text = (LOG + "é 2027 ünï\r\n" + LOG.replace("503", "504") + "a\rb\n") * 3
    raw = text.encode()
    cuts = sorted(random.Random(6).sample(range(1, len(raw)), 5))
    path = tmp_path / "app.log"
    path.write_bytes(b"")
    name, query = started(tail(spark, str(tmp_path), split_bytes=100))
    try:
        for a, b in zip([0, *cuts], [*cuts, len(raw)]):
            with open(path, "ab") as f:
                f.write(raw[a:b])
            query.processAllAvailable()
        got = rows(spark, name)
        assert got == in_batch(spark, text)[: len(got)] and len(got) == text.count("\n") + 3
    finally:
        query.stop()


def test_a_replaced_file_is_read_anew(spark, tmp_path):
    path = tmp_path / "app.log"
    path.write_text("2027-02-01 08:00:00 ERROR old\nmore\n")
    name, query = started(tail(spark, f"file://{tmp_path}"))
    try:
        query.processAllAvailable()
        path.write_text("fresh\nWARN start\nthird\n")
        query.processAllAvailable()
        got = [(r["number"], r["text"], r["level"]) for r in spark.table(name).collect()]
        assert sorted(got, key=repr) == sorted([(1, "2027-02-01 08:00:00 ERROR old", "ERROR"), (2, "more", "ERROR"), (1, "fresh", None), (2, "WARN start", "WARN"), (3, "third", "WARN")], key=repr)
    finally:
        query.stop()


def read_all(reader, start, end):
    return [r for p in reader.partitions(start, end) for r in reader.read(p)]


def test_ranges_give_every_line_once(tmp_path):
    path = tmp_path / "x.log"
    r = random.Random(1)
    lines = ["".join(r.choice("abé") for _ in range(r.choice([0, 1, 3, 40]))) for _ in range(200)]
    path.write_text("\n".join(lines) + "\nrest")
    for split in (1, 7, 64, 10_000):
        reader = TailReader({"path": str(path), "splitbytes": str(split)})
        got = read_all(reader, {}, reader.latestOffset())
        assert [x[2] for x in got] == lines and [x[1] for x in got] == sorted({x[1] for x in got})


def test_files_are_known_again(tmp_path):
    path = tmp_path / "x.log"
    reader = TailReader({"path": str(tmp_path)})
    path.write_text("one\ntwo\n")
    first = reader.latestOffset()
    path.write_text("one\ntwo\nthree\nfo")
    second = reader.latestOffset()
    assert [x[2] for x in read_all(reader, first, second)] == ["three"]
    assert read_all(reader, second, reader.latestOffset()) == []
    path.write_text("one\nnew\nother\nand more\n")
    assert [x[2] for x in read_all(reader, second, reader.latestOffset())] == ["one", "new", "other", "and more"]
    path.write_text("")
    assert read_all(reader, second, reader.latestOffset()) == []
    path.unlink()
    assert reader.latestOffset() == {} and read_all(reader, second, {}) == []
