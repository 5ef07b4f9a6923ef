"""Registered queries over the many shapes that log lines have, each event written in one of them, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.functions import spans, times, tools
from logquarry.functions import text as tx
from logquarry.functions.secrets import find_secrets, has_secret, mask_secrets
from logquarry.operators import aggregates as agg
from logquarry.operators import filters
from logquarry.operators.diff import json_changes
from logquarry.operators.parse import parse
from logquarry.options import ParseOptions
from logquarry.plans.log_queries import _EV, _events, _lines
from logquarry.plans.search import field_conditions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        SQL[name] = sql.replace("{EV}", _EV)
        return run

    return register


def _ts() -> Column:
    return F.col("ts").cast("timestamp")


def _at(pattern: str) -> Column:
    return F.date_format("ts", pattern)


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _one_of(*shapes: Column) -> Column:
    """Events take turns in the shapes, by their number."""
    return F.get(F.array(*shapes), (F.col("number") % len(shapes)).cast("int"))


@_query("log_time_formats", """WITH {EV} SELECT number, CASE WHEN number % 9 = 1 THEN ms // 1000 * 1000 - 7200000
WHEN number % 9 IN (4, 6) THEN ms // 1000 * 1000 ELSE ms END AS time FROM ev""")
def time_formats(spark, sf_dir):
    day = F.lpad(F.day("ts").cast("string"), 2, " ")
    raw = _one_of(
        _text(_at("yyyy/MM/dd HH:mm:ss,SSS"), " a"),
        _text("h - - [", _at("dd/MMM/yyyy:HH:mm:ss"), ' +0200] "GET / HTTP/1.1" 200 1'),
        _text(_at("dd-MMM-yyyy HH:mm:ss.SSS"), " a"),
        _text("[", _at("EEE MMM dd HH:mm:ss.SSSSSS yyyy"), "] a"),
        _text(_at("MMM d, yyyy h:mm:ss a"), " a"),
        _text("I", _at("MMdd HH:mm:ss.SSSSSS"), "     1 m.go:5] a"),
        _text(_at("MMM"), " ", day, _at(" HH:mm:ss"), " host app: a"),
        _text(_at("MM-dd HH:mm:ss.SSS"), "  1  2 I tag: a"),
        _text(F.unix_millis(_ts()), " a"),
    )
    return parse(_lines(_events(spark, sf_dir), raw), ParseOptions(default_year=2024)).select("number", "time")


@_query("log_time_only_lines", """WITH {EV}, d AS (SELECT number, ms % 86400000 AS clock FROM ev),
s AS (SELECT *, CASE WHEN lag(clock) OVER (ORDER BY number) - clock > 43200000 THEN 1 ELSE 0 END AS step FROM d),
t AS (SELECT number, (19000 + sum(step) OVER (ORDER BY number))::BIGINT * 86400000 + clock AS time FROM s)
SELECT number, time, time - lag(time) OVER (ORDER BY number) AS gap FROM t""")
def time_only(spark, sf_dir):
    raw = _text(_at("HH:mm:ss.SSS"), " step ", F.col("k"))
    return parse(_lines(_events(spark, sf_dir), raw), ParseOptions(base_day=19_000)).select("number", "time", "gap")


@_query("log_level_shapes", """WITH {EV} SELECT number, ['INFO', 'WARN', 'ERROR', 'ERROR', 'WARN', 'WARN', 'ERROR', 'INFO', 'WARN',
'INFO', 'INFO', 'ERROR', 'ERROR', 'ERROR', 'WARN', 'WARN'][number % 16 + 1] AS level FROM ev""")
def level_shapes(spark, sf_dir):
    k = F.col("k")
    raw = _one_of(
        _text("I", _at("MMdd HH:mm:ss.SSSSSS"), "     1 m.go:5] a ", k),
        _text("[", _at("HH:mm:ss"), " WRN] a ", k),
        _text("[", _at("yyyy-MM-dd HH:mm:ss"), "] local.ERROR: a ", k),
        _text(_at("yyyy/MM/dd HH:mm:ss"), " [alert] 12#0: a ", k),
        _text("[", _at("EEE MMM dd HH:mm:ss.SSSSSS yyyy"), "] [core:warn] a ", k),
        _text("12:M ", _at("dd MMM yyyy HH:mm:ss.SSS"), " # a ", k),
        _text("npm ERR! a ", k),
        _text("::notice file=x::a ", k),
        _text("PHP Warning:  a ", k),
        _text(_at("yyyy-MM-dd HH:mm:ss"), " UTC LOG:  a ", k),
        _text("0 [Note] a ", k),
        _text('h - - [x] "GET /a HTTP/1.1" 503 ', k),
        _text("<11>app: a ", k),
        _text("E/Tag( 12): a ", k),
        _text("main.c:3:4: warning: a ", k),
        _text("[W] a ", k),
    )
    return parse(_lines(_events(spark, sf_dir), raw)).select("number", "level")


@_query("log_custom_levels", """WITH {EV} SELECT number, CASE WHEN number % 4 = 0 THEN 'WARN' ELSE 'DEBUG' END AS level FROM ev""")
def custom_levels(spark, sf_dir):
    """A custom word counts in its own case, and in any case after ``level=`` and in a record; the rest inherit."""
    user = F.col("user_id")
    raw = _one_of(_text("AUDIT user ", user), _text("level=slow user ", user), _text("audit user ", user), _text('{"level":"Slow","user":', user, "}"))
    options = ParseOptions(custom_levels={"AUDIT": "WARN", "SLOW": "DEBUG"})
    return parse(_lines(_events(spark, sf_dir), raw), options).select("number", "level")


@_query("log_key_blocks", """WITH {EV}, l AS (SELECT number, level, unnest(CASE WHEN level = 'ERROR' THEN [0, 1, 2, 3] ELSE [0] END) AS pos FROM ev)
SELECT number * 4 - 3 + pos AS number, level, pos > 1 AS continuation, pos IN (1, 2) AS secret, pos = 2 AS secret_block FROM l""")
def key_blocks(spark, sf_dir):
    first = _text(_at("yyyy-MM-dd HH:mm:ss.SSS"), " ", F.col("level"), " k=", F.col("k"))
    block = [F.lit(x) for x in ("-----BEGIN RSA PRIVATE KEY-----", "MIIEowIBAAKCAQEA", "-----END RSA PRIVATE KEY-----")]
    rows = F.when(F.col("level") == "ERROR", F.array(first, *block)).otherwise(F.array(first))
    events = _events(spark, sf_dir).select("number", F.posexplode(rows).alias("pos", "raw"))
    lines = parse(_lines(events, F.col("raw"), number=F.col("number") * 4 + F.col("pos") - 3))
    return lines.select("number", "level", "continuation", "secret", "secret_block")


# What stands before a secret, which secret, what stands after it.
_SECRETS = (
    ("key AKIA", "upper", " x"), ("ghp_", "plain", " x"), ("glpat-", "plain", " x"), ("xoxb-", "plain", " x"), ("sk_live_", "plain", " x"),
    ("AIza", "padded", " x"), ("jwt eyJ", "token", " x"), ("dsn db://me:", "plain", "@host/x"), ("Authorization: Bearer ", "plain", " x"),
    ('password: "', "plain", '" x'), ("api-key='", "plain", "' x"), ("token=", "plain", " x"), ("password=${HOME} x", "", ""), ("plain x", "", ""),
)
_KINDS = {"upper": "upper(substr({0}, 1, 16))", "plain": "{0}", "padded": "concat({0}, 'abc')", "token": "concat({0}, '.eyJ', {0}, '.', {0})", "": "''"}


def _cases(values: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN number % {len(values)} = {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SECRET_SQL = f"""WITH {{EV}}, s AS (
  SELECT number, {_cases([_quoted(a) for a, _, _ in _SECRETS])} AS a, {_cases([_KINDS[k].format("md5(CAST(number AS VARCHAR))") for _, k, _ in _SECRETS])} AS s,
         {_cases([_quoted(b) for _, _, b in _SECRETS])} AS b FROM ev
)
SELECT number, s <> '' AS secret, a || CASE WHEN s <> '' THEN '********' ELSE '' END || b AS masked,
       CASE WHEN s <> '' THEN length(a) || ':' || (length(a) + length(s)) ELSE '' END AS spans FROM s"""


@_query("log_secret_rules", _SECRET_SQL)
def secret_rules(spark, sf_dir):
    """Every rule for secrets, and texts that only look like them: flag, mask and spans."""
    shapes = [_text(a, F.expr(_KINDS[k].format("md5(cast(number as string))")), b) for a, k, b in _SECRETS]
    lines = _events(spark, sf_dir).select("number", _one_of(*shapes).alias("t"))
    places = F.transform(find_secrets(F.col("t")), lambda s: F.concat_ws(":", s["start"], s["end"]))
    return lines.select("number", has_secret(F.col("t")).alias("secret"), mask_secrets(F.col("t")).alias("masked"), F.array_join(places, " ").alias("spans"))


@_query("log_ansi_colours", """WITH {EV} SELECT number, level, level || ' of ' || event_type || ' end' AS text,
'0:' || length(level) || ':ansi-red ansi-bold|' || (length(level) + 4) || ':' || (length(level) + 4 + length(event_type)) || ':ansi-underline' AS spans
FROM ev""")
def ansi_colours(spark, sf_dir):
    raw = _text("\x1b[1;31m", F.col("level"), "\x1b[0m of \x1b[4m", F.col("event_type"), "\x1b[24m end\x1b[K")
    lines = _lines(_events(spark, sf_dir), raw)
    shown = F.transform(spans.ansi_spans(F.col("raw")), lambda s: F.concat_ws(":", s["start"], s["end"], s["cls"]))
    return parse(lines, keep=("raw",)).select("number", "level", "text", F.array_join(shown, "|").alias("spans"))


@_query("log_highlights", """WITH {EV} SELECT number, 'user<cond+match>|=' || user_id || '<cond>| k=' || k || ' <>|user<match>' AS pieces FROM ev""")
def highlights(spark, sf_dir):
    """Overlapping ranges of two searches as pieces with all their classes."""
    t = F.col("t")

    def ranges(query: str, cls: str, regex: bool = False) -> Column:
        return F.transform(
            spans.search_ranges(t, query, regex), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), F.lit(cls).alias("cls"))
        )

    lines = _events(spark, sf_dir).select("number", _text("user=", F.col("user_id"), " k=", F.col("k"), " user").alias("t"))
    found = F.concat(ranges(r"user=\d+", "cond", True), ranges("USER", "match"))
    pieces = F.transform(spans.segments(t, found), lambda p: _text(p["text"], "<", F.array_join(p["classes"], "+"), ">"))
    return lines.select("number", F.array_join(pieces, "|").alias("pieces"))


@_query("log_table_cells", """WITH {EV} SELECT number, event_type || '|' || user_id || '|' AS cells, 'level=info k=' || k || ' z=null' AS rest FROM ev""")
def table_cells(spark, sf_dir):
    raw = _text('{"level":"info","msg":"', F.col("event_type"), '","user_id":', F.col("user_id"), ',"k":', F.col("k"), ',"z":null}')
    cells = spans.table_cells(["msg", "user_id", "nope"])
    lines = parse(_lines(_events(spark, sf_dir), raw)).select("number", cells.alias("c"))
    return lines.select("number", F.array_join("c.cells", "|").alias("cells"), F.col("c.rest").alias("rest"))


@_query("log_local_times", """WITH {EV} SELECT number,
'at ' || strftime(make_timestamp(ms * 1000) + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S.%g') || '+05:30 k=' || k AS text FROM ev""")
def local_times(spark, sf_dir):
    lines = _events(spark, sf_dir).select("number", _text("at ", _at("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), " k=", F.col("k")).alias("t"))
    return lines.select("number", spans.localized(F.col("t"), "Asia/Kolkata").alias("text"))


@_query("log_changed_words", """WITH {EV} SELECT number, '5:' || (6 + length(CAST(k AS VARCHAR))) AS before,
'5:' || (6 + length(CAST(k AS VARCHAR))) || '|' || (17 + length(CAST(k AS VARCHAR)) + length(event_type)) || ':' ||
(21 + length(CAST(k AS VARCHAR)) + length(event_type)) AS after FROM ev""")
def changed_words(spark, sf_dir):
    def said(digit: str, more: str) -> Column:
        return _text("took ", digit, F.col("k"), " ms for (", F.col("event_type"), ")", more)

    lines = _events(spark, sf_dir).select("number", spans.changed_spans(said("1", ""), said("2", " slow")).alias("s"))
    shown = [F.array_join(F.transform(f"s.{c}", lambda r: F.concat_ws(":", r["start"], r["end"])), "|").alias(c) for c in ("before", "after")]
    return lines.select("number", *shown)


@_query("log_field_units", """WITH {EV} SELECT number FROM ev WHERE CASE WHEN number % 2 = 0 THEN k >= 50 ELSE value * 1000 >= 50 END""")
def field_units(spark, sf_dir):
    raw = _one_of(_text("INFO dur=", F.col("k"), "ms"), _text("INFO dur=", F.col("value"), "s"))
    return filters.by_fields(parse(_lines(_events(spark, sf_dir), raw)), field_conditions("dur>=50ms")).select("number")


@_query("log_json_shapes", """WITH {EV} SELECT number, ['INFO', 'WARN', 'ERROR', 'DEBUG', 'WARN', 'WARN'][number % 6 + 1] AS level,
CASE WHEN number % 6 = 2 THEN ms // 1000 * 1000 ELSE ms END AS time FROM ev""")
def json_shapes(spark, sf_dir):
    """Levels as names and numbers, times as text and numbers of each size, and the records of two other makers."""
    iso = _at("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    raw = _one_of(
        _text('{"level":30,"time":', F.unix_millis(_ts()), ',"msg":"a"}'),
        _text('{"severity":"WARNING","timestamp":"', iso, '"}'),
        _text('{"lvl":3,"ts":', F.unix_seconds(_ts()), "}"),
        _text('{"log.level":"debug","@timestamp":"', iso, '"}'),
        _text('{"t":{"$date":"', iso, '"},"s":"W","msg":"a"}'),
        _text('{"short_message":"a","level":4,"timestamp":', F.unix_millis(_ts()) * 1000 + 499, "}"),
    )
    return parse(_lines(_events(spark, sf_dir), raw)).select("number", "level", "time")


@_query("log_error_kinds", """WITH {EV}, e AS (SELECT number, user_id % 4 AS pod, translate(CAST(user_id AS VARCHAR), '0123456789', 'ghijklmnop') AS w
FROM ev WHERE level = 'ERROR'), p AS (SELECT w, pod, count(*) AS n, min(number) AS lo FROM e GROUP BY w, pod)
SELECT 'ERROR kind ' || w AS sample, sum(n)::BIGINT AS count, min(lo) AS first_line, string_agg('app-' || pod || '/c', ' ' ORDER BY lo) AS sources
FROM p GROUP BY w""")
def error_kinds(spark, sf_dir):
    """As many groups of errors as users, each with the pods it was seen in, in the order of their first."""
    letters = F.translate(F.col("user_id").cast("string"), "0123456789", "ghijklmnop")
    raw = _text("[pod/app-", F.col("user_id") % 4, "/c] ", F.col("level"), " kind ", letters)
    groups = agg.error_groups(parse(_lines(_events(spark, sf_dir), raw)))
    return groups.select("sample", "count", "first_line", F.array_join("sources", " ").alias("sources"))


@_query("log_json_changes", """WITH {EV} SELECT number AS id, unnest(['$.k', '$.u.id', '$.u.name', '$.l[0]']) AS path,
unnest(['changed', 'removed', 'added', 'added']) AS kind, unnest([CAST(k AS VARCHAR), CAST(user_id AS VARCHAR), NULL, NULL]) AS before,
unnest([CAST(k + 1 AS VARCHAR), NULL, '"' || event_type || '"', CAST(k AS VARCHAR)]) AS after FROM ev""")
def changed_json(spark, sf_dir):
    events, k = _events(spark, sf_dir), F.col("k").cast("int")
    before = events.select(F.col("number").alias("id"), _text('{"k":', k, ',"u":{"id":', F.col("user_id"), '},"same":1}').alias("json"))
    after = _text('{"same":1,"l":[', k, '],"k":', k + 1, ',"u":{"name":"', F.col("event_type"), '"}}')
    return json_changes(before, events.select(F.col("number").alias("id"), after.alias("json")))


@_query("log_text_tools", """SELECT c_custkey, '{"b":' || c_custkey || ',"a":[1,"' || c_mktsegment || '"]}' AS small,
'UTC:   ' || strftime(make_timestamp((1700000000 + c_custkey) * 1000000), '%Y-%m-%dT%H:%M:%S') || '.000Z' || chr(10) || '(read as seconds)' AS time,
c_mktsegment || '/é?' AS url, lower(c_mktsegment) || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS camel FROM customer""")
def text_tools(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    return c.select(
        "c_custkey",
        tools.tool("json-minify")(_text('{ "b" : ', key, ', "a" : [ 1, "', segment, '" ] }')).alias("small"),
        tools.tool("timestamp")(_text(" ", key + 1_700_000_000, " ")).alias("time"),
        tx.url_decode(tx.url_encode(_text(segment, "/é?"))).alias("url"),
        tx.camel_case(_text(segment, " ", segment)).alias("camel"),
    )


def _kinds_of_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors whose kind is a word made of their user, in three lines each; other events in one."""
    letters = F.translate(F.col("user_id").cast("string"), "0123456789", "ghijklmnop")
    head = _text(F.col("level"), " kind ", letters)
    rows = F.when(F.col("level") == "ERROR", F.array(head, F.lit("\tat a.B.c(D.java)"), F.lit("\tat a.B.d(D.java)"))).otherwise(F.array(head))
    events = _events(spark, sf_dir).select("number", F.posexplode(rows).alias("pos", "raw"))
    return parse(_lines(events, F.col("raw"), number=F.col("number") * 3 + F.col("pos") - 2))


@_query("log_group_lines", """WITH {EV}, e AS (SELECT number, count(*) OVER (PARTITION BY user_id) AS n FROM ev WHERE level = 'ERROR')
SELECT number * 3 - 2 + unnest([0, 1, 2]) AS number FROM e WHERE n >= 2""")
def group_lines(spark, sf_dir):
    """All lines of the entries of errors that happened more than once."""
    lines = _kinds_of_errors(spark, sf_dir)
    return agg.group_lines(lines, agg.error_groups(lines).where("count >= 2")).select("number")


@_query("log_top_groups", """WITH {EV}, g AS (SELECT user_id, count(*) AS count, min(number) * 3 - 2 AS line FROM ev WHERE level = 'ERROR' GROUP BY user_id)
SELECT 'ERROR kind ' || translate(CAST(user_id AS VARCHAR), '0123456789', 'ghijklmnop') AS sample, count, line = (SELECT min(line) FROM g) AS is_earliest
FROM g ORDER BY count DESC, line LIMIT 50""")
def top_groups(spark, sf_dir):
    """The fifty groups of errors that a panel shows, the first error of the log marked if it is among them."""
    return agg.top_groups(agg.error_groups(_kinds_of_errors(spark, sf_dir))).select("sample", "count", "is_earliest")


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _text(_at("yyyy-MM-dd HH:mm:ss.SSS"), " ", F.col("level"), " k=", F.col("k"), F.when(F.col("number") % 3 == 0, " extra=1").otherwise(""))
    return parse(_lines(_events(spark, sf_dir), raw))


@_query("log_folded_sections", """WITH {EV}, d AS (SELECT min(number) AS lo FROM ev GROUP BY CAST(make_timestamp(ms * 1000) AS DATE))
SELECT lo * 2 - 1 AS number FROM d""")
def folded_sections(spark, sf_dir):
    """Each day's events are a section of a build log; of a folded one its first line stays."""
    events = _events(spark, sf_dir).withColumn("day", F.to_date("ts").cast("string"))
    first = events.groupBy("day").agg(F.min("number").alias("lo"))
    own = F.array(F.lit("INFO step"), F.lit(None).cast("string"))
    rows = F.when(F.col("number") == F.col("lo"), F.array(_text("##[group]", F.col("day")), F.lit("INFO step"))).otherwise(own)
    events = events.join(first, "day").select("number", F.posexplode(rows).alias("pos", "raw")).where("raw IS NOT NULL")
    lines = parse(_lines(events, F.col("raw"), number=F.col("number") * 2 + F.col("pos") - 1))
    return filters.fold_sections(lines, agg.sections(lines)).select("number")


@_query("log_jumps_and_ranges", """WITH {EV} SELECT 'next' AS what, coalesce(min(number) FILTER (WHERE number > 50), min(number)) AS n FROM ev WHERE level = 'ERROR'
UNION ALL SELECT 'previous', coalesce(max(number) FILTER (WHERE number < 50), max(number)) FROM ev WHERE level = 'ERROR'
UNION ALL SELECT 'around', coalesce(min(number) FILTER (WHERE number > 999999999), min(number)) FROM ev WHERE level = 'ERROR'
UNION ALL SELECT 'lines', count(*) FROM ev WHERE number BETWEEN 10 AND 60
UNION ALL SELECT 'span', max(ms) - min(ms) FROM ev WHERE number BETWEEN 10 AND 60""")
def jumps_and_ranges(spark, sf_dir):
    lines = _timed(spark, sf_dir)
    error = F.col("level") == "ERROR"
    jumps = (("next", 50, True), ("previous", 50, False), ("around", 999_999_999, True))
    found = [filters.jump(lines, at, error, forward).select(F.lit(name).alias("what"), F.col("number").alias("n")) for name, at, forward in jumps]
    part = agg.range_summary(lines, 10, 60)
    found += [part.select(F.lit("lines"), "lines"), part.select(F.lit("span"), "span_ms")]
    out = found[0]
    for other in found[1:]:
        out = out.union(other)
    return out


@_query("log_status_line", """WITH {EV} SELECT count(*) FILTER (WHERE level = 'ERROR') AS shown, count(*) AS total, count(*) FILTER (WHERE level <> 'ERROR') AS hidden FROM ev""")
def status_line(spark, sf_dir):
    """How many lines a filter shows and hides; lines of context are not counted as shown."""
    lines = _timed(spark, sf_dir)
    return agg.status_counts(filters.with_context(lines, F.col("level") == "ERROR", 2), lines)


@_query("log_common_fields", """WITH {EV} SELECT 'k' AS key, count(*) AS entries FROM ev WHERE number <= 500
UNION ALL SELECT 'extra', count(*) FROM ev WHERE number <= 500 AND number % 3 = 0""")
def common_fields(spark, sf_dir):
    """Field names among a log's first 500 lines, which is what is looked at for suggestions."""
    return agg.common_fields(_timed(spark, sf_dir))


@_query("log_shown_durations", """WITH {EV}, d AS (SELECT number, CAST(k AS BIGINT) * k * k * 10 AS n FROM ev)
SELECT number, '+' || CASE WHEN n < 1000 THEN n || 'ms' WHEN n // 100 < 600 THEN (n // 1000) || '.' || (n // 100 % 10) || 's'
WHEN n // 1000 < 3600 THEN (n // 60000) || 'm' || (n // 1000 % 60) || 's' ELSE (n // 3600000) || '.' || (n // 360000 % 10) || 'h' END AS gap,
regexp_replace(CASE WHEN n < 1000 THEN n || 'ms' WHEN floor(n / 100 + 0.5) / 10 < 60 THEN (floor(n / 100 + 0.5) / 10) || 's'
WHEN floor(n / 6000 + 0.5) / 10 < 60 THEN (floor(n / 6000 + 0.5) / 10) || 'm' ELSE (floor(n / 360000 + 0.5) / 10) || 'h' END, '\\.0([smh])$', '\\1') AS duration FROM d""")
def shown_durations(spark, sf_dir):
    k = F.col("k").cast("long")
    return _events(spark, sf_dir).select("number", times.format_gap(k * k * k * 10).alias("gap"), times.format_duration(k * k * k * 10).alias("duration"))


@_query("log_bookmarks", """WITH {EV}, b AS (SELECT number, 'k is 7' AS note, ms AS time FROM ev WHERE k = 7)
SELECT number, note, time, time - lag(time) OVER (ORDER BY number) AS since_ms FROM b""")
def bookmarks(spark, sf_dir):
    lines = _timed(spark, sf_dir)
    marked = _events(spark, sf_dir).where("k = 7").select("number", F.lit("k is 7").alias("note"))
    return agg.bookmark_rows(lines, marked).select("number", "note", "time", "since_ms")


@_query("log_changed_ranges", """WITH {EV} SELECT number, length(CAST(k AS VARCHAR)) + 2 AS before_start, length(CAST(k AS VARCHAR)) + 2 AS before_end,
length(CAST(k AS VARCHAR)) + 2 AS after_start, length(CAST(k AS VARCHAR)) + 2 + length(event_type) AS after_end FROM ev""")
def changed_ranges(spark, sf_dir):
    before, after = _text("k=", F.col("k"), " end"), _text("k=", F.col("k"), F.upper("event_type"), " end")
    return _events(spark, sf_dir).select("number", spans.changed_range(before, after).alias("r")).select("number", "r.*")


@_query(
    "log_csv_cells",
    "WITH {EV} SELECT number, [chr(39) || '=1+' || k, '\"a,' || k || '\"', '\"a \"\"' || k || '\"\"\"', 'a ' || k][number % 4 + 1] AS cell FROM ev",
)
def csv_cells(spark, sf_dir):
    """Cells that look like formulas are guarded, those with commas and quotes are quoted."""
    k = F.col("k")
    cell = _one_of(_text("=1+", k), _text("a,", k), _text('a "', k, '"'), _text("a ", k))
    return _events(spark, sf_dir).select("number", tx.quote_csv(cell).alias("cell"))
