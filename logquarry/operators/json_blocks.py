"""JSON objects printed over several lines: their lines become one entry, whose first line has the record.

A block starts at a line that opens more brackets than it closes. It goes on over lines that start with white space or a
closing bracket, or are empty, and ends where its brackets are closed; the end of the log leaves it open. A line that goes
on in another way, or one line too many, shows that there was no block, and what was read is ordinary lines.

Where a block would end depends on the lines after its first one alone. So lines from an opener on are dealt into pieces,
each read with as many lines of the next piece as a block may have and one more, and every opener's end is found in one pass: openers
wait in heaps by how many brackets they still have open, one heap for each way in which a line can begin (in or out of a
string), and a line moves whole heaps. Which openers count follows from where the block before ends; a piece tells where
it would be left for each place where it may be entered, and a fold over one small row a piece settles the entries.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions.levels import detect_level
from logquarry.functions.records import js_json, read_record, strict_json
from logquarry.functions.secrets import has_secret
from logquarry.functions.times import parse_timestamp
from logquarry.operators.ordered import CHUNK, carry, running_count
from logquarry.options import ParseOptions
from logquarry.staging import settled

# What a block's later lines look like, a line that may open one, and how many later lines it may have.
BODY = r"\A(?:[\s}\]]|\z)"
OPENER = r"\A\s*\{|\{\s*\z"
MAX_BODY = 5_000
#: Lines of a piece; each is read with MAX_BODY lines of the next, so much shorter ones would be read twice.
PIECE = 50_000
PATCH = "file_id string, number long, in_body boolean, block_json string, block_text string, block_level string, block_time long, block_time_text string, block_level_text string"
GOES_ON = re.compile(r"[\s}\]]|\Z", re.ASCII)
OUT, QUOTED, ESCAPED = 0, 1, 2
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)
_TO_QUOTE = re.compile(r'(?:[^"\\]|\\.)*"', re.DOTALL)
_OPEN_END = re.compile(r'"((?:[^"\\]|\\.)*)(\\?)\Z', re.DOTALL)


def effect(line: str, begins: int) -> tuple[int, int]:
    """(brackets that a line opens less those it closes, how the next line begins), for how the line begins."""
    if begins == ESCAPED:
        if not line:
            return 0, ESCAPED
        line, begins = line[1:], QUOTED
    if "\\" not in line:
        parts = line.split('"')
        outside = "".join(parts[begins::2])
        return _net(outside), (begins + len(parts) - 1) & 1
    if begins == QUOTED:
        end = _TO_QUOTE.match(line)
        if not end:
            return 0, ESCAPED if _OPEN_END.match('"' + line)[2] else QUOTED
        line = line[end.end() :]
    outside = _STRING.sub("", line)
    at = outside.find('"')
    if at < 0:
        return _net(outside), OUT
    return _net(outside[:at]), ESCAPED if _OPEN_END.match(outside, at)[2] else QUOTED


def _net(text: str) -> int:
    return text.count("{") + text.count("[") - text.count("}") - text.count("]")


def opening(text: str) -> tuple[int, int]:
    """(brackets left open, how the next line begins) of a line from its first brace on; 0 where none starts or ends it."""
    bare = text.strip()
    if bare[:1] != "{" and bare[-1:] != "{":
        return 0, OUT
    return effect(text[text.index("{") :], OUT)


class Waiting:
    """Openers whose end is not met yet, by how the next line begins for them: a heap of (brackets open less a shared
    number, place), and that number."""

    def __init__(self):
        self.tracks: dict[int, tuple[list[tuple[int, int]], int]] = {}

    def add(self, place: int, left_open: int, begins: int) -> None:
        heap, shared = self.tracks.setdefault(begins, ([], 0))
        heapq.heappush(heap, (left_open - shared, place))

    def read(self, line: str) -> list[int]:
        """The openers that ``line`` closes."""
        if len(self.tracks) == 1:
            [begins] = self.tracks
            if effect(line, begins) == (0, begins):
                return []
        moved: dict[int, tuple[list[tuple[int, int]], int]] = {}
        closed = []
        for begins, (heap, shared) in self.tracks.items():
            net, now = effect(line, begins)
            shared += net
            if now in moved:
                (heap, shared), (less, other) = sorted([moved[now], (heap, shared)], key=lambda t: -len(t[0]))
                for left_open, place in less:
                    heapq.heappush(heap, (left_open + other - shared, place))
            moved[now] = (heap, shared)
        for heap, shared in moved.values():
            while heap and heap[0][0] + shared <= 0:
                closed.append(heapq.heappop(heap)[1])
        self.tracks = {k: v for k, v in moved.items() if v[0]}
        return closed

    def places(self) -> list[int]:
        return [place for heap, _ in self.tracks.values() for _, place in heap]


def ends(lines: Iterable[tuple[int, str, bool, bool]], own: int, most: int = MAX_BODY) -> dict[int, int]:
    """{place of an opener up to ``own``: place of its block's last line} for (place, text, may open, may go on).

    An opener still open where the lines end, at most ``most`` lines on, gets the negative of the last place.
    """
    waiting, out, place = Waiting(), {}, 0
    for place, text, may_open, goes_on in lines:
        if not goes_on:
            waiting = Waiting()
        elif waiting.tracks:
            for i in waiting.read(text):
                if place - i <= most:
                    out[i] = place
        if may_open and place <= own:
            left_open, begins = opening(text)
            if left_open > 0:
                waiting.add(place, left_open, begins)
        elif place > own and not waiting.tracks:
            break
    out.update((i, -place) for i in waiting.places() if place - i <= most)
    return out


def left_at(found: dict[int, int], last: int) -> tuple[list[int], list[int]]:
    """Openers with a block in ascending order, and for each the place after ``last`` that follows if it is the next."""
    heads = sorted(found)
    exits = [0] * len(heads)
    for k in range(len(heads) - 1, -1, -1):
        after = abs(found[heads[k]]) + 1
        n = bisect_left(heads, after)
        exits[k] = exits[n] if n < len(heads) else max(after, last + 1)
    return heads, exits


def chosen(heads: list[int], found: list[int], entry: int) -> list[tuple[int, int]]:
    """The blocks that count, where reading comes to a piece at ``entry``."""
    out, k = [], bisect_left(heads, entry)
    while k < len(heads):
        out.append((heads[k], found[k]))
        k = bisect_left(heads, abs(found[k]) + 1)
    return out


def patches(lines: list[tuple[int, str]], custom: dict[str, str]) -> list[tuple]:
    """(number, in_body, ...) of a closed block's lines."""
    first = lines[0][1]
    whole = first.strip().startswith("{")
    text = "\n".join(t for _, t in lines)[0 if whole else first.index("{") :]
    head = (None,) * 6
    if whole:
        json, line, level, ms, time_text, level_text = read_record(text, custom)
        head = (json, line, level, ms, time_text, level_text)
    else:
        try:
            value = strict_json(text)
        except (ValueError, RecursionError):
            value = None
        head = (js_json(value) if isinstance(value, dict) else None, *head[1:])
    return [(lines[0][0], False, *head), *[(n, True, *(None,) * 6) for n, _ in lines[1:]]]


def starts_run(text: Column) -> Column:
    return ~text.rlike(BODY)


def _run_events() -> dict[str, tuple[Column, bool]]:
    """What is carried along to find the lines of blocks: the last line that ends all blocks, and the last opener."""
    run = F.when(~F.col("goes_on"), F.col("number"))
    opener = F.when(F.col("is_opener"), F.col("number"))
    return {"run": (run, True), "opener": (opener, True), "run_before": (run, False), "opener_before": (opener, False)}


def _block_lines(df: DataFrame) -> DataFrame:
    """Lines from an opener to where no block can go on, that line included, numbered in each file."""
    inside = F.col("opener") >= F.coalesce("run", F.lit(0))
    ends_here = ~F.col("goes_on") & (F.col("opener_before") >= F.coalesce("run_before", F.lit(0)))
    chunk = [CHUNK] if CHUNK in df.columns else []
    df = df.select("file_id", *chunk, "number", "plain", "is_opener", "in_key", (~starts_run(F.col("plain"))).alias("goes_on"))
    rows = carry(df, _run_events()).where(inside | ends_here).select(
        "file_id", *chunk, "number", "plain", (F.col("is_opener") & ~F.col("in_key")).alias("may_open"), "goes_on",
    )
    return settled(running_count(rows, "at", F.lit(True)).withColumn("at", F.col("at").cast("long")), "block-lines")


def _blocks(rows: DataFrame, piece: int, most: int) -> DataFrame:
    """(file_id, head_at, end_at): the blocks that count; end_at is negative where the log ends first."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (file_id, number), lines in _keyed(batches, 2):
            last = (number + 1) * piece
            found = ends(lines, last, most)
            heads, exits = left_at(found, last)
            yield pd.DataFrame([(file_id, number, heads, [found[h] for h in heads], exits)], columns=["file_id", "piece", "heads", "ends", "exits"])

    def enter(pdf: pd.DataFrame) -> pd.DataFrame:
        out, entry = [], 1
        for file_id, number, heads, exits in pdf.sort_values("piece").itertuples(index=False):
            out.append((file_id, number, entry))
            k = bisect_left(list(heads), entry)
            entry = max(entry, int(exits[k])) if k < len(heads) else entry
        return pd.DataFrame(out, columns=["file_id", "piece", "entry"])

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [
                (file_id, head, end)
                for file_id, heads, own, entry in zip(pdf["file_id"], pdf["heads"], pdf["ends"], pdf["entry"])
                for head, end in chosen(list(heads), list(own), entry)
            ]
            yield pd.DataFrame(out, columns=["file_id", "head_at", "end_at"]).astype({"head_at": "int64", "end_at": "int64"})

    own = F.floor((F.col("at") - 1) / piece)
    ahead = F.when((own > 0) & ((F.col("at") - 1) % piece <= most), F.array(own, own - 1)).otherwise(F.array(own))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("piece", F.explode(ahead)).repartition(n, "file_id", "piece").sortWithinPartitions("file_id", "piece", "at")
    names = ["file_id", "piece", "at", "plain", "may_open", "goes_on"]
    pieces = dealt.select(*names).mapInPandas(find, "file_id string, piece long, heads array<long>, ends array<long>, exits array<long>")
    pieces = settled(pieces, "block-pieces")
    may_enter = F.filter("heads", lambda h: h <= F.col("piece") * piece + most + 1)
    few = F.least(F.size(may_enter) + 1, F.size("heads"))
    small = pieces.select("file_id", "piece", F.slice("heads", 1, few).alias("heads"), F.slice("exits", 1, few).alias("exits"))
    entries = small.groupBy("file_id").applyInPandas(enter, "file_id string, piece long, entry long")
    entered = pieces.join(entries, ["file_id", "piece"]).select("file_id", "heads", "ends", "entry")
    return entered.mapInPandas(choose, "file_id string, head_at long, end_at long")


def _keyed(batches: Iterator[pd.DataFrame], width: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows that stand together by their first ``width`` columns, in a sorted stream."""
    rows = chain.from_iterable(zip(*[pdf[c].tolist() for c in pdf.columns]) for pdf in batches)
    for key, run in groupby(rows, itemgetter(slice(width))):
        yield key, map(itemgetter(slice(width, None)), run)


def _patched(rows: DataFrame, blocks: DataFrame, custom: dict[str, str]) -> DataFrame:
    """What the lines of blocks are, a row each."""
    heads = blocks.select("file_id", F.col("head_at").alias("at"), F.struct("head_at", "end_at").alias("starts"))
    # A row a line and a row a block, which Spark would take for as small as the compressed files they were read from.
    rows = carry(rows.join(heads.hint("merge"), ["file_id", "at"], "left"), {"block": (F.col("starts"), True)}, order="at")
    rows = rows.where(F.col("at") <= F.abs(F.col("block.end_at")))
    lower = {k.lower(): v for k, v in custom.items()}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for (file_id, _, closed), lines in _keyed(batches, 3):
            own = list(lines)
            found = patches(own, lower) if closed else [(n, i > 0, *(None,) * 6) for i, (n, _) in enumerate(own)]
            out += [(file_id, *patch) for patch in found]
            if len(out) >= 10_000:
                yield _table(out)
                out = []
        yield _table(out)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("file_id", F.col("block.head_at").alias("head_at"), (F.col("block.end_at") > 0).alias("closed"), "number", "plain")
    return rows.repartition(n, "file_id", "head_at").sortWithinPartitions("file_id", "head_at", "number").mapInPandas(read, PATCH)


def _table(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in PATCH.split(", ")])
    return out.astype({"block_time": "Int64"})


def with_json_blocks(df: DataFrame, options: ParseOptions, custom: dict[str, str], piece: int = PIECE, most: int = MAX_BODY) -> DataFrame:
    """Classified lines, with in_key, in which the lines of JSON blocks are one entry."""
    rows = _block_lines(df)
    found = _patched(rows, _blocks(rows, piece, most), custom)
    return patched(df.join(found.hint("merge"), ["file_id", "number"], "left"), options, custom)


def patched(df: DataFrame, options: ParseOptions, custom: dict[str, str]) -> DataFrame:
    """Classified lines with the columns of ``PATCH``, null outside blocks, which are put to use and dropped."""
    body, shown = F.coalesce("in_body", F.lit(False)), F.col("block_text")
    is_record = shown.isNotNull()
    level = F.coalesce("block_level", detect_level(F.col("block_level_text"), custom), "own_level")
    time = F.coalesce("block_time", parse_timestamp(F.col("block_time_text"), options.default_year), "full_time")
    told_anew = is_record | (body & F.col("is_json"))
    text = F.when(body, F.col("plain")).otherwise(F.coalesce(shown, "text"))
    return df.withColumns(
        {
            "continues": F.col("continues") | body,
            "json": F.when(~body, F.coalesce("block_json", "json")),
            "text": text,
            "own_level": F.when(is_record, level).otherwise(F.col("own_level")),
            "full_time": F.when(is_record, time).otherwise(F.col("full_time")),
            "source": F.when(~body, F.col("source")),
            "secret": F.when(told_anew, has_secret(text, options.secret_patterns)).otherwise(F.col("secret")),
        }
    ).drop(*[c.split()[0] for c in PATCH.split(", ")[2:]])
