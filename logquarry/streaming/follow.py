"""Following logs that grow: a stateful parse of a stream of raw lines, with the same rows as the batch parse.

Lines come as (file_id, number, raw), in order within a file: across batches by arrival, inside one by number; or as
(file_id, at, raw), with places that only rise, and are numbered here. A place or number that starts anew (``at`` 0,
number 1) is a file that was replaced, and its state starts anew.

What one line tells is computed by the same Column expressions as in batch. Two states follow: the first numbers lines and
holds back those of a JSON block until it is closed or given up, so a block may be cut at any batch border; the second is
what is carried along, a few values a file. Lines of a block that is still open come out when the next lines decide.
The first state needs RocksDB's state store, which ``parse_stream`` sets for the session where none is chosen.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from logquarry.functions.levels import usable_levels
from logquarry.functions.times import DAY_MS
from logquarry.operators import json_blocks as jb
from logquarry.operators import parse as batch
from logquarry.options import ParseOptions

OUTPUT = (
    "file_id string, number long, text string, level string, continuation boolean, time long, gap long, json string, "
    "secret boolean, secret_block boolean, source string, entry_id long, entry_time long"
)
_TOLD = (
    "plain string, text string, source string, is_json boolean, json string, key_marker boolean, continues boolean, "
    "is_opener boolean, own_level string, full_time long, clock long, role string, secret boolean"
)
_BLOCKED = f"file_id string, seq long, number long, {_TOLD}, {jb.PATCH.split(', ', 2)[2]}"
_PLACE = "seq long, number long, in_key boolean, left_open long, begins int"
STATE = "in_key boolean, level string, last_time long, last_clock long, days long, entry_id long"


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Blocks(StatefulProcessor):
    """Numbers the lines of a file and tells which are lines of JSON blocks; those of the open one wait in a list."""

    def __init__(self, custom: dict[str, str], counted: bool, joined: bool):
        self.custom, self.counted, self.joined = custom, counted, joined
        self.names = [c.split()[0] for c in _TOLD.split(", ")]
        self.columns = [c.split()[0] for c in _BLOCKED.split(", ")]
        self.nothing = (None,) * (len(self.columns) - 3 - len(self.names))
        # A worker has no session to read types by.
        self.place_type = StructType.fromDDL(_PLACE)
        self.line_type = StructType.fromDDL(f"number long, {_TOLD}")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", self.place_type)
        self.waiting = handle.getListState("waiting", self.line_type)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seq, number, in_key, left_open, begins = self.place.get() if self.place.exists() else (0, 0, False, 0, 0)
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        had = bool(held)
        out: list[tuple] = []
        again: deque[tuple] = deque()

        def give(lines: list[tuple], found: list[tuple]) -> None:
            nonlocal seq
            for line, patch in zip(lines, found):
                seq += 1
                out.append((key[0], seq, *line, *patch))

        def give_up() -> None:
            nonlocal held
            give(held[:1], [self.nothing])
            again.extendleft(reversed(held[1:]))
            held = []

        lines = pd.concat(list(rows)).sort_values("number")[["number", *self.names]]
        lines = lines.astype({"full_time": "Int64", "clock": "Int64"})
        for line in lines.astype(object).where(lines.notna(), None).itertuples(index=False, name=None):
            if line[0] == (0 if self.counted else 1):
                give(held, [(i > 0, *self.nothing[1:]) for i in range(len(held))])
                held, number, in_key = [], 0, False
            number = number + 1 if self.counted else int(line[0])
            again.append((number, *line[1:]))
            while again:
                line = again.popleft()
                told = dict(zip(self.names, line[1:]))
                if held:
                    if not jb.GOES_ON.match(told["plain"]) or len(held) > jb.MAX_BODY:
                        again.appendleft(line)
                        give_up()
                        continue
                    held.append(line)
                    net, begins = jb.effect(told["plain"], begins)
                    left_open += net
                    if left_open <= 0:
                        give(held, [p[1:] for p in jb.patches([(h[0], h[1]) for h in held], self.custom)])
                        held = []
                    continue
                if self.joined and told["is_opener"] and not in_key:
                    left_open, begins = jb.opening(told["plain"])
                    if left_open > 0:
                        held = [line]
                        continue
                if told["key_marker"] is not None:
                    in_key = bool(told["key_marker"])
                give([line], [self.nothing])
        self.place.update((seq, number, in_key, left_open, begins))
        if held:
            self.waiting.put(held)
        elif had:
            self.waiting.clear()
        made = pd.DataFrame(out, columns=self.columns)
        yield made.astype({c: "Int64" for c in ("full_time", "clock", "block_time")})

    def close(self) -> None:
        pass


def parse_stream(lines: DataFrame, options: ParseOptions = ParseOptions()) -> DataFrame:
    """The line table of a stream of raw lines, in append mode."""
    if not lines.sparkSession.conf.get(_PROVIDER, "").endswith("RocksDBStateStoreProvider"):
        lines.sparkSession.conf.set(_PROVIDER, _ROCKSDB)
    counted = "at" in lines.columns
    custom = usable_levels(options.custom_levels)
    lines = lines.withColumn("number", F.col("at")) if counted else lines
    told = batch._classified(lines.withColumn("file_idx", F.lit(0)), options)
    blocks = Blocks({k.lower(): v for k, v in custom.items()}, counted, options.json_blocks)
    told = told.select("file_id", "number", *blocks.names)
    told = told.groupBy("file_id").transformWithStateInPandas(
        blocks, outputStructType=StructType.fromDDL(_BLOCKED), outputMode="Append", timeMode="None"
    )
    told = jb.patched(told, options, custom)

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        in_key, level, last_time, last_clock, days, entry_id = (
            state.get if state.exists else (False, None, None, None, options.base_day, 0)
        )
        rows = []
        for r in pd.concat(list(frames)).sort_values("seq").itertuples():
            if r.number == 1:
                in_key, level, last_time, last_clock, days, entry_id = False, None, None, None, options.base_day, 0
            marker = None if pd.isna(r.key_marker) else bool(r.key_marker)
            inside, body = in_key, in_key and marker is not False
            in_key = in_key if marker is None else marker
            continuation = inside or bool(r.continues)
            time = gap = None
            if not continuation:
                own = None if pd.isna(r.own_level) else r.own_level
                if not pd.isna(r.full_time):
                    time = int(r.full_time)
                elif not pd.isna(r.clock):
                    clock = int(r.clock)
                    days += last_clock is not None and last_clock - clock > DAY_MS // 2
                    last_clock, time = clock, days * DAY_MS + clock
                if own is not None or time is not None or r.role == "step":
                    level = own
                elif r.role == "exception" and level is None:
                    level = "ERROR"
                entry_id = int(r.number)
            if time is not None:
                gap, last_time = (None if last_time is None else time - last_time), time
            rows.append(
                (
                    key[0], r.number, r.plain if inside else r.text, level, continuation, time, gap,
                    None if inside else r.json, body or (not inside and bool(r.secret)), body,
                    None if inside else r.source, entry_id, last_time,
                )
            )
        state.update((in_key, level, last_time, last_clock, days, entry_id))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")])
        yield out.astype({c: "Int64" for c in ("time", "gap", "entry_time")})

    return told.groupBy("file_id").applyInPandasWithState(fold, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def level_windows(parsed: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Lines per level and time window of a parsed stream; lines later than ``late`` are left out."""
    timed = parsed.where("time IS NOT NULL").withColumn("ts", F.timestamp_millis("time")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "level").agg(F.count("*").alias("lines"))
