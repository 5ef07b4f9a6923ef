"""Files that grow, as a streaming source of lines: ``spark.readStream.format("log_tail")``.

Options: ``path``, files and folders separated by commas; ``splitBytes``, what one task reads at most (64 MB). Rows are
(file_id, at, raw): the file, the byte at which the line starts, the line. A micro-batch has what was added since the last
one up to the last line break; an unfinished line waits for its end. A file that was replaced is read from byte 0 again:
its first line, or what stands before the point read so far, is another than it was. A file that is gone, or shorter and
the same, waits. Driver and executors must both reach the files.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file_id string, at long, raw string"
#: Bytes of the first line, and before the point read so far, by which a file is known again.
KNOWN_BYTES = 1_024
_BLOCK = 1 << 16
_LINE_END = re.compile(r"\r\n?|\n")


class Part(NamedTuple):
    path: str
    start: int
    stop: int
    is_first: bool


class Range(InputPartition):
    def __init__(self, part: Part):
        self.part = part


def _opened(path: str):
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _read(file, start: int, size: int) -> bytes:
    file.seek(start)
    return file.read(size)


def _mark(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


def _last_break(file, size: int) -> int:
    """The byte after the last line break; 0 if there is none."""
    stop = size
    while stop:
        start = max(0, stop - _BLOCK)
        at = _read(file, start, stop - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        stop = start
    return 0


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.paths = [p.strip() for p in options["path"].split(",") if p.strip()]
        self.split = int(options.get("splitbytes", options.get("splitBytes", 64 << 20)))

    def _files(self) -> list[str]:
        out = set()
        for path in self.paths:
            system, inner = fs.FileSystem.from_uri(path)
            scheme = path[: path.index(":") + 1] + "//" if "://" in path else "file://"
            info = system.get_file_info(inner)
            if info.type == fs.FileType.Directory:
                found = system.get_file_info(fs.FileSelector(inner))
                out |= {scheme + f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))}
            elif info.type == fs.FileType.File:
                out.add(scheme + info.path)
        return sorted(out)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """For each file what is read once the batch is done, and by what it is known again."""
        out = {}
        for path in self._files():
            with _opened(path) as file:
                end = _last_break(file, file.size())
                first = _read(file, 0, min(end, KNOWN_BYTES)).split(b"\n")[0]
                before = max(0, end - KNOWN_BYTES)
                out[path] = {"end": end, "first": _mark(first), "before": _mark(_read(file, before, end - before))}
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, now in sorted(end.items()):
            at = self._from(path, start.get(path), now)
            for a in range(at, now["end"], self.split):
                out.append(Range(Part(path, a, min(a + self.split, now["end"]), a == at)))
        return out

    def _from(self, path: str, was: dict | None, now: dict) -> int:
        """Where to go on in a file: after what was read, or at 0 if it was replaced."""
        if not was or not was["end"]:
            return 0
        if was["first"] != now["first"]:
            return 0
        if now["end"] < was["end"]:
            return 0 if now["before"] != was["before"] and now["end"] else now["end"]
        before = max(0, was["end"] - KNOWN_BYTES)
        with _opened(path) as file:
            same = _mark(_read(file, before, was["end"] - before)) == was["before"]
        return was["end"] if same else 0

    def read(self, partition: Range) -> Iterator[tuple]:
        """The lines that start in the range, to the end of the last one."""
        path, start, stop, is_first = partition.part
        with _opened(path) as file:
            at = start if is_first else start - 1
            held = b""
            skip = not is_first
            size = file.size()
            while at < size:
                block = _read(file, at + len(held), _BLOCK)
                if not block:
                    return
                held += block
                lines = held.split(b"\n")
                held = lines.pop()
                for line in lines:
                    if not skip:
                        yield from self._lines(path, at, line)
                    skip = False
                    at += len(line) + 1
                    if at >= stop:
                        return

    def _lines(self, path: str, at: int, line: bytes) -> Iterator[tuple]:
        text = line.removesuffix(b"\r").decode("utf-8", "replace")
        text = text.removeprefix("\ufeff") if at == 0 else text
        place = at
        for i, part in enumerate(_LINE_END.split(text)):
            yield (path, place + i, part)  # a lone carriage return takes a byte of its own


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


def tail(spark: SparkSession, path: str, split_bytes: int = 64 << 20):
    """The lines of growing files as a streaming DataFrame."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("log_tail").option("path", path).option("splitBytes", split_bytes).load()
