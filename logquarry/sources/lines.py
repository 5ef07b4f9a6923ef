"""Numbered raw lines: (file_id, file_idx, number, raw), the input of every log operator.

``file_id`` is a file's path or name, ``file_idx`` its place in the order given, ``number`` counts from 1 in each file.
Line ends are \\n, \\r\\n and \\r; a last line break ends the last line.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.functions.levels import detect_level
from logquarry.functions.text import EXTENSIONS, strip_ansi
from logquarry.functions.times import parse_timestamp

SCHEMA = "file_id string, file_idx int, number long, raw string"


def _split(text):
    text = F.regexp_replace(text, r"\r\n?", "\n")
    return F.split(F.regexp_replace(text, r"\n\z", ""), "\n")


def from_text(spark: SparkSession, text: str, name: str = "log") -> DataFrame:
    """A pasted text."""
    return from_texts(spark.createDataFrame([(name, 0, text)], "file_id string, file_idx int, text string"))


def from_texts(texts: DataFrame) -> DataFrame:
    """Rows of whole texts (file_id, file_idx, text) as lines. An empty text has no lines."""
    rows = texts.where(F.length("text") > 0).select("file_id", "file_idx", F.posexplode(_split(F.col("text"))).alias("pos", "raw"))
    return rows.select("file_id", "file_idx", (F.col("pos") + 1).cast("long").alias("number"), "raw")


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of text files of any size, plain or compressed with a known suffix.

    Files are read in splits. Rows of a split are numbered by their place in its task; a file's splits are then lined up
    by what stands before each, a sum over one small row a split. Lines stay where they are as long as Spark finds these
    rows small enough to broadcast; beyond that they are joined by file and split.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file_id"),
        F.col("_metadata.file_block_start").alias("split_at"),
        F.monotonically_increasing_id().alias("row"),
        F.regexp_replace("value", r"\A﻿", "").alias("raw"),
    )
    splits = lines.groupBy("file_id", "split_at").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(_up_to_previous("file_id", "split_at"))
    order = F.dense_rank().over(_all_by("file_id"))
    splits = splits.select(
        "file_id", "split_at", "first", F.coalesce(before, F.lit(0)).alias("before"), (order - 1).alias("file_idx")
    )
    return lines.join(splits, ["file_id", "split_at"]).select(
        "file_id", "file_idx", (F.col("row") - F.col("first") + F.col("before") + 1).alias("number"), "raw"
    )


def _up_to_previous(key: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _all_by(order: str):
    from pyspark.sql import Window

    return Window.orderBy(order)


def read_any(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of files that may be gzip under any name: told by their first bytes. Each file is read whole by one task."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                text = raw.decode("utf-8", "replace").removeprefix("﻿")
                yield pd.DataFrame({"file_id": [path], "file_idx": [0], "text": [text]})

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return from_texts(files.mapInPandas(unpack, "file_id string, file_idx int, text string"))


def looks_like_log(texts: DataFrame, default_year: int = 2026) -> DataFrame:
    """(file_id, is_log): at least 3 of the first 300 lines, and 30 % of them, have a level, a time or a JSON record."""
    head = texts.select("file_id", F.slice(F.split(F.substring("text", 1, 50_000), "\n"), 1, 300).alias("lines"))
    lines = head.select("file_id", F.explode("lines").alias("raw")).withColumn("line", strip_ansi(F.col("raw")))
    line = F.col("line")
    record = F.try_parse_json(line)
    hit = (
        detect_level(line).isNotNull()
        | parse_timestamp(line, default_year).isNotNull()
        | (line.rlike(r"\A\s*\{.*\}\s*\z") & record.isNotNull())
    )
    share = F.avg(F.when(hit, 1).otherwise(0))
    return lines.groupBy("file_id").agg(((F.count("*") >= 3) & (share >= 0.3)).alias("is_log"))


def file_labels(names: list[str]) -> list[str]:
    """A short distinct label for each file name, ending in a log extension."""
    taken: set[str] = set()
    out = []
    for name in names:
        label = re.sub(r"(?i)\.gz\Z", "", name)
        label = re.sub(r"^[.-]+", "", re.sub(r"[^\w.-]+", "_", label, flags=re.ASCII)) or "log"
        if not re.search(rf"(?i)\.(?:{'|'.join(EXTENSIONS)})\Z", label):
            label += ".log"
        stem, _, extension = label.rpartition(".")
        n = 2
        while label.lower() in taken:
            label, n = f"{stem}-{n}.{extension}", n + 1
        taken.add(label.lower())
        out.append(label)
    return out


def appended_text(before: str, after: str) -> tuple[str, int] | None:
    """(new whole lines, length read) of a text that grew; null where it was replaced."""
    if not after.startswith(before):
        return None
    end = after.rfind("\n", len(before)) + 1
    return (after[len(before) : end], end) if end else ("", len(before))
