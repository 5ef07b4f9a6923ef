"""Token ids in length-delimited binary record files with an offset index.

A record file is a run of frames, each followed by a line feed. A frame is: length of the payload (unsigned 64 bit,
little-endian), masked CRC-32 of those eight bytes, the payload, masked CRC-32 of the payload; a mask is the CRC rotated
right by 15 bits plus 0xa282ead8. A payload is one serialized sequence: flags (1 byte: 1 = null doc_id, 2 = 32-bit ids,
4 = ids packed by zstandard), doc_id (signed 64 bit), number of ids (unsigned 32 bit), ids.

Files stand under PATH/records in ascending doc_id order; PATH/index is a table (file_no, record_no, doc_id, offset,
length, n_ids, ids_crc32) of every frame, by which frames can be read in any order. It is made by reading the files back,
every checksum checked, so what it says of the ids is what the files hold. Both are written and read by Spark's own writers
and readers, so any file system that Spark knows will do, and a task that is run again or twice leaves one whole file.
Files are cut by bytes of text, not by the number of tasks a session has.

Defined cases: a null text counts as empty, a null doc_id comes first, rows with one doc_id are ordered by their text's
hash; a very long text is one record; an empty table gives no records; further columns play no part.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logquarry.llm.bpe import encoder
from logquarry.llm.common import new_path, table

_HEAD = "<BqI"
_HEAD_BYTES = struct.calcsize(_HEAD)
INDEX = "file_no int, record_no long, doc_id long, offset long, length long, n_ids long, ids_crc32 long"
#: Bytes of text whose ids one file holds, at most and, where there is less to do than tasks, at least.
FILE_BYTES = 128 << 20
SMALL_FILE_BYTES = 1 << 20


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join([length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))])


def unframe(read: Callable[[int], bytes]) -> bytes:
    """The next payload; ``read`` gives a number of bytes."""
    length = read(8)
    if masked_crc(length) != struct.unpack("<I", read(4))[0]:
        raise ValueError("a record's length is damaged")
    payload = read(struct.unpack("<Q", length)[0])
    if masked_crc(payload) != struct.unpack("<I", read(4))[0]:
        raise ValueError("a record is damaged")
    return payload


@functools.cache
def _zstandard():
    """A compressor and a decompressor for each Python worker."""
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(doc_id: int | None, ids: bytes, item: int) -> bytes:
    small = _zstandard()[0].compress(ids)
    flags = (doc_id is None) | 2 * (item == 4) | 4 * (len(small) < len(ids))
    return struct.pack(_HEAD, flags, doc_id or 0, len(ids) // item) + (small if flags & 4 else ids)


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id, n = struct.unpack_from(_HEAD, payload)
    raw, dtype = payload[_HEAD_BYTES:], "<u4" if flags & 2 else "<u2"
    if flags & 4:
        raw = _zstandard()[1].decompress(raw, max_output_size=n * (4 if flags & 2 else 2))
    return None if flags & 1 else doc_id, np.frombuffer(raw, dtype, n)


def _by_id(docs: DataFrame) -> DataFrame:
    """(doc_id, no_id, text) dealt over one partition a file and sorted in it, ascending by doc_id over all."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), text.alias("text")
    ).withColumn("first", ~F.col("no_id"))
    order = ["first", "doc_id", F.xxhash64("text")]
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = max(1, -(-size // FILE_BYTES), min(tasks, size // SMALL_FILE_BYTES))
    return rows.repartitionByRange(files, *order).sortWithinPartitions(*order).drop("first")


def write_records(docs: DataFrame, vocabulary_file: str, end_id: int, path: str) -> None:
    """Write every text's ids and ``end_id`` as records under ``path``, in doc_id order, and their index."""

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary_file)
        item, end = enc.dtype.itemsize, np.array([end_id], enc.dtype).tobytes()
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo : lo + 256]
                coded = zip(part["doc_id"], part["no_id"], enc.encode(part["text"]))
                made = [frame(pack(None if missing else int(i), ids + end, item)) for i, missing, ids in coded]
                yield pd.DataFrame({"frame": made})

    # A string column of the text writer is written byte by byte as it is.
    lines = _by_id(docs).mapInPandas(frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
    lines.write.option("lineSep", "\n").text(f"{path}/records")

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for no, content in zip(pdf["file_no"], pdf["content"]):
                rows = []
                for i, (at, length, doc_id, ids) in enumerate(records(content)):
                    rows.append((no, i, doc_id, at, length, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])
                yield out.astype({"doc_id": "Int64"})

    _contents(docs.sparkSession, path).mapInPandas(index, INDEX).write.parquet(f"{path}/index")


def _contents(spark: SparkSession, path: str) -> DataFrame:
    """(file_no, content) of the record files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records")
    return files.select(F.regexp_extract("path", r"part-(\d+)[^/]*\z", 1).cast("int").alias("file_no"), "content")


def records(content: bytes) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(offset, length of the payload, doc_id, ids) of a file's records in order, every checksum checked."""
    at = 0

    def read(n: int) -> bytes:
        nonlocal at
        at += n
        return content[at - n : at]

    while at < len(content):
        start, payload = at, unframe(read)
        yield start, len(payload), *unpack(payload)
        if read(1) != b"\n":
            raise ValueError("a record's end is damaged")


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for every record under ``path``, as they were read back for the index."""
    index = spark.read.parquet(f"{path}/index")
    # One row a file: what the files before it hold.
    sizes = index.groupBy("file_no").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("file_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("held"))
    own = Window.partitionBy("file_no").orderBy("record_no").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("n_ids").over(own), F.lit(0))
    rows = index.withColumn("inside", inside).join(sizes, "file_no")
    return rows.select("doc_id", (F.col("held") + F.col("inside")).alias("start"), F.col("n_ids").alias("n_tokens"), "ids_crc32")


def read_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(file_no, offset, doc_id, ids) of the frames ``wanted`` (file_no, offset), in any order: a read by the index."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for no, content, offsets in zip(pdf["file_no"], pdf["content"], pdf["offsets"]):
                rows = []
                for offset in offsets:
                    at = int(offset)

                    def take(n: int) -> bytes:
                        nonlocal at
                        at += n
                        return content[at - n : at]

                    doc_id, ids = unpack(unframe(take))
                    rows.append((no, offset, doc_id, ids.astype("<u4").tobytes()))
                yield pd.DataFrame(rows, columns=["file_no", "offset", "doc_id", "ids"]).astype({"doc_id": "Int64"})

    asked = wanted.groupBy("file_no").agg(F.collect_list("offset").alias("offsets"))
    return _contents(spark, path).join(asked, "file_no").mapInPandas(read, "file_no int, offset long, doc_id long, ids binary")


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "records")
    write_records(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0, path)
    return read_back(spark, path)
