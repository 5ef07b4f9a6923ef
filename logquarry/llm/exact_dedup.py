"""Exact dedup by a Golomb-coded fingerprint exchange.

Each block of rows sends the sorted, Golomb-Rice coded fingerprints of its texts to their owners, an owner answers with
a bitmap of those that other blocks hold as well, and only the texts so suspected are shuffled and compared byte by byte.

Defined cases: a null text counts as empty; rows with equal doc_id and equal text are one group of which one row stays;
a null doc_id sorts after every other; an empty table gives an empty result; further columns are carried by ``dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm.common import free_name, salted_left_join, staged, table

SPACES = r"[ \t\n\x0B\f\r]+"
#: Fingerprints an owner gets, about.
OWNER_ROWS = 1 << 16
#: Bits of a fingerprint beyond log2(rows): one text in 2^SLACK is suspected in vain.
SLACK = 14


def rice_encode(values: np.ndarray) -> bytes:
    """Sorted distinct unsigned integers as Golomb-Rice coded gaps: a header, the unary quotients, the remainders."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    k = max(0, int(np.log2(max(1.0, float(gaps.mean()) * 0.69)))) if len(gaps) else 0
    q = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(q + 1)
    unary = np.ones(int(ends[-1]) if len(ends) else 0, np.uint8)
    unary[ends - 1] = 0
    low = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    head = np.array([len(values), k, len(unary)], "<i8").tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(low).tobytes()


def rice_decode(blob: bytes) -> np.ndarray:
    n, k, bits = (int(x) for x in np.frombuffer(blob, "<i8", 3))
    at = 24 + (bits + 7) // 8
    unary = np.unpackbits(np.frombuffer(blob, np.uint8, at - 24, 24), count=bits)
    q = np.diff(np.flatnonzero(unary == 0), prepend=-1) - 1
    low = np.unpackbits(np.frombuffer(blob, np.uint8, -1, at), count=n * k).reshape(n, k).astype(np.uint64)
    gaps = (q.astype(np.uint64) << np.uint64(k)) + (low << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def _send(bits: int, owners: int):
    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[np.ndarray]] = {}
        for pdf in batches:
            for block, rows in pdf.groupby("block")["fp"]:
                held.setdefault(block, []).append(rows.to_numpy(np.uint64))
        for block, parts in held.items():
            own = np.unique(np.concatenate(parts))
            at = np.searchsorted(own, _bounds(bits, owners))
            rows = [(i, block, rice_encode(own[a:b])) for i, (a, b) in enumerate(zip(at[:-1], at[1:])) if b > a]
            yield pd.DataFrame(rows, columns=["owner", "block", "blob"])

    return send


def _bounds(bits: int, owners: int) -> np.ndarray:
    return np.array([(1 << bits) * i // owners for i in range(owners)] + [1 << bits], np.uint64)


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bit for each fingerprint of a blob: whether another block sent it too."""
    sent = [rice_decode(x) for x in pdf["blob"]]
    values, counts = np.unique(np.concatenate(sent), return_counts=True)
    twice = values[counts > 1]
    shared = [np.isin(x, twice, assume_unique=True) for x in sent]
    return pd.DataFrame({"owner": pdf["owner"], "block": pdf["block"], "bitmap": [np.packbits(x).tobytes() for x in shared]})


def _mark(bits: int, owners: int):
    def mark(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        fp = rows["fp"].to_numpy(np.uint64)
        own, where, counts = np.unique(fp, return_inverse=True, return_counts=True)
        suspect = counts > 1
        at = np.searchsorted(own, _bounds(bits, owners))
        for owner, bitmap in zip(answers["owner"], answers["bitmap"]):
            a, b = at[owner], at[owner + 1]
            suspect[a:b] |= np.unpackbits(np.frombuffer(bitmap, np.uint8), count=b - a).astype(bool)
        return rows[["rid", "doc_id", "sha"]].assign(suspect=suspect[where])

    return mark


def groups(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, keep_id, group_size, kept, sha) for every row of ``docs`` (doc_id, text)."""
    norm = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACES, " ")
    docs = docs.select("doc_id", norm.alias("norm"))
    sha = F.sha2("norm", 256)
    rows = staged(
        docs.select(
            F.monotonically_increasing_id().alias("rid"), F.spark_partition_id().alias("block"), "doc_id", sha.alias("sha")
        ),
        "prints",
    )
    n = rows.count()
    owners = max(1, -(-n // OWNER_ROWS))
    bits = min(60, max(16, n.bit_length() + SLACK))
    fp = F.conv(F.substring("sha", 1, 15), 16, 10).cast("long")
    prints = rows.withColumn("fp", F.shiftright(fp, 60 - bits))
    blobs = prints.select("block", "fp").mapInPandas(_send(bits, owners), "owner int, block int, blob binary")
    answers = blobs.groupBy("owner").applyInPandas(_answer, "owner int, block int, bitmap binary")
    marked = staged(
        prints.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInPandas(_mark(bits, owners), "rid long, doc_id long, sha string, suspect boolean"),
        "marked",
    )
    suspects = marked.where("suspect")
    # The bytes of suspected texts are the grouping key; copies are merged before the shuffle.
    wanted = suspects.select(F.col("doc_id").alias("suspect_id")).distinct()
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(F.col("suspect_id")), "left_semi")
    classes = texts.groupBy("norm").agg(F.count("*").alias("n")).where("n > 1").select(sha.alias("sha"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid"))
    sizes = suspects.groupBy("sha").agg(F.count("*").alias("group_size"), first.alias("first"))
    sizes = sizes.join(classes, "sha", "left_semi")
    found = salted_left_join(suspects, sizes, "sha", F.col("rid")).select(
        "rid",
        "doc_id",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.coalesce(F.col("first.rid") == F.col("rid"), F.lit(True)).alias("kept"),
        "sha",
    )
    alone = marked.where("not suspect").select(
        "rid", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    return alone.unionByName(found)


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are named by id and text. Of rows equal in both one stays, if their text's first row is among them.
    """
    name = free_name(docs, "row_name")
    norm = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACES, " ")

    def named(sha):
        return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), sha).alias(name)

    verdicts = groups(docs).select(named(F.col("sha")), "kept").groupBy(name).agg(
        F.max("kept").alias("kept"), F.count("*").alias("n")
    )
    verdicts = staged(verdicts.where("not kept or n > 1"), "verdicts")
    docs = docs.withColumn(name, named(F.sha2(norm, 256)))
    left = docs.join(verdicts.where("not kept").select(name), name, "left_anti")
    twice = verdicts.where("kept").select(name)
    if not twice.isEmpty():
        left = left.join(twice, name, "left_anti").unionByName(left.join(twice, name, "left_semi").dropDuplicates([name]))
    return left.drop(name)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")
    )


OP7_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
