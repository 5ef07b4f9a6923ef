"""Best-fit packing of token sequences by patterns, after non-negative least squares on the length histogram.

The pieces' lengths make a histogram of at most ``size`` bins, which alone reaches the driver. Every pattern of one, two
or three lengths that fills a sequence exactly is a column of a non-negative least-squares fit to the histogram; the
fitted repeat counts are rounded, and what they leave is packed by best fit, longest first. The plan is a list of
(length, ordinals, sequence, offset) whose size depends on ``size`` alone; pieces get ordinals within their length and
look their place up.

Defined cases: a null text counts as empty; rows with one doc_id are packed each for itself; an empty table gives an
empty result; further columns play no part.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logquarry.llm.bpe import encoder
from logquarry.llm.common import staged, table

SIZE = 1024
#: Pieces of one length that one window task numbers, about.
RUN_ROWS = 5_000
#: Patterns that are fitted again, so that fewer repeats are lost to rounding.
REFITTED = 8_192


def patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """All multisets of up to three of ``lengths`` with the sum ``size``; a row each, filled up with zeros."""
    have = np.zeros(size + 1, bool)
    have[lengths] = True
    a = np.flatnonzero(have[: size + 1])
    a = a[a > 0]
    one = np.array([[size, 0, 0]]) if have[size] else np.zeros((0, 3), int)
    two = a[(a * 2 <= size) & (a < size)]
    two = two[have[size - two]]
    pairs = np.stack([size - two, two, two * 0], axis=1)
    x, y = np.meshgrid(a, a, indexing="ij")
    z = size - x - y
    ok = (x >= y) & (y >= z) & (z > 0)
    x, y, z = x[ok], y[ok], z[ok]
    ok = have[z]
    return np.concatenate([one, pairs, np.stack([x[ok], y[ok], z[ok]], axis=1)])


def fit(columns: np.ndarray, histogram: np.ndarray, weights: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the weighted |columns x - histogram|^2, by accelerated projected gradients."""
    size = len(histogram)
    if not len(columns):
        return np.zeros(0)

    def served(x: np.ndarray) -> np.ndarray:
        return np.bincount(columns.ravel(), np.repeat(x, 3), minlength=size) * (np.arange(size) > 0)

    v, top = np.ones(len(columns)), 1.0
    for _ in range(20):  # the largest eigenvalue, for the step
        g = (weights * served(v))[columns].sum(axis=1)
        top = np.linalg.norm(g)
        v = g / top
    x = y = np.zeros(len(columns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - (weights * (served(y) - histogram))[columns].sum(axis=1) / (1.05 * top))
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y = new + (old - 1) / t * (new - x)
        x = new
    return x


def plan(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), covering the histogram exactly.

    Two fits are made, of which one counts a long length left over as worse than a short one; the fitted patterns and
    packed residuals with the fewest sequences are taken.
    """
    counts = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    columns = patterns(np.flatnonzero(counts), size)
    plans = []
    for weights in (np.ones(size + 1), np.arange(size + 1) / size + 0.001):
        x = fit(columns, counts.astype(float), weights)
        most = columns[np.argsort(-x, kind="stable")[:REFITTED]]
        plans.append(_rounded(most, fit(most, counts.astype(float), weights), counts, size))
    return sorted(min(plans, key=lambda p: sum(p.values())).items(), reverse=True)


def _rounded(columns: np.ndarray, x: np.ndarray, counts: np.ndarray, size: int) -> Counter[tuple[int, ...]]:
    """Repeat counts rounded down, largest first, and the rest by best fit."""
    left, made = counts.copy(), Counter()
    for i in np.argsort(-x, kind="stable"):
        if x[i] < 1:
            break
        need = Counter(int(v) for v in columns[i] if v)
        n = min(int(x[i]), *(int(left[v]) // k for v, k in need.items()))
        if n > 0:
            made[tuple(sorted(need.elements(), reverse=True))] += n
            for v, k in need.items():
                left[v] -= n * k
    for content, n in best_fit({int(v): int(left[v]) for v in np.flatnonzero(left)}, size):
        made[content] += n
    return made


def best_fit(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, with equal lengths placed in equal bins at once."""
    bins: list[Counter[tuple[int, ...]]] = [Counter() for _ in range(size + 1)]  # by the room that is left
    for length in sorted(histogram, reverse=True):
        n, room = histogram[length], length
        while n and room <= size:
            group = bins[room] if room < size else Counter({(): n})
            for content in sorted(group):
                each = room // length
                full = min(group[content], n // each)
                for k, m in ((each, full), (n - full * each, 1)) if full < group[content] and (n - full * each) < each else ((each, full),):
                    if m and k:
                        bins[room - k * length][content + (length,) * k] += m
                        group[content] -= m
                        n -= k * m
                if not group[content]:
                    del group[content]
                if not n:
                    break
            room += 1
    return [(content, m) for group in bins for content, m in sorted(group.items()) if content and m]


def places(made: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length << 40 | first ordinal), and the first sequence and the offset that belong to each."""
    rows, used, sequence = [], Counter(), 0
    for content, n in made:
        offset = 0
        for length in content:
            rows.append((length << 40 | used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    keys, first, offsets = np.array(sorted(rows), np.int64).reshape(-1, 3).T
    return keys, first, offsets


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset. ``pieces`` is a written table."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    keys, first, offsets = places(plan(histogram, size))
    runs = max(1, sum(histogram.values()) // RUN_ROWS)
    run = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(runs)).cast("int")
    dealt = pieces.withColumn("run", run)
    before = Window.partitionBy("length").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("length", "run")
        .agg(F.count("*").alias("n"))
        .select("length", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("run_start"))
    )
    numbered = dealt.withColumn(
        "nth", F.row_number().over(Window.partitionBy("length", "run").orderBy("doc_id", "piece", "ids_crc32"))
    ).join(starts, ["length", "run"])
    ordinal = (F.col("run_start") + F.col("nth") - 1).alias("ordinal")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            key = pdf["length"].to_numpy(np.int64) << 40 | pdf["ordinal"].to_numpy(np.int64)
            at = np.searchsorted(keys, key, side="right") - 1
            yield pdf[names].assign(sequence_id=first[at] + key - keys[at], offset=offsets[at])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return numbered.select(*names, ordinal).mapInPandas(place, schema)


def token_pieces(docs: DataFrame, vocabulary_file: str, end_id: int, size: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and ``end_id``; longer ones are cut from their end."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary_file)
        end = np.array([end_id], enc.dtype).tobytes()
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part, rows = pdf.iloc[lo : lo + 256], []
                for doc_id, packed in zip(part["doc_id"].astype("Int64"), enc.encode(part["text"])):
                    ids = np.frombuffer(packed + end, enc.dtype).astype("<u4")
                    bounds = [0, *range(len(ids) % size or size, len(ids) + 1, size)] if len(ids) > size else [0, len(ids)]
                    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                        rows.append((doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
                yield out.astype({"doc_id": "Int64"})

    text = F.coalesce("text", F.lit("")).alias("text")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", text).mapInPandas(cut, schema)


def pack_documents(docs: DataFrame, vocabulary_file: str, end_id: int = 2, size: int = SIZE) -> DataFrame:
    pieces = staged(token_pieces(docs, vocabulary_file, end_id, size), "pieces")
    return pack(pieces, size)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
