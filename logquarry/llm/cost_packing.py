"""Cost-balanced packing: pieces in descending order of cost go to the sequence of lowest cost that has room for them.

A piece of l tokens costs ``linear * l + l * l``: the matrix products of a layer grow with the tokens, its attention with
their square within a document. Sequences are as many as the tokens need, and their sizes add up to the tokens exactly:
full ones of ``size``, and for the remainder one for each power of two in it, which needs no padding. A piece that fits
nowhere is cut: its start fills the sequence with most room left (of these the cheapest), its rest is placed later in its
turn. So no sequence has padding.

Only the histogram of piece lengths (``size`` bins) reaches the driver. Sequences alike in cost and room are one group
there, and pieces of one length are placed a group at a time, so the plan's size depends on ``size`` alone; pieces get
ordinals within their length and look their places up.

Defined cases: a null text counts as empty (its end id is packed); rows with one doc_id are packed each for itself, a
null doc_id like any other; a very long text is cut into full pieces and a rest; an empty table gives an empty result;
further columns, those with names of the result included, play no part.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logquarry.llm.bpe import encoder
from logquarry.llm.common import staged, table

SIZE = 1024
#: Cost of a token against that of a pair of tokens: 12 times the hidden size, here 1024.
LINEAR = 12 * 1024
#: Pieces of one length that one window task numbers, about.
RUN_ROWS = 5_000
#: Texts whose ids are held at once.
BATCH = 256


class Part(NamedTuple):
    """``count`` pieces of one original length, from ``ordinal`` on, have their tokens from ``start`` on in ``count``
    sequences from ``sequence`` on, at ``offset``."""

    original: int
    ordinal: int
    count: int
    start: int
    length: int
    sequence: int
    offset: int


class Group(NamedTuple):
    """``count`` sequences from ``sequence`` on with equal cost and room."""

    cost: int
    sequence: int
    count: int
    room: int
    capacity: int


class Groups:
    """Open sequences: those with room for the length in turn by cost, the others by room."""

    def __init__(self, capacities: list[tuple[int, int]]):
        self.length = max((c for c, _ in capacities), default=0) + 1
        self.ready: list[Group] = []
        self.waiting: dict[int, list[Group]] = defaultdict(list)
        sequence = 0
        for capacity, count in capacities:
            self.put(Group(0, sequence, count, capacity, capacity))
            sequence += count

    def put(self, group: Group) -> None:
        if group.count and group.room >= self.length:
            heapq.heappush(self.ready, group)
        elif group.count and group.room:
            heapq.heappush(self.waiting[group.room], group)

    def turn_to(self, length: int) -> None:
        for room in range(length, self.length):
            for group in self.waiting.pop(room, ()):
                heapq.heappush(self.ready, group)
        self.length = length

    def cheapest(self) -> Group | None:
        return heapq.heappop(self.ready) if self.ready else None

    def roomiest(self) -> Group:
        room = next(r for r in range(self.length - 1, 0, -1) if self.waiting.get(r))
        return heapq.heappop(self.waiting[room])


def capacities(tokens: int, size: int) -> list[tuple[int, int]]:
    """(size, how many) of the sequences that ``tokens`` fill without padding, in descending order."""
    full, rest = divmod(tokens, size)
    return [(size, full)] * bool(full) + [(1 << b, 1) for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def plan(histogram: dict[int, int], size: int, linear: int = LINEAR) -> list[Part]:
    """Where all pieces go, for ``histogram`` of their lengths (1 to ``size``)."""
    groups = Groups(capacities(sum(length * n for length, n in histogram.items()), size))
    turns: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    for length, n in histogram.items():
        turns[length].append((length, 0, n, 0))
    parts = []
    for length in range(size, 0, -1):
        groups.turn_to(length)
        for original, ordinal, count, start in turns.pop(length, ()):
            while count:
                group = groups.cheapest() or groups.roomiest()
                n, put = min(count, group.count), min(length, group.room)
                parts.append(Part(original, ordinal, n, start, put, group.sequence, group.capacity - group.room))
                groups.put(group._replace(sequence=group.sequence + n, count=group.count - n))
                cost = group.cost + linear * put + put * put
                groups.put(group._replace(cost=cost, count=n, room=group.room - put))
                if put < length:
                    turns[length - put].append((original, ordinal, n, start + put))
                ordinal, count = ordinal + n, count - n
    return parts


class Places:
    """The parts of each piece by its length and ordinal."""

    def __init__(self, parts: list[Part]):
        borders: dict[int, set[int]] = defaultdict(set)
        by_length: dict[int, list[Part]] = defaultdict(list)
        for p in parts:
            borders[p.original] |= {p.ordinal, p.ordinal + p.count}
            by_length[p.original].append(p)
        keys, rows, counts = [], [], []
        for length, own in sorted(by_length.items()):
            marks = sorted(borders[length])
            at = {m: i for i, m in enumerate(marks)}
            spans: list[list[tuple[int, int, int, int]]] = [[] for _ in marks[:-1]]
            for p in own:
                for i in range(at[p.ordinal], at[p.ordinal + p.count]):
                    spans[i].append((p.start, p.length, p.sequence - p.ordinal, p.offset))
            for mark, span in zip(marks, spans):
                keys.append(length << 40 | mark)
                counts.append(len(span))
                rows += sorted(span)
        self.keys, self.counts = np.array(keys, np.int64), np.array(counts, np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.rows = np.array(rows, np.int64).reshape(-1, 4)

    def of(self, lengths: np.ndarray, ordinals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each part: its piece's index, (start in the piece, length, sequence, offset), and whether the piece is cut."""
        span = np.searchsorted(self.keys, lengths << 40 | ordinals, side="right") - 1
        n = self.counts[span]
        piece = np.repeat(np.arange(len(span)), n)
        nth = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
        rows = self.rows[self.first[span][piece] + nth]
        rows[:, 2] += ordinals[piece]
        return piece, rows, n[piece] > 1


def token_pieces(docs: DataFrame, vocabulary_file: str, end_id: int, size: int) -> DataFrame:
    """Full pieces of each document and its rest, whose ids are kept because it may be cut; ``piece_key`` is unique."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary_file)
        end, width = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        key = TaskContext.get().partitionId() << 40
        for pdf in batches:
            for lo in range(0, len(pdf), BATCH):
                part, rows = pdf.iloc[lo : lo + BATCH], []
                for doc_id, packed in zip(part["doc_id"].astype("Int64"), enc.encode(part["text"])):
                    packed += end
                    tokens = len(packed) // width
                    for a in range(0, tokens, size):
                        own = packed[a * width : (a + size) * width]
                        crc = zlib.crc32(np.frombuffer(own, enc.dtype).astype("<u4").tobytes())
                        length = len(own) // width
                        rows.append((key, doc_id, a, length, crc, tokens, own if length < size else None))
                        key += 1
                out = pd.DataFrame(rows, columns=["piece_key", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
                yield out.astype({"doc_id": "Int64"})

    text = F.coalesce("text", F.lit("")).alias("text")
    schema = "piece_key long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    return docs.select("doc_id", text).mapInPandas(cut, schema)


def numbered(pieces: DataFrame, histogram: dict[int, int], run_rows: int = RUN_ROWS) -> DataFrame:
    """``pieces`` with ``ordinal``, from 0 within each length: numbers within runs, and one row a run for where it starts."""
    runs_of = F.array(*[F.lit(1 + histogram.get(n, 0) // run_rows) for n in range(1, max(histogram, default=0) + 2)])
    run = F.pmod(F.xxhash64("piece_key"), F.element_at(runs_of, F.col("length").cast("int")).cast("long"))
    dealt = pieces.withColumn("run", run)
    before = Window.partitionBy("length").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("length", "run")
        .agg(F.count("*").alias("n"))
        .select("length", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("run_start"))
    )
    nth = F.row_number().over(Window.partitionBy("length", "run").orderBy("piece_key"))
    return (
        dealt.withColumn("nth", nth)
        .join(starts, ["length", "run"])
        .withColumn("ordinal", F.col("run_start") + F.col("nth") - 1)
        .drop("run", "nth", "run_start")
    )


def pack_documents(
    docs: DataFrame, vocabulary_file: str, end_id: int = 0, size: int = SIZE, linear: int = LINEAR, run_rows: int = RUN_ROWS
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cost): one row a piece of a document's ids."""
    pieces = staged(token_pieces(docs, vocabulary_file, end_id, size), "cost-pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = Places(plan(histogram, size, linear))
    own = ["piece_key", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            piece, rows, is_cut = places.of(pdf["length"].to_numpy(np.int64), pdf["ordinal"].to_numpy(np.int64))
            out = pdf[own].iloc[piece]
            part_start, length, sequence_id, offset = rows.T
            yield out.assign(start=out["start"] + part_start, length=length, sequence_id=sequence_id, offset=offset, part_start=part_start, is_cut=is_cut)

    schema = "piece_key long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part_start long, is_cut boolean"
    placed = staged(numbered(pieces.select(*own), histogram, run_rows).mapInPandas(place, schema), "cost-places")
    width = encoder(vocabulary_file).dtype

    def checksums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            crcs = [
                zlib.crc32(np.frombuffer(ids, width)[a : a + n].astype("<u4").tobytes())
                for ids, a, n in zip(pdf["ids"], pdf["part_start"], pdf["length"])
            ]
            yield pdf[names].assign(ids_crc32=crcs)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    types = ", ".join(f"{n} long" for n in names)
    cut = placed.where("is_cut").join(pieces.where("ids is not null").select("piece_key", "ids"), "piece_key")
    whole = placed.where("not is_cut").select(*names)
    cost = F.lit(linear) * F.col("length") + F.col("length") * F.col("length")
    return whole.union(cut.drop("piece_key", "is_cut").mapInPandas(checksums, types)).withColumn("cost", cost)


def op13_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
