"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, in each document and over all of them.

A is a byte-level BPE file of the tokenizers library, encoded over a space and the text; B is a SentencePiece model, which
adds that space itself. Both cut the bytes of a text into tokens. Between two neighbouring ends of either side lies one
link, the pair of tokens that cover those bytes; ends of both sides cut the text into groups.

Postings cogroup. A batch of documents gives, for each bucket of B ids, its postings: how often each document links each
pair. Postings are shuffled by bucket, hot buckets split over several tasks, and sorted there by Spark, which spills;
the pairs' partial counts come first in that stream. A task adds them up, finds each B id's highest count, and then
turns one batch's postings after the other into its documents' contributions, which are summed by document.

No token of either side reaches over a space or line break between two characters that are not white space (A's
pre-tokens and a proof over B's pieces), so these cut a text into units, and each different unit is aligned once by the
libraries.

Defined cases: texts that are null, empty or not given back by the tokens' bytes (a U+2581 in them, say) have no tokens:
zeros and ''; rows with one doc_id, null too, have a row each; a very long text is a batch of its own; an empty table
gives an empty result; further columns, those with names of the result included, play no part.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm.bpe import TextEncoder
from logquarry.llm.common import new_path, table
from logquarry.llm.token_counts import MARK, borders_proved

#: Buckets of B ids.
BUCKETS = 32
#: Postings of a bucket that one task takes, about.
TASK_POSTINGS = 8_000_000
#: Units and documents of a batch; a single document may exceed the first.
BATCH_UNITS, BATCH_DOCS = 150_000, 1_024
#: Different units, and different pairs, that a worker keeps.
MEMO, PAIRS = 500_000, 2_000_000
_ODD = re.compile(r"\A\s|\s\s|\s\Z")
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Stands before units that follow a line break; no text holds it.
_LINE = "\ud800"
_STATS = ("n_a", "n_b", "n_groups", "n_links")


class Aligner:
    """Units of texts, each with the space or line break before it, and their counts, links and groups."""

    def __init__(self, file_a: str, file_b: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.a = TextEncoder(file_a)
        self.a.library.encode_special_tokens = True
        self.a.special = []
        back = {c: b for b, c in self.a.shown.items()} | {chr(256 + 10): 10}
        names = self.a.library.get_vocab()
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            known = all(c in back or ord(c) < 256 for c in name)
            self.bytes_a[i] = bytes(back.get(c, ord(c) & 255) for c in name) if known else name.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=file_b)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(file_b, "rb") as f:
            proto.ParseFromString(f.read())
        self.bytes_b = [
            bytes([int(p.piece[3:5], 16)]) if p.type == p.BYTE else p.piece.replace(MARK, " ").encode() for p in proto.pieces
        ]
        self.by_units = self.a.by_words and borders_proved(proto)
        alone = self.b.encode("\n")
        self.by_units &= len(alone) > 1 and alone[0] == self.b.piece_to_id(MARK)
        self.sizes_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.sizes_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.stats = np.zeros((0, len(_STATS) + 1), np.int64)  # and whether the bytes are those of the unit
        self.first = np.zeros(1, np.int64)
        self.links = np.zeros(0, np.int64)
        self.hits = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keep the units met more than once since the last time, if these leave room for others."""
        kept = np.flatnonzero(self.hits > 1)
        names, groups, stats, first, links = list(self.known), self.groups, self.stats, self.first, self.links
        self.clear()
        if len(kept) > MEMO // 2:
            return
        n = np.diff(first)[kept]
        self.links = links[np.repeat(first[kept] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        self.first = np.concatenate([[0], np.cumsum(n)])
        self.stats, self.hits = stats[kept], np.zeros(len(kept), np.int64)
        self.groups = [groups[i] for i in kept.tolist()]
        self.known = {names[i]: k for k, i in enumerate(kept.tolist())}

    def units(self, text: str) -> list[str]:
        """The space before a unit is left out; a line break is ``_LINE``."""
        if not self.by_units:
            return [text]
        if _ODD.search(text):
            first, *rest = _CUT.split(text)
            return [first, *[u[1:] if u[0] == " " else _LINE + u[1:] for u in rest]]
        return (text.replace("\n", " " + _LINE) if "\n" in text else text).split(" ")

    def numbers(self, units: list[str]) -> np.ndarray:
        """The numbers of units, new ones aligned first; they hold until the next call."""
        if len(self.known) > MEMO:
            self._forget()
        found = list(map(self.known.get, units))
        new = list(dict.fromkeys([u for u, i in zip(units, found) if i is None]))
        if new:
            self._learn(new)
            found = list(map(self.known.__getitem__, units))
        out = np.array(found, np.int64)
        self.hits += np.bincount(out, minlength=len(self.hits))
        return out

    def _flat(self, ids_a: list[bytes], ids_b: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        a = np.frombuffer(b"".join(ids_a), self.a.dtype).astype(np.int64)
        return a, np.fromiter(chain.from_iterable(ids_b), np.int64)

    def _learn(self, units: list[str]) -> None:
        real = ["\n" + u[1:] if u[:1] == _LINE else " " + u for u in units]
        ids_a = self.a.encode(real)
        self.a.words, self.a.heads = {}, {}
        # B adds a space to what it encodes; a line break after it keeps it a token of its own.
        ids_b = [
            y[1:] if r[0] == "\n" else y
            for r, y in zip(real, self.b.encode([r if r[0] == "\n" else r[1:] for r in real], num_threads=1))
        ]
        a, b = self._flat(ids_a, ids_b)
        ok = np.ones(len(units), bool)
        want = "".join(real).encode()
        if b"".join([self.bytes_a[t] for t in a]) != want or b"".join([self.bytes_b[t] for t in b]) != want:
            for i, (r, x, y) in enumerate(zip(real, ids_a, ids_b)):
                own_a, own_b = self._flat([x], [y])
                given = {b"".join([self.bytes_a[t] for t in own_a]), b"".join([self.bytes_b[t] for t in own_b])}
                if given != {r.encode()}:
                    ok[i] = False
                    ids_a[i], ids_b[i] = b"", []
            a, b = self._flat(ids_a, ids_b)
        n_a = np.array([len(x) for x in ids_a], np.int64) // self.a.dtype.itemsize
        n_b = np.array([len(y) for y in ids_b], np.int64)
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        ends = np.union1d(ends_a, ends_b)
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        unit = np.repeat(np.arange(len(units)), n_a)[at_a]
        n_links = np.bincount(unit, minlength=len(units))
        both = (ends_a[at_a] == ends) & (ends_b[at_b] == ends)
        n_groups = np.bincount(unit[both], minlength=len(units))
        stop_a, stop_b = (at_a[both] + 1).tolist(), (at_b[both] + 1).tolist()
        said_a, said_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        groups = [
            ",".join(said_a[p:q]) + "|" + ",".join(said_b[r:s])
            for p, q, r, s in zip([0, *stop_a], stop_a, [0, *stop_b], stop_b)
        ]
        at = np.concatenate([[0], np.cumsum(n_groups)]).tolist()
        base = len(self.groups)
        self.groups += [";".join(groups[i:j]) for i, j in zip(at, at[1:])]
        self.stats = np.concatenate([self.stats, np.stack([n_a, n_b, n_groups, n_links, ok], axis=1)])
        self.links = np.concatenate([self.links, b[at_b] << 32 | a[at_a]])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(n_links)])
        self.hits = np.concatenate([self.hits, np.zeros(len(units), np.int64)])
        self.known.update(zip(units, range(base, base + len(units))))


@functools.lru_cache(maxsize=1)
def aligner(file_a: str, file_b: str) -> Aligner:
    """One for each Python worker, which keeps its memo from task to task."""
    return Aligner(file_a, file_b)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of int64 with their lengths; values that need fewer bytes take fewer."""
    out = []
    for x in arrays:
        top = int(x.max()) if len(x) else 0
        kind = next(i for i, t in enumerate(_KINDS) if top <= np.iinfo(t).max)
        out += [np.array([kind, len(x)], "<u4").tobytes(), x.astype(_KINDS[kind]).tobytes()]
    return b"".join(out)


_KINDS = ("<u1", "<u2", "<u4", "<u8")


def unpacked(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        kind, n = np.frombuffer(blob, "<u4", 2, at)
        out.append(np.frombuffer(blob, _KINDS[kind], n, at + 8).astype(np.int64))
        at += 8 + int(n) * (1 << int(kind))
    return out


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different ``keys`` in ascending order, and the sums of their ``counts``."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts


class Totals:
    """Counts of keys, added up a part at a time."""

    def __init__(self):
        self.keys = self.counts = np.zeros(0, np.int64)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.held += len(keys)
        if self.held > max(1_000_000, len(self.keys)):
            self.all()

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if self.parts:
            keys, counts = zip((self.keys, self.counts), *self.parts)
            self.keys, self.counts = summed(np.concatenate(keys), np.concatenate(counts))
            self.parts, self.held = [], 0
        return self.keys, self.counts


_ENCODED = "kind string, doc_key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, bucket int, n long, blob binary"
_ENCODED_ARROW = pa.schema(
    [("kind", pa.string()), ("doc_key", pa.int64()), ("doc_id", pa.int64())]
    + [(n, pa.int64()) for n in _STATS]
    + [("groups_sha256", pa.string()), ("bucket", pa.int32()), ("n", pa.int64()), ("blob", pa.binary())]
)


def _rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ENCODED_ARROW], schema=_ENCODED_ARROW
    )


def encoded(docs: DataFrame, file_a: str, file_b: str, buckets: int) -> DataFrame:
    """Rows of three kinds: ``doc`` with its counts; ``postings`` of a batch and bucket; ``pairs`` with a task's counts."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(file_a, file_b)
        key = TaskContext.get().partitionId() << 40
        totals = Totals()
        ids: list[int | None] = []
        units: list[list[str]] = []
        n = 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids.append(doc_id)
                units.append(both.units(text) if text else [])
                n += len(units[-1])
                if n >= BATCH_UNITS or len(ids) >= BATCH_DOCS:
                    yield from batch_rows(both, key, ids, units, totals)
                    key, ids, units, n = key + len(ids), [], [], 0
                    if len(totals.keys) > PAIRS:
                        yield pair_rows(totals)
                        totals = Totals()
        if ids:
            yield from batch_rows(both, key, ids, units, totals)
        if len(totals.all()[0]):
            yield pair_rows(totals)

    def batch_rows(both: Aligner, key: int, ids: list, units: list[list[str]], totals: Totals) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum([len(u) for u in units])
        index = both.numbers(list(chain.from_iterable(units)))
        number = index.tolist()
        doc = np.repeat(np.arange(len(ids)), [len(u) for u in units])
        bad = np.bincount(doc[both.stats[index, 4] == 0], minlength=len(ids)) > 0
        digests, groups = [], both.groups
        for a, b, skip in zip([0, *ends.tolist()], ends.tolist(), bad.tolist()):
            joined = "" if skip or a == b else ";".join([groups[i] for i in number[a:b]])
            digests.append(hashlib.sha256(joined.encode()).hexdigest() if joined else "")
        used = ~bad[doc]
        index, doc = index[used], doc[used]
        stats = {name: np.bincount(doc, both.stats[index, i], len(ids)).astype(np.int64) for i, name in enumerate(_STATS)}
        yield _rows(kind=["doc"] * len(ids), doc_key=np.arange(key, key + len(ids)), doc_id=ids, groups_sha256=digests, **stats)
        unit_doc, times = summed(index * len(ids) + doc, np.ones(len(index), np.int64))
        unit, doc = unit_doc // len(ids), unit_doc % len(ids)
        n = both.first[unit + 1] - both.first[unit]
        at = np.repeat(both.first[unit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pairs, which = np.unique(both.links[at], return_inverse=True)
        pair_doc, counts = summed(which * len(ids) + np.repeat(doc, n), np.repeat(times, n))
        which, doc = pair_doc // len(ids), pair_doc % len(ids)
        totals.add(pairs, np.bincount(which, counts, len(pairs)).astype(np.int64))
        blobs, sizes, own_buckets = [], [], []
        bucket = (pairs >> 32) % buckets
        for k in np.unique(bucket).tolist():
            mine = bucket == k
            own = mine[which]
            per_pair = np.bincount(which[own], minlength=len(pairs))[mine]
            blobs.append(packed(*split_pairs(pairs[mine]), per_pair, doc[own], counts[own], np.array([len(ids)])))
            sizes.append(int(own.sum()))
            own_buckets.append(k)
        if blobs:
            yield _rows(kind=["postings"] * len(blobs), doc_key=[key] * len(blobs), bucket=own_buckets, n=sizes, blob=blobs)

    def pair_rows(totals: Totals) -> pa.RecordBatch:
        return _pair_rows(*totals.all(), buckets)

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    path = new_path(docs.sparkSession, "aligned")
    text.mapInArrow(encode, _ENCODED).write.partitionBy("kind").parquet(path)
    return docs.sparkSession.read.schema(_ENCODED).parquet(path)


def split_pairs(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return pairs >> 32, pairs & 0xFFFFFFFF


def _pair_rows(pairs: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    bucket = (pairs >> 32) % buckets
    own = [(k, bucket == k) for k in np.unique(bucket).tolist()]
    blobs = [packed(*split_pairs(pairs[m]), counts[m]) for _, m in own]
    return _rows(kind=["pairs"] * len(own), bucket=[k for k, _ in own], n=[int(m.sum()) for _, m in own], blob=blobs)


def merged(partials: DataFrame, fan: int) -> DataFrame:
    """Partial pair counts of each bucket, at most ``fan`` rows of them."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _runs(batches, ("bucket", "part")):
            totals = Totals()
            for row in rows:
                b, a, counts = unpacked(row["blob"])
                totals.add(b << 32 | a, counts)
            pairs, counts = totals.all()
            yield _rows(kind=["pairs"], bucket=[bucket[0]], n=[len(pairs)], blob=[packed(*split_pairs(pairs), counts)])

    dealt = partials.withColumn("part", F.pmod(F.xxhash64("blob"), F.lit(fan)))
    dealt = dealt.repartition("bucket", "part").sortWithinPartitions("bucket", "part")
    return dealt.select("bucket", "part", "blob").mapInArrow(merge, _ENCODED)


def _runs(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows that stand together by ``key`` in a sorted stream, a row at a time."""
    rows = (batch.slice(i, 1).to_pylist()[0] for batch in batches for i in range(batch.num_rows))
    held = next(rows, None)
    while held is not None:
        now = tuple(held[k] for k in key)

        def run(now: tuple = now) -> Iterator[dict]:
            nonlocal held
            while held is not None and tuple(held[k] for k in key) == now:
                row, held = held, next(rows, None)
                yield row

        own = run()
        yield now, own
        for _ in own:
            pass


def contributions(postings: DataFrame, pairs: DataFrame, salts: list[int]) -> DataFrame:
    """(doc_key, n_docs, blob): what each batch's documents get from one bucket's links; ``salts`` are tasks a bucket."""

    def contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches, ("bucket", "salt")):
            totals, best = Totals(), None
            for row in rows:
                if row["doc_key"] is None:
                    b, a, counts = unpacked(row["blob"])
                    totals.add(b << 32 | a, counts)
                    continue
                if best is None:
                    known, counts = totals.all()
                    starts = np.flatnonzero(np.concatenate([[True], known[1:] >> 32 != known[:-1] >> 32]))
                    top = np.repeat(np.maximum.reduceat(counts, starts), np.diff(np.append(starts, len(known))))
                    best = counts == top
                b, a, per_pair, doc, times, n_docs = unpacked(row["blob"])
                at = np.repeat(np.searchsorted(known, b << 32 | a), per_pair)
                n_docs = int(n_docs[0])
                n_best, count_sum = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
                np.add.at(n_best, doc, times * best[at])
                np.add.at(count_sum, doc, times * counts[at])
                yield pa.RecordBatch.from_pydict({"doc_key": [row["doc_key"]], "blob": [packed(n_best, count_sum)]})

    tasks = F.element_at(F.array(*map(F.lit, salts)), F.col("bucket") + 1)
    left = pairs.select("bucket", F.explode(F.sequence(F.lit(0), tasks - 1)).alias("salt"), F.lit(None).cast("long").alias("doc_key"), "blob")
    right = postings.select("bucket", F.pmod(F.xxhash64("doc_key"), tasks).cast("int").alias("salt"), "doc_key", "blob")
    stream = left.union(right).repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", F.col("doc_key").asc_nulls_first())
    return stream.mapInArrow(contribute, "doc_key long, blob binary")


def align(
    docs: DataFrame, file_a: str, file_b: str, buckets: int = BUCKETS, task_postings: int = TASK_POSTINGS
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs`` (doc_id, text)."""
    rows = encoded(docs, file_a, file_b, buckets)
    postings = rows.where("kind = 'postings'")
    partials = rows.where("kind = 'pairs'")
    salts, n_partials = [1] * buckets, 0
    for r in postings.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        salts[r["bucket"]] = 1 + r["n"] // task_postings
    if max(salts) > 1:
        n_partials = partials.groupBy("bucket").count().agg(F.max("count")).first()[0]
        partials = merged(merged(partials, max(1, int(n_partials**0.5))), 1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for (first,), own in _runs(batches, ("doc_key",)):
            n_best, count_sum = map(sum, zip(*(unpacked(r["blob"]) for r in own)))
            keys = np.arange(first, first + len(n_best))
            yield pa.RecordBatch.from_pydict({"doc_key": keys, "n_best": n_best, "count_sum": count_sum})

    sums = (
        contributions(postings, partials, salts)
        .repartition("doc_key")
        .sortWithinPartitions("doc_key")
        .mapInArrow(add, "doc_key long, n_best long, count_sum long")
    )
    found = rows.where("kind = 'doc'").select("doc_key", "doc_id", *_STATS, "groups_sha256").join(sums, "doc_key", "left")
    zero = [F.coalesce(n, F.lit(0)).alias(n) for n in ("n_best", "count_sum")]
    return found.select("doc_id", *_STATS, *zero, "groups_sha256")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path
    return align(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))
