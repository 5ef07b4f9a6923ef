"""SentencePiece encoding with seeded merge-dropout, and lossless decoding, for BPE models with byte fallback.

A pre-token's characters are merged pair by pair, the best-scored adjacent pair first. Each candidate merge is skipped
for good if a hash keyed by seed, document, the pre-token's place in it and the candidate's three borders falls under
the rate, so every occurrence of a word draws its own skips, and the same ones whenever the document is encoded again.
With rate 0 the ids are the library's.

Only what does not depend on the draw is kept by word: its merges without skips and the ids they give. An occurrence
that skips none of these merges has these ids, since the best pair is then the same at each step. In the same way the
merges under one or two skips are kept, for words that stand often, and an occurrence that skips these and no other of the
merges that follow has their ids. The others are merged by their own draws.

Characters that are no pieces become byte pieces, and so does a space mark that stands in the text itself; decoding
gives back every text byte by byte. Defined cases: a null text counts as empty and has no ids; rows with one doc_id are
encoded each for itself; a null doc_id is keyed as 0; an empty table gives an empty result; further columns play no part.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm.common import table
from logquarry.llm.token_counts import BATCH_CHARS, MARK, borders_proved, pre_tokens
from logquarry.llm.word_codes import mix

RATE = 0.1
SEED = 17
#: Pre-tokens a worker keeps, in two generations: what was met lately, and what was met before that.
MEMO = 1_000_000
#: Pre-tokens with one or two skips that a worker keeps.
SKIP_MEMO = 300_000
#: Pre-tokens longer than this go through an agenda of their own.
LONG = 64
#: Pre-tokens that are merged at once, and whose skips are drawn at once.
ROUND_ROWS = 20_000
SKIP_ROWS = 50_000

_U = np.uint64
_NONE = np.int64(1) << 62


class PieceCodec:
    def __init__(self, model_file: str, rate: float = RATE, seed: int = SEED):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        if not borders_proved(proto) or not proto.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback and without pieces across words is needed")
        self.limit, self.seed = min((1 << 64) - 1, int(rate * 2.0**64)), seed
        pieces = list(proto.pieces)
        ids = {p.piece.replace(MARK, " "): i for i, p in enumerate(pieces) if p.type == p.NORMAL}
        self.byte_ids = [next(i for i, p in enumerate(pieces) if p.type == p.BYTE)] * 256
        self.bytes_of: list[bytes] = [b""] * len(pieces)
        for i, p in enumerate(pieces):
            if p.type == p.BYTE:
                value = int(p.piece[1:-1], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
            elif p.type == p.NORMAL:
                self.bytes_of[i] = p.piece.replace(MARK, " ").encode()
        self.chars = {c: i for c, i in ids.items() if len(c) == 1}
        self.unknown = len(pieces)
        order = sorted(ids.values(), key=lambda i: (-pieces[i].score, i))
        rank = {i: r for r, i in enumerate(order)}
        self.of_point = np.full(0x110000, self.unknown, np.int64)
        for c, i in self.chars.items():
            self.of_point[ord(c)] = i
        merges = {}
        for text, i in ids.items():
            for cut in range(1, len(text)):
                a, b = ids.get(text[:cut]), ids.get(text[cut:])
                if a is not None and b is not None:
                    merges[a << 32 | b] = (rank[i], i)
        self.merges = merges
        keys = np.array(sorted(merges), np.int64)
        self.size = 1 << max(4, int(len(keys) * 8).bit_length())
        self.slots = np.full(self.size, -1, np.int64)
        self.ranks, self.made = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        home = (mix(keys.astype(np.uint64)) & _U(self.size - 1)).astype(np.int64)
        for key, at in zip(keys.tolist(), home.tolist()):
            while self.slots[at] >= 0:
                at = (at + 1) & (self.size - 1)
            self.slots[at] = key
            self.ranks[at], self.made[at] = merges[key]
        # Of each pre-token without skips: the hashed borders of its merges, and its ids.
        self.memo: dict[str, tuple[bytes, bytes]] = {}
        self.earlier: dict[str, tuple[bytes, bytes]] = {}
        # The same under given skips: by pre-token and the hashed borders of one or two merges, 0 for none.
        self.skip_memo: dict[tuple[str, int, int], tuple[bytes, bytes]] = {}
        self.newline = np.array([self.byte_ids[10]], "<u4").tobytes()
        self.flat_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.n_bytes = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self.first_byte = np.cumsum(self.n_bytes) - self.n_bytes

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or none) and result of the merges of neighbours."""
        key = a << 32 | b
        at = (mix(key.astype(np.uint64)) & _U(self.size - 1)).astype(np.int64)
        rank, made = np.full(len(key), _NONE), np.zeros(len(key), np.int64)
        left = np.arange(len(key))
        while len(left):
            slot = self.slots[at]
            hit = slot == key
            rank[left[hit]], made[left[hit]] = self.ranks[at[hit]], self.made[at[hit]]
            on = ~hit & (slot >= 0)
            left, key, at = left[on], key[on], (at[on] + 1) & (self.size - 1)
        return rank, made

    @staticmethod
    def _borders(start: np.ndarray, cut: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(start.astype(np.uint64) << _U(42) ^ cut.astype(np.uint64) << _U(21) ^ end.astype(np.uint64))

    def _skipped(self, key: np.ndarray, start: np.ndarray, cut: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self._borders(start, cut, end) ^ key) < _U(self.limit)

    def segment(self, words: list[str], draws: np.ndarray) -> list[bytes]:
        """Ids (unsigned, 32 bit) of each pre-token by its own draw."""
        return self._segment(words, self._keys(draws), None)

    def _keys(self, draws: np.ndarray) -> np.ndarray:
        return mix(draws.astype(np.uint64) ^ mix(np.array([self.seed], np.uint64)))

    def _segment(
        self, words: list[str], keys: np.ndarray | None, traces: list[bytes] | None, given: np.ndarray | None = None
    ) -> list[bytes]:
        """Ids of each pre-token; without keys nothing is skipped but what is ``given``, two borders for each pre-token of
        LONG characters at most. ``traces`` takes the borders of the merges made."""
        out: list[bytes] = [b""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        short = size <= LONG
        for i in np.flatnonzero(~short):
            sym, start, trace = self._agenda(words[i], None if keys is None else keys[i : i + 1])
            out[i] = self._ids(words[i], sym, start)
            if traces is not None:
                traces[i] = trace
        points = points[np.repeat(short, size)]
        places = np.flatnonzero(short)
        end = np.cumsum(size[places])
        for lo in range(0, len(places), ROUND_ROWS):
            part = places[lo : lo + ROUND_ROWS]
            sizes = size[part]
            stop = end[min(lo + ROUND_ROWS, len(places)) - 1]
            skips = given[part] if given is not None else None if keys is None else keys[part]
            self._rounds(self.of_point[points[stop - sizes.sum() : stop]], sizes, skips, words, part.tolist(), out, traces)
        return out

    def _rounds(
        self,
        sym: np.ndarray,
        size: np.ndarray,
        keys: np.ndarray | None,
        words: list[str],
        places: list[int],
        out: list[bytes],
        traces: list[bytes] | None,
    ) -> None:
        """Merge the best pair of each pre-token, for all at once, until none has any."""
        word = np.repeat(np.arange(len(size)), size)
        first = np.cumsum(size) - size
        start = np.arange(len(sym)) - np.repeat(first, size)
        end = start + 1
        rank, made = self._candidates(sym, word, start, end, keys)
        done: list[tuple[np.ndarray, ...]] = []
        made_by: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            head = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.minimum.reduceat(np.where(rank < _NONE, rank << 32 | np.arange(len(rank)), _NONE), head)
            live = best < _NONE
            if not live.all():
                keep = np.repeat(live, np.diff(np.append(head, len(sym))))
                done.append((word[~keep], sym[~keep], start[~keep]))
                moved = np.cumsum(keep) - 1
                at = moved[(best[live] & 0xFFFFFFFF)]
                word, sym, start, end, rank, made = (x[keep] for x in (word, sym, start, end, rank, made))
            else:
                at = best & 0xFFFFFFFF
            if not len(sym):
                break
            if traces is not None:
                made_by.append((word[at], self._borders(start[at], start[at + 1], end[at + 1])))
            sym[at], end[at] = made[at], end[at + 1]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))
            word, sym, start, end, rank, made = (x[keep] for x in (word, sym, start, end, rank, made))
            touched = np.concatenate([at, at[at > 0] - 1])
            rank[touched], made[touched] = self._at(touched, sym, word, start, end, keys)
        word, sym, start = (np.concatenate(x) for x in zip(*done))
        order = np.lexsort((start, word))
        word, sym, start = word[order], sym[order], start[order]
        head = np.flatnonzero(np.diff(word, prepend=-1))
        flat, odd = sym.astype("<u4"), set(word[sym == self.unknown].tolist())
        raw, tail = flat.tobytes(), np.append(head[1:], len(word))
        for w, a, b in zip(word[head].tolist(), head.tolist(), tail.tolist()):
            out[places[w]] = self._ids(words[places[w]], sym[a:b], start[a:b]) if w in odd else raw[4 * a : 4 * b]
        if made_by:
            word, borders = (np.concatenate(x) for x in zip(*made_by))
            order = np.argsort(word, kind="stable")
            raw, at = borders[order].tobytes(), np.searchsorted(word[order], np.arange(len(size) + 1)).tolist()
            for w, (a, b) in enumerate(zip(at[:-1], at[1:])):
                traces[places[w]] = raw[8 * a : 8 * b]

    def _candidates(self, sym, word, start, end, keys):
        return self._at(np.arange(len(sym)), sym, word, start, end, keys)

    def _at(self, at, sym, word, start, end, keys):
        """Rank and result of merging each symbol ``at`` with the next, if it may be."""
        rank, made = np.full(len(at), _NONE), np.zeros(len(at), np.int64)
        if len(sym) > 1:
            nxt = np.minimum(at + 1, len(sym) - 1)
            same = (at + 1 < len(sym)) & (word[at] == word[nxt])
            a, b = at[same], nxt[same]
            r, m = self._lookup(sym[a], sym[b])
            if keys is not None and keys.ndim == 2:
                r[(self._borders(start[a], start[b], end[b])[:, None] == keys[word[a]]).any(axis=1)] = _NONE
            elif keys is not None:
                r[self._skipped(keys[word[a]], start[a], start[b], end[b])] = _NONE
            rank[same], made[same] = r, m
        return rank, made

    def _agenda(self, text: str, key: np.ndarray | None) -> tuple[list[int], list[int], bytes]:
        """The same by an agenda, for one long pre-token: (symbols, starts, borders of the merges made)."""
        sym = [self.chars.get(c, self.unknown) for c in text]
        n = len(sym)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        agenda: list[tuple[int, int, int, int, int]] = []

        def push(pairs: list[tuple[int, int]]) -> None:
            pairs = [(a, b) for a, b in pairs if sym[a] << 32 | sym[b] in self.merges]
            if pairs:
                a, b = np.array(pairs).T
                skipped = np.zeros(len(a), bool) if key is None else self._skipped(key, a, b, np.array([end[x] for x in b]))
                for (x, y), skip in zip(pairs, skipped):
                    if not skip:
                        heapq.heappush(agenda, (self.merges[sym[x] << 32 | sym[y]][0], x, y, sym[x], sym[y]))

        merged: list[tuple[int, int, int]] = []
        push([(i, i + 1) for i in range(n - 1)])
        while agenda:
            _, a, b, left, right = heapq.heappop(agenda)
            if not (alive[a] and alive[b] and sym[a] == left and sym[b] == right and end[a] == b):
                continue
            merged.append((a, b, end[b]))
            sym[a], end[a], alive[b] = self.merges[left << 32 | right][1], end[b], False
            if end[a] < n:
                before[end[a]] = a
            push(([(before[a], a)] if before[a] >= 0 else []) + ([(a, end[a])] if end[a] < n else []))
        starts = [i for i in range(n) if alive[i]]
        return [sym[i] for i in starts], starts, self._borders(*np.array(merged, np.int64).reshape(-1, 3).T).tobytes()

    def _ids(self, text: str, sym, start) -> bytes:
        ids: list[int] = []
        for s, at in zip(sym, start):
            ids.extend([self.byte_ids[x] for x in text[at].encode()] if s == self.unknown else [int(s)])
        return np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str], doc_ids: list[int]) -> list[bytes]:
        """Ids of each text, unsigned, 32 bit, little-endian."""
        words: list[str] = []
        ends = []
        for text in texts:
            for i, line in enumerate(pre_tokens(text)):
                if i:
                    words.append("\n")
                words += line
            ends.append(len(words))
        if not words:
            return [b""] * len(texts)
        # A key for each occurrence, of seed, document and place; line breaks have no place.
        distinct = list(dict.fromkeys(words))
        places = dict(zip(distinct, range(len(distinct))))
        at = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
        text_of = np.repeat(np.arange(len(texts)), np.diff([0, *ends]))
        nth = np.cumsum(at != places.get("\n", -1)) - 1
        begin = np.array([0, *ends[:-1]])
        nth -= np.append(nth, 0)[np.minimum(begin, len(nth))][text_of]
        seed = mix(np.array([self.seed + 1], np.uint64))
        starts = mix(np.array([doc_id % (1 << 64) for doc_id in doc_ids], np.uint64) ^ seed)
        keys = self._keys(mix(starts[text_of] + nth.astype(np.uint64)))
        kind, ids = self._occurrences(distinct, at, keys)
        flat = np.frombuffer(b"".join(ids), "<u4")
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        n = size[kind]
        stop = np.cumsum(n)
        raw = flat[np.repeat((np.cumsum(size) - size)[kind] - (stop - n), n) + np.arange(stop[-1])].tobytes()
        bounds = (4 * np.append(0, stop)[[0, *ends]]).tolist()
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]

    def _occurrences(self, distinct: list[str], at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """Occurrences of the pre-tokens ``distinct[at]`` by their keys: (which ids each has, all ids that any has)."""
        self._learn(distinct)
        own = list(map(self.memo.__getitem__, distinct))
        traces, ids = [trace for trace, _ in own], [x for _, x in own]
        kind = at.copy()
        skipping, first, second, borders, n = self._skips(traces, at, keys)
        short = np.fromiter(map(len, distinct), np.int64, len(distinct)) <= LONG
        again = (n <= 2) & (short & (np.bincount(at, minlength=len(distinct)) > 1))[at[skipping]]
        places = skipping[again]
        first, second, borders = first[again], second[again], borders[again]
        _, one, which = np.unique(at[places] << 14 | first << 7 | second, return_index=True, return_inverse=True)
        kinds = list(zip(map(distinct.__getitem__, at[places[one]].tolist()), *borders[one].T.tolist()))
        self._learn_skips(kinds)
        known = list(map(self.skip_memo.__getitem__, kinds))
        kind[places] = len(ids) + which
        ids += [x for _, x in known]
        others = np.concatenate([skipping[~again], places[self._skips([trace for trace, _ in known], which, keys[places])[0]]])
        kind[others] = len(ids) + np.arange(len(others))
        ids += self._segment(list(map(distinct.__getitem__, at[others].tolist())), keys[others], None)
        return kind, ids

    def _skips(self, traces: list[bytes], at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of occurrences that follow the traces ``at``: which skip any of its merges, the places in the trace of the first
        two that they skip (127 for none), their borders (0 for none), and how many."""
        borders = np.frombuffer(b"".join(traces), np.uint64)
        size = np.fromiter(map(len, traces), np.int64, len(traces)) // 8
        start = np.cumsum(size) - size
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        for lo in range(0, len(at), SKIP_ROWS):
            part = at[lo : lo + SKIP_ROWS]
            n = size[part]
            occurrence = np.repeat(np.arange(lo, lo + len(part)), n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            merge = borders[place + start[at[occurrence]]]
            hit = np.flatnonzero(mix(merge ^ keys[occurrence]) < _U(self.limit))
            parts.append((occurrence[hit], np.minimum(place[hit], 126), merge[hit]))
        occurrence, place, merge = (np.concatenate(x) for x in zip(*parts))
        head = np.flatnonzero(np.diff(occurrence, prepend=-1))
        n = np.diff(np.append(head, len(occurrence)))
        second = np.where(n > 1, np.append(place, 0)[head + 1], 127)
        other = np.where(n > 1, np.append(merge, _U(0))[head + 1], _U(0))
        return occurrence[head], place[head], second, np.stack([merge[head], other], axis=1), n

    def _learn(self, words: list[str]) -> None:
        memo, earlier = self.memo, self.earlier
        if len(memo) > MEMO // 2:
            self.memo, self.earlier = memo, earlier = {}, memo
        memo["\n"] = (b"", self.newline)
        missing = [w for w in words if w not in memo]
        new = []
        for w in missing:
            if (kept := earlier.get(w)) is None:
                new.append(w)
            else:
                memo[w] = kept
        traces = [b""] * len(new)
        plain = self._segment(new, None, traces)
        memo.update(zip(new, zip(traces, plain)))

    def _learn_skips(self, kinds: list[tuple[str, int, int]]) -> None:
        new = [k for k in kinds if k not in self.skip_memo]
        if len(self.skip_memo) + len(new) > SKIP_MEMO:
            self.skip_memo = {k: self.skip_memo[k] for k in kinds if k in self.skip_memo}
        traces = [b""] * len(new)
        given = np.array([k[1:] for k in new], np.uint64).reshape(-1, 2)
        ids = self._segment([k[0] for k in new], None, traces, given)
        self.skip_memo.update(zip(new, zip(traces, ids)))

    def decode(self, ids: bytes) -> str:
        return self.decode_all([ids])[0]

    def decode_all(self, coded: list[bytes]) -> list[str]:
        """The texts of ids; the space before a text's first word is not part of it."""
        ids = np.frombuffer(b"".join(coded), "<u4")
        n = self.n_bytes[ids]
        stop = np.cumsum(n)
        places = np.repeat(self.first_byte[ids] - (stop - n), n) + np.arange(n.sum())
        raw = self.flat_bytes[places].tobytes()
        ends = np.append(0, stop)[np.cumsum([0, *map(len, coded)]) // 4].tolist()
        return [raw[a:b][1:].decode() for a, b in zip(ends, ends[1:])]


@functools.lru_cache(maxsize=2)
def codec(model_file: str, rate: float = RATE, seed: int = SEED) -> PieceCodec:
    """One for each Python worker, which keeps its memo from task to task."""
    return PieceCodec(model_file, rate, seed)


def encode_decode(docs: DataFrame, model_file: str, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """(doc_id, ids, decoded) for every row of ``docs`` (doc_id, text): unsigned 32-bit ids, and the text they give back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = codec(model_file, rate, seed)
        for pdf in batches:
            at = 0
            sizes = pdf["text"].str.len().cumsum().to_numpy()
            while at < len(pdf):
                stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_CHARS)))
                part = pdf.iloc[at:stop]
                ids = part["doc_id"].astype("Int64")
                coded = code.encode(list(part["text"]), ids.fillna(0).tolist())
                yield pd.DataFrame({"doc_id": ids, "text": part["text"], "ids": coded, "decoded": code.decode_all(coded)})
                at = stop

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, text string, ids binary, decoded string")


def op4_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
        (F.col("decoded") == F.col("text")).alias("lossless"),
    )
