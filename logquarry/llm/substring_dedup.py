"""Substring dedup by relative Lempel-Ziv parsing over indexed reference blocks.

Every document is a reference for those with larger ids. Which of them a document must be parsed against is found by
codes first: the least n-gram of each window of ``window`` words is the window's anchor, so equal windows have equal
anchors wherever they stand; a span is the run of words whose windows share an anchor. Anchors are dealt over blocks,
which learn the first document of each span. Where several spans share an anchor, their single windows are looked up.

Then the words themselves decide. A run of windows that one earlier document is said to hold is a segment; segments go to
the reference block of that document, where its words are indexed. The segment is factored greedily: from its first
window on, the longest match at any indexed position, extended word by word. A factor is (row, start, length, block,
reference, position). After a factor, parsing goes on with the first window that it does not hold whole, which is how
its boundary is checked. What factors of ``window`` words or more cover is duplicate.

A passage that many documents share is settled in the task that reads it, up to one row a span and stretch of its
partition (``INDEX_BYTES``); an anchor with many spans there is passed on as crowded, without them; and a reference that many segments name is indexed in
as many blocks as these fill.

Codes only find candidates, so nothing is removed that is not equal word by word; two different windows of one code could
hide a match, not make one. Defined cases: a null text has no words; a document with a null id is no reference and loses
nothing; rows with one doc_id are judged each against smaller ids; repeats within a document stay; a very long text is
parsed whole, like others; an empty table gives an empty result; further columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm.common import discard, salted_left_join, staged, table
from logquarry.llm.word_codes import chunks, mix, prefix_sums, range_codes, word_codes

WINDOW = 13
ANCHOR = 7
#: Bytes of text whose anchors one block learns, and that one task parses or indexes as a reference block, about.
BLOCK_BYTES = 12 << 20
PARSE_BYTES = 8 << 20
#: Bytes of text whose spans a task holds before it sends them on.
INDEX_BYTES = 8 << 20
#: Spans of one anchor that a partition sends on.
CROWD = 4
#: Segments that one copy of a reference answers.
REFERENCE_SEGMENTS = 2_000
#: Matches of one window that are extended to find the longest.
CHAIN = 16

_U = np.uint64
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
PARSED = f"{RESULT}, row long, text binary, runs binary, windows array<long>"
SEGMENT = "row long, ref long, start long, words binary"
FACTOR = "row long, start long, length long, block int, ref long, position long"
# What a blob holds, and where it goes.
_SPANS, _CROWDED, _KNOWN, _ASKED = range(4)


def spans_of(codes: np.ndarray, at: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, span, first window, last window) of every span, for words as word_codes gives them."""
    none = np.zeros(0, np.int64)
    n = len(codes) - window + 1
    if n <= 0:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    sums = prefix_sums(codes)
    starts = np.arange(len(codes) - anchor + 1)
    grams = range_codes(sums, starts, starts + anchor)
    width = window - anchor + 1
    least, place = grams[:n].copy(), np.zeros(n, np.int64)
    for d in range(1, width):
        other = grams[d : d + n]
        less = other < least
        least[less], place[less] = other[less], d
    place += np.arange(n)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    valid = np.flatnonzero(text[:n] == text[window - 1 :])
    place = place[valid]
    new = np.flatnonzero(np.diff(place, prepend=-1))
    first, last, place = valid[new], valid[np.append(new[1:], len(valid)) - 1], place[new]
    shape = mix(((place - first) << 32 | (last - first)).astype(np.uint64))
    return text[first], grams[place], mix(range_codes(sums, first, last + window) ^ shape), first, last


def window_codes(codes: np.ndarray, window: int) -> np.ndarray:
    starts = np.arange(max(0, len(codes) - window + 1))
    return range_codes(prefix_sums(codes), starts, starts + window)


def _index(blocks: int, buckets: int, window: int, anchor: int):
    """Distinct spans of a stretch of the partition go to their blocks; documents that an earlier one of the stretch
    answers, or whose anchor is crowded there, are told so at once."""

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for pdf in batches:
            texts, ids = list(pdf["text"]), pdf["doc_id"].to_numpy(np.int64)
            for part in chunks(texts):
                doc, anchors, spans, _, _ = spans_of(*word_codes(texts[part]), window, anchor)
                held.append((anchors, spans, ids[part][doc]))
                size += sum(map(len, texts[part]))
                if size >= INDEX_BYTES:
                    yield from dealt(held)
                    size = 0
        if held:
            yield from dealt(held)

    def dealt(held: list[tuple[np.ndarray, ...]]) -> Iterator[pd.DataFrame]:
        anchors, spans, docs = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.lexsort((docs, spans, anchors))
        anchors, spans, docs = anchors[order], spans[order], docs[order]
        new = np.diff(spans, prepend=spans[:1] + _U(1)) != 0
        least = docs[np.flatnonzero(new)][np.cumsum(new) - 1]
        again = (docs != least) & ~(np.diff(docs, prepend=-1) == 0)
        yield from _packed(_KNOWN, _bucket(docs[again], buckets), docs[again], spans[again], least[again])
        anchors, spans, docs = anchors[new], spans[new], docs[new]
        edge = np.flatnonzero(np.diff(anchors, prepend=anchors[:1] + _U(1)))
        size = np.diff(np.append(edge, len(anchors)))
        crowd = np.repeat(size > CROWD, size)
        yield from _packed(_ASKED, _bucket(docs[crowd], buckets), docs[crowd], spans[crowd])
        yield from _packed(_CROWDED, _block(anchors[edge][size > CROWD], blocks), anchors[edge][size > CROWD])
        yield from _packed(_SPANS, _block(anchors[~crowd], blocks), anchors[~crowd], spans[~crowd], docs[~crowd])

    return index


def _block(anchors: np.ndarray, blocks: int) -> np.ndarray:
    """Anchors are least codes and so crowd at the low end; mixed, they fill all blocks alike."""
    return ((mix(anchors) >> _U(32)) * _U(blocks) >> _U(32)).astype(np.int64)


def _bucket(docs: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(docs.astype(np.uint64)) % _U(buckets)).astype(np.int64)


def _packed(kind: int, place: np.ndarray, *columns: np.ndarray) -> Iterator[pd.DataFrame]:
    order = np.argsort(place, kind="stable")
    place, columns = place[order], [c[order] for c in columns]
    edges = np.flatnonzero(np.diff(place, prepend=-1)).tolist()
    rows = [(int(place[a]), kind, b"".join(c[a:b].tobytes() for c in columns)) for a, b in zip(edges, [*edges[1:], len(place)])]
    for lo in range(0, len(rows), 256):
        yield pd.DataFrame(rows[lo : lo + 256], columns=["place", "kind", "blob"])


def _unpacked(rows: pd.DataFrame, kind: int, n: int) -> list[np.ndarray]:
    parts = [np.frombuffer(x, np.uint64).reshape(n, -1) for x in rows["blob"][rows["kind"] == kind]]
    return list(np.concatenate(parts, axis=1)) if parts else [np.zeros(0, np.uint64)] * n


def _look_up(buckets: int):
    """A block's answers: in which first document a span stands, and which windows must be looked up one by one."""

    def look_up(pdf: pd.DataFrame) -> pd.DataFrame:
        anchors, spans, docs = _unpacked(pdf, _SPANS, 3)
        (crowded,) = _unpacked(pdf, _CROWDED, 1)
        docs = docs.astype(np.int64)
        order = np.lexsort((docs, spans, anchors))
        anchors, spans, docs = anchors[order], spans[order], docs[order]
        new = np.diff(spans, prepend=spans[:1] + _U(1)) != 0
        at = np.flatnonzero(new)
        first = docs[at][np.cumsum(new) - 1]
        later = docs != first
        out = [*_packed(_KNOWN, _bucket(docs[later], buckets), docs[later], spans[later], first[later])]
        # One row a distinct span now: several spans and several first documents under one anchor need a closer look.
        anchors, spans, docs = anchors[at], spans[at], docs[at]
        edge = np.flatnonzero(np.diff(anchors, prepend=anchors[:1] + _U(1)))
        if len(edge):
            size = np.diff(np.append(edge, len(anchors)))
            mixed = np.repeat(np.minimum.reduceat(docs, edge) != np.maximum.reduceat(docs, edge), size)
            mixed |= np.isin(anchors, crowded)
            out += _packed(_ASKED, _bucket(docs[mixed], buckets), docs[mixed], spans[mixed])
        return pd.concat(out) if out else pd.DataFrame({"place": [], "kind": [], "blob": []})

    return look_up


def _answers(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys of document and span that are known, sorted; their least references; keys to be looked up)."""
    docs, spans, refs = _unpacked(rows, _KNOWN, 3)
    key, refs = mix(docs) ^ spans, refs.astype(np.int64)
    order = np.lexsort((refs, key))
    key, refs = key[order], refs[order]
    new = np.flatnonzero(np.diff(key, prepend=key[:1] + _U(1)))
    docs, spans = _unpacked(rows, _ASKED, 2)
    return key[new], refs[new], np.unique(mix(docs) ^ spans)


def _found(key: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether, where) each key stands among sorted ones."""
    if not len(known):
        return np.zeros(len(key), bool), np.zeros(len(key), np.int64)
    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
    return known[at] == key, at


def _parse(window: int, anchor: int):
    """Rows without any candidate are finished; others give their runs of windows (first, last, reference), and the
    codes of windows that must be looked up."""

    def parse(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        known, refs, asked = _answers(answers)
        rows = []
        ids, raw = texts["doc_id"].to_numpy(np.int64), list(texts["text"])
        base = int(texts["place"].iloc[0]) << 36 if len(texts) else 0
        for part in chunks(raw):
            codes, at = word_codes(raw[part])
            doc, _, spans, first, last = spans_of(codes, at, window, anchor)
            key = mix(ids[part][doc].astype(np.uint64)) ^ spans
            hit, where = _found(key, known)
            ask = _found(key, asked)[0] & ~hit
            grams = window_codes(codes, window).view(np.int64) if ask.any() else None
            edge = np.searchsorted(doc, np.arange(len(at)))
            for i, text in enumerate(raw[part]):
                a, b = edge[i], edge[i + 1]
                own, open_ = np.flatnonzero(hit[a:b]) + a, np.flatnonzero(ask[a:b]) + a
                if not len(own) and not len(open_):
                    rows.append((ids[part][i], *kept_words(text, []), base + part.start + i, None, None, None))
                    continue
                runs = np.stack([first[own] - at[i], last[own] - at[i], refs[where[own]]], axis=1)
                windows = None
                if len(open_):
                    windows = np.unique(np.concatenate([grams[first[k] : last[k] + 1] for k in open_]))
                rows.append((ids[part][i], None, None, None, base + part.start + i, text, runs.tobytes(), windows))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in PARSED.split(", ")])
        return out.astype({"n_words": "Int64", "n_removed": "Int64"})

    return parse


def _segments(window: int):
    """Runs of windows with one reference, with their words."""

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row, text, runs, late in zip(pdf["row"], pdf["text"], pdf["runs"], pdf["late"]):
                words = text.split()
                refs = np.full(len(words) - window + 1, -1, np.int64)
                named = np.zeros(len(refs), bool)
                for a, b, ref in np.frombuffer(runs, np.int64).reshape(-1, 3).tolist():
                    refs[a : b + 1], named[a : b + 1] = ref, True
                if late is not None and len(late):
                    code, ref = np.array([(x["code"], x["least"]) for x in late], np.int64).T
                    order = np.argsort(code)
                    hit, where = _found(window_codes(word_codes([text])[0], window).view(np.int64), code[order])
                    hit &= ~named
                    refs[hit], named[hit] = ref[order][where[hit]], True
                edge = np.flatnonzero((np.diff(refs, prepend=refs[:1]) != 0) | (np.diff(named, prepend=False) != 0)).tolist()
                for a, b in zip(edge, [*edge[1:], len(refs)]):
                    if named[a]:
                        rows.append((row, refs[a], a, b" ".join(words[a : b + window - 1])))
            yield pd.DataFrame(rows, columns=["row", "ref", "start", "words"])

    return segments


def longest(segment: list[bytes], i: int, reference: list[bytes], positions: Iterator[int], least: int) -> tuple[int, int]:
    """(length, position) of the longest match of ``segment`` from i on at one of ``positions``; 0 if under ``least``."""
    best, where, matches = 0, -1, 0
    for p in positions:
        if segment[i:] == reference[p : p + len(segment) - i]:
            return len(segment) - i, p
        n, most = 0, min(len(segment) - i, len(reference) - p)
        while n < most and segment[i + n] == reference[p + n]:
            n += 1
        if n >= least:
            matches += 1
            if n > best:
                best, where = n, p
            if matches == CHAIN:
                break
    return best, where


def factors(segment: list[bytes], reference: list[bytes], chains: list[np.ndarray], window: int) -> list[tuple[int, int, int]]:
    """Greedy parse: (start, length, position) of the factors of ``window`` words or more, ``chains`` giving for each
    window of the segment the positions of the reference at which its like may stand."""
    out, i = [], 0
    while i + window <= len(segment):
        n, p = longest(segment, i, reference, chains[i], window)
        if n:
            out.append((i, n, p))
        i += n - window + 1 if n else 1
    return out


def _factor(window: int):
    """Segments of a reference block are factored against the words of the documents that they name."""

    def factor(references: pd.DataFrame, segments: pd.DataFrame) -> pd.DataFrame:
        rows = []
        texts: dict[int, list[bytes]] = {}
        for ref, text in zip(references["ref"], references["text"]):
            texts.setdefault(ref, []).append(text)
        base = 0
        for ref, own in segments.groupby("ref") if len(segments) else ():
            for text in texts.get(ref, ()):
                words = text.split()
                grams = window_codes(word_codes([text])[0], window)
                order = np.argsort(grams, kind="stable")
                grams = grams[order]
                asked = list(own["words"])
                for part in chunks(asked):
                    codes, at = word_codes(asked[part])
                    wanted = window_codes(codes, window)
                    low, high = np.searchsorted(grams, wanted), np.searchsorted(grams, wanted, side="right")
                    for k, (row, start) in enumerate(zip(own["row"].iloc[part], own["start"].iloc[part])):
                        n = at[k + 1] - at[k] - window + 1
                        chains = [order[a:b] for a, b in zip(low[at[k] : at[k] + n], high[at[k] : at[k] + n])]
                        for i, length, p in factors(asked[part][k].split(), words, chains, window):
                            rows.append((row, start + i, length, references["place"].iloc[0], ref, base + p))
                base += len(words)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FACTOR.split(", ")])

    return factor


def kept_words(text: bytes, gone: list[tuple[int, int]]) -> tuple[int, int, str]:
    """(words, removed words, SHA-256 of the rest), without the stretches (start, length)."""
    words = text.split()
    at, rest = 0, []
    for start, length in sorted(gone):
        if start > at:
            rest += words[at:start]
        at = max(at, start + length)
    rest = rest + words[at:] if at else words
    return len(words), len(words) - len(rest), hashlib.sha256(b" ".join(rest)).hexdigest()


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        gone = [[] if x is None else [(f["start"], f["length"]) for f in x] for x in pdf["gone"]]
        rows = [(i, *kept_words(text, x)) for i, text, x in zip(pdf["doc_id"].astype("Int64"), pdf["text"], gone)]
        yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256"]).astype({"doc_id": "Int64"})


def parsed_rows(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """Every row with an id: finished, or with its text and where its windows may stand. A written table."""
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", _words())
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks, buckets = max(least, total // BLOCK_BYTES), max(least, total // PARSE_BYTES)
    blob = "place int, kind int, blob binary"
    indexed = staged(texts.mapInPandas(_index(blocks, buckets, window, anchor), blob), "spans")
    answers = indexed.where(F.col("kind").isin(_SPANS, _CROWDED)).groupBy("place").applyInPandas(_look_up(buckets), blob)
    answers = staged(answers.union(indexed.where(F.col("kind").isin(_KNOWN, _ASKED))), "answers")
    discard(indexed)

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(_bucket(ids.to_numpy(np.int64), buckets))

    grouped = texts.withColumn("place", bucket("doc_id")).groupBy("place").cogroup(answers.groupBy("place"))
    parsed = staged(grouped.applyInPandas(_parse(window, anchor), PARSED), "parsed")
    discard(answers)
    return parsed


def segments_of(parsed: DataFrame, window: int) -> DataFrame:
    """(row, ref, start, words): what may stand in an earlier document, and in which. A written table."""
    open_ = parsed.where("text IS NOT NULL")
    single = open_.select("row", "doc_id", F.explode("windows").alias("code"))
    shared = single.groupBy("code").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    late = (
        salted_left_join(single, shared.select("code", "least"), "code", F.col("row"), salts=8)
        .where("doc_id > least")
        .groupBy("row")
        .agg(F.collect_list(F.struct("code", "least")).alias("late"))
    )
    rows = open_.select("row", "text", "runs").join(late, "row", "left")
    return staged(rows.mapInPandas(_segments(window), SEGMENT), "segments")


def factored(docs: DataFrame, segments: DataFrame, window: int) -> DataFrame:
    """The factors of ``segments`` over the reference blocks of ``docs``."""
    named = segments.groupBy("ref").agg(F.ceil(F.count("*") / REFERENCE_SEGMENTS).cast("int").alias("copies"))
    size = segments.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * size // PARSE_BYTES)

    def place(copy):
        return F.pmod(F.xxhash64("ref", copy), F.lit(blocks)).cast("int").alias("place")

    texts = docs.select(F.col("doc_id").alias("ref"), _words()).join(named, "ref")
    texts = texts.select("ref", "text", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    asked = salted_left_join(segments, named, "ref", F.col("row"), salts=8)
    asked = asked.withColumn("copy", F.pmod(F.xxhash64("row"), F.col("copies")).cast("int"))
    return (
        texts.select("ref", "text", place("copy"))
        .groupBy("place")
        .cogroup(asked.select("row", "ref", "start", "words", place("copy")).groupBy("place"))
        .applyInPandas(_factor(window), FACTOR)
    )


def _words():
    return F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    parsed = parsed_rows(docs, window, anchor)
    segments = segments_of(parsed, window)
    found = factored(docs, segments, window)
    gone = staged(found.groupBy("row").agg(F.collect_list(F.struct("start", "length")).alias("gone")), "factors")
    discard(segments)
    open_ = parsed.where("text IS NOT NULL").select("row", "doc_id", "text").join(gone, "row", "left")
    nameless = docs.where("doc_id IS NULL").select("doc_id", _words(), F.lit(None).cast(gone.schema["gone"].dataType).alias("gone"))
    finished = open_.select("doc_id", "text", "gone").union(nameless).mapInPandas(_finish, RESULT)
    return parsed.where("text IS NULL").select(finished.columns).union(finished)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
),
p AS (SELECT doc_id, words, unnest(generate_series(1, len(words))) AS i FROM w),
g AS (SELECT doc_id, i, array_to_string(words[i : i + 12], ' ') AS gram FROM p WHERE i + 12 <= len(words)),
f AS (SELECT gram, min(doc_id) AS least FROM g GROUP BY gram),
d AS (SELECT g.doc_id, g.i FROM g JOIN f USING (gram) WHERE f.least < g.doc_id),
c AS (SELECT DISTINCT doc_id, i + unnest(generate_series(0, 12)) AS i FROM d),
k AS (
  SELECT p.doc_id, p.i, p.words[p.i] AS word, c.i IS NOT NULL AS gone
  FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.i = p.i
),
a AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept
  FROM k GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, coalesce(a.n_removed, 0) AS n_removed,
       sha256(coalesce(a.kept, '')) AS kept_sha256
FROM w LEFT JOIN a USING (doc_id)
"""
