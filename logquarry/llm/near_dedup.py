"""MinHash near-dedup with sequential Bayesian verification.

Documents whose words are equal, case of A-Z aside, are one class (by the SHA-256 of those words); its least doc_id
stands for it and is its node. Signatures are banded; what shares a band is a candidate. In a band, a member's signature
is compared with others batch by batch, and a pair is pruned as soon as the posterior chance that its similarity reaches
the threshold, given the matches so far, falls below the miss probability. Survivors are verified on full sets of the
shingles themselves; codes of 64 bits serve to find them only.

A band of m members does not give m^2 pairs, in rows or in copies:

* Nodes in bands of more than ``BAND_ROWS`` members leave those for stricter bands: more hashes to a band, more bands,
  under the same chance of a miss. Members that are only somewhat alike do not meet there.
* First each member is linked to the most central member that looks similar; these links, one a member and band at most,
  are verified and merged into components.
* Bands that still hold several components are dealt into tiles of bounded size with their texts. A tile compares members
  of different components only, verifies what is not pruned at once, and merges the components of a link before it goes
  on, so it gives fewer links than it has components. The members of a band's largest component meet the others, not
  each other.

Defined cases: a text without words, null or not, has an empty set and is linked with nothing; a null doc_id is never
linked and has a null component; rows with one doc_id are one document for links; very long texts are one class and one
set like others, whole; an empty table gives an empty result; further columns are carried by ``dedup``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm.common import connected_components, discard, keep_ids, salted_left_join, staged, table
from logquarry.llm.word_codes import mix, shingle_sets, shingles

HASHES = 128
#: Further hashes, of which stricter bands are made.
STRICT_HASHES = 512
#: Hashes compared at a time.
BATCHES = (16, 16, 32, 64)
#: Chance that a pair at the threshold shares no band, at most.
MISS_BAND = 1e-5
#: Posterior chance of a link below which a pair is pruned.
MISS_PRUNE = 1e-6
#: Members of a band that one task compares with each other or with as many others.
BAND_ROWS = 512
#: Pairs with one document that a task verifies.
VERIFY_ROWS = 256

_U = np.uint64
_ALL = HASHES + STRICT_HASHES
_MULTIPLIERS = ((mix(np.arange(1, _ALL + 1, dtype=np.uint64)) >> _U(32)).astype(np.uint32) | np.uint32(1))[:, None]


def min_hashes(codes: np.ndarray, first: int, n: int) -> np.ndarray:
    """The least of each of n hashes, counted from ``first``, over a set of 64-bit codes; 32 bits each."""
    folded = (codes ^ (codes >> _U(32))).astype(np.uint32)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(folded), 512):
        h = folded[at : at + 512] * _MULTIPLIERS[first : first + n]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        np.minimum(out, h.min(axis=1), out=out)
    return out


def band_shape(threshold: float, hashes: int) -> tuple[int, int]:
    """(hashes a band, bands): the most hashes for which ``hashes`` give enough bands, so that a pair at the threshold is
    missed with MISS_BAND at most; of one hash where none are enough."""
    for rows in range(24, 0, -1):
        bands = math.ceil(math.log(MISS_BAND) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if rows * bands <= hashes:
            return rows, hashes // rows if hashes == HASHES else bands
    return 1, hashes


@lru_cache(maxsize=8)
def prune_below(threshold: float) -> tuple[tuple[int, int], ...]:
    """(hashes seen, matches below which the posterior chance of a link is under MISS_PRUNE) after each batch.

    The prior is uniform; m of n match at similarity s with the binomial of s.
    """
    grid = (np.arange(4_000) + 0.5) / 4_000
    out, seen = [], 0
    for size in BATCHES:
        seen += size
        for m in range(seen + 1):
            density = m * np.log(grid) + (seen - m) * np.log1p(-grid)
            density = np.exp(density - density.max())
            if density[grid >= threshold].sum() >= MISS_PRUNE * density.sum():
                out.append((seen, m))
                break
    return tuple(out)


def survivors(one: np.ndarray, many: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of ``many`` are not pruned against ``one``, and how many of all their hashes match."""
    left, matches, at = np.arange(len(many)), np.zeros(len(many), np.int64), 0
    for seen, least in prune_below(threshold):
        matches = matches + (many[left, at:seen] == one[at:seen]).sum(axis=1)
        ok = matches >= least
        left, matches, at = left[ok], matches[ok], seen
        if not len(left):
            break
    return left, matches


def similar(x: set, y: set, percent: int) -> bool:
    both = len(x & y)
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def shingled(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, sha, signature) for every row of ``docs``; sha tells which words a text has, if any."""

    def shingle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 512):
                part = pdf.iloc[lo : lo + 512]
                texts = [t.lower() for t in part["text"]]
                sets = shingle_sets(texts, words)
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].astype("Int64"),
                        "n_shingles": [len(shingles(t, words)) for t in texts],
                        "sha": [hashlib.sha256(b" ".join(t.split())).digest() if len(s) else None for t, s in zip(texts, sets)],
                        "signature": [min_hashes(s, 0, HASHES).tobytes() if len(s) else None for s in sets],
                    }
                )

    return docs.select("doc_id", _bytes()).mapInPandas(shingle, "doc_id long, n_shingles long, sha binary, signature binary")


def _bytes() -> Column:
    return F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")


def _texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text): the texts of the documents ``nodes`` (node), each text of an id once."""
    texts = docs.select(F.col("doc_id").alias("node"), _bytes())
    return texts.join(nodes, "node", "left_semi").dropDuplicates(["node", "text"])


def _band_codes(hashes: np.ndarray, rows: int, bands: int, kind: int) -> np.ndarray:
    """A code for each band of each row of hashes."""
    sig = hashes.astype(np.uint64)
    codes = np.empty((len(sig), bands), np.int64)
    for b in range(bands):
        code = np.full(len(sig), kind * 1000 + b + 1, np.uint64)
        for c in range(b * rows, (b + 1) * rows):
            code = mix(code * _U(0x9E3779B97F4A7C15) ^ sig[:, c])
        codes[:, b] = code.view(np.int64)
    return codes


def _bands(threshold: float):
    shape = band_shape(threshold, HASHES)

    def bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            codes = _band_codes(np.frombuffer(b"".join(pdf["signature"]), np.uint32).reshape(len(pdf), HASHES), *shape, 0)
            for b in range(codes.shape[1]):
                yield pd.DataFrame({"node": pdf["node"], "band": codes[:, b]})

    return bands


def _strict_bands(threshold: float, words: int):
    rows, n = band_shape(threshold, STRICT_HASHES)

    def bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 512):
                part = pdf.iloc[lo : lo + 512]
                sets = shingle_sets(list(part["text"]), words)
                codes = _band_codes(np.array([min_hashes(s, HASHES, rows * n) for s in sets]), rows, n, 1)
                yield pd.DataFrame({"node": np.repeat(part["node"].to_numpy(), n), "band": codes.ravel()})

    return bands


def _groups(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of the runs of rows with one key, of a partition sorted by it. One run is held at a time."""
    held = None
    for pdf in batches:
        columns = {c: pdf[c].to_numpy() for c in pdf.columns}
        change = np.zeros(len(pdf), bool)
        for k in key:
            change[1:] |= columns[k][1:] != columns[k][:-1]
        edges = [*([0] if len(pdf) else []), *np.flatnonzero(change).tolist(), len(pdf)]
        for a, b in zip(edges, edges[1:]):
            piece = {c: v[a:b] for c, v in columns.items()}
            if held is not None and all(held[k][-1] == piece[k][0] for k in key):
                held = {c: np.concatenate([v, piece[c]]) for c, v in held.items()}
            else:
                if held is not None:
                    yield held
                held = piece
    if held is not None:
        yield held


def _pairs(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
    """Links of many groups, some thousand at a time."""
    heads, members, n = [], [], 0
    for a, b in found:
        heads.append(a)
        members.append(b)
        n += len(a)
        if n > 10_000:
            yield pd.DataFrame({"a": np.concatenate(heads), "b": np.concatenate(members)})
            heads, members, n = [], [], 0
    if n:
        yield pd.DataFrame({"a": np.concatenate(heads), "b": np.concatenate(members)})


def _signatures(rows: dict[str, np.ndarray]) -> np.ndarray:
    return np.frombuffer(b"".join(rows["signature"]), np.uint32).reshape(-1, HASHES)


def _central(sig: np.ndarray) -> int:
    """The row that agrees most with the commonest value of each column."""
    if len(sig) < 4:
        return 0
    by = np.sort(sig, axis=0)
    run = np.zeros(by.shape, np.int64)
    for i in range(1, len(by)):
        run[i] = np.where(by[i] == by[i - 1], run[i - 1] + 1, 0)
    common = np.take_along_axis(by, run.argmax(axis=0)[None], axis=0)[0]
    return int((sig == common).sum(axis=1).argmax())


def _first_links(threshold: float):
    """Each member to the most central member that looks similar; at most one link a member of a band."""

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for rows in _groups(batches, ["band", "block"]):
            ids, sig = rows["node"], _signatures(rows)
            left, scattered = np.arange(len(ids)), False
            while len(left) > 1:
                at = 0 if scattered else _central(sig[left])
                head, left = left[at], np.delete(left, at)
                some, matches = survivors(sig[head], sig[left], threshold)
                close = some[matches >= threshold * HASHES]
                scattered = not len(close)
                if len(close):
                    others = ids[left[close]]
                    others = others[others != ids[head]]
                    yield np.full(len(others), ids[head]), others
                    left = np.delete(left, close)

    return lambda batches: _pairs(links(batches))


class _Tile:
    """Members of a band, with their sets, and which of their components are one by now."""

    def __init__(self, rows: dict[str, np.ndarray], words: int, percent: int):
        self.words, self.percent = words, percent
        self.nodes = rows["node"]
        self.texts = [t.lower() for t in rows["text"]]
        self.signatures = _signatures(rows)
        sets = shingle_sets(self.texts, words)
        self.size = np.array([len(s) for s in sets])
        self.start = np.cumsum(self.size) - self.size
        found, self.codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(found), bool)
        _, self.component = np.unique(rows["component"], return_inverse=True)
        self.known: dict[int, set] = {}

    def _set(self, i: int) -> set:
        if len(self.known) > 64:
            self.known.clear()
        if i not in self.known:
            self.known[i] = shingles(self.texts[i], self.words)
        return self.known[i]

    def links(self, i: int, others: np.ndarray) -> Iterator[tuple[int, int]]:
        """Verified links of member i to ``others``, one for each component that it joins."""
        others = others[self.component[others] != self.component[i]]
        if not len(others):
            return
        left, _ = survivors(self.signatures[i], self.signatures[others], self.percent / 100)
        others = others[left]
        if not len(others):
            return
        own = self.codes[self.start[i] : self.start[i] + self.size[i]]
        self.mark[own] = True
        if 4 * len(others) > len(self.size):
            both = np.add.reduceat(self.mark[self.codes].astype(np.int32), self.start)[others]
        else:
            both = np.array([self.mark[self.codes[self.start[j] : self.start[j] + self.size[j]]].sum() for j in others])
        self.mark[own] = False
        union = self.size[i] + self.size[others] - both
        order = np.argsort(-both / union, kind="stable")
        for j in others[order][(100 * both >= self.percent * union)[order]].tolist():
            if self.component[i] != self.component[j] and similar(self._set(i), self._set(j), self.percent):
                self.component[self.component == self.component[j]] = self.component[i]
                yield int(self.nodes[i]), int(self.nodes[j])


def _cross_links(words: int, percent: int):
    """Links between the components that meet in a tile. y is the block that is compared with block x, or with itself."""

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for rows in _groups(batches, ["band", "x", "y"]):
            x, y = rows["x"][0], rows["y"][0]
            asked, given = np.flatnonzero(rows["block"] == y), np.flatnonzero(rows["block"] != y)
            if not len(asked) or (rows["component"] == rows["component"][0]).all():
                continue
            tile = _Tile(rows, words, percent)
            found = [
                pair for k, i in enumerate(asked.tolist()) for pair in tile.links(i, asked[k + 1 :] if x == y else given)
            ]
            if found:
                yield tuple(np.array(found, np.int64).T)

    return lambda batches: _pairs(links(batches))


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes of which any texts are similar, on full sets."""
    degree = pairs.groupBy("a").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("b"), F.greatest(F.lit(1), F.ceil(F.col("n") / VERIFY_ROWS)))
    dealt = salted_left_join(pairs, degree, "a", F.col("b"), salts=8).select("a", "b", part.alias("part"))
    right = dealt.join(texts.toDF("b", "text"), "b").select("a", "part", "b", "text")
    left = dealt.select("a", "part").distinct().join(texts.toDF("a", "text"), "a").toDF("one", "one_part", "one_text")

    def verify(one: pd.DataFrame, many: pd.DataFrame) -> pd.DataFrame:
        own = [shingles(t.lower(), words) for t in one["one_text"]]
        rows = []
        for b, text in zip(many["b"], many["text"]):
            other = shingles(text.lower(), words)
            if any(similar(x, other, percent) for x in own):
                rows.append((one["one"].iloc[0], b))
        return pd.DataFrame(rows, columns=["a", "b"])

    return left.groupBy("one", "one_part").cogroup(right.groupBy("a", "part")).applyInPandas(verify, "a long, b long")


def _crowded(bands: DataFrame) -> DataFrame:
    """(node, band, m) for bands of m > 1 members."""
    full = bands.groupBy("band").agg(F.count("*").alias("m")).where("m > 1")
    return salted_left_join(bands, full, "band", F.col("node"), salts=8).where("m IS NOT NULL")


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    component_id is the least doc_id that can be reached over links of a Jaccard similarity of percent / 100 or more.
    """
    threshold = percent / 100
    rows = staged(shingled(docs, words), "shingled")
    named = rows.where("sha IS NOT NULL AND doc_id IS NOT NULL")
    classes = staged(
        named.groupBy("sha").agg(F.min("doc_id").alias("node"), F.count("*").alias("n"), F.first("signature").alias("signature")),
        "classes",
    )
    wide = staged(_crowded(classes.mapInPandas(_bands(threshold), "node long, band long").distinct()), "bands")
    hot = wide.where(F.col("m") > BAND_ROWS).select("node").distinct()
    strict = _texts_of(docs, hot).mapInPandas(_strict_bands(threshold, words), "node long, band long").distinct()
    shared = staged(wide.where(F.col("m") <= BAND_ROWS).union(_crowded(strict).select(wide.columns)), "shared")
    discard(wide)
    nodes = shared.select("node").distinct()
    signatures = classes.select("node", "signature").join(nodes, "node", "left_semi")
    texts = staged(_texts_of(docs, nodes), "texts")

    def blocks(n: Column) -> Column:
        return F.ceil(n / BAND_ROWS).cast("int")

    def dealt(n: Column) -> Column:
        return F.pmod(F.xxhash64("node", "band"), n).cast("int")

    first = (
        shared.select("band", "node", dealt(blocks(F.col("m"))).alias("block"))
        .join(signatures, "node")
        .repartition("band", "block")
        .sortWithinPartitions("band", "block", "node")
        .mapInPandas(_first_links(threshold), "a long, b long")
        .distinct()
    )
    first = staged(first, "first")
    links = staged(_verified(first, texts, words, percent), "links")
    discard(first)
    parts = connected_components(links)

    placed = shared.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = staged(placed.select("band", "node", "component"), "placed")
    # Of a band with several components: its largest one is dealt to blocks below ``main``, all others to those from there on.
    sizes = placed.groupBy("band", "component").agg(F.count("*").alias("n")).groupBy("band")
    sizes = sizes.agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("m")).where("top.n < m")
    mixed = sizes.select(
        "band",
        F.col("top.component").alias("main_component"),
        blocks(F.col("top.n")).alias("main"),
        blocks(F.col("m") - F.col("top.n")).alias("others"),
    )
    in_main = F.col("component") == F.col("main_component")
    crossed = salted_left_join(placed, mixed, "band", F.col("node"), salts=8).where("main IS NOT NULL")
    crossed = crossed.withColumn(
        "block", F.when(in_main, dealt(F.col("main"))).otherwise(F.col("main") + dealt(F.col("others")))
    )
    last = F.col("main") + F.col("others") - 1
    later = F.transform(
        F.sequence(F.greatest("block", "main"), last), lambda y: F.struct(F.col("block").alias("x"), y.alias("y"))
    )
    earlier = F.transform(
        F.filter(F.sequence(F.lit(0), F.col("block")), lambda x: x < F.col("block")),
        lambda x: F.struct(x.alias("x"), F.col("block").alias("y")),
    )
    tiles = F.explode(F.when(in_main, later).otherwise(F.concat(later, earlier)))
    found = (
        crossed.select("band", "node", "component", "block", tiles.alias("tile"))
        .select("band", "node", "component", "block", "tile.x", "tile.y")
        .join(signatures, "node")
        .join(texts, "node")
        .repartition("band", "x", "y")
        .sortWithinPartitions("band", "x", "y", "node")
        .mapInPandas(_cross_links(words, percent), "a long, b long")
        .distinct()
    )
    # Texts of one id are one document.
    ids = named.groupBy("doc_id", "sha").agg(F.lit(1).alias("one")).join(classes.select("sha", "node"), "sha")
    ends = ids.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b")
    again = ids.join(ends, "doc_id").select("a", F.col("node").alias("b"))
    links = staged(links.union(found).union(again), "all-links")
    discard(placed, shared, texts)
    parts = connected_components(links)

    # What each class of several documents, or of a larger component, is called; copies may be many, so they are salted.
    called = classes.join(parts, "node", "left").where("n > 1 OR component IS NOT NULL")
    called = called.select("sha", F.coalesce("component", "node").alias("component"))
    out = salted_left_join(rows.select("doc_id", "n_shingles", "sha"), called, "sha", F.col("doc_id"))
    return out.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    )


def dedup(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of its group, with all their columns; rows without an id stay."""
    kept = near_groups(docs, words, percent).where("component_id IS NULL OR doc_id = component_id")
    return keep_ids(docs, kept.select("doc_id").distinct())


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(table(spark, sf_dir, "documents"), words=3, percent=85)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
