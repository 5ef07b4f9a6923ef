"""Source divergence audit: how far each source of a language is from each other one, and which terms set it apart.

Words are counted by language and source before anything is shuffled. The terms in at least three documents of a language
are kept, and a group (language, source) gives each of them p, its smoothed share in units of 1e-9, also those that it
does not hold. A group's divergence from q is the sum of floor((p - q)^2 / q) over all kept terms, all in whole numbers.

Two-dimensional tiling for the pairs. The groups of a language are dealt into blocks, its kept terms into chunks; the
counts of a block in a chunk are one packed row of sparse vectors. Each row is copied to the tiles of its block with every
other, and Spark sorts a tile's rows by chunk; a task reads them as a stream and adds up its submatrix, one chunk after
the other, both directions at once. Long vocabularies are cut into slabs of chunks whose sums are added, so that no task
holds more than two blocks of one chunk or reads more than one slab.

Defined cases: null text, lang and source count as ''; a group whose documents have no terms takes part with counts of 0; a
language that keeps no term gives pairs of value 0; a language with one source gives no pairs; repeated rows count each;
long texts are counted whole; an empty table gives an empty result; further columns play no part.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logquarry.llm.common import salted_left_join, staged, table

#: Documents of a language that must hold a kept term; terms listed for a group.
MIN_DOCS, TOP_TERMS = 3, 200
SCALE = 1_000_000_000
#: Groups in a block, kept terms in a chunk, entries that one task packs, chunks in a slab.
BLOCK, CHUNK_TERMS, CHUNK_ENTRIES, SLAB = 16, 8_192, 200_000, 64
#: Different terms by group that a task holds before it gives them on.
HELD = 300_000
#: ASCII letters in lower case, further bytes of UTF-8 as they are, all else a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): partial counts, and one row without a term for each group that a task met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
        in_docs: dict[tuple[str, str], Counter] = defaultdict(Counter)
        held = 0
        for batch in batches:
            rows = zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"])
            for lang, source, text in rows:
                words = text.as_buffer().to_pybytes().translate(_LETTERS).split()
                n, own = counts[lang, source], in_docs[lang, source]
                held -= len(n)
                n.update(words)
                own.update(set(words))
                held += len(n)
                if held > HELD:
                    yield from given(counts, in_docs)
                    counts.clear()
                    in_docs.clear()
                    held = 0
        yield from given(counts, in_docs)

    def given(counts: dict, in_docs: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), n in counts.items():
            size = len(n) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * size, pa.string()),
                    pa.array([source] * size, pa.string()),
                    pa.array([None, *n], pa.binary()).cast(pa.string()),
                    pa.array([0, *n.values()], pa.int64()),
                    pa.array([0, *map(in_docs[lang, source].__getitem__, n)], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )

    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source", "text")]
    rows = docs.select(blank[0].alias("lang"), blank[1].alias("source"), blank[2].cast("binary").alias("text"))
    return rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def kept_counts(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, source, term, n, lang_n, is_first): kept terms by group; ``is_first`` marks one row a term of a language."""
    parts = term_counts(docs).repartition("lang", "term")
    sums = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    ordered = Window.partitionBy("lang", "term").orderBy("source")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        sums.withColumn("lang_n", F.sum("n").over(whole))
        .withColumn("lang_docs", F.sum("docs").over(whole))
        .withColumn("is_first", F.row_number().over(ordered) == 1)
        .where((F.col("lang_docs") >= min_docs) | F.col("term").isNull())
        .select("lang", "source", "term", "n", "lang_n", "is_first")
    )


def groups_of(counts: DataFrame, block: int, chunk_terms: int, chunk_entries: int) -> DataFrame:
    """One row a group: its place in its language, and the totals that its terms' shares are made of."""
    own = counts.groupBy("lang", "source").agg(
        F.sum("n").alias("n_terms"),
        F.count("term").alias("entries"),
        F.sum((F.col("is_first") & F.col("term").isNotNull()).cast("long")).alias("first"),
    )
    ordered = Window.partitionBy("lang").orderBy("source")
    lang = Window.partitionBy("lang")
    kept = F.sum("first").over(lang)
    chunks = F.greatest(F.ceil(kept / chunk_terms), F.ceil(F.sum("entries").over(lang) / chunk_entries), F.lit(1))
    return own.select(
        "lang",
        "source",
        (F.row_number().over(ordered) - 1).alias("place"),
        F.ceil(F.count("*").over(lang) / block).cast("int").alias("blocks"),
        chunks.cast("int").alias("chunks"),
        (F.col("n_terms") + kept).alias("total"),
        (F.sum("n_terms").over(lang) + kept).alias("lang_total"),
    )


def share(count: Column, total: Column) -> Column:
    """1 + floor(1e9 * (count + 1) / total), three digits at a time, so that nothing overflows."""
    rest, out = count + 1, F.lit(0).cast("long")
    for _ in range(3):
        out = out * 1000 + F.call_function("div", rest * 1000, total)
        rest = (rest * 1000) % total
    return out + 1


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """``share`` of each count."""
    rest, out = counts + 1, np.zeros(len(counts), np.int64)
    for _ in range(3):
        out = out * 1000 + rest * 1000 // total
        rest = rest * 1000 % total
    return out + 1


def top_terms(entries: DataFrame, top: int) -> DataFrame:
    """The terms that a group has more of than its language, largest divergence first."""
    p = entries.where("n > 0").withColumn("p", share(F.col("n"), F.col("total"))).withColumn("q", share(F.col("lang_n"), F.col("lang_total")))
    value = F.expr("(p - q) * (p - q) div q")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (
        p.where("p > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value"))
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= top)
    )


def packed_chunks(entries: DataFrame, block: int) -> DataFrame:
    """(lang, chunk, block, terms, blob): for each block the counts of one chunk's terms, which every block numbers alike."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lang, chunk = key
        codes, terms = pd.factorize(pdf["term"])
        place = pdf["place"].to_numpy(np.int64)
        order = np.lexsort((codes, place))
        codes, place, n = codes[order].astype("<u4"), place[order], pdf["n"].to_numpy("<i8")[order]
        rows = []
        for b in range(int(pdf["blocks"].iat[0])):
            lo, hi = np.searchsorted(place, [b * block, (b + 1) * block])
            sizes = np.bincount(place[lo:hi] - b * block, minlength=block).astype("<u4")
            rows.append((lang, chunk, b, len(terms), sizes.tobytes() + codes[lo:hi].tobytes() + n[lo:hi].tobytes()))
        return pd.DataFrame(rows, columns=["lang", "chunk", "block", "terms", "blob"])

    chunk = F.pmod(F.xxhash64("term"), F.col("chunks").cast("long")).cast("int")
    dealt = entries.select("lang", chunk.alias("chunk"), "term", "place", "n", "blocks")
    return dealt.groupBy("lang", "chunk").applyInPandas(pack, "lang string, chunk int, block int, terms int, blob binary")


def pair_sums(groups: DataFrame, chunks: DataFrame, block: int, slab: int) -> DataFrame:
    """(lang, source, item, value) for ordered pairs of a language's groups, a row for each slab of chunks."""

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                now = (row["lang"], row["left"], row["right"], row["slab"])
                if now != key:
                    if own:
                        yield own.rows()
                    key, own = now, Tile(*now[:3], block)
                own.add(row)
        if own:
            yield own.rows()

    cut = F.floor(F.col("chunk") / slab).cast("int")
    heads = (
        groups.withColumn("block", F.floor(F.col("place") / block).cast("int"))
        .groupBy("lang", "block", "blocks", "chunks")
        .agg(F.array_sort(F.collect_list(F.struct("place", "source", "total"))).alias("members"))
        .withColumn("slab", F.explode(F.sequence(F.lit(0), F.floor((F.col("chunks") - 1) / slab).cast("int"))))
        .select("lang", "block", "blocks", "slab", F.lit(-1).alias("chunk"), "members", F.lit(0).alias("terms"), F.lit(None).cast("binary").alias("blob"))
    )
    blocks = groups.groupBy("lang").agg(F.max("blocks").alias("blocks"))
    vectors = salted_left_join(chunks, blocks, "lang", F.col("chunk")).select(
        "lang", "block", "blocks", cut.alias("slab"), "chunk", F.lit(None).cast("array<struct<place:int,source:string,total:bigint>>").alias("members"), "terms", "blob"
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = (
        heads.union(vectors)
        .withColumn("other", other)
        .withColumn("left", F.least("block", "other"))
        .withColumn("right", F.greatest("block", "other"))
        .select("lang", "left", "right", "slab", "chunk", "block", "members", "terms", "blob")
        .repartition("lang", "left", "right", "slab")
        .sortWithinPartitions("lang", "left", "right", "slab", "chunk", "block")
    )
    return tiles.mapInArrow(tile, "lang string, source string, item string, value long")


class Tile:
    """The sums of one pair of blocks, added up from their packed rows in the order of chunks."""

    def __init__(self, lang: str, left: int, right: int, block: int):
        self.lang, self.left, self.right, self.block = lang, left, right, block
        self.members: dict[int, list[dict]] = {}
        self.held: np.ndarray | None = None
        self.there = self.back = None

    def add(self, row: dict) -> None:
        if row["blob"] is None:
            self.members[row["block"]] = row["members"]
            return
        p = self._dense(row)
        if self.left == self.right:
            self._meet(p, p)
        elif row["block"] == self.left:
            self.held = p
        else:
            self._meet(self.held, p)

    def _dense(self, row: dict) -> np.ndarray:
        members, blob = self.members[row["block"]], row["blob"]
        sizes = np.frombuffer(blob, "<u4", self.block).astype(np.int64)
        codes = np.frombuffer(blob, "<u4", sizes.sum(), 4 * self.block)
        n = np.frombuffer(blob, "<i8", sizes.sum(), 4 * (self.block + len(codes)))
        out, at = np.zeros((len(members), row["terms"]), np.int64), 0
        for i, (m, size) in enumerate(zip(members, sizes.tolist())):
            out[i] = shares(np.zeros(1, np.int64), m["total"])[0]
            out[i, codes[at : at + size]] = shares(n[at : at + size], m["total"])
            at += size
        return out

    def _meet(self, left: np.ndarray, right: np.ndarray) -> None:
        if self.there is None:
            self.there, self.back = (np.zeros((len(left), len(right)), np.int64) for _ in range(2))
        for i, p in enumerate(left):
            square = (p - right) ** 2
            self.there[i] += (square // right).sum(axis=1)
            if self.left != self.right:
                self.back[i] += (square // p).sum(axis=1)

    def rows(self) -> pa.RecordBatch:
        left, right = ([m["source"] for m in self.members[b]] for b in (self.left, self.right))
        if self.there is None:
            self.there, self.back = (np.zeros((len(left), len(right)), np.int64) for _ in range(2))
        out = [(a, b, v) for a, row in zip(left, self.there.tolist()) for b, v in zip(right, row) if a != b]
        if self.left != self.right:
            out += [(b, a, v) for a, row in zip(left, self.back.tolist()) for b, v in zip(right, row)]
        columns = list(zip(*out)) or [(), (), ()]
        return pa.RecordBatch.from_arrays(
            [pa.array([self.lang] * len(out), pa.string())]
            + [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))],
            names=["lang", "source", "item", "value"],
        )


def audit(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    top: int = TOP_TERMS,
    block: int = BLOCK,
    chunk_terms: int = CHUNK_TERMS,
    chunk_entries: int = CHUNK_ENTRIES,
    slab: int = SLAB,
) -> DataFrame:
    """(lang, source, part, item, value, rank) for ``docs`` (text, lang, source)."""
    counts = staged(kept_counts(docs, min_docs), "kept-terms")
    groups = staged(groups_of(counts, block, chunk_terms, chunk_entries), "groups")
    key = F.struct("lang", "source")
    totals = groups.withColumn("group", key).drop("lang", "source")
    terms = counts.where("term is not null").withColumn("group", key)
    entries = salted_left_join(terms, totals, "group", F.col("term")).drop("group")
    pairs = pair_sums(groups, packed_chunks(entries, block), block, slab)
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = (
        pairs.repartition("lang", "source")
        .groupBy("lang", "source", "item")
        .agg(F.sum("value").alias("value"))
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    )
    return pairs.union(top_terms(entries, top).select(pairs.columns))


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), w AS (
  SELECT i, lang, source, unnest(words) AS term FROM d
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 3
), g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS lang_total FROM kept GROUP BY lang),
c AS (
  SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL
), t AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (t.total + v.v) AS p,
         1 + (1000000000::HUGEINT * (kept.lang_n + 1)) // (v.lang_total + v.v) AS q
  FROM g JOIN kept USING (lang) JOIN v USING (lang) JOIN t USING (lang, source)
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value
  FROM p WHERE n > 0 AND p > q
)
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
) WHERE part = 'pair' OR rank <= 200
"""
