"""Exact top-k inner-product search with an impact-ordered index, score at a time.

Vectors become integers and are dealt over shards. A shard's index holds a posting segment for each dimension and signed
quantised impact. A query walks a shard's segments by descending |weight| x impact and adds them to accumulators; what
segments can still add to any one score is bounded by what they hold at most. It stops only when that bound proves that
all members of the answer are among few enough accumulators (or nothing is left to walk), and scores those exactly.

Defined cases: a null id, a null vector and a vector with null or non-finite components take no part; every row is a
candidate, and a query, of its own, whatever ids it shares: only the query's own row is left out of its answer; vectors
of another length than the query's take no part in it; ties go to the smaller id; an empty table gives an empty result;
further columns play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logquarry.llm.common import staged, table

SHARD_ROWS = 16_384
#: Queries that a shard answers in one task: the least, for enough tasks, and the most, as the index is copied for each.
QUERY_ROWS, MOST_QUERY_ROWS = 256, 8_192
LEVELS = 16
#: Looks at the bound in the course of a query, at most.
LOOKS = 8
#: An accumulator's exact score costs as much as so many postings for each dimension, about.
RESCORE = 0.05

INDEX = "shard int, dims int, keys binary, ids binary, vectors binary, width long, seg_dim binary, seg_level binary, seg_at binary, postings binary"


def quantised(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(key, id, v): floor(scale * x) of every usable vector, written; ``key`` is another for each row."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    usable = rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad)
    return staged(usable.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("id"), v.alias("v")), "vectors")


def build_index(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard's index, one row for each length of vectors."""
    shard, out = int(pdf["shard"].iloc[0]), []
    for dims, rows in pdf.groupby(pdf["v"].map(len)):
        rows = rows.sort_values(["id", "key"])
        x = np.array(rows["v"].tolist(), np.int64).reshape(len(rows), dims)
        width = int(np.abs(x).max(initial=0)) // LEVELS + 1
        level = np.sign(x) * (np.abs(x) // width)
        doc, dim = np.nonzero(level)
        level = level[doc, dim]
        order = np.lexsort((doc, level, dim))
        doc, dim, level = doc[order], dim[order], level[order]
        new = np.flatnonzero((np.diff(dim, prepend=-1) != 0) | (np.diff(level, prepend=0) != 0))
        narrow = next(t for t in ("<i2", "<i4", "<i8") if t == "<i8" or np.abs(x).max(initial=0) <= np.iinfo(t).max)
        out.append(
            (
                shard,
                int(dims),
                rows["key"].to_numpy("<i8").tobytes(),
                rows["id"].to_numpy("<i8").tobytes(),
                narrow.encode() + x.astype(narrow).tobytes(),
                width,
                dim[new].astype("<i4").tobytes(),
                level[new].astype("<i4").tobytes(),
                np.append(new, len(doc)).astype("<i8").tobytes(),
                doc.astype("<i4").tobytes(),
            )
        )
    return pd.DataFrame(out, columns=[c.split()[0] for c in INDEX.split(", ")])


class Shard:
    def __init__(self, row):
        self.keys, self.ids = np.frombuffer(row.keys, "<i8"), np.frombuffer(row.ids, "<i8")
        self.x = np.frombuffer(row.vectors[3:], row.vectors[:3].decode()).reshape(len(self.ids), row.dims).astype(np.int64)
        self.peak = int(np.abs(self.x).max(initial=0))
        self.floats = self.x.astype(float)
        self.width = row.width
        self.dim, self.level = np.frombuffer(row.seg_dim, "<i4"), np.frombuffer(row.seg_level, "<i4")
        self.at = np.frombuffer(row.seg_at, "<i8")
        self.postings = np.frombuffer(row.postings, "<i4").astype(np.intp)

    def exact(self, docs: np.ndarray, q: np.ndarray) -> np.ndarray:
        if float(np.abs(q).max(initial=0)) * self.peak * max(1, len(q)) < 2**53:
            return (self.floats[docs] @ q.astype(float)).astype(np.int64)
        return self.x[docs] @ q

    def top(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best but the query's own row."""
        w, weight = self.width, np.abs(q).astype(float)
        impact = weight[self.dim] * (np.abs(self.level) * w)
        order = np.argsort(-impact, kind="stable")
        size = (self.at[1:] - self.at[:-1])[order]
        left = int(size.sum())
        add = q[self.dim] * np.sign(self.level) * (np.abs(self.level) * w + (w - 1) / 2)
        acc = np.zeros(len(self.ids))
        me = np.flatnonzero(self.keys == own)
        look = max(1, len(order) // LOOKS)
        for lo in range(0, len(order) + 1, look):
            for s in order[lo : lo + look]:
                acc[self.postings[self.at[s] : self.at[s + 1]]] += add[s]
            left -= int(size[lo : lo + look].sum())
            rest = order[lo + look :]
            bound = np.full(len(q), w - 1.0)
            np.maximum.at(bound, self.dim[rest], np.abs(self.level[rest]) * w + (w - 1.0))
            error = float(weight @ bound) + 1
            acc[me] = -np.inf
            if len(acc) > k:
                best = np.argpartition(acc, -k)[-k:]
                floor = self.exact(best[acc[best] > -np.inf], q).min(initial=np.iinfo(np.int64).max)
                members = np.flatnonzero(acc + error >= floor)
            else:
                members = np.flatnonzero(acc > -np.inf)
            if len(members) * len(q) * RESCORE <= left or not len(rest):
                break
        members = members[self.keys[members] != own]
        scores = self.exact(members, q)
        first = np.lexsort((self.ids[members], -scores))[:k]
        return self.ids[members][first], scores[first]


def top_k(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of ``rows``; both are (key, id, v), written tables or parts of one."""
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    asked = queries.count()
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-asked // MOST_QUERY_ROWS), min(-(-asked // QUERY_ROWS), -(-tasks // shards)))
    deal = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")
    index = staged(rows.withColumn("shard", deal).groupBy("shard").applyInPandas(build_index, INDEX), "index")
    asked = (
        queries.groupBy(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))
        .agg(F.collect_list(F.struct("key", "id", "v")).alias("asked"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    )
    copies = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(held: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in held.itertuples():
            shard = Shard(row)
            for batch in block["asked"]:
                for one in batch:
                    if len(one["v"]) == row.dims:
                        ids, scores = shard.top(one["key"], np.array(one["v"], np.int64), k)
                        out.append(pd.DataFrame({"query_key": one["key"], "query_id": one["id"], "vec_id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_key": [], "query_id": [], "vec_id": [], "score": []})

    found = (
        copies.groupBy("shard", "block")
        .cogroup(asked.groupBy("shard", "block"))
        .applyInPandas(search, "query_key long, query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256)
    return top_k(rows, rows.where("id % 50 = 0"), 5)


OP1_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS i, vec_id,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.i, q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.i <> c.i WHERE q.vec_id % 50 = 0
),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id) AS rn FROM s)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM r WHERE rn <= 5
"""
