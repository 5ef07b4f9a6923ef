import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logquarry.llm import quality, secret_scans, topk_search
from logquarry.llm.queries import QUERIES, SQL
from tests.llm import brute
from tests.oracle import rows_of_df, rows_of_sql

SF = "/root/testdata/sf0.001"


def brute_top(vectors, k):
    ints = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, v in vectors]
    out = []
    for n, (q, a) in enumerate(ints):
        if q % 50 == 0:
            scores = [(-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(ints) if m != n and len(b) == len(a)]
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard", [7, 64, 10_000])
def test_top_k_is_exact(spark, monkeypatch, shard):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(0, 0.2, 16).round(2)]) for i in range(300)]
    rows += [(i, rows[i - 300][1]) for i in range(300, 340)]
    odd = [(400, None), (401, [0.1, None] * 8), (402, [float("nan")] * 16), (403, [float("inf")] * 16), (None, [0.1] * 16)]
    odd += [(450, [0.5] * 3), (451, [0.25] * 3), (500, [])]
    again = [(0, rows[0][1]), (50, rows[50][1]), (50, rows[51][1]), (77, rows[50][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + odd + again], "vec_id long, embedding array<float>, score int, v string")
    monkeypatch.setattr(topk_search, "SHARD_ROWS", shard)
    monkeypatch.setattr(topk_search, "QUERY_ROWS", 3)
    ints = topk_search.quantised(df, "vec_id", "embedding", 256)
    got = topk_search.top_k(ints, ints.where("id % 50 = 0"), 5).collect()
    assert sorted(map(tuple, got)) == brute_top(rows + odd[-3:] + again, 5)
    none = df.limit(0)
    ints = topk_search.quantised(none, "vec_id", "embedding", 256)
    assert topk_search.top_k(ints, ints, 5).count() == 0


def test_top_k_stops_before_all_segments_are_walked():
    r = np.random.default_rng(4)
    import pandas as pd

    centres = r.normal(0, 40, (20, 32))
    x = (centres[r.integers(0, 20, 2000)] + r.normal(0, 8, (2000, 32))).astype(int)
    pdf = pd.DataFrame({"shard": 0, "key": np.arange(2000), "id": np.arange(2000), "v": list(x)})
    shard = topk_search.Shard(next(topk_search.build_index(pdf).itertuples()))
    for q in range(0, 2000, 400):
        ids, scores = shard.top(q, x[q].astype(np.int64), 5)
        exact = x @ x[q]
        exact[q] = -(10**9)
        want = np.lexsort((np.arange(2000), -exact))[:5]
        assert ids.tolist() == want.tolist() and scores.tolist() == exact[want].tolist()


def test_top_k_query(spark):
    assert rows_of_df(QUERIES["op1_topk_search"](spark, SF)) == rows_of_sql(SQL["op1_topk_search"], SF)


def brute_spans(text):
    kinds = [
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        ("access", r"AKIA[A-Z0-9]+", 0, 16),
        ("hex", r"[0-9a-f]+", 0, 32),
    ] + [(r.kind, r.regex, 0, 1) for r in secret_scans.ADDED]
    found = [
        (m.start(), n, m.end(), kind)
        for n, (kind, regex, group, least) in enumerate(kinds)
        for m in re.finditer(regex, text)
        if len(m[group]) >= least
    ]
    return sorted(found)


def test_secret_spans(spark):
    docs = brute.frame(spark)
    got = secret_scans.with_spans(docs)
    name = got.columns[-1]
    assert got.columns[:-1] == docs.columns
    rows = Counter((r["doc_id"], r["text"], tuple(map(tuple, r[name]))) for r in got.collect())
    assert rows == Counter((r[0], r[1], tuple(brute_spans(r[1] or ""))) for r in brute.documents())
    assert any(spans for _, _, spans in rows)
    assert secret_scans.with_spans(brute.empty(spark)).count() == 0


def test_redaction_takes_the_secrets_out(spark):
    docs = brute.frame(spark)
    got = secret_scans.redact(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    for r in got.collect():
        assert not [s for s in brute_spans(r["text"] or "") if s[3] != "assign"]
        assert "hunter22" not in (r["text"] or "")
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    clean = {(r[0], r[1]) for r in brute.documents() if not brute_spans(r[1] or "")}
    assert clean == {(r["doc_id"], r["text"]) for r in got.collect()} & clean


def test_trigram_queries():
    query = secret_scans.trigram_query
    assert query("[0-9a-f]{32,}") == []
    assert query("AKIA[A-Z0-9]+") == [[["aki", "kia"]]]
    assert query("abc.*(def|xyz)") == [[["abc"]], [["def"], ["xyz"]]]
    assert query("(ab|c)d") == []


def test_secret_query_on_the_tables(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op10_secret_scans"](spark, SF).collect():
        spans = brute_spans(texts[r["doc_id"]])
        base = ",".join(f"{k}:{a}:{b}" for a, n, b, k in spans if n < 3)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[1] == n for s in spans) for n in range(3))


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.where(F.xxhash64("doc_id") % 3 != 0)
    held = labels.where(F.xxhash64("doc_id") % 3 == 0)
    out = docs.withColumn("s", quality.scored(docs, quality.fit(docs, seen)))
    rows = out.join(held, "doc_id").select("quality", (F.col("s.score") >= quality.CUT).cast("int").alias("keep")).collect()
    right = sum(r["quality"] == r["keep"] for r in rows)
    assert len(rows) > 100 and right >= 0.97 * len(rows)
    clean = [r for r in rows if r["quality"]]
    assert sum(r["keep"] for r in clean) >= 0.99 * len(clean)


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(1, None), (None, 1), (999, 1)], "doc_id long, quality int")
    docs = brute.frame(spark)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    assert quality.keep_good(docs, labels.limit(0)).count() == docs.count()
    assert quality.keep_good(docs.drop("lang", "source", "n_chars"), labels).columns == ["doc_id", "text", "sha", "spans", "component"]
    assert quality.keep_good(brute.empty(spark), labels).count() == 0


def test_co_training_learns_both_views():
    r = np.random.default_rng(1)
    random.seed(1)
    y = r.integers(0, 2, 3000)
    text = r.normal(0, 1, (3000, 5)) + y[:, None]
    meta = np.stack([r.random(3000) < 0.3 + 0.4 * y, r.random(3000) < 0.5], axis=1).astype(float)
    label = np.where(np.arange(3000) < 600, y, -1)
    model = quality.co_train(text, meta, label)
    _, p_meta, score = model.scores(text[600:], meta[600:])
    assert ((score >= 0.5) == y[600:]).mean() > 0.85
    assert ((p_meta >= 0.5) == y[600:]).mean() > 0.6
    assert quality.co_train(text, meta, np.full(3000, -1)) is None
