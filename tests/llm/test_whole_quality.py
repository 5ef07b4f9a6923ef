import numpy as np
from pyspark.sql import functions as F

from logquarry.llm import quality


def test_every_unlabelled_document_takes_part(spark, monkeypatch):
    """Beyond the 6,000 that were a cap once; the last bits of the sums may differ between partitionings."""
    docs = spark.range(0, 6_400, 1, 8).select(
        F.col("id").alias("doc_id"), F.concat(F.when(F.col("id") % 2 == 0, "good words here ").otherwise("zz zz zz "), "id").alias("text")
    )
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(100)], "doc_id long, quality int")
    pools, real = [], quality.co_train

    def co_train(text, meta, label, rounds=quality.ROUNDS, pool=None):
        pools.append(pool.total(lambda t, m: np.array([float(len(t)), t.sum()])))
        return real(text, meta, label, 1, pool)

    monkeypatch.setattr(quality, "co_train", co_train)
    model = quality.fit(docs, labels)
    assert pools[0][0] == 6_300
    monkeypatch.setattr(quality, "SUM_ROWS", 1)
    again = quality.fit(docs, labels)
    assert np.allclose(pools[0], pools[1])
    assert np.allclose(model.text.weights, again.text.weights)


def test_all_sure_rows_are_given_each_round():
    r = np.random.default_rng(3)
    y = r.integers(0, 2, 4000)
    text, meta = (r.normal(0, 0.3, (4000, 3)) + 4 * y[:, None] for _ in range(2))
    label = np.where(np.arange(4000) < 400, y, -1)
    counts = []

    class Counting(quality.Rows):
        def total(self, term):
            out = super().total(term)
            if len(out) == 7:
                counts.append(out[0])
            return out

    quality.co_train(text[:400], meta[:400], label[:400], 2, Counting(text[400:], meta[400:]))
    assert len(counts) == 4 and min(counts) > 3000
