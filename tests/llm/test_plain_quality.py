"""The registered query of the quality classifier against co-training written out over whole arrays."""

import numpy as np

from logquarry.llm import quality
from logquarry.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def plain_logistic(x, y, weight, penalty):
    """Weighted logistic regression with a ridge on all but the intercept, by damped Newton steps to the end."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.append(np.full(x.shape[1] - 1, penalty), 1e-6)

    def loss(b):
        z = np.clip(x @ b, -30, 30)
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + (ridge * b * b).sum() / 2

    b = np.zeros(x.shape[1])
    for _ in range(200):
        p = sigmoid(x @ b)
        step = np.linalg.solve((x.T * (weight * np.maximum(p * (1 - p), 1e-6))) @ x + np.diag(ridge), x.T @ (weight * (p - y)) + ridge * b)
        size = 1.0
        while loss(b - size * step) > loss(b) and size > 1e-9:
            size /= 2
        b = b - size * step
        if np.abs(step).max() < 1e-10:
            break
    return b


def plain_view(x, y, held, held_y, more_x, more_y):
    weight = 0.5 * min(1, len(x) / len(more_x)) if len(more_x) else 0
    rows, w = np.vstack([x, more_x]), np.append(np.ones(len(x)), np.full(len(more_x), weight))
    mean = (rows * w[:, None]).sum(axis=0) / w.sum()
    scale = np.sqrt(np.maximum((rows * rows * w[:, None]).sum(axis=0) / w.sum() - mean**2, 0)) + 1e-3
    b = plain_logistic((rows - mean) / scale, np.append(y, more_y), w, 1.0)

    def raw(z):
        return np.clip((z - mean) / scale @ b[:-1] + b[-1], -30, 30)

    c = plain_logistic(raw(held)[:, None], held_y, np.ones(len(held)), 1e-2)
    return lambda z: raw(z) * c[0] + c[1]


def test_op6_is_co_training(spark):
    docs = sorted((r["doc_id"], r["text"] or "", (r["lang"], r["source"], r["n_chars"])) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    named = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        if r["quality"] is not None:
            named[r["doc_id"]] = max(named.get(r["doc_id"], 0), r["quality"])
    text = np.array([quality.text_features(t.encode()) for _, t, _ in docs])
    meta = np.array([quality.meta_features(m) for _, _, m in docs])
    views = [v.astype("f4").astype(float) for v in (text, meta)]
    label = np.array([named.get(i, -1) for i, _, _ in docs])
    kinds = [np.flatnonzero(label == c) for c in (0, 1)]
    held = np.sort(np.concatenate([k[::5] for k in kinds]))
    seen = np.setdiff1d(np.flatnonzero(label >= 0), held)
    pool = np.flatnonzero(label < 0)
    none = [(v[:0], label[:0]) for v in views]
    for given in (none, *[None] * 3):
        if given is None:
            sure = [sigmoid(f(v[pool])) for f, v in zip(fitted, views)]
            given = []
            for taker, p in ((0, sure[1]), (1, sure[0])):
                ok = np.maximum(p, 1 - p) >= 0.97
                given.append((views[taker][pool][ok], (p[ok] >= 0.5).astype(int)))
            assert min(len(g[1]) for g in given) > 0
        fitted = [plain_view(v[seen], label[seen], v[held], label[held], *g) for v, g in zip(views, given)]
    both = np.stack([f(v) for f, v in zip(fitted, views)], axis=1)
    c = plain_logistic(both[held], label[held], np.ones(len(held)), 1e-2)
    want = np.column_stack([sigmoid(both[:, 0]), sigmoid(both[:, 1]), sigmoid(both @ c[:2] + c[2])])
    got = {r["doc_id"]: r for r in QUERIES["op6_quality_classifier"](spark, SF).collect()}
    assert len(got) == len(docs)
    have = np.array([[got[i][k] for k in ("p_text", "p_meta", "score")] for i, _, _ in docs])
    assert np.abs(have - want).max() < 0.02 and np.abs(have - want).mean() < 0.002
    assert all(got[i]["keep"] == (got[i]["score"] >= 0.5) for i, _, _ in docs)
