"""Quality classification by co-training two views of a document.

One view is the text's content (shares of byte values, repetition, lengths), the other the page's metadata (language,
source, size). Each view has a logistic classifier; in each round each labels all unlabelled documents that it is sure
of for the other one to learn from. Both are calibrated on held-out labels and combined there, and the combination
scores every document.

Fitting uses ``LABELLED`` labelled documents at most, those with the least hashed ids, and every unlabelled one. The
features of the unlabelled ones are written once and read again at each Newton step, which takes sums of loss, gradient
and Hessian from them, so that no such row reaches the driver. Pseudo-labels weigh half of a label, and all of them together
half of all labels at most. Scoring covers all rows and whole texts. Defined cases: a null text counts as empty;
missing metadata is a value of its own; a label that is null, or whose document is missing, is left out; where labels of
both kinds are missing, every score is 0.5 and every document is kept; an empty table gives an empty result; further
columns are carried by ``keep_good``.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm.common import discard, staged, table

LABELLED = 12_000
ROUNDS = 3
#: A view labels for the other what it is at least so sure of.
SURE = 0.97
#: Weight of a pseudo-label.
GIVEN_WEIGHT = 0.5
#: Rows that add up the partitions' sums, before the driver does.
SUM_ROWS = 16
#: Rows of features held as numbers at once.
SUM_BATCH = 4096
#: Every fifth labelled document of each kind is held out, for calibration.
HELD_OUT = 5
#: Looks at all rows that a fit may take.
PASSES = 60
META_BINS = 64
CUT = 0.5

_SPACE = b" \t\n\r\x0b\x0c"


def text_features(text: bytes) -> np.ndarray:
    """Shares of ASCII bytes and of others, and measures of repetition and length."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = np.append(counts[:128], counts[128:].sum()) / max(1, len(text))
    words, lines = text.split(), text.split(b"\n")
    n = len(words)
    distinct = Counter(words)
    top = max(distinct.values(), default=0)
    ends = Counter(w[-1:] for w in words)
    marks = sum(v for k, v in ends.items() if not k.isalnum() and k < b"\x80")
    shape = [
        np.log1p(n),
        np.log1p(len(text)),
        len(distinct) / max(1, n),
        np.log1p(n) * len(distinct) / max(1, n),
        top / max(1, n),
        marks / max(1, n),
        sum(map(len, words)) / max(1, n) / 10,
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        float(n == 0),
    ]
    return np.concatenate([np.sqrt(shares), shape])


def meta_features(row: tuple) -> np.ndarray:
    """Metadata values, hashed to bins; numbers by their power of two."""
    out = np.zeros(META_BINS * len(row))
    for i, value in enumerate(row):
        if isinstance(value, float) and np.isnan(value):
            value = None
        key = f"2^{int(np.log2(max(1, value)))}" if isinstance(value, (int, float)) else str(value)
        out[i * META_BINS + zlib.crc32(key.encode()) % META_BINS] = 1
    return out


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian of the rows ``x``, which end in a 1."""
    z = np.clip(x @ b, -30, 30)
    p = 1 / (1 + np.exp(-z))
    h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x
    return float(weight @ (np.logaddexp(0, z) - y * z)), x.T @ (weight * (p - y)), h


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0, start=None, more=None) -> np.ndarray:
    """Coefficients, the intercept last, by Newton steps, halved where the loss would rise; ``more`` gives the loss,
    gradient and Hessian of further rows."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    b = at = np.zeros(x.shape[1]) if start is None else start
    least, step = np.inf, None
    for _ in range(PASSES):
        loss, g, h = _newton(x, y, weight, b)
        if more is not None:
            loss2, g2, h2 = more(b)
            loss, g, h = loss + loss2, g + g2, h + h2
        loss += (ridge * b * b).sum() / 2
        if loss > least + 1e-9 * abs(least):
            step = step / 2
        else:
            at, least = b, loss
            step = np.linalg.solve(h + np.diag(ridge), g + ridge * b)
        b = at - step
        if np.abs(step).max() < (1e-6 if more is None else 1e-3):
            return b
    return at


@dataclass
class View:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    calibration: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        raw = ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return np.clip(raw, -30, 30) * self.calibration[0] + self.calibration[1]


@dataclass
class Model:
    text: View
    meta: View
    combination: np.ndarray

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.logit(text), self.meta.logit(meta)
        return _p(a), _p(b), _p(a * self.combination[0] + b * self.combination[1] + self.combination[2])


def _p(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


#: What is added up over the unlabelled rows: (features of the text, of the metadata) -> an array.
Term = Callable[[np.ndarray, np.ndarray], np.ndarray]


class Rows:
    """Unlabelled rows held here."""

    def __init__(self, text: np.ndarray, meta: np.ndarray):
        self.text, self.meta = text, meta

    def total(self, term: Term) -> np.ndarray:
        return term(self.text, self.meta)


class StagedRows:
    """Unlabelled rows (x) of a table, the first ``cut`` features the text's; sums are made where the rows are."""

    def __init__(self, rows: DataFrame, width: int, cut: int):
        self.rows, self.width, self.cut = rows, width, cut
        self.many = rows.rdd.getNumPartitions() > 4 * SUM_ROWS

    def total(self, term: Term) -> np.ndarray:
        width, cut = self.width, self.cut

        def partial(batches):
            out = term(np.zeros((0, cut)), np.zeros((0, width - cut)))
            for pdf in batches:
                for lo in range(0, len(pdf), SUM_BATCH):
                    x = np.frombuffer(b"".join(pdf["x"].iloc[lo : lo + SUM_BATCH]), "<f4").reshape(-1, width).astype(float)
                    out = out + term(x[:, :cut], x[:, cut:])
            part = TaskContext.get().partitionId()
            yield pd.DataFrame({"part": [part], "sums": [out.tobytes()]})

        def added(pdf):
            pdf = pdf.sort_values("part")
            out = sum(np.frombuffer(x, float) for x in pdf["sums"])
            return pd.DataFrame({"part": pdf["part"].iloc[:1], "sums": [out.tobytes()]})

        sums = self.rows.mapInPandas(partial, "part int, sums binary")
        if self.many:
            sums = sums.groupBy(F.col("part") % SUM_ROWS).applyInPandas(added, "part int, sums binary")
        empty = term(np.zeros((0, cut)), np.zeros((0, width - cut)))
        got = sorted((r["part"], r["sums"]) for r in sums.collect())
        return empty + sum(np.frombuffer(x, float) for _, x in got)


def _learn(
    x: np.ndarray, y: np.ndarray, held_x: np.ndarray, held_y: np.ndarray, before: View | None = None, given=None, pool=None
) -> View:
    """A view of the labelled rows and of what is ``given``: (text, meta) -> (own features, pseudo-labels) of ``pool``."""
    n, one, two, width = len(x), x.sum(axis=0), (x * x).sum(axis=0), x.shape[1]
    weight, more, start = 0.0, None, None
    if given is not None:

        def moments(text, meta):
            z, _ = given(text, meta)
            return np.concatenate([[len(z)], z.sum(axis=0), (z * z).sum(axis=0)])

        sums = pool.total(moments)
        if sums[0]:
            weight = GIVEN_WEIGHT * min(1.0, n / sums[0])
            one, two, n = one + weight * sums[1 : width + 1], two + weight * sums[width + 1 :], n + weight * sums[0]
    mean = one / n
    scale = np.sqrt(np.maximum(two / n - mean * mean, 0)) + 1e-3
    if weight:

        def more(b):
            def newton(text, meta):
                z, labels = given(text, meta)
                z = np.hstack([(z - mean) / scale, np.ones((len(z), 1))])
                loss, g, h = _newton(z, labels, np.full(len(z), weight), b)
                return np.concatenate([[loss], g, h.ravel()])

            sums = pool.total(newton)
            return sums[0], sums[1 : len(b) + 1], sums[len(b) + 1 :].reshape(len(b), len(b))

        # The view of the round before, in this round's scale.
        start = np.append(before.weights[:-1] / before.scale * scale, 0)
        start[-1] = before.weights[-1] + (before.weights[:-1] / before.scale) @ (mean - before.mean)
    weights = logistic((x - mean) / scale, y, np.ones(len(x)), start=start, more=more)
    view = View(mean, scale, weights, np.array([1.0, 0.0]))
    view.calibration = logistic(view.logit(held_x)[:, None], held_y, np.ones(len(held_y)), 1e-2)
    return view


def _given(giver: View, of: int, taker: int) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The taker's features and the labels of the rows that the giver is sure of."""

    def rows(*views: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = _p(giver.logit(views[of]))
        sure = np.maximum(p, 1 - p) >= SURE
        return views[taker][sure], (p[sure] >= 0.5).astype(float)

    return rows


def co_train(text: np.ndarray, meta: np.ndarray, label: np.ndarray, rounds: int = ROUNDS, pool=None) -> Model | None:
    """``label`` is 0, 1, or -1 for unlabelled rows; these may be in ``pool`` instead."""
    pool = pool or Rows(text[label < 0], meta[label < 0])
    held = np.sort(np.concatenate([np.flatnonzero(label == c)[::HELD_OUT] for c in (0, 1)]))
    seen = np.setdiff1d(np.flatnonzero(label >= 0), held)
    if any(len(np.unique(label[part])) < 2 for part in (held, seen)):
        return None
    views, y, held_y = [text, meta], label[seen].astype(float), label[held].astype(float)
    fitted = [_learn(x[seen], y, x[held], held_y) for x in views]
    for _ in range(rounds):
        fitted = [
            _learn(views[taker][seen], y, views[taker][held], held_y, fitted[taker], _given(fitted[giver], giver, taker), pool)
            for giver, taker in ((1, 0), (0, 1))
        ]
    logits = np.stack([v.logit(x[held]) for v, x in zip(fitted, views)], axis=1)
    return Model(*fitted, logistic(logits, held_y, np.ones(len(held)), 1e-2))


def _meta_columns(docs: DataFrame) -> list[str]:
    return [c for c in ("lang", "source", "n_chars") if c in docs.columns]


def _features(pdf: pd.DataFrame, meta: list[str]) -> tuple[np.ndarray, np.ndarray]:
    text = np.array([text_features(t) for t in pdf["text"]])
    return text, np.array([meta_features(row) for row in pdf[meta].itertuples(index=False)]).reshape(len(pdf), -1)


def _bytes_of_text() -> Column:
    return F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Co-train on a bounded sample of labelled ``docs`` and all unlabelled ones; ``labels`` is (doc_id, quality)."""
    meta = _meta_columns(docs)
    order = F.xxhash64("doc_id")
    labels = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = docs.where("doc_id IS NOT NULL").select("doc_id").distinct()
    named = labels.join(ids, "doc_id", "left_semi").orderBy(order, "doc_id").limit(LABELLED)
    texts = docs.select("doc_id", _bytes_of_text(), *meta)
    sample = texts.join(F.broadcast(named), "doc_id")
    width = len(text_features(b"")) + META_BINS * len(meta)

    def featurise(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo : lo + 256]
                both = np.hstack(_features(part, meta)).astype("<f4")
                yield pd.DataFrame({"doc_id": part["doc_id"], "quality": part["quality"], "x": [r.tobytes() for r in both]})

    def features_only(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                both = np.hstack(_features(pdf.iloc[lo : lo + 256], meta)).astype("<f4")
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[lo : lo + 256].astype("Int64"), "x": [r.tobytes() for r in both]})

    # One row an id before anything reaches the driver: of an id's rows the one with the least features.
    got = sample.mapInPandas(featurise, "doc_id long, quality int, x binary").groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("s"))
    got = got.select("doc_id", "s.quality", "s.x").toPandas().sort_values("doc_id")
    if got.empty:
        return None
    x = np.frombuffer(b"".join(got["x"]), "<f4").reshape(-1, width).astype(float)
    cut = width - META_BINS * len(meta)
    quality = got["quality"].to_numpy()
    if min((quality == c).sum() for c in (0, 1)) < 2:
        return None
    # Features are shuffled instead of texts. Repeated and null ids are rows like others here.
    others = texts.mapInPandas(features_only, "doc_id long, x binary").join(labels.select("doc_id"), "doc_id", "left_anti")
    pool = staged(others.select("x"), "unlabelled")
    model = co_train(x[:, :cut], x[:, cut:], quality, pool=StagedRows(pool, width, cut))
    discard(pool)
    return model


def scored(docs: DataFrame, model: Model | None) -> Column:
    """A column of (p_text, p_meta, score) for the rows of ``docs``."""
    meta = _meta_columns(docs)

    @F.pandas_udf("p_text double, p_meta double, score double")
    def score(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for lo in range(0, len(rows), 256):
            part = rows.iloc[lo : lo + 256]
            p = [np.full(len(part), 0.5)] * 3 if model is None else model.scores(*_features(part, meta))
            out.append(np.round(np.stack(p, axis=1), 9))
        return pd.DataFrame(np.concatenate(out) if out else np.zeros((0, 3)), columns=["p_text", "p_meta", "score"])

    return score(F.struct(_bytes_of_text(), *meta))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the combined views score ``CUT`` or more, with all their columns."""
    return docs.where(scored(docs, fit(docs, labels))["score"] >= CUT)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", scored(docs, model).alias("s")).select("doc_id", "s.*")
    return out.withColumn("keep", F.col("score") >= CUT)
