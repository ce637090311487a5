"""A quality classifier from positive and unlabelled documents (non-negative PU learning, Kiryo et al. 2017).

Trusted positives are the documents that labels call good; the whole corpus is the unlabelled set. Labels of
bad documents are never trained on. The share of good documents in the corpus is estimated first: a
classifier of four fifths of the positives against the corpus ranks all documents, and the least ratio between the corpus's and the
other positives' share above a score bounds the prior (best bin estimation, Garg et al. 2021). Then a linear
model minimises  p R_p(+) + max(0, R_u(-) - p R_p(-))  by full-batch gradient steps.

Texts are read once to fit (features are some fifty numbers a document, kept in the shared folder) and
once to apply. A gradient step is one narrow job over the features, of which each task returns two sums.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .store import Scratch

# Bytes by class: each ASCII punctuation mark is its own, and so are the kinds of letters.
_CLASS = np.zeros(256, np.int64)
_NAMES = ["other", "lower", "upper", "digit", "space", "line", "wide"]
for _b in range(256):
    _c = chr(_b)
    if _b >= 128:
        _CLASS[_b] = 6
    elif _c.islower() or _c.isupper() or _c.isdigit():
        _CLASS[_b] = 1 if _c.islower() else 2 if _c.isupper() else 3
    elif _c in " \n":
        _CLASS[_b] = 4 if _c == " " else 5
    elif 32 < _b < 127:
        _CLASS[_b] = len(_NAMES)
        _NAMES.append(_c)
_N = len(_NAMES)
#: Numbers per document: byte classes and those of whole words.
N_FEATURES = _N + 6
#: Words at which a text's standard scores count half.
SHRINK = 16


def features(col: pa.Array) -> np.ndarray:
    """One row of N_FEATURES numbers per text; all zero for a text without words (or null)."""
    data, offsets = vec.joined(col)
    n = len(offsets) - 1
    size = np.diff(offsets) - 1
    row = np.repeat(np.arange(n, dtype=np.int64) * _N, np.diff(offsets))
    count = np.bincount(row + _CLASS[data], minlength=n * _N).reshape(n, _N).astype(float)
    count[:, 5] -= 1  # the line feed that closes each row
    share = count / np.maximum(size, 1)[:, None]
    w = vec.words(col)
    words = np.diff(w.first).astype(float)
    some = np.maximum(words, 1)
    key = w.hash ^ vec.mix(w.row.astype(vec.U) + vec.U(1))
    order = np.argsort(key, kind="stable")
    fresh = np.ones(len(key), bool)
    fresh[order[1:]] = key[order[1:]] != key[order[:-1]]
    distinct = np.bincount(w.row[fresh], minlength=n)
    again = np.flatnonzero((w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1]))
    length = (w.end - w.start).astype(float)
    mean = np.bincount(w.row, length, minlength=n) / some
    spread = np.sqrt(np.maximum(np.bincount(w.row, length**2, minlength=n) / some - mean**2, 0))
    extra = np.stack(
        [np.log1p(words), mean, spread, distinct / some * (words > 0), np.log1p(50 * np.bincount(w.row[again], minlength=n) / some), np.bincount(w.row[length > 18], minlength=n) / some], 1
    )
    out = np.concatenate([np.log1p(50 * share), extra], 1)
    out[words == 0] = 0
    return out.astype(np.float32)


@dataclass
class Model:
    weights: list[float]
    mean: list[float]
    scale: list[float]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Above 0: good. A text without words scores -inf, as nothing speaks for it."""
        z = _standard(x, np.array(self.mean), np.array(self.scale)) @ np.array(self.weights)
        z[~x.any(1)] = -np.inf
        return z

    def to_json(self) -> str:
        return json.dumps(self.__dict__)


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standard scores and a constant. Shares of few words vary much by chance, so those of short texts shrink towards the mean."""
    words = np.expm1(x[:, _N : _N + 1])
    z = np.clip((x - mean) / scale, -8, 8) * (words / (words + SHRINK))
    return np.concatenate([z, np.ones((len(x), 1))], 1)


def _sums(table: DataFrame, size: int, f) -> np.ndarray:
    """The sum over all rows of what ``f(features, is positive)`` returns for a block of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(float)
            total += f(x, batch.column(1).to_numpy(zero_copy_only=False).astype(bool))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

    parts = table.select("x", "positive").mapInArrow(run, "s array<double>")
    out = parts.select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(size)
    for r in out:
        total[r.i] = r.v
    return total


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def held_out(x: np.ndarray) -> np.ndarray:
    """A fifth of all rows, by their features: the same in every pass."""
    bits = np.ascontiguousarray(x, np.float32).view(np.uint32).astype(vec.U)
    return vec.mix((bits * np.arange(1, 2 * x.shape[1], 2, dtype=vec.U)).sum(1)) % vec.U(5) == 0


def risk_terms(z: np.ndarray, positive: np.ndarray, w: np.ndarray, n_p: float, n_u: float) -> np.ndarray:
    """What a block adds to R_p(-), R_u(-) and their gradients, with the sigmoid loss l(z, +) = s(-z), l(z, -) = s(z)."""
    s = _sigmoid(z @ w)
    slope = s * (1 - s)
    return np.concatenate([[s[positive].sum() / n_p, s.sum() / n_u], z[positive].T @ slope[positive] / n_p, z.T @ slope / n_u])


def risk_step(terms: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk  p R_p(+) + max(0, R_u(-) - p R_p(-)), and the direction to step against: its gradient, or, where the
    second part is below zero, which only overfitting can do, the one that raises that part again."""
    d = len(terms) // 2 - 1
    g_p, g_u = terms[2 : 2 + d], terms[2 + d :]
    negative = terms[1] - prior * terms[0]
    risk = prior * (1 - terms[0]) + max(0.0, negative)
    return risk, (g_u - 2 * prior * g_p if negative >= 0 else prior * g_p - g_u)


class _Adam:
    def __init__(self, n: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(n), np.zeros(n), 0, rate

    def step(self, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.99 * self.v + 0.01 * g * g
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-9)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.05) -> float:
    """The largest share of positives that the unlabelled scores allow, from histograms by falling score."""
    n_p, n_u = positive.sum(), unlabelled.sum()
    q_p, q_u = np.cumsum(positive) / max(n_p, 1), np.cumsum(unlabelled) / max(n_u, 1)
    slack = np.sqrt(np.log(4 / delta) / (2 * max(n_p, 1))) + np.sqrt(np.log(4 / delta) / (2 * max(n_u, 1)))
    seen = q_p > 0
    if not seen.any():
        return 0.5
    best = np.argmin((q_u[seen] + slack) / q_p[seen])
    return float(np.clip(q_u[seen][best] / q_p[seen][best], 0.01, 0.99))


def featurize(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, x)`` with x the packed features of each row's whole text."""
    kind = dict(docs.select(doc_id).dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in vec.slices(vec.as_strings(batch.column(1))):
                part = batch.slice(a, b - a)
                x = features(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, x binary")


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", prior_steps: int = 12, steps: int = 24, keep_table: bool = True) -> tuple[Model | None, DataFrame]:
    """The model, and the table ``(doc_id, x, positive)`` of features that it was fitted on.

    All documents are unlabelled data and all whose labels (one or several) all say 1 are trusted
    positives; no row is sampled. Null texts and texts without words are left out, as are labels with a
    null id or value. Without any positive there is nothing to learn from, and no model. The table stays in the shared folder
    for scoring, unless ``keep_table`` is unset.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    good = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg((F.min(label) == 1).alias("positive"))
    table = featurize(docs, doc_id, text).join(good, "doc_id", "left").withColumn("positive", F.coalesce("positive", F.lit(False)))
    table = scratch.keep(table, "features")
    d = N_FEATURES

    def moments(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        x, p = x[(keep := x.any(1))], p[keep]
        return np.concatenate([[len(x), p.sum()], x.sum(0), (x * x).sum(0)])

    s = _sums(table, 2 + 2 * d, moments)
    n_u, n_p = s[0], s[1]
    if not n_p:
        return None, table
    mean = s[2 : 2 + d] / n_u
    scale = np.sqrt(np.maximum(s[2 + d :] / n_u - mean**2, 0)) + 0.1
    w = np.zeros(d + 1)

    # Positives against the corpus, to rank documents for the prior. A fifth of the positives is held out of this fit, as those that were
    # fitted score higher than others of their kind; with fewer than five all serve for both.
    some = _sums(table, 1, lambda x, p: np.array([(held_out(x) & p & x.any(1)).sum()]))[0]
    split = n_p >= 5 and 0 < some < n_p
    n_fit = n_p - some if split else n_p
    adam = _Adam(d + 1, 0.15)
    for _ in range(prior_steps):

        def logistic(x: np.ndarray, p: np.ndarray, w=w) -> np.ndarray:
            x, p = x[(keep := x.any(1))], p[keep]
            p = p & ~held_out(x) if split else p
            z = _standard(x, mean, scale)
            s = _sigmoid(z @ w)
            return z.T @ s / n_u - z[p].T @ (1 - s[p]) / n_fit

        w = w - adam.step(_sums(table, d + 1, logistic) + 1e-3 * w)
    bins = 400

    def histogram(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        x, p = x[(keep := x.any(1))], p[keep]
        p = p & held_out(x) if split else p
        at = np.clip(((1 - _sigmoid(_standard(x, mean, scale) @ w)) * bins).astype(int), 0, bins - 1)
        return np.concatenate([np.bincount(at[p], minlength=bins), np.bincount(at, minlength=bins)])

    h = _sums(table, 2 * bins, histogram)
    prior = estimate_prior(h[:bins], h[bins:])

    adam = _Adam(d + 1, 0.15)
    for _ in range(steps):

        def terms(x: np.ndarray, p: np.ndarray, w=w) -> np.ndarray:
            x, p = x[(keep := x.any(1))], p[keep]
            return risk_terms(_standard(x, mean, scale), p, w, n_p, n_u)

        _, g = risk_step(_sums(table, 2 + 2 * (d + 1), terms), prior)
        w = w - adam.step(g + 1e-3 * w)
    if not keep_table:
        scratch.drop()
    return Model(w.tolist(), mean.tolist(), scale.tolist(), prior), table


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """``(doc_id, score, keep)`` of every row; ``keep`` is score >= 0.

    Without any trusted positive nothing can be judged: every score is null and every row is kept. Null, empty and wordless texts score null and aren't kept. Very long texts are read whole; repeated rows
    get equal scores; of columns other than the two named none is read. An empty table gives an empty
    result without labels being looked at.
    """
    if docs.isEmpty():
        kind = dict(docs.select(doc_id).dtypes)[doc_id]
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, score double, keep boolean")
    model, table = fit(docs, labels, doc_id, text, **params)
    if model is None:
        return table.select("doc_id", F.lit(None).cast("double").alias("score"), F.lit(True).alias("keep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(float)
            z = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(z, 6), mask=np.isinf(z)), pa.array(z >= 0)], names=["doc_id", "score", "keep"])

    kind = dict(table.dtypes)["doc_id"]
    return table.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, score double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the fitted model keeps. Rows are judged where they
    are: no join back by id, no shuffle of texts. Null, empty and wordless texts go; without any trusted positive, or any row, all stays."""
    if docs.isEmpty():
        return docs
    model, _ = fit(docs, labels, doc_id, text, keep_table=False, **params)
    if model is None:
        return docs
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in vec.slices(vec.as_strings(batch.column(at))):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(model.score(features(part.column(at)).astype(float)) >= 0))

    return docs.mapInArrow(run, docs.schema)
