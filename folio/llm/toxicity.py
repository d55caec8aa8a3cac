"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Per-coordinate learning rates and L1 leave a sparse weight vector; only its non-zero part is broadcast
(at most 2**bits pairs, 16 MB at the default 20 bits).

Words are lower-cased, ASCII punctuation apart. The rarer class of the sample is visited as often as the other, and the
intercept is set by two fits on halves of the sample, so that small samples too are cut where it is best.

Cases: null text counts as empty; an empty text has the score of the intercept alone; a very long text is
scored whole, piece by piece; repeated rows get equal scores; an empty table gives no rows; extra columns are
ignored; with no usable label, or one class only, the score is that class's smoothed share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import as_schema, labelled_sample, remainder, slim, tidy


PIECE = 1 << 19


@dataclass(frozen=True)
class FtrlParams:
    bits: int = 20
    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 1.0
    epochs: int = 4
    per_class: int = 4000  # bound of the fitting sample, for each class
    pair_value: float | None = 0.4  # value of a pair's feature beside a word's 1; None: no pairs
    natural: bool = False  # move the intercept from the sample's odds to those of all labels
    balanced: bool = True  # visit the rarer class of the sample as often as the other
    cut: float | None = 0.7  # move the intercept so that the best cut of fits on halves, by F1, scores this


@dataclass(frozen=True)
class SparseModel:
    """Non-zero weights by ascending feature index, and the intercept."""

    index: np.ndarray
    weight: np.ndarray
    intercept: float
    bits: int

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits, np.float32)
        w[self.index] = self.weight
        return w


def features(h: np.ndarray, at: np.ndarray, bits: int, skip: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed features by kind: words, word pairs, pairs that skip a word. Each with the rows' bounds. Where there are
    pairs, words have the lower half of the slots and pairs the upper."""
    half = np.uint64(1 << (bits - 1))
    if not skip:
        return [((h & (half + half - np.uint64(1))).astype(np.int64), at)]
    low = half - np.uint64(1)
    pairs, to2 = K.grams(h, at, 2)
    count = np.maximum(np.diff(at) - 2, 0)
    to3 = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(at[:-1] - to3[:-1], count) + np.arange(to3[-1])
    over = K.pair_hash(h[first], h[first + 2], 3)
    return [((h & low).astype(np.int64), at), ((pairs & low | half).astype(np.int64), to2), ((over & low | half).astype(np.int64), to3)]


def row_sets(texts: pa.Array, bits: int, skip: bool, lower: bool) -> list[bytes]:
    """For fitting: the distinct features of each text, as bytes."""
    data, bounds = K.text_bytes(texts)
    out = []
    for i, j in K.row_pieces(bounds, PIECE):
        h, at = K.words(data, bounds[i : j + 1], K.LETTERS if lower else None)
        kinds = features(h, at, bits, skip)
        for r in range(j - i):
            out.append(np.unique(np.concatenate([x[to[r] : to[r + 1]] for x, to in kinds])).astype("<u4").tobytes())
    return out


def fit_ftrl(rows: list[np.ndarray], y: np.ndarray, p: FtrlParams, prior: float) -> SparseModel:
    """FTRL-proximal over binary features; if natural, the intercept then moves from the sample's odds to the prior's."""
    n = 1 << p.bits
    z, g2 = np.zeros(n + 1), np.zeros(n + 1)
    value = np.ones(n) if not p.pair_value else np.where(np.arange(n) < n // 2, 1.0, p.pair_value)
    rng = np.random.default_rng(7)
    share = min(max(float(np.mean(y)), 1e-6), 1 - 1e-6) if len(y) else prior
    times = np.rint([max(1.0, share / (1 - share)), max(1.0, (1 - share) / share)]).astype(int) if p.balanced else np.ones(2, int)
    visits = np.repeat(np.arange(len(rows)), times[np.asarray(y, int)])

    def weights(ix: np.ndarray) -> np.ndarray:
        zi = z[ix]
        w = -(zi - np.sign(zi) * p.l1) / ((p.beta + np.sqrt(g2[ix])) / p.alpha + p.l2)
        w[np.abs(zi) <= p.l1] = 0
        return w

    def bias() -> float:
        return -z[n] / ((p.beta + np.sqrt(g2[n])) / p.alpha)

    for _ in range(p.epochs):
        for r in rng.permutation(visits):
            ix = rows[r]
            w, b, x = weights(ix), bias(), value[ix]
            g = float(K.sigmoid(w @ x + b)) - y[r]
            gg = g * g
            root = np.sqrt(g2[ix])
            g2[ix] += gg * x * x
            z[ix] += g * x - (np.sqrt(g2[ix]) - root) / p.alpha * w
            s0 = (np.sqrt(g2[n] + gg) - np.sqrt(g2[n])) / p.alpha
            z[n] += g - s0 * b
            g2[n] += gg
    index = np.flatnonzero(np.abs(z[:n]) > p.l1)
    shift = np.log(prior / (1 - prior)) - np.log(share / (1 - share)) if p.natural else 0.0
    return SparseModel(index, (weights(index) * value[index]).astype(np.float32), float(bias() + shift), p.bits)


def best_cut(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The cut of the logits with the highest F1, rows weighted; midway to the next logit."""
    order = np.argsort(-logits, kind="stable")
    caught, taken = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    f1 = 2 * caught / (taken + (weight * y).sum())
    v = logits[order]
    f1[:-1][v[1:] == v[:-1]] = -1  # equal logits can't be parted
    k = int(np.argmax(f1))
    return float((v[k] + v[min(k + 1, len(v) - 1)]) / 2)


def calibrated(rows: list[np.ndarray], y: np.ndarray, p: FtrlParams, prior: float) -> SparseModel:
    """The fit on all rows, its intercept moved by what fits on either half say of the other: their logits' best cut,
    with the classes weighted as in all labels, gets the score p.cut."""
    model = fit_ftrl(rows, y, p, prior)
    half = np.arange(len(y)) % 2
    if p.cut is None or any(len(set(y[half == k])) < 2 for k in (0, 1)):
        return model
    logits = np.zeros(len(y))
    for k in (0, 1):
        part = fit_ftrl([rows[i] for i in np.flatnonzero(half != k)], y[half != k], p, prior)
        w = part.dense()
        for i in np.flatnonzero(half == k):
            logits[i] = part.intercept + w[rows[i]].sum()
    share = float(np.mean(y))
    at = best_cut(logits, y, np.where(y == 1, prior / share, (1 - prior) / (1 - share)))
    return SparseModel(model.index, model.weight, model.intercept + float(np.log(p.cut / (1 - p.cut))) - at, p.bits)


def train(docs: DataFrame, labels: DataFrame, label: Column, keep: Column, p: FtrlParams = FtrlParams(), skip: bool = True, lower: bool = True) -> SparseModel:
    """Fit on a bounded sample of the labelled rows that keep selects."""
    forms, y, counts = labelled_sample(docs, labels, label, keep, p.per_class, lambda t: row_sets(t, p.bits, skip, lower))
    prior = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    y = np.array([1.0 if v == 1 else 0.0 for v in y])
    if len(set(y.tolist())) < 2:
        return SparseModel(np.zeros(0, np.int64), np.zeros(0, np.float32), float(np.log(prior / (1 - prior))), p.bits)
    return calibrated([np.frombuffer(f, "<u4").astype(np.int64) for f in forms], y, p, prior)


def row_scores(column: pa.Array, models: list[SparseModel], dense: list[np.ndarray], skip: bool = True, lower: bool = True) -> np.ndarray:
    """Probabilities, a column for each model. Only features with a weight are made distinct within a row."""
    data, bounds = K.text_bytes(column)
    out = np.zeros((len(column), len(models)))
    for i, j in K.row_pieces(bounds, PIECE):
        h, at = K.words(data, bounds[i : j + 1], K.LETTERS if lower else None)
        kinds = [(x, np.repeat(np.arange(j - i), np.diff(to))) for x, to in features(h, at, models[0].bits, skip)]
        for m, (model, w) in enumerate(zip(models, dense, strict=True)):
            keys = []
            for x, row in kinds:
                hit = np.flatnonzero(w[x])
                keys.append((row[hit] << model.bits) | x[hit])
            key = np.unique(np.concatenate(keys))
            out[i:j, m] = model.intercept + np.bincount(key >> model.bits, weights=w[key & ((1 << model.bits) - 1)], minlength=j - i)
    return K.sigmoid(out)


def score(docs: DataFrame, model: SparseModel) -> DataFrame:
    """doc_id, score for every row, over its whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        dense = [m.dense()]
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(row_scores(b.column(1), [m], dense)[:, 0])], ["doc_id", "score"])

    return slim(docs, "doc_id", "text").mapInArrow(run, as_schema("doc_id long, score double"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, mod: int = 3, held: int = 1, p: FtrlParams = FtrlParams()) -> DataFrame:
    """doc_id, held_out, score, predicted. Labels of held-out ids (crc32 mod `mod` = `held`) are never read."""
    model = train(docs, labels, F.col("toxic"), remainder("doc_id", mod) != held, p)
    out = F.coalesce(remainder("doc_id", mod) == held, F.lit(False))
    return score(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
