"""Quality classifier: a factorisation machine over hashed words, structure statistics and length metadata.

Every word occurrence is a field with value 1/n (n words in the text), every statistic a field with its own
value. Pairwise interactions of rank k are summed in linear time by the identity
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2].
The model that is broadcast has (2**bits + statistics) * (k + 1) floats: 1.3 MB at the defaults.

Cases: null text counts as empty; an empty text has statistics of 0 and no words; a very long text is scored
whole; repeated rows get equal scores; an empty table gives no rows; extra columns are ignored; with one class
of labels only, or none, the score is that class's smoothed share.
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


@dataclass(frozen=True)
class FmParams:
    bits: int = 16
    rank: int = 4
    epochs: int = 6
    rate: float = 0.08
    l2: float = 1e-5
    per_class: int = 3000  # bound of the fitting sample, for each class
    word_scale: float = 8.0


@dataclass(frozen=True)
class FmModel:
    w: np.ndarray  # linear weights: words, then statistics
    v: np.ndarray  # factors
    bias: float
    mean: np.ndarray
    std: np.ndarray
    bits: int
    scale: float


def _kinds() -> np.ndarray:
    """The class of each byte: upper, lower, digit, space, line feed, punctuation, mark, bar, high, none of these."""
    t = np.full(256, 9, np.uint8)
    t[65:91], t[97:123], t[48:58], t[128:] = 0, 1, 2, 8
    t[K.SPACE] = 3
    t[10] = 4
    t[[ord(c) for c in ".,;:'\"()?-"]] = 5
    t[[ord(c) for c in "!#$%&*+/<=>@[]^_{}~\\`"]] = 6
    t[ord("|")] = 7
    return t


KIND = _kinds()
N_STATS = 14
CLIP = 8.0
PIECE = 1 << 19


def statistics(data: np.ndarray, bounds: np.ndarray, h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Structure statistics of each row: shares of byte classes, word shape, repetition, and length."""
    size = np.diff(bounds).astype(np.float64)
    n = np.diff(at).astype(np.float64)
    safe, words = np.maximum(size, 1), np.maximum(n, 1)
    counts = K.row_counts(KIND[data], bounds, 10)[:, :9].astype(np.float64)
    lines = counts[:, 4].copy()
    counts[:, 3] += lines
    out = np.zeros((len(size), N_STATS))
    out[:, :9] = counts / safe[:, None]
    out[:, 4] = lines / words
    again = np.zeros(len(h))
    if len(h) > 1:
        again[1:] = h[1:] == h[:-1]
    out[:, 9] = K.row_sums(again, at) / words
    out[:, 10] = np.log1p(size)
    out[:, 11] = np.log1p(n)
    out[:, 12] = (size - counts[:, 3]) / words / 10
    out[:, 13] = np.log1p(lines)
    return out


def standard(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    """Statistics as the model takes them, in fitting and in scoring alike."""
    return np.clip((x - mean) / std, -CLIP, CLIP)


def _score_piece(m: FmModel, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    own, rel = data[bounds[0] : bounds[-1]], bounds - bounds[0]
    h, at = K.words(own, rel, None)
    ix = (h & np.uint64((1 << m.bits) - 1)).astype(np.int64)
    x = standard(statistics(own, rel, h, at), m.mean, m.std)
    one = m.scale / np.maximum(np.diff(at), 1)
    n = 1 << m.bits
    lin = K.row_sums(m.w[ix], at) * one + x @ m.w[n:]
    s = K.row_sums(m.v[ix], at) * one[:, None] + x @ m.v[n:]
    q = K.row_sums((m.v * m.v).sum(axis=1)[ix], at) * one**2 + (x * x) @ (m.v[n:] ** 2).sum(axis=1)
    return K.sigmoid(m.bias + lin + 0.5 * ((s * s).sum(axis=1) - q))


def row_scores(column: pa.Array, m: FmModel) -> np.ndarray:
    data, bounds = K.text_bytes(column)
    out = np.zeros(len(column))
    for i, j in K.row_pieces(bounds, PIECE):
        out[i:j] = _score_piece(m, data, bounds[i : j + 1])
    return out


def sample_rows(texts: pa.Array, bits: int) -> list[bytes]:
    """For fitting: a text's statistics, then its distinct word slots and how often each occurs, as bytes."""
    data, bounds = K.text_bytes(texts)
    out = []
    for i, j in K.row_pieces(bounds, PIECE):
        own, rel = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        h, at = K.words(own, rel, None)
        stats = statistics(own, rel, h, at)
        ix = (h & np.uint64((1 << bits) - 1)).astype("<u4")
        for r in range(j - i):
            slot, count = np.unique(ix[at[r] : at[r + 1]], return_counts=True)
            out.append(stats[r].astype("<f8").tobytes() + slot.tobytes() + count.astype("<u4").tobytes())
    return out


def fit_fm(forms: list[bytes], y: np.ndarray, p: FmParams, prior: float) -> FmModel:
    """AdaGrad on the logistic loss, one text at a time. forms: see sample_rows."""
    n = 1 << p.bits
    x = np.array([np.frombuffer(f, "<f8", N_STATS) for f in forms])
    words = [np.frombuffer(f, "<u4", offset=8 * N_STATS).reshape(2, -1).astype(np.int64) for f in forms]
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = standard(x, mean, std)
    rng = np.random.default_rng(11)
    w, v = np.zeros(n + N_STATS), rng.normal(0, 0.02, (n + N_STATS, p.rank))
    gw, gv, gb, bias = np.full(n + N_STATS, 1e-2), np.full((n + N_STATS, p.rank), 1e-2), 1e-2, 0.0
    tail = np.arange(n, n + N_STATS)
    for _ in range(p.epochs):
        for r in rng.permutation(len(words)):
            ix, c = words[r]
            ids = np.concatenate([ix, tail])
            each = p.word_scale / max(int(c.sum()), 1)
            val = np.concatenate([c * each, x[r]])  # a word that occurs c times: c fields of one value
            sq = np.concatenate([c * each * each, x[r] * x[r]])
            vi = v[ids]
            s = val @ vi
            f = bias + val @ w[ids] + 0.5 * (s @ s - sq @ (vi * vi).sum(axis=1))
            g = float(K.sigmoid(f)) - y[r]
            dw = g * val + p.l2 * w[ids]
            dv = g * (val[:, None] * s - sq[:, None] * vi) + p.l2 * vi
            gw[ids] += dw * dw
            gv[ids] += dv * dv
            gb += g * g
            w[ids] -= p.rate * dw / np.sqrt(gw[ids])
            v[ids] = vi - p.rate * dv / np.sqrt(gv[ids])
            bias -= p.rate * g / np.sqrt(gb)
    share = min(max(float(np.mean(y)), 1e-6), 1 - 1e-6)
    bias += float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return FmModel(w.astype(np.float32), v.astype(np.float32), bias, mean, std, p.bits, p.word_scale)


def train(docs: DataFrame, labels: DataFrame, label: Column, keep: Column, p: FmParams = FmParams()) -> FmModel:
    """Fit on a bounded sample of the labelled rows that keep selects."""
    forms, y, counts = labelled_sample(docs, labels, label, keep, p.per_class, lambda t: sample_rows(t, p.bits))
    prior = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    y = np.array([1.0 if v == 1 else 0.0 for v in y])
    if len(set(y.tolist())) < 2:
        n = (1 << p.bits) + N_STATS
        z = np.zeros(N_STATS)
        return FmModel(np.zeros(n, np.float32), np.zeros((n, p.rank), np.float32), float(np.log(prior / (1 - prior))), z, z + 1, p.bits, p.word_scale)
    return fit_fm(forms, y, p, prior)


def score(docs: DataFrame, model: FmModel) -> DataFrame:
    """doc_id, score for every row, over its whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(row_scores(b.column(1), sent.value))], ["doc_id", "score"])

    return slim(docs, "doc_id", "text").mapInArrow(run, as_schema("doc_id long, score double"))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, mod: int = 5, held: int = 0, p: FmParams = FmParams()) -> DataFrame:
    """doc_id, held_out, score, predicted. Labels of held-out ids (crc32 mod `mod` = `held`) are never read."""
    model = train(docs, labels, F.col("quality"), remainder("doc_id", mod) != held, p)
    out = F.coalesce(remainder("doc_id", mod) == held, F.lit(False))
    return score(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, mod: int = 5, held: int = 0, p: FmParams = FmParams()) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, F.col("quality"), remainder("doc_id", mod) != held, p))
    at = [c.lower() for c in docs.columns].index("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(row_scores(b.column(at), model.value) >= threshold))

    return docs.mapInArrow(run, docs.schema)
