"""Language identification: a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time on windows of a bounded sample of
labelled texts. It gives every byte position of a text a distribution over the languages; a document's
probabilities are the mean over all its positions. Texts are read whole, in windows of WINDOW bytes which start
with a fresh state; windows of many texts run side by side. Only text and lang of rows that are not held out
are learned from.

Cases: a text that is null or has no letter is `und` with score 0; a very long text is read whole, a slab of
windows at a time; repeated rows get equal results; an empty table gives no rows; extra columns are ignored; with
no labelled row every text is `und`; with one language every text with a letter has it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import as_schema, remainder, slim, tidy

WINDOW = 64
SLAB = 4096


@dataclass(frozen=True)
class GruParams:
    hidden: int = 12
    per_language: int = 300  # bound of the fitting sample: texts of each language
    per_text: int = 6  # and windows of each text
    steps: int = 260
    batch: int = 128
    rate: float = 0.02


def init(hidden: int, langs: int) -> dict[str, np.ndarray]:
    """Parameters, transposed so that a step works on (units, windows). Index 0 of E, U: forward; 1: backward."""
    r = np.random.default_rng(3)
    f = np.float32
    return {
        "E": r.normal(0, 0.3, (2, 3 * hidden, 256)).astype(f),  # input part of update gate, reset gate, candidate
        "U": r.normal(0, 0.6 / np.sqrt(hidden), (2, 3 * hidden, hidden)).astype(f),
        "O": r.normal(0, 0.3, (2, langs, hidden)).astype(f),
        "b": np.zeros((langs, 1), f),
    }


def forward(p: dict, x: np.ndarray, way: int, keep: bool = False):
    """States (positions, units, windows) of one direction over bytes x (positions, windows)."""
    h, u, e = p["U"].shape[2], p["U"][way], p["E"][way]
    state = np.zeros((h, x.shape[1]), np.float32)
    states = np.empty((len(x), h, x.shape[1]), np.float32)
    saved = []
    for t in range(len(x)) if way == 0 else range(len(x) - 1, -1, -1):
        a = np.take(e, x[t], axis=1)
        g = u @ state
        zr = a[: 2 * h]
        zr += g[: 2 * h]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        n = g[2 * h :] * zr[h:]
        n += a[2 * h :]
        np.tanh(n, out=n)
        if keep:
            saved.append((t, state.copy(), zr[:h].copy(), zr[h:].copy(), n.copy(), g[2 * h :].copy()))
        state -= n
        state *= zr[:h]
        state += n
        states[t] = state
    return (states, saved) if keep else states


def posteriors(p: dict, sf: np.ndarray, sb: np.ndarray) -> np.ndarray:
    """Language probabilities of every position: (positions, languages, windows)."""
    logits = p["O"][0] @ sf
    logits += p["O"][1] @ sb
    logits += p["b"]
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def backward(p: dict, x: np.ndarray, way: int, saved: list, ds: np.ndarray, grad: dict) -> None:
    """Backpropagation through time of one direction; ds: loss gradient at its states."""
    h, u = p["U"].shape[2], p["U"][way]
    carry = np.zeros((h, x.shape[1]), np.float32)
    for t, before, z, r, n, gn in reversed(saved):
        d = ds[t] + carry
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (before - n) * z * (1 - z)
        dr = dn * gn * r * (1 - r)
        da = np.concatenate([dz, dr, dn])
        dg = np.concatenate([dz, dr, dn * r])
        carry = d * z + u.T @ dg
        grad["U"][way] += dg @ before.T
        np.add.at(grad["E"][way].T, x[t], da.T)


def fit(windows: np.ndarray, mask: np.ndarray, y: np.ndarray, langs: int, c: GruParams) -> dict:
    """Adam on the mean cross-entropy of all positions. windows: (windows, positions) bytes; languages drawn evenly."""
    p = init(c.hidden, langs)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    rng = np.random.default_rng(5)
    by = [np.flatnonzero(y == k) for k in range(langs)]
    for step in range(1, c.steps + 1):
        who = np.array([rng.choice(by[k]) for k in rng.integers(0, langs, c.batch)])
        x, ok, lab = windows[who].T, mask[who].T, y[who]
        sf, kf = forward(p, x, 0, True)
        sb, kb = forward(p, x, 1, True)
        d = posteriors(p, sf, sb)
        d[:, lab, np.arange(len(lab))] -= 1
        d *= ok[:, None, :] / max(ok.sum(), 1)
        grad = {k: np.zeros_like(a) for k, a in p.items()}
        for way, s in ((0, sf), (1, sb)):
            grad["O"][way] = np.einsum("tkb,thb->kh", d, s, optimize=True)
        grad["b"][:, 0] = d.sum(axis=(0, 2))
        backward(p, x, 0, kf, p["O"][0].T @ d, grad)
        backward(p, x, 1, kb, p["O"][1].T @ d, grad)
        rate = c.rate * min(1.0, 2 * (1 - step / (c.steps + 1)))
        for k in p:
            m[k] += 0.1 * (grad[k] - m[k])
            v[k] += 0.01 * (grad[k] ** 2 - v[k])
            p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return p


def cut_windows(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the windows that cover each row's bytes."""
    count = -(-np.diff(bounds) // size)
    row = np.repeat(np.arange(len(count)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    starts = bounds[:-1][row] + k * size
    return starts, np.minimum(starts + size, bounds[1:][row]), row


def row_posteriors(p: dict, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean of the position probabilities of each row; 0 for an empty row."""
    starts, ends, row = cut_windows(bounds, WINDOW)
    langs = len(p["b"])
    total = np.zeros((len(bounds) - 1, langs))
    pad = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    for lo in range(0, len(starts), SLAB):
        s, e, r = starts[lo : lo + SLAB], ends[lo : lo + SLAB], row[lo : lo + SLAB]
        x = pad[s[None, :] + np.arange(WINDOW)[:, None]]
        q = posteriors(p, forward(p, x, 0), forward(p, x, 1))
        q *= (np.arange(WINDOW)[:, None] < (e - s)[None, :])[:, None, :]
        add = q.sum(axis=0, dtype=np.float64)
        for k in range(langs):
            total[:, k] += np.bincount(r, weights=add[k], minlength=len(total))
    return total / np.maximum(np.diff(bounds), 1)[:, None]


def sample(docs: DataFrame, c: GruParams, mod: int, held: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages and training windows of a bounded sample: per_language texts of each, per_text windows of a text."""
    d = slim(docs, "doc_id", "text", "lang")
    known = d.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", mod) != held))
    ids: set[int] = set()
    for r in known.select("lang").distinct().collect():  # for each language, as many ids as the bound, by a distributed top
        top = known.where(F.col("lang") == r["lang"]).select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(23)), "doc_id").limit(c.per_language)
        ids |= {x["doc_id"] for x in top.collect()}
    ids = docs.sparkSession.createDataFrame([(i,) for i in sorted(ids)], "doc_id long")
    n = F.length("text")
    at = F.transform(F.sequence(F.lit(0), F.lit(c.per_text - 1)), lambda k: F.encode(F.substring(F.col("text"), (n * k / c.per_text).cast("int") + 1, F.lit(WINDOW)), "utf-8"))
    rows = known.join(F.broadcast(ids), "doc_id").select("doc_id", "lang", F.array_distinct(at).alias("w")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["lang"]))
    langs = sorted({r["lang"] for r in rows})
    got = [(bytes(w)[:WINDOW], langs.index(r["lang"])) for r in rows for w in r["w"] if len(w)]
    x, ok = np.zeros((len(got), WINDOW), np.uint8), np.zeros((len(got), WINDOW), np.float32)
    for i, (w, _) in enumerate(got):
        x[i, : len(w)] = np.frombuffer(w, np.uint8)
        ok[i, : len(w)] = 1
    return langs, x, ok, np.array([k for _, k in got], np.int64)


def language_id(docs: DataFrame, mod: int = 3, held: int = 1, c: GruParams = GruParams()) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    spark = docs.sparkSession
    langs, x, ok, y = sample(docs, c, mod, held)
    p = fit(x, ok, y, len(langs), c) if langs else {}
    sent = spark.sparkContext.broadcast((langs, p))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, p = sent.value
        for b in batches:
            data, bounds = K.text_bytes(b.column(1))
            letter = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            best, score = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            if langs:
                for i, j in K.row_pieces(bounds):
                    q = row_posteriors(p, data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                    best[i:j], score[i:j] = q.argmax(axis=1), q.max(axis=1)
            names = np.array([*langs, "und"], dtype=object)
            letter &= bool(langs)
            pred = names[np.where(letter, best, len(langs))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(np.where(letter, np.clip(score, 0, 1), 0.0))], ["doc_id", "lang_pred", "score"])

    text = slim(docs, "doc_id", "text").withColumn("letter", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)))
    out = text.mapInArrow(run, as_schema("doc_id long, lang_pred string, score double"))
    return out.select("doc_id", F.coalesce(remainder("doc_id", mod) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
