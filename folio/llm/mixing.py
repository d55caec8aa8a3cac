"""Mixing sources to target weights by soft membership.

A classifier fitted on the labelled table gives each document a posterior over domains (clean, low, toxic).
Document rates r >= 0 minimise || sum_d r_d tokens_d posterior_d - target ||^2 from r = 1 by projected gradient,
so a document's rate stays near 1 where its domain already meets its target. Expected tokens of a domain are sums over all
documents, computed anew in each step by partial sums; only vectors of as many entries as there are domains reach
the driver, and a rate is the replay of the steps on the document's own posterior, so no state is kept.

Cases: null text has no tokens and rate 1; repeated rows are documents of their own with equal rates; an empty
table gives no rows; extra columns are ignored by `rates` and kept by `mix`; a domain with a target but no mass
can't be met and is left out of the residual.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import as_schema, persist, slim, tidy
from .toxicity import FtrlParams, SparseModel, row_scores, train

DOMAINS = ("clean", "low", "toxic")


@dataclass(frozen=True)
class MixParams:
    #: shares of the tokens wanted of each domain; the budget is such that `anchor` has its tokens times 1 + lift,
    #: so that rates of its documents lie a little above 1 and dealing by fractions repeats a few of them but drops none
    weights: dict[str, float] = field(default_factory=lambda: {"clean": 0.96, "low": 0.03, "toxic": 0.01})
    anchor: str = "clean"
    lift: float = 0.02
    steps: int = 12
    fit: FtrlParams = FtrlParams(bits=18, per_class=2500, alpha=0.5, l1=1.5, epochs=5, natural=True, balanced=False, pair_value=None, cut=None)


def domain_models(docs: DataFrame, labels: DataFrame, p: MixParams) -> list[SparseModel]:
    """A sparse logistic model for each domain, on words as they stand. A row whose label leaves a domain open, being
    null, isn't used for that domain."""
    label = {
        "clean": ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int"),
        "low": (F.col("quality") == 0).cast("int"),
        "toxic": (F.col("toxic") == 1).cast("int"),
    }
    return [train(docs, labels, label[d], F.lit(True), p.fit, skip=False, lower=False) for d in DOMAINS]


def replay(post: np.ndarray, steps: list[tuple[np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the steps, and the point the next gradient is taken at. A step: (gradient in domains, momentum)."""
    rate = np.ones(len(post))
    ahead = rate
    for g, beta in steps:
        new = np.maximum(0.0, ahead - post @ g)
        ahead = np.maximum(0.0, new + beta * (new - rate))
        rate = new
    return rate, ahead


def membership(docs: DataFrame, labels: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """doc_id, tokens, posterior (array<double> by DOMAINS) for every row."""
    models = docs.sparkSession.sparkContext.broadcast(domain_models(docs, labels, p))
    return slim(docs, "doc_id", "text").mapInArrow(_member(models, 1, False), as_schema("doc_id long, tokens long, posterior array<double>"))


def _member(models, at: int, keep: bool):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = models.value
        dense = [m.dense() for m in own]
        for b in batches:
            post = row_scores(b.column(at), own, dense, skip=False, lower=False)
            post /= post.sum(axis=1, keepdims=True)
            data, bounds = K.text_bytes(b.column(at))
            n = np.zeros(b.num_rows, np.int64)
            for i, j in K.row_pieces(bounds):
                n[i:j] = np.diff(K.word_spans(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])[2])
            arr = pa.ListArray.from_arrays(pa.array(np.arange(len(post) + 1) * len(own), pa.int32()), pa.array(post.ravel()))
            head, names = (list(b.columns), b.schema.names) if keep else ([b.column(0)], ["doc_id"])
            yield pa.RecordBatch.from_arrays([*head, pa.array(n), arr], [*names, "tokens", "posterior"])

    return run


def _sums(member: DataFrame, steps: list[tuple[np.ndarray, float]], at_rate: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Over all documents: expected tokens of each domain at the current point, and the domains' Gram matrix."""
    k = len(DOMAINS)
    size = k + k * k

    @tidy
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            post = b.column(1).flatten().to_numpy().reshape(-1, k)
            n = b.column(0).to_numpy().astype(np.float64)
            rate, ahead = replay(post, steps)
            total[:k] += (post * (n * (rate if at_rate else ahead))[:, None]).sum(axis=0)
            total[k:] += ((post * n[:, None]).T @ post).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], ["i", "v"])

    rows = member.select("tokens", "posterior").mapInArrow(part, as_schema("i int, v double")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in rows:
        out[r["i"]] = r["v"]
    return out[:k], out[k:].reshape(k, k)


def fit_steps(member: DataFrame, p: MixParams) -> tuple[list[tuple[np.ndarray, float]], np.ndarray]:
    """Projected gradient with momentum. Gradients are taken in the metric weighted by tokens, so that a step needs
    the posterior alone; the step length is the inverse of the Gram matrix's largest eigenvalue."""
    expected, gram = _sums(member, [])
    w = np.array([p.weights.get(d, 0.0) for d in DOMAINS])
    a = DOMAINS.index(p.anchor)
    target = w / max(w[a], 1e-9) * expected[a] * (1 + p.lift)
    live = expected > 0
    if not live.any():
        return [], target
    # residuals relative to each domain's own mass, so that small domains count as well
    scale = np.where(live, 1.0 / np.maximum(expected, 1.0), 0.0)
    top = float(np.linalg.eigvalsh(np.sqrt(scale)[:, None] * gram * np.sqrt(scale)[None, :]).max())
    steps: list[tuple[np.ndarray, float]] = []
    now, t = expected, 1.0
    for _ in range(p.steps):
        g = np.where(live, (now - target) * scale, 0.0) / max(top, 1e-12)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        steps.append((g, (t - 1) / t2))
        t = t2
        now, _ = _sums(member, steps)
        if np.abs((now - target) * scale).max() < 1e-4:
            break
    return steps, target


def _rated(member: DataFrame, steps: list[tuple[np.ndarray, float]]) -> DataFrame:
    k, at, width = len(DOMAINS), member.columns.index("posterior"), len(member.columns)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rate, _ = replay(b.column(at).flatten().to_numpy().reshape(-1, k), steps)
            n = b.column(at - 1).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.where(n > 0, rate, 1.0))], [*b.schema.names[:width], "rate"])

    schema = as_schema(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in member.schema) + ", rate double")
    return member.mapInArrow(run, schema)


def rates(docs: DataFrame, labels: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """doc_id, tokens, posterior by domain, rate for every row."""
    member, _ = persist(membership(docs, labels, p), "member")
    steps, _ = fit_steps(member, p)
    out = _rated(member, steps)
    return out.select("doc_id", "tokens", *[F.get("posterior", i).alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate")


def mix(docs: DataFrame, labels: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """docs, all columns, each row as often as its rate says: the whole part, and once more where a hash of the
    document lies under the fraction. So the expected tokens of the rows dealt out are those of the rates.

    Cases as above; repeated rows are dealt alike; a column of any name is kept.
    """
    models = docs.sparkSession.sparkContext.broadcast(domain_models(docs, labels, p))
    at = [c.lower() for c in docs.columns].index("text")
    own = [f"__c{i}" for i in range(len(docs.columns))]  # names that can't clash
    renamed = docs.toDF(*own)
    schema = as_schema(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in renamed.schema) + ", tokens long, posterior array<double>")
    member, _ = persist(renamed.mapInArrow(_member(models, at, True), schema), "mixed")
    steps, _ = fit_steps(member, p)
    done = _rated(member, steps)
    ident = [c.lower() for c in docs.columns].index("doc_id")
    u = F.pmod(F.xxhash64(own[ident], own[at], F.lit(41)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    whole = F.floor("rate")
    copies = (whole + F.when(u < F.col("rate") - whole, 1).otherwise(0)).cast("int")
    out = done.withColumn("__n", copies).where("__n > 0").select(*own, F.explode(F.expr("sequence(1, __n)")).alias("__i"))
    return out.select(*own).toDF(*docs.columns)
