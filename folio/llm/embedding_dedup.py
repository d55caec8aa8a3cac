"""Embedding near-dedup: an exact metric range join on the unit sphere.

Cosine >= t is distance <= eps = sqrt(2 - 2 t) between unit vectors. Pivots partition the vectors: home is the
nearest pivot's cell. A vector must also be seen in cell j if a point within eps of it can lie there: by the
triangle inequality only if d(x, p_j) <= d(x, p_home) + 2 eps, and, tighter, only if x is within eps of the
bisecting hyperplane of the two pivots, (x.p_home - x.p_j) <= eps |p_home - p_j|. Both are tested; so the join is
exact. Cells join independently, in blocks: a block holds a bounded number of home rows, and the cell's other
rows stream past it. Links are counted there and never emitted: a block returns a row for each home vector and
one for each linked vector that passed, which carry local components; these are merged by connected components.

Equal vectors are one class with a multiplicity, so a vector that occurs very often is one row.

The number of pivots grows with the vectors, to MOST at the most. A bounded sample tells how far each number would
replicate; the one with the least work is taken, which changes the cost but never the result. On isotropic vectors of
many dimensions no pivot scheme excludes much: the replication comes near the number of pivots and the join's products
near all pairs. It is then a blocked matrix product, whose cost is quadratic.

Vectors are scaled by their largest component before their norm is taken, so neither very large nor very small ones
over- or underflow. A cosine is the product of two unit vectors in double precision; what lies within rounding
(some 1e-15) of t may fall on either side.

Cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of
different dimension don't link; repeated rows of one vec_id are counted as vectors of their own; a null vec_id links
with nothing; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_schema, persist, small_batches, tidy
from .components import connected_components

BLOCK = 4096
SLAB = 512
#: most pivots (so 1 MB of them for 128 dimensions), and vectors of the sample that the number is chosen by
MOST, SAMPLE = 1024, 4096


def unit_rows(raw: list[bytes], dtype: str) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), dtype=dtype).reshape(len(raw), -1).astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def spread(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots: farthest-first among the sample."""
    picked = [0]
    far = sample @ sample[0]
    while len(picked) < min(count, len(sample)):
        nxt = int(np.argmin(far))
        if far[nxt] > 1 - 1e-9:
            break
        picked.append(nxt)
        far = np.maximum(far, sample @ sample[nxt])
    return sample[picked]


def cells_of(u: np.ndarray, pivots: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of each vector, and which cells it must be seen in (vectors, pivots)."""
    near = u @ pivots.T
    home = near.argmax(axis=1)
    gap = near[np.arange(len(u)), home][:, None] - near
    apart = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 0))[home]
    dist = np.sqrt(np.maximum(2 - 2 * near, 0))
    ball = dist <= dist[np.arange(len(u)), home][:, None] + 2 * eps + 1e-9
    return home, ball & (gap <= eps * apart + 1e-9)


def pivots_for(sample: np.ndarray, total: int, eps: float, most: int) -> np.ndarray:
    """The pivots, of 1, 4, 16, ... as far as the cells keep BLOCK vectors each, with the least work: cells a vector is
    seen in, times the blocks of a cell."""
    all_ = spread(sample, min(most, max(total // BLOCK, 1)))
    best, least, count = all_[:1], math.inf, 1
    while True:
        some = all_[:count]
        _, seen = cells_of(sample, some, eps)
        work = seen.sum() / len(sample) * math.ceil(total / len(some) / BLOCK)
        if work < least:
            best, least = some, work
        if count >= len(all_):
            return best
        count = min(4 * count, len(all_))


class Block:
    """The home rows of a block, their links so far, and their local components."""

    def __init__(self, rep: np.ndarray, u: np.ndarray, least: float):
        self.rep, self.u, self.least = rep, u, least
        self.links = np.zeros(len(rep), np.int64)
        self.label = np.arange(len(rep))

    def meet(self, rep: np.ndarray, count: np.ndarray, u: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Takes guests in; (guest, a home row it links with) of those that link."""
        for lo in range(0, len(rep), SLAB):
            hit = (self.u @ u[lo : lo + SLAB].T) >= self.least
            self.links += hit @ count[lo : lo + SLAB]
            linked = np.flatnonzero(hit.any(axis=0))
            if not len(linked):
                continue
            hit = hit[:, linked]
            low = np.where(hit, self.label[:, None], len(self.label)).min(axis=0)
            high = np.where(hit, self.label[:, None], -1).max(axis=0)
            for c in np.flatnonzero(low != high):
                own = np.unique(self.label[hit[:, c]])
                if len(own) > 1:
                    self.label[np.isin(self.label, own)] = own[0]
            yield rep[lo : lo + SLAB][linked], self.rep[hit.argmax(axis=0)]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vector, links, a member of its local component) of the home rows."""
        return self.rep, self.links, self.rep[self.label]


def range_join(classes: DataFrame, dtype: str, threshold: float, pivots: int | None = None) -> DataFrame:
    """classes (rep, n, dim, raw) -> rows (a, links, b): see Block.rows; links is -1 for a guest."""
    spark = classes.sparkSession
    total = classes.count()
    eps = math.sqrt(max(0.0, 2 - 2 * threshold))
    dims = [r["dim"] for r in classes.select("dim").distinct().limit(1 << 16).collect()]
    chosen: dict[int, np.ndarray] = {}
    for d in dims:  # usually one
        got = classes.where(F.col("dim") == d).orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("raw").collect()
        sample = unit_rows([bytes(r["raw"]) for r in got], dtype)
        chosen[d] = spread(sample, pivots) if pivots else pivots_for(sample, total, eps, MOST)
    sent = spark.sparkContext.broadcast(chosen)  # at most MOST vectors for each dimension

    @tidy
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim = b.column(2).to_numpy()
            for d in np.unique(dim):
                part = b.filter(pa.array(dim == d))
                home, seen = cells_of(unit_rows(part.column(3).to_pylist(), dtype), sent.value[int(d)], eps)
                row, cell = np.nonzero(seen)
                own = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(cell.astype(np.int32)), pa.array(home[row] == cell)], ["rep", "n", "dim", "raw", "cell", "home"])

    spread_rows, _ = persist(classes.select("rep", "n", "dim", "raw").mapInArrow(assign, as_schema("rep long, n long, dim int, raw binary, cell int, home boolean")), "cells")
    size = spread_rows.groupBy("dim", "cell").agg(F.count_if("home").alias("homes"))
    size = size.where("homes > 0").withColumn("blocks", F.ceil(F.col("homes") / BLOCK).cast("int"))
    rows = spread_rows.join(F.broadcast(size.select("dim", "cell", "blocks")), ["dim", "cell"])  # at most MOST cells a dimension
    own = F.pmod(F.xxhash64("rep", F.lit(2)), F.col("blocks")).cast("int")
    guest = rows.select("dim", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "rep", "n", "raw")
    host = rows.where("home").select("dim", "cell", own.alias("block"), F.lit(0).alias("role"), "rep", "n", "raw")
    dealt = host.unionByName(guest).repartition("dim", "cell", "block").sortWithinPartitions("dim", "cell", "block", "role")

    @tidy
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, hosts = None, None, []

        def close() -> Iterator[pa.RecordBatch]:
            if block is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in block.rows()], ["a", "links", "b"])

        for b in batches:
            dim, cell, blk, role = (b.column(i).to_numpy() for i in range(4))
            change = np.flatnonzero((np.diff(dim) != 0) | (np.diff(cell) != 0) | (np.diff(blk) != 0) | (np.diff(role) != 0)) + 1
            for lo, hi in zip([0, *change], [*change, b.num_rows], strict=True):
                now = (int(dim[lo]), int(cell[lo]), int(blk[lo]))
                if now != key:
                    yield from close()
                    key, block, hosts = now, None, []
                rep, n = b.column(4).slice(lo, hi - lo).to_numpy(), b.column(5).slice(lo, hi - lo).to_numpy()
                u = unit_rows(b.column(6).slice(lo, hi - lo).to_pylist(), dtype)
                if role[lo] == 0:
                    hosts.append((rep, u))
                    continue
                if block is None and hosts:
                    block = Block(np.concatenate([h[0] for h in hosts]), np.concatenate([h[1] for h in hosts]), threshold)
                if block is not None:
                    for guest, home in block.meet(rep, n, u):
                        yield pa.RecordBatch.from_arrays([pa.array(guest), pa.array(np.full(len(guest), -1)), pa.array(home)], ["a", "links", "b"])
        yield from close()

    return dealt.mapInArrow(join, as_schema("a long, links long, b long"))


def near_dedup(vectors: DataFrame, threshold: float = 0.95, pivots: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding)."""
    have = {c.lower(): c for c in vectors.columns}
    kind = vectors.schema[have["embedding"]].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    dtype = "<f4" if single else "<f8"
    narrow = vectors.select(F.col(f"`{have['vec_id']}`").cast("long").alias("vec_id"), F.col(f"`{have['embedding']}`").cast(f"array<{'float' if single else 'double'}>").alias("e"))

    small_batches(vectors.sparkSession)

    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws: list[bytes | None] = [None] * b.num_rows
            e = b.column(1)
            flat = e.flatten()
            x, bad = flat.fill_null(0).to_numpy().astype(dtype), flat.is_null().to_numpy(zero_copy_only=False) | ~np.isfinite(flat.fill_null(0).to_numpy())
            size = e.value_lengths().fill_null(0).to_numpy()
            at = np.concatenate([[0], np.cumsum(size)])
            x = x + x.dtype.type(0)  # -0 as 0, so that equal vectors have equal bytes
            no, some = np.concatenate([[0], np.cumsum(bad)]), np.concatenate([[0], np.cumsum(x != 0)])
            for r in np.flatnonzero((no[at[1:]] == no[at[:-1]]) & (some[at[1:]] > some[at[:-1]])):
                raws[r] = x[at[r] : at[r + 1]].tobytes()
            cls = [hashlib.blake2b(r, digest_size=16).digest() if r else None for r in raws]
            dim = np.where([r is None for r in raws], 0, size).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raws, pa.binary()), pa.array(cls, pa.binary()), pa.array(dim)], ["vec_id", "raw", "cls", "dim"])

    packed, _ = persist(narrow.mapInArrow(pack, as_schema("vec_id long, raw binary, cls binary, dim int")), "vectors")
    good = packed.where("raw is not null and vec_id is not null")
    classes, _ = persist(good.groupBy("cls").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("dim").alias("dim"), F.first("raw").alias("raw")), "classes")
    joined, _ = persist(range_join(classes, dtype, threshold, pivots), "links")
    links = joined.where("links >= 0").select(F.col("a").alias("rep"), (F.col("links") - 1).alias("n_links"))
    label = connected_components(joined.select("a", "b")).withColumnRenamed("node", "rep")
    found = classes.select("cls", "rep").join(links, "rep", "left").join(label, "rep", "left").select("cls", "n_links", F.coalesce("component", "rep").alias("component"))
    out = good.select("vec_id", "cls").join(found, "cls", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    rest = packed.where("raw is null or vec_id is null")  # null keys would meet in one task
    out = out.unionByName(rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
