"""N-gram Jaccard join with a count-vector R-tree.

A document's set: the hashes of its runs of n words (ASCII white space apart, A-Z lower-cased); fewer words make
one run of all; no word, no set. Two documents link if |A & B| / |A | B| >= num/den, exactly.

1. Equal sets are one class. Each class has its count vector (hashes by group), a few min-hash keys, and its
   prefix: of the set in one global order, common shingles last, the first size - ceil(size num/den) + 1. Two
   linked sets share a prefix shingle.
2. Group cells: classes with a min-hash key in common. Their count vectors are the points of an R-tree; in order of
   id, a class that no earlier one has found searches the tree and is tried against all that it finds. So a large
   group of near copies gives about one pair a member. Provisional components follow.
3. Prefix cells: classes with a prefix shingle in common, where they lie in more than one provisional component.
   Each class searches the R-tree of the cell; a subtree is passed over if it lies in the query's own component, has
   no fitting sizes, or its summed coordinate minima with the query stay under the overlap that is needed.
   What links inside one component can't change the result, so no link between different components is lost.
   Two classes with many cells in common are a pair in one of them, mostly: each carries its FIRST least keys of
   cells, and a cell leaves a pair that has a lesser key in common to the cell of that key, which finds it too.
4. Pairs that pass either are verified on the whole sets, read again for the documents concerned. The set of a class
   with many partners is sent once for each salted part of them.

Only the components are worked out, which is what the result holds; links inside a component are not all counted.

Common shingles are found on a hash sample of documents, as a bitmap of fixed size: it only orders the prefix
(any one order is exact), so that frequent passages don't make large cells. Cells of over BLOCK classes are dealt
out as blocks (2) or pairs of blocks (3), so no task holds more than two blocks of a cell.

Cases: null or blank text: empty set, linked with nothing; repeated rows of one doc_id are one document; a null
doc_id links with nothing and has a null component; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels as K
from .common import as_schema, id_bitmap, id_slot, persist, slim, tidy
from .components import connected_components

GROUPS = 128
STARS = 4
BLOCK = 1024
FAN = 16
SLICE = 1 << 14
SALTS = 64
FIRST = 16
SLOT_BITS = 23
OPEN_BITS = 26
SAMPLE, OFTEN = 32, 6
ODD = (np.random.default_rng(29).integers(0, 1 << 63, STARS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The set of each row, ascending."""
    h, at = K.words(data, bounds)
    g, to = K.grams(h, at, n)
    for r in range(len(bounds) - 1):
        if to[r + 1] > to[r]:
            yield np.unique(g[to[r] : to[r + 1]])
        elif at[r + 1] > at[r]:
            yield K.grams(h[at[r] : at[r + 1]], np.array([0, at[r + 1] - at[r]]), int(at[r + 1] - at[r]))[0]
        else:
            yield np.zeros(0, np.uint64)


def batch_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    data, bounds = K.text_bytes(column)
    for i, j in K.row_pieces(bounds):
        yield from shingle_sets(data, bounds[i : j + 1], n)


def common_slots(docs: DataFrame, n: int) -> bytes:
    """Bitmap (1 MB) of the slots of shingles in OFTEN documents or more of a 1/SAMPLE hash sample."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in batch_sets(b.column(0), n):
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["s"])

    picked = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(SAMPLE)) == 0).select("text")
    often = picked.mapInArrow(run, as_schema("s long")).groupBy("s").count().where(F.col("count") >= OFTEN)
    return slot_bitmap(often, "s", SLOT_BITS)


def slot_bitmap(rows: DataFrame, key: str, width: int) -> bytes:
    """Bitmap of the slots (first `width` bits) of keys."""
    slot = F.shiftrightunsigned(key, 64 - width) + 1
    rows = rows.select(slot.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("m")).collect()
    out = bytearray((1 << width) // 8)
    for r in rows:  # at most 2**width / 32768 rows of 4 KB
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = bytes(r["m"])
    return bytes(out)


def in_slots(bits: bytes, keys: np.ndarray, width: int) -> np.ndarray:
    """Whether the slot of each key is in the bitmap."""
    slot = keys >> np.uint64(64 - width)
    return (np.frombuffer(bits, np.uint8)[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def keys_in_slots(classes: DataFrame, column: str, bits: bytes) -> DataFrame:
    """(key, rep, component, size) of the keys in an array column whose slot is in the bitmap."""
    sent = classes.sparkSession.sparkContext.broadcast(bits)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).flatten().to_numpy()
            row = np.repeat(np.arange(b.num_rows), b.column(0).value_lengths().to_numpy())
            ok = in_slots(sent.value, keys.view(np.uint64), OPEN_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(keys[ok]), *(b.column(c).take(pa.array(row[ok])) for c in (1, 2, 3))], ["key", "rep", "component", "size"])

    return classes.select(column, "rep", "component", "size").mapInArrow(run, as_schema("key long, rep long, component long, size long"))


def packed(counts: np.ndarray) -> bytes:
    """Group counts in as few bytes each as the largest needs: 1, 2 or 4."""
    return counts.astype(next(k for k in ("<u1", "<u2", "<u4") if counts.max() <= np.iinfo(k).max)).tobytes()


def unpacked(counts: list[bytes]) -> np.ndarray:
    """The points of packed counts, a row each."""
    width = np.fromiter(map(len, counts), np.int64, len(counts)) // GROUPS
    out = np.zeros((len(counts), GROUPS), np.uint32 if width.max(initial=1) > 2 else np.uint16)
    for k in np.unique(width):
        at = np.flatnonzero(width == k)
        out[at] = np.frombuffer(b"".join(counts[i] for i in at), f"<u{k}").reshape(-1, GROUPS)
    return out


PROFILE = "doc_id long, row long, size long, s1 long, s2 long, stars array<long>, prefix array<long>, counts binary"


def profiles(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(common_slots(docs, n))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        names = [c.split()[0] for c in PROFILE.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2 + [pa.binary()]
        number = TaskContext.get().partitionId() << 33
        for b in batches:
            cols: list[list] = [[] for _ in kinds]
            for s in batch_sets(b.column(1), n):
                if not len(s):
                    row = (number, 0, 0, 0, [], [], b"")
                else:
                    first = len(s) - -(-len(s) * num // den) + 1
                    prefix = s[np.argsort(in_slots(bits, s, SLOT_BITS), kind="stable")[:first]]
                    sig = [int(np.bitwise_xor.reduce(K.mix(s * o)).view(np.int64)) for o in ODD[:2]]
                    stars = [int((s * o).min().view(np.int64)) for o in ODD]
                    counts = np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
                    row = (number, len(s), *sig, stars, prefix.view(np.int64), packed(counts))
                number += 1
                for c, x in zip(cols[1:], row, strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols[1:], kinds[1:], strict=True))], names)

    return docs.mapInArrow(run, as_schema(PROFILE))


def overlap_fits(minima: np.ndarray, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether an overlap of `minima` at most leaves Jaccard >= num/den possible: (num + den) I >= num (|A| + |B|)."""
    return (num + den) * minima.astype(np.int64) >= num * (a.astype(np.int64) + b.astype(np.int64))


class CountRTree:
    """Points by group counts, packed in order of size and coordinates; a node holds its points' largest counts."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, parts: np.ndarray):
        wide = np.argsort(-points.var(axis=0), kind="stable")[:3]
        self.order = np.lexsort([*(points[:, k] for k in wide[::-1]), sizes])
        p, s, c = points[self.order], sizes[self.order], parts[self.order]
        self.levels = []
        high, lo, hi, c0, c1 = p, s, s, c, c
        while True:
            self.levels.append((high, lo, hi, c0, c1))
            if len(high) <= FAN:
                break
            at = np.arange(0, len(high), FAN)
            high, lo, hi = np.maximum.reduceat(high, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
            c0, c1 = np.minimum.reduceat(c0, at), np.maximum.reduceat(c1, at)

    def search(self, points: np.ndarray, sizes: np.ndarray, parts: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) of all that may link and lie in different parts; SLICE pairs at a time, so memory is bounded."""
        top = len(self.levels) - 1
        n = len(self.levels[top][0])
        step = max(SLICE // n, 1)
        todo = [(top, np.repeat(np.arange(lo, min(lo + step, len(points))), n), np.tile(np.arange(n), min(step, len(points) - lo))) for lo in range(0, len(points), step)]
        found_q, found_e = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while todo:
            k, q, e = todo.pop()
            high, lo, hi, c0, c1 = self.levels[k]
            n = sizes[q]
            ok = (hi[e] * den >= n * num) & (n * den >= lo[e] * num) & ~((c0[e] == c1[e]) & (c0[e] == parts[q]))
            q, e, n = q[ok], e[ok], n[ok]
            ok = overlap_fits(np.minimum(points[q], high[e]).sum(axis=1, dtype=np.int64), n, lo[e], num, den)
            q, e = q[ok], e[ok]
            if not k:
                found_q.append(q)
                found_e.append(self.order[e])
                continue
            below = len(self.levels[k - 1][0])
            e = (e[:, None] * FAN + np.arange(FAN)[None, :]).ravel()
            q = np.repeat(q, FAN)
            q, e = q[e < below], e[e < below]
            todo += [(k - 1, q[at : at + SLICE], e[at : at + SLICE]) for at in range(0, len(q), SLICE)]
        return np.concatenate(found_q), np.concatenate(found_e)


Cell = Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]


def group_pairs(rep: np.ndarray, points: np.ndarray, sizes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """About one pair a class: in order of rep, a class that none before has found is tried against all that its search
    of the R-tree finds, if not found before. The cell's least class is in each block and so comes first in all."""
    order = np.argsort(rep, kind="stable")
    own = np.arange(len(rep))
    tree = CountRTree(points, sizes, own)
    left = np.ones(len(rep), bool)
    a, b = [], []
    at, step = 0, 1
    while at < len(order):
        ask = order[at : at + step]
        at += step
        ask = ask[left[ask]]
        q, e = tree.search(points[ask], sizes[ask], own[ask], num, den)
        by = np.argsort(q, kind="stable")
        q, e = q[by], e[by]
        cut = np.searchsorted(q, np.arange(len(ask) + 1))
        for k, x in enumerate(ask):
            if left[x]:
                left[x] = False
                mine = e[cut[k] : cut[k + 1]]
                mine = mine[left[mine]]
                left[mine] = False
                a.append(np.full(len(mine), rep[x]))
                b.append(rep[mine])
        step = min(2 * step, 64)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(a or none), np.concatenate(b or none)


def padded(lists: pa.ChunkedArray) -> np.ndarray:
    """Lists of at most FIRST keys as rows of one matrix, filled up with the greatest key."""
    lists = pa.concat_arrays(lists.chunks)
    out = np.full((len(lists), FIRST), np.iinfo(np.int64).max)
    out[np.arange(FIRST) < lists.value_lengths().to_numpy()[:, None]] = lists.flatten().to_numpy()
    return out


def met_before(key: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether each row of x shares a key under `key` with that of y."""
    out = np.zeros(len(x), bool)
    for at in range(0, len(x), SLICE // FIRST):
        p, q = x[at : at + SLICE // FIRST], y[at : at + SLICE // FIRST]
        out[at : at + SLICE // FIRST] = ((p[:, :, None] == q[:, None, :]) & (p < key)[:, :, None]).any(axis=(1, 2))
    return out


def cell_pairs(
    rep: np.ndarray, points: np.ndarray, sizes: np.ndarray, parts: np.ndarray, block: np.ndarray, key: int, firsts: np.ndarray, num: int, den: int
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a cell in different parts: within its block, or between its two blocks; not those that the cell of a
    lesser key finds by their firsts."""
    sides = np.unique(block)
    a = np.flatnonzero(block == sides[0])
    b = np.flatnonzero(block == sides[-1])
    q, e = CountRTree(points[b], sizes[b], parts[b]).search(points[a], sizes[a], parts[a], num, den)
    q, e = a[q], b[e]
    if len(sides) == 1:  # each pair came up from both ends
        q, e = q[rep[q] < rep[e]], e[rep[q] < rep[e]]
    new = ~met_before(key, firsts[q], firsts[e])
    x, y = rep[q[new]], rep[e[new]]
    both = np.stack([np.minimum(x, y), np.maximum(x, y)])
    both = np.unique(both[:, both[0] < both[1]], axis=1)
    return both[0], both[1]


def cells(rows: DataFrame, work: Cell) -> DataFrame:
    """rows (key, b1, b2, ..., counts) -> the distinct pairs (a, b) that work finds in each (key, b1, b2)."""
    dealt = rows.repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = [t.column(c).to_numpy() for c in ("key", "b1", "b2")]
            cut = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1
            found = [work(t.slice(lo, hi - lo)) for lo, hi in zip([0, *cut], [*cut, len(t)], strict=True)]
            both = np.unique(np.stack([np.concatenate([f[k] for f in found]) for k in (0, 1)]), axis=1)  # cells share pairs
            for at in range(0, both.shape[1], 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)], pa.int64()) for x in both], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            keys = [t.column(c).to_numpy() for c in ("key", "b1", "b2")]
            same = np.all([k == k[-1] for k in keys], axis=0)
            last = len(t) - int(np.argmin(same[::-1])) if not same.all() else 0  # the last cell may go on in the next batch
            if last:
                yield from flush(t.slice(0, last))
            held = t.slice(last).combine_chunks()
        if held is not None and len(held):
            yield from flush(held)

    return dealt.mapInArrow(run, as_schema("a long, b long")).distinct()


def opened(keys: DataFrame) -> DataFrame:
    """Of keys (key, c classes, ends lo and hi, x: an xor of the classes' hashes) one for each set of classes, told by
    all these, with the number of its blocks."""
    one = keys.groupBy("c", "lo", "hi", "x").agg(F.min("key").alias("key"))
    return persist(one.select("key", "lo", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")), "open")[0]


def in_cells(classes: DataFrame, column: str, open_: DataFrame) -> DataFrame:
    """(key, lo, blocks, own, rep, component, size): the classes of each open cell, with their block. A bitmap of fixed
    size (8 MB) keeps most keys of no cell from the shuffle; the join settles what it lets pass."""
    own = F.pmod(F.xxhash64("rep", F.lit(6)), F.col("blocks")).cast("int")
    return keys_in_slots(classes, column, slot_bitmap(open_, "key", OPEN_BITS)).join(open_, "key").withColumn("own", own)


def fine_counts(s: np.ndarray) -> bytes:
    """Counts of a set in at least half as many groups as it has members, a byte each; empty if one doesn't fit."""
    groups = 1 << max(8, (max(len(s), 2) // 2 - 1).bit_length())
    counts = np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def fine_fits(p: bytes, q: bytes, num: int, den: int) -> bool:
    """Whether the summed minima of two fine count vectors, folded to the coarser one, leave a link possible."""
    if not p or not q:
        return True
    if len(p) < len(q):
        p, q = q, p
    x, y = np.frombuffer(p, np.uint8).reshape(-1, len(q)).sum(axis=0, dtype=np.int64), np.frombuffer(q, np.uint8)
    return (num + den) * int(np.minimum(x, y).sum()) >= num * int(x.sum() + y.sum(dtype=np.int64))


def forms_of(pairs: DataFrame, docs: DataFrame, n: int, name: str, form: Callable[[np.ndarray], bytes]) -> DataFrame:
    """(doc_id, form): the form of the set of each document in pairs, read again from its text."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    sent = docs.sparkSession.sparkContext.broadcast(id_bitmap(ids, "doc_id"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, np.uint8)
        for b in batches:
            slot = b.column(2).to_numpy()
            b = b.filter(pa.array(((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)))
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([form(s) for s in batch_sets(b.column(1), n)], pa.binary())], ["doc_id", "form"])

    source = docs.where("doc_id is not null").select("doc_id", "text", id_slot("doc_id").alias("slot"))
    return persist(source.mapInArrow(run, as_schema("doc_id long, form binary")), name)[0]


def meet(pairs: DataFrame, forms: DataFrame, test: Callable[[bytes, bytes], bool]) -> DataFrame:
    """The pairs whose forms pass the test. Partners b go to a in up to SALTS parts, each with one copy of a's form, so
    that no class with very many partners meets them in one task or travels with each of them."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b", F.lit(8)), F.lit(SALTS)).cast("int"))
    hosts = salted.select("a", "salt").distinct().join(forms, salted["a"] == forms["doc_id"]).select("a", "salt", F.lit(None).cast("long").alias("b"), "form")
    guests = salted.join(forms, salted["b"] == forms["doc_id"]).select("a", "salt", "b", "form")
    dealt = hosts.unionByName(guests).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hosts = None, []  # several forms where rows of one doc_id differ
        for batch in batches:
            a, b = [], []
            form = batch.column(3)
            for i, k in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2)), strict=True)):
                if k[:2] != key:
                    key, hosts = k[:2], []
                own = form[i].as_py()
                if k[2] is None:
                    hosts += [own] * (own not in hosts)
                elif any(test(h, own) for h in hosts):
                    a.append(k[0])
                    b.append(k[2])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], ["a", "b"])

    return dealt.mapInArrow(run, as_schema("a long, b long"))


def verified(pairs: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of doc_ids that link. A pair's fine count vectors are tried first; whole sets are read again,
    and sent, of the documents in the pairs left only, so that long documents don't travel for nothing."""
    pairs, _ = persist(pairs, "pairs")
    if pairs.isEmpty():
        return pairs

    def linked(p: bytes, q: bytes) -> bool:
        x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
        if min(len(x), len(y)) * den < num * max(len(x), len(y)):
            return False
        both = np.concatenate([x, y])
        both.sort(kind="stable")
        same = int((both[1:] == both[:-1]).sum())
        return den * same >= num * (len(both) - same)

    pairs, _ = persist(meet(pairs, forms_of(pairs, docs, n, "fine", fine_counts), lambda p, q: fine_fits(p, q, num, den)), "fine-passed")
    return persist(meet(pairs, forms_of(pairs, docs, n, "sets", np.ndarray.tobytes), linked), "linked")[0]


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) for every row."""
    prof, found = components_by_set(docs, n, num, den)
    sets = prof.where("size > 0 and doc_id is not null").join(found, ["s1", "s2", "size"], "left").select("doc_id", "size", "component")
    alone = prof.where("size = 0 or doc_id is null").select("doc_id", "size", F.col("doc_id").alias("component"))  # null keys would meet in one task
    return sets.unionByName(alone).select("doc_id", F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))


def components_by_set(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The rows' profiles, and (s1, s2, size, component) of each class of equal sets."""
    docs = slim(docs, "doc_id", "text")
    prof, _ = persist(profiles(docs, n, num, den), "profiles")
    some = prof.where("size > 0 and doc_id is not null")
    least = some.groupBy("s1", "s2", "size").agg(F.min(F.struct("doc_id", "row")).alias("m"))
    cls, _ = persist(least.select("s1", "s2", "size", F.col("m.doc_id").alias("rep"), F.col("m.row").alias("row")), "classes")
    reps, _ = persist(some.join(cls.select("row"), "row", "left_semi").select(F.col("doc_id").alias("rep"), "size", "stars", "prefix", "counts"), "reps")

    def columns(t: pa.Table) -> list[np.ndarray]:
        return [t.column("rep").to_numpy(), unpacked(t.column("counts").to_pylist()), t.column("size").to_numpy()]

    def in_group(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return group_pairs(*columns(t), num, den)

    def in_prefix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return cell_pairs(*columns(t), *(t.column(c).to_numpy() for c in ("component", "own")), t.column("key")[0].as_py(), padded(t.column("firsts")), num, den)

    classes = F.count("*").alias("c"), F.bit_xor(F.xxhash64("rep")).alias("x")
    counts = reps.select("rep", "counts")
    keys = reps.select(F.explode(F.array_distinct("stars")).alias("key"), "rep").groupBy("key").agg(*classes, F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    hit = in_cells(reps.withColumn("component", F.col("rep")), "stars", opened(keys.where("c > 1")))
    block = F.explode(F.when(F.col("rep") == F.col("lo"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))).alias("b1")
    hit = hit.select("key", block, "rep", "size").withColumn("b2", F.col("b1")).join(counts, "rep")
    links = verified(cells(hit, in_group), docs, n, num, den)

    first = connected_components(links)
    lab = reps.join(first, reps["rep"] == first["node"], "left").select("rep", "size", "prefix", F.coalesce("component", "rep").alias("component"))
    keys = lab.select(F.explode("prefix").alias("key"), "rep", "component")
    keys = keys.groupBy("key").agg(*classes, F.min("component").alias("lo"), F.max("component").alias("hi"))
    hit, _ = persist(in_cells(lab, "prefix", opened(keys.where("lo < hi"))), "in-cells")
    firsts = hit.groupBy("rep", "size").agg(F.slice(F.array_sort(F.collect_set("key")), 1, FIRST).alias("firsts"))  # a class has as many keys as its prefix at most
    hit = hit.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    hit = hit.select("key", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "own", "rep", "component", "size")
    # a class that has a partner of fitting size in its cell has one beside it in order of size
    near = Window.partitionBy("key", "b1", "b2").orderBy("size")
    below, above = F.lag("size").over(near), F.lead("size").over(near)
    fits = (below * den >= F.col("size") * num) | (F.col("size") * den >= above * num)
    hit = hit.withColumn("fits", fits).where("fits").drop("fits").join(firsts, ["rep", "size"]).join(counts, "rep")
    more = verified(cells(hit, in_prefix), docs, n, num, den)

    label = connected_components(links.unionByName(more))
    found = cls.join(label, cls["rep"] == label["node"], "left").select("s1", "s2", "size", F.coalesce("component", "rep").alias("component"))
    return prof, found


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs, all columns, with one document of each group left: that of the smallest doc_id, once.

    Cases: of rows with that doc_id and different texts, the one of the least text by hash stays, and of equal rows one;
    rows without a doc_id stay; null and blank texts are in no group and stay, once for each doc_id; an empty table
    gives no rows; a column of any name is kept.
    """
    kept = jaccard_components(docs, n, num, den).where("doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct()
    own = [f"c{i}" for i in range(len(docs.columns))]  # names that can't clash
    lower = [c.lower() for c in docs.columns]
    ident, text = (F.col(own[lower.index(c)]) for c in ("doc_id", "text"))
    rows = docs.toDF(*own)
    left = rows.join(kept, ident.cast("long") == F.col("kept"), "left_semi")
    rest = [F.xxhash64(c) for c, f in zip(own, docs.schema, strict=True) if "map<" not in f.dataType.simpleString()]
    once = left.withColumn("nth", F.row_number().over(Window.partitionBy(ident).orderBy(F.xxhash64(text), *rest))).where("nth = 1").drop("nth")
    return once.unionByName(rows.where(ident.isNull())).toDF(*docs.columns)
