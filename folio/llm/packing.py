"""Best-fit packing of token pieces into fixed-length sequences, by bin completion over a length histogram.

Documents become ids plus a closing id 0; only longer ones are cut, the first piece being the shorter one.
Bins are solved on the histogram of piece lengths, which has at most `capacity` entries however large the
corpus, so the driver's work is bounded. Bin completion, branch and bound: a node completes the largest length left
with an undominated filling, least waste first, and applies it as often as the counts and the waste that is left to
beat the incumbent allow. Best-fit decreasing is the first incumbent. The search is anytime: it ends when a packing
meets the lower bound, or after `node_limit` nodes or `step_limit` steps of enumeration (documented parameters), with
the best packing known.
Pieces then find their places by rank within their length: rank = pieces of that length in
earlier partitions + running number, so no length, however common, meets in one task.

Cases: null text counts as empty and gives one piece of the closing id; repeated rows give repeated pieces with
places of their own; an empty table gives no rows; extra columns are ignored; a null doc_id is kept as it is.
"""

from __future__ import annotations

import base64
import bisect
import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_schema, persist, slim, tidy

CAPACITY = 2048


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=1)
def encoder(json_path: str):
    """A function from texts to lists of ids, equal to `tokenizers` on json_path with add_special_tokens=False.

    Where the same vocabulary lies beside it as ranks, texts of plain Latin letters without special tokens
    go through tiktoken, which gives the same ids four times as fast; all others go through tokenizers.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(json_path)
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    ranks = json_path.removesuffix(".json") + ".tiktoken"
    quick = None
    if os.path.exists(ranks):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={})

    def encode(texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        rest = []
        for i, t in enumerate(texts):
            if quick is not None and (t.isascii() or max(t) < "ɐ") and not any(s in t for s in special):
                out[i] = np.asarray(quick.encode_to_numpy(t), dtype="<u4")
            else:
                rest.append(i)
        for i, e in zip(rest, whole.encode_batch([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.asarray(e.ids, dtype="<u4")
        return out

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, but for the first."""
    first = n % capacity or min(n, capacity)
    at = [0, *range(first, n, capacity)]
    return [(a, b - a) for a, b in zip(at, [*at[1:], n], strict=True)]


PIECES = "doc_id long, piece int, start long, length long, ids binary, part int, nth long"


def token_pieces(docs: DataFrame, json_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with their ids (little-endian unsigned 32 bits); part and nth number equal lengths within a task."""
    path = json_path or tokenizer_path()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        encode = encoder(path)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                ids = b.column(0).slice(lo, 512).to_pylist()
                texts = [t or "" for t in b.column(1).slice(lo, 512).to_pylist()]
                cols: list[list] = [[] for _ in range(7)]
                for d, t in zip(ids, encode(texts), strict=True):
                    t = np.append(t, np.uint32(0)).astype("<u4")
                    for k, (s, n) in enumerate(cut(len(t), capacity)):
                        for c, x in zip(cols, (d, k, s, n, t[s : s + n].tobytes(), part, int(seen[n])), strict=True):
                            c.append(x)
                        seen[n] += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids", "part", "nth"])

    return slim(docs, "doc_id", "text").mapInArrow(run, as_schema(PIECES))


@dataclass(frozen=True)
class Pattern:
    """times bins, each filled with these lengths."""

    lengths: tuple[int, ...]
    times: int


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins needed at least: by volume, and by the lengths over half with what no longer fits beside them."""
    size = np.arange(len(counts))
    best = math.ceil(int((size * counts).sum()) / capacity)
    half = capacity // 2
    big = np.cumsum(counts[::-1])[::-1]
    vol = np.concatenate([[0], np.cumsum(size * counts)])
    for a in range(1, half + 1):
        over = int(big[min(capacity - a + 1, len(counts) - 1)]) if capacity - a + 1 < len(counts) else 0
        mid_n = int(big[half + 1]) - over if half + 1 < len(counts) else 0
        mid_v = int(vol[capacity - a + 1] - vol[half + 1])
        small_v = int(vol[half + 1] - vol[a])
        best = max(best, over + mid_n + max(0, math.ceil((small_v - (mid_n * capacity - mid_v)) / capacity)))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing on the histogram: the incumbent."""
    left, out = counts.copy(), []
    sizes = np.flatnonzero(left)
    while len(sizes):
        top = int(sizes[-1])
        fill, room, times = [top], capacity - top, int(left[top])
        used = {top: 1}
        while room > 0:
            fit = sizes[: np.searchsorted(sizes, room, side="right")]
            s = next((int(s) for s in fit[::-1] if left[s] > used.get(int(s), 0)), 0)
            if not s:
                break
            fill.append(s)
            used[s] = used.get(s, 0) + 1
            room -= s
        times = min(int(left[s]) // k for s, k in used.items())
        for s, k in used.items():
            left[s] -= k * times
        out.append(Pattern(tuple(fill), times))
        sizes = np.flatnonzero(left)
    return out


def reachable(sizes: np.ndarray, capacity: int) -> list[int]:
    """For each length the sums, as a set of bits, that lengths up to it can make, each any number of times."""
    bits, out, full = 1, [], (1 << (capacity + 1)) - 1
    have = set(sizes.tolist())
    for s in range(capacity + 1):
        if s in have and s:
            step = s
            while step <= capacity:
                bits |= bits << step & full
                step *= 2
        out.append(bits)
    return out


def dominated(taken: list[tuple[int, int]], spare: int, room: int) -> bool:
    """Whether a length left over (spare, a set of bits) could take the place of some items of a filling, or of none:
    of two or more that sum to it, or of any whose sum is less by the waste, room, at most."""
    one, two = 1, 0  # sums of any items, of two items or more
    for s, k in taken:
        for _ in range(k):
            two |= two << s | (one ^ 1) << s
            one |= one << s
    wide, width = one << 1, 1  # the sums, each plus 1 to width
    while width < room:
        step = min(width, room - width)
        wide |= wide << step
        width += step
    return bool(two & spare or (room and wide & spare))


def fillings(left: np.ndarray, room: int, most: int, reach: list[int], budget: list[int]) -> Iterator[tuple[tuple[int, int], ...]]:
    """The undominated fillings ((length, times), ...) of room by the lengths left with a waste of at most `most`, by
    bands of ever more waste. budget[0] steps are left for all enumeration; without, the greedy filling alone comes."""
    if room and left[room]:
        yield ((room, 1),)  # one item that fills the room dominates all others
        return
    sizes = np.flatnonzero(left[: room + 1]).tolist()
    spare = sum(1 << s for s in sizes)

    def grow(i: int, free: int, low: int, high: int, taken: list[tuple[int, int]]) -> Iterator[tuple[tuple[int, int], ...]]:
        """Fillings whose waste is from low to high, with lengths up to sizes[i]."""
        budget[0] -= 1
        if free < low:
            return
        if free <= high and not dominated(taken, spare & ~sum(1 << s for s, k in taken if left[s] <= k), free):
            yield tuple(taken)
        for k in range(min(i, bisect.bisect_right(sizes, free) - 1), -1, -1):
            s = sizes[k]
            if budget[0] < 0 or not reach[s] >> max(free - high, 0) & (1 << (min(high, free) - low + 1)) - 1:
                return  # no sum of lengths up to this one leaves a waste in the band
            for times in range(min(int(left[s]), free // s), 0, -1):
                yield from grow(k - 1, free - times * s, low, high, [*taken, (s, times)])

    low, none = 0, True
    while low <= min(room, most) and budget[0] >= 0:
        high = min(4 * low, room, most)
        for filling in grow(len(sizes) - 1, room, low, high, []):
            none = False
            yield filling
        low = high + 1
    if none and budget[0] < 0:
        greedy = []
        for s in reversed(sizes):
            if times := min(int(left[s]), room // s):
                greedy.append((s, times))
                room -= s * times
        yield tuple(greedy)


def bin_completion(counts: np.ndarray, capacity: int = CAPACITY, node_limit: int = 20000, step_limit: int = 200000, report: dict | None = None) -> list[Pattern]:
    """Patterns that hold all counts in as few bins as the search finds within its limits.

    Depth first; the bins that the volume and the waste so far need bound a branch from below. A packing that the
    search completes is taken if it needs no more bins than best-fit. report, if given, gets what the search did.
    """
    counts = counts.astype(np.int64)
    goal = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    best_bins = at_first = sum(p.times for p in best)
    volume = int((np.arange(len(counts)) * counts).sum())
    reach = reachable(np.flatnonzero(counts), capacity)
    nodes, searched, budget = 0, False, [step_limit]
    # a frame: the histogram left, the patterns so far, the bins, the waste, the largest length and its fillings left
    stack: list[list] = [[counts.copy(), (), 0, 0, 0, None]]
    while stack and nodes < node_limit and counts.any() and (best_bins > goal or not searched):
        left, done, bins, waste, top, todo = stack[-1]
        # waste that a packing of fewer bins (at first: of no more) than the incumbent can still have
        slack = (best_bins - searched) * capacity - volume - waste
        if todo is None:
            nodes += 1
            if not left.any():
                best, best_bins, searched = _unroll(done), bins, True
                stack.pop()
                continue
            top = int(np.flatnonzero(left)[-1])
            rest = left.copy()
            rest[top] -= 1
            todo = fillings(rest, capacity - top, slack, reach, budget)
            stack[-1][4:] = [top, todo]
        fill = next(todo, None)
        if fill is None:
            stack.pop()
            continue
        used = dict(fill)
        used[top] = used.get(top, 0) + 1
        lost = capacity - sum(s * k for s, k in used.items())
        times = min(int(left[s]) // k for s, k in used.items())
        if lost:
            times = min(times, slack // lost)
        if times <= 0:
            continue
        after = left.copy()
        for s, k in used.items():
            after[s] -= k * times
        lengths = tuple(s for s in sorted(used, reverse=True) for _ in range(used[s]))
        stack.append([after, (done, Pattern(lengths, times)), bins + times, waste + lost * times, 0, None])
    if report is not None:
        report |= {"lower_bound": goal, "best_fit": at_first, "bins": best_bins, "nodes": nodes, "steps": step_limit - budget[0], "by_search": searched}
    return best


def _unroll(done: tuple) -> list[Pattern]:
    out = []
    while done:
        done, p = done
        out.append(p)
    return out[::-1]


def places(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """(length, rank_from, rank_to, first sequence, offset): pieces of a length, by rank, take one bin each.

    Bounded by the patterns (about one for each length) times the items of a bin.
    """
    rank: dict[int, int] = {}
    out, first = [], 0
    for p in patterns:
        at = 0
        for n in p.lengths:
            r = rank.get(n, 0)
            out.append((n, r, r + p.times, first, at))
            rank[n] = r + p.times
            at += n
        first += p.times
    return out


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with length, part, nth, read from a table) with sequence_id and offset."""
    spark = pieces.sparkSession
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
        counts[r["length"]] = r["n"]
    rows = places(bin_completion(counts, capacity))
    kind = "length long, lo long, hi long, first long, offset long"
    where = spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5, names=kind.replace(" long", "").split(", ")))
    ranked = pieces.join(base.select("length", "part", "before"), ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    hit = (ranked["length"] == where["length"]) & (ranked["rank"] >= where["lo"]) & (ranked["rank"] < where["hi"])
    out = ranked.join(F.broadcast(where), hit).select(ranked["*"], (where["first"] + ranked["rank"] - where["lo"]).alias("sequence_id"), where["offset"].alias("offset"))
    return out.drop("part", "nth", "before", "rank")


def packed_pieces(docs: DataFrame, json_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece.

    The ids are written once, to the shared folder; only narrow columns are shuffled.
    """
    table, _ = persist(token_pieces(docs, json_path, capacity), "pieces", "zstd")
    narrow = table.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return place(narrow, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, json_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves, ids as little-endian unsigned 32 bits."""
    table, _ = persist(token_pieces(docs, json_path, capacity), "pieces", "zstd")
    items = F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("items")  # a sequence has capacity ids at most
    joined = F.expr("aggregate(items, X'', (a, x) -> concat(a, x.ids))").alias("ids")
    return place(table, capacity).groupBy("sequence_id").agg(items).select("sequence_id", joined)
