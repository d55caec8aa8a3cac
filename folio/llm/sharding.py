"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Groups of equal texts are the items. A group of over 1/FINE of a shard (so at most 3 * FINE * shards of them, for the
three sizes) is an item of its own; all smaller ones are dealt by hash into a fixed number of buckets, which are the
items then. Items, largest first, go where the dot product of their sizes with the residual capacity is highest. A
group is split into rows only if it can't fit: if it is over a shard, or if it makes its shard hold over SLACK of its share of
bytes; then all is placed anew with that group in parts.

The law is `bytes`: the shards' bytes are near equal. slot numbers a shard's rows from 0: rank within a bucket
of the shard's rows plus the rows of the buckets before it, so no shard's rows meet in one task.

Cases: a null text is a group of its own with size 1 and no crc; repeated rows are equal texts; ties between
shards go to the lower number; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import persist, slim

BUCKETS = 16384
SLICES = 1024
FINE = 1024
SLACK = 1.01
#: parts of a shard's share that a group which can't fit is split into
PARTS = 64


def pack_vectors(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item. items: sizes by dimension; largest first, to the highest dot product with what is left.

    Sizes count as shares of a shard's mean, so that the dimensions weigh alike. The first dimension has a
    double weight: its law must hold.
    """
    mean = np.maximum(items.sum(axis=0) / shards, 1e-12)
    x = items / mean
    room = np.ones((shards, items.shape[1]))
    weight = np.array([2.0] + [1.0] * (items.shape[1] - 1))
    out = np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -x.max(axis=1))):
        to = int(np.argmax(np.round(room @ (x[i] * weight), 12)))
        out[i] = to
        room[to] -= x[i]
    return out


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, tokens, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    spark = docs.sparkSession
    text = slim(docs, "doc_id", "text")
    rows = text.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.regexp_count("text", F.lit("[^ \\t\\n\\x0B\\f\\r]+")), F.lit(0)).cast("long").alias("tokens"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.xxhash64("text", F.length("text")).alias("group"),
        F.monotonically_increasing_id().alias("row"),  # fixed by the table written
    )
    rows, _ = persist(rows, "shard-rows")
    groups = rows.groupBy("group").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n"))
    total = rows.agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    part = [max(float(total[k] or 0), 1.0) / shards for k in "btn"]
    share = F.greatest(*[F.col(k) / F.lit(p) for k, p in zip("btn", part, strict=True)])
    bucket = F.pmod(F.xxhash64("group", F.lit(9)), F.lit(BUCKETS)).cast("long")
    large = groups.withColumn("share", share).where(F.col("share") > 1.0 / FINE)
    big = large.orderBy("group").select("group", "share", "b", "t", "n").collect()  # at most 3 * FINE * shards rows
    own = spark.createDataFrame(pa.table({"group": pa.array([r["group"] for r in big], pa.int64())}))
    small = rows.join(F.broadcast(own), "group", "left_anti").groupBy(bucket.alias("item")).agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n")).orderBy("item").toPandas()
    base = small[["b", "t", "n"]].to_numpy(np.float64)
    parts = [math.ceil(r["share"] * PARTS) if r["share"] > 1 else 1 for r in big]
    while True:
        whole = np.repeat(np.arange(len(big)), parts)  # the group of each large item
        sizes = np.array([[r["b"], r["t"], r["n"]] for r in big], np.float64).reshape(-1, 3)[whole] / np.array(parts, np.float64)[whole][:, None]
        to = pack_vectors(np.concatenate([base, sizes]), shards) if len(base) + len(sizes) else np.zeros(0, np.int64)
        load = np.bincount(to, weights=np.concatenate([base, sizes])[:, 0], minlength=shards)
        excess = load / max(load.sum() / shards, 1.0) - SLACK
        at = to[len(base) + np.searchsorted(whole, np.arange(len(big)))].tolist()
        # groups that make up half of what their shard holds too much; the largest of each shard is split
        fault = [k for k in range(len(big)) if parts[k] == 1 and big[k]["n"] > 1 and excess[at[k]] > 0 and big[k]["b"] / part[0] > max(1 / PARTS, excess[at[k]] / 2)]
        if not fault:
            break
        for k in {at[k]: k for k in sorted(fault, key=lambda k: big[k]["b"])}.values():
            parts[k] = math.ceil(big[k]["share"] * PARTS)
    first = np.searchsorted(whole, np.arange(len(big)))
    sent = spark.createDataFrame(pa.table({"group": pa.array([r["group"] for r in big], pa.int64()), "parts": pa.array(parts, pa.int64()), "first": pa.array(first, pa.int64())}))
    mine = F.lit(BUCKETS) + F.col("first") + F.pmod(F.xxhash64("row", F.lit(3)), F.col("parts"))
    dealt = rows.join(F.broadcast(sent), "group", "left").withColumn("item", F.when(F.col("first").isNull(), bucket).otherwise(mine))
    names = np.array([*small["item"].tolist(), *(BUCKETS + np.arange(len(whole))).tolist()], np.int64)
    if max(parts, default=1) > 1:  # parts by hash are not quite equal: they are placed by what they hold
        held = dealt.where("parts > 1").groupBy("item").agg(F.sum("size"), F.sum("tokens"), F.count("*")).toPandas().to_numpy(np.float64)
        sizes = np.concatenate([base, sizes])
        sizes[len(base) + np.flatnonzero(np.array(parts)[whole] > 1)] = 0
        sizes[len(base) + held[:, 0].astype(np.int64) - BUCKETS] = held[:, 1:]
        to = pack_vectors(sizes, shards)
    item = spark.createDataFrame(pa.table({"item": pa.array(names), "shard": pa.array(to, pa.int32())}))
    placed = dealt.join(F.broadcast(item), "item").withColumn("slice", F.pmod(F.xxhash64("row", F.lit(4)), F.lit(SLICES)))
    count = placed.groupBy("shard", "slice").agg(F.count("*").alias("n"))  # at most SLICES rows a shard
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    earlier = count.select("shard", "slice", F.coalesce(before, F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("row"))
    out = placed.withColumn("r", rank - 1).join(F.broadcast(earlier), ["shard", "slice"])
    return out.select("doc_id", "size", "tokens", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("r")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
