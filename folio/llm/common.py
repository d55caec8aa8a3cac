"""Shared pieces of the training-data operators: shared folder, held-out rows, samples, id bitmaps."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where a local session has none, as in tests, a local folder is made and kept for the session; a cluster
    without one is refused, as each machine would write to its own disk.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folio-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def persist(df: DataFrame, name: str, codec: str = "snappy", cols: list[str] | None = None) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folio/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Delete a persisted table that no pending result reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str | Column, mod: int) -> Column:
    """crc32 of doc_id as text, modulo mod; null for a null doc_id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(mod)


BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows and about BATCH_BYTES: a Python worker holds one batch at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def slim(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra or clashing ones can't interfere; absent ones as null."""
    small_batches(df.sparkSession)
    have = {c.lower(): c for c in df.columns}
    kinds = {"doc_id": "bigint", "text": "string", "lang": "string", "n_chars": "bigint"}
    return df.select(*[(F.col(f"`{have[n]}`") if n in have else F.lit(None)).cast(kinds.get(n, "string")).alias(n) for n in names])


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run for mapInArrow; at its end the worker, which Spark uses again, gives freed memory back."""

    @functools.wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # only glibc has it
                pass

    return inner


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: Column, keep: Column, per_class: int, form: Callable[[pa.Array], list[bytes]], max_bytes: int = 65536
) -> tuple[list[bytes], list[int], dict[int, int]]:
    """A bounded sample of labelled rows for fitting: forms of the texts, labels, and rows per class in all labels.

    Bounds (documented parameters): at most per_class labelled documents of each class, the first by a hash of
    the id, and texts of at most max_bytes bytes. A document labelled more than once has its largest label, one
    with more than one text its least by hash. Texts become features on the executors; only these come to the
    driver. Only fitting is bounded so; scoring covers every whole text.
    """
    lab = labels.where(keep & label.isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label.cast("int")).alias("y"))
    lab = lab.withColumn("h", F.xxhash64("doc_id", F.lit(17)))
    counts = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y in sorted(counts):
        part = lab.where(F.col("y") == y).orderBy("h", "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    if picked is None:
        return [], [], {}
    ids = {r["doc_id"]: r["y"] for r in picked.select("doc_id", "y").collect()}  # at most per_class for each class
    small = docs.sparkSession.createDataFrame(list(ids.items()), "doc_id long, y int")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(form(b.column(2)), pa.binary())], ["doc_id", "y", "h", "form"])

    texts = slim(docs, "doc_id", "text").where(F.octet_length("text") <= max_bytes).join(F.broadcast(small), "doc_id")
    formed = texts.select("doc_id", "y", "text", F.xxhash64("text").alias("h")).mapInArrow(run, as_schema("doc_id long, y int, h long, form binary"))
    rows = formed.groupBy("doc_id").agg(F.min_by(F.struct("y", "form"), "h").alias("r")).select("doc_id", "r.y", "r.form").toArrow().sort_by("doc_id")
    return [x.as_py() for x in rows["form"]], rows["y"].to_pylist(), counts


BITMAP_BITS = 23


def id_slot(c: str) -> Column:
    return F.pmod(F.xxhash64(F.col(c), F.lit(5)), F.lit(1 << BITMAP_BITS))


def id_bitmap(df: DataFrame, c: str) -> bytes:
    """A bitmap of 2**BITMAP_BITS bits over hashed ids: 1 MB whatever the number of ids.

    It only spares work (a set bit may be another id's); an exact join follows it.
    """
    h = id_slot(c) + 1  # bucket numbers count from 1
    rows = (
        df.select(h.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("b"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("m")).collect()
    )
    size = 4096
    out = bytearray((1 << BITMAP_BITS) // 8)
    for r in rows:
        at = (r["b"] - 1) * size
        out[at : at + size] = bytes(r["m"])[: len(out) - at]
    return bytes(out)


def as_schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)
