"""Continuous ingest: new page files become chunks with vectors in the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..config import EngineConfig
from ..plans.retrieval import build_index
from ..schemas import PAGE


def ingest_pages(spark: SparkSession, source: str, index: str, checkpoint: str, config: EngineConfig | None = None) -> StreamingQuery:
    """A micro-batch tells which books have new pages; each of them is built anew from all its pages below source, as its
    repeated lines and headings need them all, and takes the place of its former chunks.

    The index is laid out as `write_index` leaves it, by book, and only the partitions of the books built are
    overwritten. So a batch that is run again after a failure, a book that comes in several batches and a page file
    delivered twice all leave each chunk once.
    """

    def put(batch: DataFrame, _: int) -> None:
        touched = batch.select("book_id").distinct()
        whole = spark.read.schema(PAGE).parquet(source).join(touched, "book_id", "left_semi").distinct()
        built = build_index(whole, config)
        built.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_id").parquet(index)

    return spark.readStream.schema(PAGE).parquet(source).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
