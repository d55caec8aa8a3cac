"""python -m folio STEP: runs the engine up to a step over a folder of books, or a question over an index, and prints a report."""

from __future__ import annotations

import argparse
import importlib
import os
from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import EngineConfig
from .operators import answer, chunk, clean, embed
from .plans import retrieval
from .sources import pages as P

STEPS = ("documents", "preprocess", "chunks", "embeddings", "context", "answer")


def named(path: str) -> Callable:
    """module:function."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def options(argv: Sequence[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="python -m folio", description=__doc__)
    p.add_argument("step", choices=STEPS)
    p.add_argument("--books", help="folder of PDF files; else RAG_BOOKS_DIR, books or data/books")
    p.add_argument("--index", default=os.environ.get("RAG_INDEX_DIRECTORY", "index"), help="where embeddings writes the index and context and answer read it")
    p.add_argument("--question", default="What food groups support healthy growth in children?")
    p.add_argument("--extractor", type=named, default=P.pdf_texts, help="module:function from a file's bytes to its page texts")
    p.add_argument("--embedder", type=named, help="module:function from texts to vectors")
    p.add_argument("--generator", type=named, help="module:function, a Column function of instructions and prompt")
    p.add_argument("--env", default=".env", help="file of KEY=value lines")
    return p.parse_args(argv)


def report(title: str, df: DataFrame, order: str | None = None) -> None:
    """Reports are small: a row for each book, or the chunks of one question."""
    print(title)
    for r in (df.orderBy(order) if order else df).collect():
        print("  " + ", ".join(f"{k}: {v}" for k, v in r.asDict().items()))


def ask(spark: SparkSession, o: argparse.Namespace, config: EngineConfig) -> None:
    index = P.read_index(spark, o.index)
    asked = spark.createDataFrame([("q", o.question)], "query_id string, question string")
    if o.step == "answer":
        report("Answer", retrieval.answer_questions(asked, index, config).select("status", "retrieved_count", "answer"))
        return
    got = retrieval.retrieve_context(asked, index, config)
    report("Question", got["questions"].select("question", "expansion", "rewritten"))
    report("Sources", got["chunks"].select("position", F.round("final_score", 4).alias("score"), answer.citation().alias("citation"), F.substring("text", 1, 260).alias("text")), "position")


def build(spark: SparkSession, o: argparse.Namespace, config: EngineConfig) -> None:
    raw = P.load_documents(spark, config, o.extractor)
    if o.step == "documents":
        return report("Pages", P.document_report(raw), "book_title")
    cleaned = clean.preprocess(P.usable_pages(raw, config.min_page_characters), config.min_clean_characters)
    if o.step == "preprocess":
        return report("Cleaning", clean.preprocessing_report(raw, cleaned))
    chunks = chunk.create_chunks(cleaned, config)
    if o.step == "chunks":
        report("Chunks", chunk.audit(chunks).where("section <> 'chapter'"), "name")
        return report("Chapters", chunk.top_chapters(chunks))
    P.write_index(embed.with_embeddings(chunks, config.embedder, config.embedding_batch), o.index)
    written = P.read_index(spark, o.index)
    embed.check_embeddings(written)
    report("Vectors", embed.embedding_checks(written))


def main(argv: Sequence[str] | None = None) -> None:
    o = options(argv)
    P.load_environment(o.env)
    config = EngineConfig(embedder=o.embedder, generator=o.generator)
    if o.books:
        config = replace(config, books_dir=o.books)
    spark = SparkSession.builder.appName("folio").getOrCreate()
    (ask if o.step in ("context", "answer") else build)(spark, o, config)


if __name__ == "__main__":
    main()
