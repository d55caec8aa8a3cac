"""Chunks: the recursive splitter, filters, ids, audit."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import EngineConfig
from ..functions import text as X
from ..functions.store import settled
from .hierarchy import REFERENCE, YEAR, attach_hierarchy, is_reference

SEPARATORS = ("\n\n", "\n", ". ", "; ", ": ", ", ", " ", "")  # fixed values
VERSION = "canonical_page_recursive_v10"  # fixed value


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Cut at the first separator present, which opens the next piece; merge small pieces up to size, with overlap;
    cut pieces of size or more by the separators that follow. Results are stripped; blank ones go."""
    sep = next((s for s in separators if s == "" or s in text), "")
    rest = separators[separators.index(sep) + 1 :]
    if sep:
        first, *more = text.split(sep)
        pieces = [p for p in (first, *(sep + m for m in more)) if p]
    else:
        pieces = list(text)
    out: list[str] = []
    run: list[str] = []

    def merge() -> None:
        held: list[str] = []
        total = 0
        for p in run:
            if held and total + len(p) > size:
                out.append("".join(held).strip())
                while held and (total > overlap or total + len(p) > size):
                    total -= len(held.pop(0))
            held.append(p)
            total += len(p)
        if held:
            out.append("".join(held).strip())
        run.clear()

    for p in pieces:
        if len(p) < size:
            run.append(p)
            continue
        merge()
        if rest:
            out += split_text(p, size, overlap, rest)
        else:
            out.append(p.strip())
    merge()
    return [x for x in out if x]


def splitter(size: int, overlap: int):
    """split_text as a Column function; marked as not deterministic, so that the optimizer doesn't copy it."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, size, overlap) if t else [])

    return run.asNondeterministic()


def reference_like(text: str | Column) -> Column:
    """No line at all, or at least four citation and four year lines with a fifth of all lines citing."""
    return X.let(X.solid(X.first_lines(text, 80)), _mostly_cites)


def _mostly_cites(ls: Column) -> Column:
    cites = F.size(F.filter(ls, lambda x: is_reference(x) | X.let(F.lower(x), lambda y: y.rlike(f"et{X.WS}+al") & F.contains(X.compact(y), F.lit(" et al")))))
    years = F.size(F.filter(ls, lambda x: X.compact(x).rlike(YEAR)))
    n = F.size(ls)
    return (n == 0) | ((cites >= 4) & (years >= 4) & (cites * 5 >= n))


def chunk_id(book: Column, page: Column, path: Column, index: Column, text: Column, compacted: bool = False) -> Column:
    """book_pPAGE_cINDEX_ and 18 hex digits over what tells the chunk apart. compacted: text is already."""
    payload = F.concat_ws("|", book, page.cast("string"), path, index.cast("string"), F.substring(text if compacted else X.compact(text), 1, 700))
    return F.concat(book, F.lit("_p"), page.cast("string"), F.lit("_c"), index.cast("string"), F.lit("_"), F.substring(F.sha2(payload, 256), 1, 18))


def duplicate_key(book: Column, text: Column, compacted: bool = False) -> Column:
    return F.sha2(F.concat(book, F.lit("|"), F.lower(text if compacted else X.compact(text))), 256)


def first_of_duplicates(chunks: DataFrame, key: Column | None = None) -> DataFrame:
    """The first chunk of each text of a book, in page and chunk order.

    The key is a digest, so copies meet by hash of it; min over a struct sums up each task's rows before the shuffle.
    Chunks are read twice, so they are kept in the shared folder. key: their duplicate_key, if known.
    """
    keyed = settled(chunks.withColumn("__k", duplicate_key(F.col("book_id"), F.col("text")) if key is None else key))
    first = keyed.groupBy("__k").agg(F.min(F.struct("page_number", "chunk_index_on_page")).alias("m")).select("__k", "m.*")
    return keyed.join(first, ["__k", "page_number", "chunk_index_on_page"], "left_semi").drop("__k")


def create_chunks(pages: DataFrame, config: EngineConfig | None = None, dealt: bool = False) -> DataFrame:
    """Chunks of the indexable pages: numbered before any filter; short, reference-like and repeated ones go.
    dealt: as for attach_hierarchy."""
    config = config or EngineConfig()
    hier = attach_hierarchy(pages, config, dealt).where("indexable")
    pieces = hier.withColumn("__p", splitter(config.chunk_size, config.chunk_overlap)("text")).drop("text")
    cut = pieces.select(*[c for c in pieces.columns if c != "__p"], F.posexplode("__p").alias("chunk_index_on_page", "text"))
    cut = cut.withColumn("chunk_index_on_page", F.col("chunk_index_on_page") + 1)
    good = cut.where(~X.compact_under("text", config.min_chunk_characters) & ~reference_like("text"))
    ident = lambda c: chunk_id(*[F.col(x) for x in ("book_id", "page_number", "hierarchy_path", "chunk_index_on_page")], c, compacted=True)
    keys = X.let(X.compact("text"), lambda c: F.struct(duplicate_key(F.col("book_id"), c, compacted=True).alias("k"), ident(c).alias("id")))
    out = first_of_duplicates(good.withColumn("__s", keys), F.col("__s.k")).withColumn("chunk_id", F.col("__s.id")).drop("__s")
    out = out.withColumn("chunk_size_characters", F.length("text")).withColumn("text", X.strip("text"))
    return out.select(*[c for c in out.columns if c != "chunk_id"], F.lit(VERSION).alias("chunking_version"), "chunk_id")


def suspicious(chapter: str = "chapter_title", kind: str = "content_type") -> Column:
    c = X.compact(chapter)
    return c.isin("", "Front Matter") | c.rlike(REFERENCE) | F.contains(F.lower(c), F.lit(" et al")) | (F.coalesce(F.col(kind), F.lit("")) != "body")


def audit(chunks: DataFrame) -> DataFrame:
    """section (total, book, chapter), name, chunks, suspicious: in one pass over grouping sets."""
    d = chunks.select(
        F.coalesce("book_title", F.lit("Unknown")).alias("book"), F.coalesce(F.nullif(X.compact("chapter_title"), F.lit("")), F.lit("Missing")).alias("chapter"),
        F.when(suspicious(), F.col("chunk_id")).alias("bad"),
    )
    sets = d.groupingSets([["book"], ["chapter"], []], "book", "chapter").agg(F.grouping_id().alias("g"), F.count("*").alias("chunks"), F.count_distinct("bad").alias("suspicious"))
    kind = F.when(F.col("g") == 1, "book").when(F.col("g") == 2, "chapter").otherwise("total")
    return sets.select(kind.alias("section"), F.when(F.col("g") == 1, F.col("book")).when(F.col("g") == 2, F.col("chapter")).otherwise("").alias("name"), "chunks", "suspicious")


def top_chapters(chunks: DataFrame, n: int = 20) -> DataFrame:
    return audit(chunks).where("section = 'chapter'").orderBy(F.desc("chunks"), "name").limit(n).select("name", "chunks")


def check_audit(chunks: DataFrame, titles: set[str]) -> None:
    """Raises unless the chunks are of exactly these titles and none is suspicious."""
    rows = audit(chunks).where("section <> 'chapter'").collect()
    found = {r["name"] for r in rows if r["section"] == "book"}
    if found != titles:
        raise RuntimeError(f"unexpected books in the index: {sorted(found)}")
    if bad := next(r["suspicious"] for r in rows if r["section"] == "total"):
        raise RuntimeError(f"{bad} suspicious chunks")
