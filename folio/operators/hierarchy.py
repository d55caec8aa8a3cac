"""Page classes, headings, and the hierarchy that carries forward through a book."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import EngineConfig
from ..functions import text as X
from ..functions.store import settled
from ..functions.dims import CHAPTER_TITLES, EXCLUDED_CHAPTERS, EXCLUDED_SECTIONS, INFANT_MARKERS, SECTION_TITLES

VERSION = "canonical_school_v10"  # fixed value

#: Patterns of headings and references
CHAPTER_LINE = "(?iuU)^\\s*(?:\\d{1,4}\\s+)?Chapter\\s+(\\d{1,3})(?:\\s+.*)?\\z"
SECTION_LINE = "(?iuU)^\\s*(?:Section\\s+)?([IVXLC]+)\\s*[:.-]\\s*([^\\n]{3,120})\\z"
NUMBERED_LINE = "(?U)^\\s*(\\d{1,2}(?:\\.\\d{1,2}){1,2})\\s+([A-Z][A-Za-z0-9 ,/&()'’\\-–—:]{1,180})\\s*\\z"
REFERENCE = "(?U)^\\s*\\d{1,3}[.)]?\\s+[A-Z][A-Za-z'’\\-]+(?:\\s+[A-Z][A-Za-z'’\\-]+)?(?:,|\\s+[A-Z]{1,4},)"
YEAR = "(?U)\\b(?:19|20)\\d{2}\\b"
INDEX_MARKS = ("subject index", "author index", "index of terms")
NOT_TITLES = ("et al", "doi", "journal", "university", "published online", "references", "table ", "figure ", "fig ")


def starts_with_digit(line: Column) -> Column:
    return line.rlike(f"^{X.WS}*\\p{{Nd}}")


def is_reference(line: Column) -> Column:
    """Whether a raw line, compacted, is a REFERENCE; only lines that begin with a digit are compacted for it."""
    return starts_with_digit(line) & X.compact(line).rlike(REFERENCE)


def heading_lines(lines: Column, most: int) -> Column:
    """The lines of `lines`' first `most` that aren't blank, compacted; a hyphen for one that can't be a heading, as it
    neither begins with a digit nor names a chapter or section."""
    low = lambda x: any_of(F.lower(x), ("chapter", "section"))
    return F.transform(X.solid(F.slice(lines, 1, most)), lambda x: F.when(starts_with_digit(x) | low(x), X.compact(x)).otherwise("-"))


def any_of(c: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for p in parts])


def titles_map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])


def book_layout(book_id: str | Column = "book_id") -> Column:
    b = F.lower(F.coalesce(X.col(book_id), F.lit("")))
    return F.when(b == "aap8", "aap_chapter").when(b == "pnp3", "pnp_numbered").otherwise("unknown")


def page_class(config: EngineConfig, book_id: str = "book_id", page: str = "page_number", text: str = "text", lines: str | None = None) -> Column:
    """front_matter, index, references, low_text or body: the first that holds. lines: a column of the text's first 80
    raw lines, if known."""
    return X.let(F.col(lines) if lines else X.first_lines(text, 80), lambda ls: _page_class(ls, config, book_id, page, text))


def _page_class(lines: Column, config: EngineConfig, book_id: str, page: str, text: str) -> Column:
    b, n = F.col(book_id), F.coalesce(F.col(page), F.lit(0))
    refs = F.size(F.filter(lines, lambda x: is_reference(x) & X.compact(x).rlike(YEAR)))
    front = ((b == "aap8") & (n < config.aap_body_start)) | ((b == "pnp3") & (n < config.pnp_body_start))
    rest = F.when(X.compact_under(text, 60), "low_text").otherwise("body")
    marked = lambda raw: F.contains(raw, F.lit("index")) & any_of(X.compact(raw), INDEX_MARKS)
    by_head = lambda raw: F.when(marked(raw), "index").when(X.strip(raw).startswith("references") | (refs >= 5), "references").otherwise(rest)
    return F.when(front, "front_matter").otherwise(X.let(F.lower(F.array_join(F.slice(lines, 1, 12), " ")), by_head))


def chapter_label(number: Column) -> Column:
    """Chapter n: title; without a title where n has none."""
    title = F.try_element_at(titles_map((i, t) for i, t in enumerate(CHAPTER_TITLES, 1)), number.cast("int"))
    return F.concat(F.lit("Chapter "), number.cast("int").cast("string"), F.coalesce(F.concat(F.lit(": "), title), F.lit("")))


def section_label(number: Column, extracted: Column | None = None) -> Column:
    title = F.coalesce(F.try_element_at(titles_map(SECTION_TITLES.items()), number), X.compact(extracted) if extracted is not None else F.lit(""))
    return F.trim(F.concat(number, F.lit(" "), title))


def _first(a: Column) -> Column:
    return F.try_element_at(a, F.lit(1))


FOUND = "struct<part:string,section:string,chapter:string,number:string>"


def chapter_headings(page: str) -> Column:
    """Section from the top 12 lines, chapter of a known number from the top 25; null where none. page: a column of lines."""
    ls = F.col(page)
    sec = _first(F.filter(F.slice(ls, 1, 12), lambda x: x.rlike(SECTION_LINE) & F.contains(F.lower(x), F.lit("section"))))
    title = X.strip(F.regexp_replace(X.compact(F.regexp_extract(sec, SECTION_LINE, 2)), "(?U)\\s+\\d+$", ""))
    section = F.concat(F.lit("Section "), F.upper(F.regexp_extract(sec, SECTION_LINE, 1)), F.lit(": "), title)
    num = lambda x: F.regexp_extract(x, CHAPTER_LINE, 1).try_cast("int")
    chap = num(_first(F.filter(F.slice(ls, 1, 25), lambda x: x.rlike(CHAPTER_LINE) & num(x).between(1, len(CHAPTER_TITLES)))))
    return F.struct(F.lit(None).cast("string").alias("part"), section.alias("section"), F.when(chap.isNotNull(), chapter_label(chap)).alias("chapter"), chap.cast("string").alias("number"))


def valid_heading(number: Column, title: Column) -> Column:
    t = X.compact(title)
    dots = F.regexp_count(number, F.lit("\\."))
    return (t != "") & (F.length(t) <= 180) & (F.regexp_count(t, F.lit(",")) <= 3) & ~any_of(F.lower(t), NOT_TITLES) & ~t.rlike(YEAR) & dots.isin(1, 2)


def numbered_headings(page: str) -> Column:
    """Of the first four valid numbered headings, the one with most dots, the first of equals. page: a column of lines."""
    ls = F.col(page)
    good = F.filter(
        F.transform(F.filter(ls, lambda x: x.rlike(NUMBERED_LINE)), lambda x: F.struct(F.regexp_extract(x, NUMBERED_LINE, 1).alias("n"), X.compact(F.regexp_extract(x, NUMBERED_LINE, 2)).alias("t"))),
        lambda h: valid_heading(h["n"], h["t"]),
    )
    ranked = F.array_sort(F.transform(F.slice(good, 1, 4), lambda h, i: F.struct((-F.regexp_count(h["n"], F.lit("\\."))).alias("d"), i.alias("i"), h["n"].alias("n"), h["t"].alias("t"))))
    best = _first(ranked)
    part, sec = F.substring_index(best["n"], ".", 1), F.substring_index(best["n"], ".", 2)
    return F.struct(part.alias("part"), section_label(sec).alias("section"), section_label(best["n"], best["t"]).alias("chapter"), best["n"].alias("number"))


def hierarchy_path(*parts: str) -> Column:
    """Distinct non-empty parts joined, without Front Matter."""
    return F.array_join(F.array_distinct(F.filter(F.array(*[X.compact(p) for p in parts]), lambda x: (x != "") & (x != "Front Matter"))), " > ")


def scope_allows(book_id: str = "book_id", number: str = "chapter_number", path: str = "hierarchy_path", matched: Column | None = None) -> Column:
    n = F.coalesce(F.col(number), F.lit(""))
    as_int = X.strip(n).try_cast("int")
    chapter_ok = F.coalesce(~as_int.isin(*EXCLUDED_CHAPTERS), F.lit(False))
    s = X.strip(n)
    out = reduce(lambda a, b: a | b, [(s == p) | s.startswith(p + ".") for p in EXCLUDED_SECTIONS])
    return F.when(F.col(book_id) == "aap8", chapter_ok).when(F.col(book_id) == "pnp3", ~out & ~any_of(matched if matched is not None else X.match_text(path), INFANT_MARKERS)).otherwise(F.lit(True))


RANGE = 4096
FIELDS = {"part_title": "part", "section_title": "section", "chapter_title": "chapter", "chapter_number": "number"}


def carried(found: DataFrame) -> DataFrame:
    """book_id, page_number and the FIELDS as they stand at each page, from headings (book_id, page_number, FIELDS; null:
    none). Each field carries forward on its own. Pages are taken in ranges of RANGE numbers: within a range by a
    window, and into a range by the last heading of those before it; so no task holds a whole book."""
    d = found.withColumn("__r", F.floor(F.col("page_number") / RANGE))
    ends = d.groupBy("book_id", "__r").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("page_number"))).alias(f"__{f}") for f in FIELDS])
    before = Window.partitionBy("book_id").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    into = ends.select(F.col("book_id").alias("__b"), F.col("__r").alias("__o"), *[F.last(f"__{f}", ignorenulls=True).over(before).alias(f"__in_{f}") for f in FIELDS])
    so_far = Window.partitionBy("book_id", "__r").orderBy("page_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.select("book_id", "page_number", "__r", *[F.last(f, ignorenulls=True).over(so_far).alias(f) for f in FIELDS])
    d = d.join(into, d["book_id"].eqNullSafe(into["__b"]) & d["__r"].eqNullSafe(into["__o"]))
    return d.select("book_id", "page_number", *[F.coalesce(f, f"__in_{f}", F.lit("")).alias(f) for f in FIELDS])


def attach_hierarchy(pages: DataFrame, config: EngineConfig | None = None, dealt: bool = False) -> DataFrame:
    """Each of four fields carries forward on its own over a book's body pages; other pages neither read nor write it.

    Texts are dealt by book and page, so their patterns run in as many tasks as there are partitions; only the
    headings found go through the windows (`carried`) and come back by book and page. Pages of one book and number
    share their headings, of each field the greatest. dealt: the pages are already, as `preprocess` leaves them.
    """
    config = config or EngineConfig()
    d = pages if dealt else pages.repartition("book_id", "page_number")
    d = d.withColumn("book_layout", book_layout()).withColumn("__l", X.first_lines("text", 80))
    d = d.withColumn("content_type", page_class(config, lines="__l")).withColumn("__l", heading_lines(F.col("__l"), 55))
    body = F.col("content_type") == "body"
    none = F.lit(None).cast(FOUND)
    found = F.when(body & (F.col("book_layout") == "aap_chapter"), chapter_headings("__l")).when(body & (F.col("book_layout") == "pnp_numbered"), numbered_headings("__l")).otherwise(none)
    d = settled(d.withColumn("__f", found).drop("__l"))  # read twice below: by the headings, and by what they are joined to
    heads = d.where(body).groupBy("book_id", "page_number").agg(*[F.max(F.nullif(F.col("__f")[f], F.lit(""))).alias(out) for out, f in FIELDS.items()])
    state = carried(heads).withColumnsRenamed({"book_id": "__b", "page_number": "__p"})
    d = d.join(state, d["book_id"].eqNullSafe(state["__b"]) & d["page_number"].eqNullSafe(state["__p"]), "left").drop("__b", "__p", "__f")
    d = d.withColumns({f: F.when(body, F.col(f)) for f in FIELDS})
    d = d.withColumn("hierarchy_version", F.lit(VERSION)).withColumn("hierarchy_path", F.when(body, hierarchy_path("part_title", "section_title", "chapter_title")))
    d = d.withColumn("__m", X.match_text("hierarchy_path")).withColumn("school_scope", F.when(body, scope_allows(matched=F.col("__m")))).drop("__m")
    has = (F.col("hierarchy_path") != "") & (F.col("chapter_number") != "")
    return d.withColumn("indexable", F.coalesce(body & has & (F.col("school_scope") | F.lit(not config.school_scope_only)), F.lit(False)))
