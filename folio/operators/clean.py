"""Cleaning: repeated edge lines of a book, artefacts, broken lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.store import settled

EDGE = 5
BOOKS = 10_000
VERSION = "school_medical_safe_v5"  # fixed value

#: Patterns of what is noise
DOWNLOAD = "(?isu)Downloaded\\s+from\\s+https?://.*?(?:on\\s+\\d{1,2}\\s+[A-Za-z]+\\s+\\d{4}|by\\s+guest\\s+on\\s+\\d{1,2}\\s+[A-Za-z]+\\s+\\d{4})"
LAYOUT_STAMP = "(?iuU)\\b\\S+\\.indd\\s+\\d+\\s+\\d{1,2}/\\d{1,2}/\\d{2,4}\\s+\\d{1,2}:\\d{2}\\s*(?:AM|PM)?"
GLUED = (("Chapter", "(?U)(?<=\\d{4})(?=\\d{2,4}\\s+Chapter\\s+\\d+)"), ("Section", "(?U)(?<=\\d)(?=Section\\s+[IVXLC]+:)"), ("Chapter", "(?U)(?<=\\d)(?=Chapter\\s+\\d+)"))
BROKEN_WORD = "(?U)[-\\u2010\\u2011](?<=[A-Za-z].)\\s*\\n\\s*(?=[A-Za-z])"
NOISE = "[\\uFFFD\\u25A1\\u25A0\\u25C6]+"
URL_LINE = "(?iuU)^\\s*(?:https?://|www\\.)\\S+\\s*\\z"
PAGE_NUMBER = "(?iuU)^\\s*(?:page\\s*)?\\d+\\s*\\z"
PAGE_NUMBER_FORM = "(?U)^\\s*(?:page\\s*)?#\\s*\\z"
BROKEN_LINE = "\\n(?<![.!?:;\\]]\\n)(?=[a-z])"


def edge_forms(text: Column) -> Column:
    """Distinct detection forms of a page's first and last EDGE non-blank lines (text: unicode-normalised)."""
    return F.array_distinct(F.filter(F.transform(F.array_distinct(ends(X.solid(X.lines(text)))), X.detection_line), lambda x: x != ""))


def repeated_edge_lines(pages: DataFrame, min_pages: int = 12, ratio: float = 0.12, edges: str | None = None) -> DataFrame:
    """book_id, line, pages: edge lines on at least max(min_pages, ratio of the book's pages) pages, of 4 characters or more.

    Two aggregations with partial sums; nothing is kept for a page but its edge lines. edges: a column of them, if known.
    """
    forms = pages.select("book_id", F.col(edges).alias("e")) if edges else pages.select("book_id", X.normalize_unicode("text").alias("t")).select("book_id", edge_forms(F.col("t")).alias("e"))
    need = pages.groupBy("book_id").agg(F.greatest(F.lit(min_pages), F.bround(F.count("*") * F.lit(ratio)).cast("long")).alias("need"))
    seen = forms.select("book_id", F.explode("e").alias("line")).groupBy("book_id", "line").agg(F.count("*").alias("pages"))
    seen = seen.where((F.col("pages") >= min_pages) & (F.length("line") >= 4))  # few are left to meet by book
    return seen.join(need, "book_id").where(F.col("pages") >= F.col("need")).select("book_id", "line", "pages")


def without_artefacts(t: Column) -> Column:
    t = X.replaced(X.replaced(t, "://", DOWNLOAD, "\n"), "/", LAYOUT_STAMP, "\n")
    for mark, p in GLUED:
        t = X.replaced(t, mark, p, "\n")
    return t


def ends(places: Column) -> Column:
    """The first and last EDGE elements of an array."""
    return X.let(places, lambda p: F.concat(F.slice(p, 1, EDGE), F.slice(p, F.greatest(F.lit(1), F.size(p) - EDGE + 1), EDGE)))


def without_repeated_edges(t: Column, repeated: Column) -> Column:
    """Without the edge lines whose detection form is in repeated, or that are a bare page number."""

    def solid(all_: Column) -> Column:
        return F.filter(F.transform(all_, lambda x, i: F.when(X.strip(x) != "", i)), lambda i: i.isNotNull())

    def kept(all_: Column, edge: Column) -> Column:
        return F.filter(all_, lambda x, i: ~(F.array_contains(edge, i) & (F.array_contains(repeated, X.detection_line(x)) | x.rlike(PAGE_NUMBER))))

    return X.let(X.lines(t), lambda a: X.let(ends(solid(a)), lambda e: F.array_join(kept(a, e), "\n")))


def has_edges_to_go(forms: Column, repeated: Column) -> Column:
    """Whether some edge line, by its detection form, is repeated or a bare page number."""
    return F.arrays_overlap(forms, repeated) | F.exists(forms, lambda x: x.rlike(PAGE_NUMBER_FORM))


def clean_text(df: DataFrame, repeated: str, text: str = "text", normalised: str | None = None, edges: str | None = None) -> DataFrame:
    """df with text cleaned; repeated: a column of the book's repeated lines (null or empty: none, then no line is taken off).

    normalised, edges: columns of the unicode-normalised text and its edge forms, if known. Lines are gone through for
    edges only where one has to go."""
    df = df.withColumn("__u", F.col(normalised) if normalised else X.normalize_unicode(text))
    df = df.withColumn("__e2", F.col(edges) if edges else edge_forms(F.col("__u"))).withColumn("__n", without_artefacts(F.col("__u")))
    some = F.coalesce(F.size(repeated), F.lit(0)) > 0
    # taking artefacts out may bring up other edges, so only an unchanged text is told by its forms
    same = (F.col("__n") == F.col("__u")) & ~has_edges_to_go(F.col("__e2"), F.col(repeated))
    untouched = F.array_join(X.lines(F.col("__n")), "\n")
    df = df.withColumn("__c", F.when(~some, F.col("__n")).when(same, untouched).otherwise(without_repeated_edges(F.col("__n"), F.col(repeated))))
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace("__c", BROKEN_WORD, ""), NOISE, " "), "\\t[ \\t]*| [ \\t]+", " ")  # a single blank stays as it is
    kept = F.filter(F.transform(X.lines(t), X.strip), lambda x: (x == "") | ~x.rlike(URL_LINE))
    t = F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), BROKEN_LINE, " "), "\\n{3,}", "\n\n")
    return df.withColumn(text, X.strip(t)).drop("__u", "__e2", "__n", "__c")


def preprocess(pages: DataFrame, least: int = 60, min_pages: int = 12, ratio: float = 0.12) -> DataFrame:
    """Pages cleaned by their book's repeated lines; those of fewer than `least` characters go.

    A book has few repeated lines: at most one for each 0.12 of its pages' ten edge lines, 83. So a book's set is
    one short array, sent to each task, as a join by book_id would clean a book in one task; beyond BOOKS of them the
    join is by book_id. Pages are dealt by book and number, normalised once and kept in the shared folder, as both the
    repeated lines and the cleaning read them.
    """
    if "page_number" in pages.columns:  # else a file of one row group would be one task
        pages = pages.repartition("book_id", "page_number")
    base = pages.withColumn("original_character_count", F.length(F.coalesce("text", F.lit("")))).withColumn("text", X.normalize_unicode("text"))
    base = settled(base.withColumn("__f", edge_forms(F.col("text"))))
    sets = settled(repeated_edge_lines(base, min_pages, ratio, "__f").groupBy("book_id").agg(F.sort_array(F.collect_set("line")).alias("__rep")))
    sets = F.broadcast(sets) if sets.count() <= BOOKS else sets
    out = clean_text(base.join(sets, "book_id", "left"), "__rep", normalised="text", edges="__f").drop("__rep", "__f")
    # a plain filter would be pushed below the cleaning, with a copy of all its steps in it for each mention of a column
    long_enough = F.filter(F.array(F.struct(*out.columns)), lambda r: F.length(r["text"]) >= least)
    out = out.select(F.inline(long_enough))
    return out.withColumns({"preprocessed": F.lit(True), "preprocessing_version": F.lit(VERSION), "clean_character_count": F.length("text")})


def preprocessing_report(pages: DataFrame, cleaned: DataFrame) -> DataFrame:
    a = pages.agg(F.count("*").alias("pages_in"), F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)).alias("characters_in"))
    b = cleaned.agg(F.count("*").alias("pages_out"), F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)).alias("characters_out"))
    return a.join(b, F.lit(True)).withColumn("characters_removed", F.col("characters_in") - F.col("characters_out"))  # one row each
