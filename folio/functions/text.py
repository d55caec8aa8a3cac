"""Text normalisers as Column functions. They differ on purpose; don't use one for another.

Compatibility normal forms have no built-in, so they are Arrow UDFs, which pass ASCII through.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dims import STOP_WORDS

#: all of Unicode's white space and the separators 1C to 1F, as a plain class, which matches faster than one under (?U)
WS = "[\\t-\\r\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
SOLID = "[^" + WS[1:]
#: the characters of WS, to trim
BLANKS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
LINE_BREAK = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"
#: Arabic letters that fold, and to what
FOLD_FROM, FOLD_TO = "أإآىؤئ", "ااايوي"
DIACRITICS = "[\\u0610-\\u061A\\u064B-\\u065F\\u0670\\u06D6-\\u06ED]"
TOKEN = "([A-Za-z0-9]+|[\\u0600-\\u06FF]+)"
PREFIXES = ("وال", "فال", "بال", "كال")


def _form(kind: str):
    def one(x):
        return x if x is None or x.isascii() else unicodedata.normalize(kind, x)

    def run(s: pd.Series) -> pd.Series:
        return s.map(one, na_action="ignore")

    def run_array(s: pd.Series) -> pd.Series:
        return s.map(lambda a: None if a is None else [one(x) for x in a])

    udf, array_udf = F.pandas_udf(run, T.StringType()), F.pandas_udf(run_array, T.ArrayType(T.StringType()))

    def form(c: Column) -> Column:
        """Only texts beyond ASCII go to the UDF; the others stay in the JVM."""
        return F.coalesce(udf(F.when(c.rlike("[^\\x00-\\x7F]"), c)), c)

    return form, array_udf


nfkc, nfkc_array = _form("NFKC")
nfkd, nfkd_array = _form("NFKD")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body of value, worked out once. A plain column used inside a lambda may be inlined there by the optimizer and
    then be worked out for every element; a lambda's own argument can't be."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: str | Column) -> Column:
    """Without white space at both ends (all of Unicode's)."""
    return F.btrim(col(c), F.lit(BLANKS))


def replaced(c: str | Column, mark: str, pattern: str, to: str) -> Column:
    """pattern replaced, with only the texts gone through that contain mark, without which it can't match."""
    return let(col(c), lambda t: F.when(F.contains(t, F.lit(mark)), F.regexp_replace(t, pattern, to)).otherwise(t))


def _split(t: Column, limit: int = -1) -> Column:
    """At line breaks; without a carriage return each is one character, which is told faster."""
    return F.when(F.contains(t, F.lit("\r")), F.split(t, LINE_BREAK, limit)).otherwise(F.split(t, LINE_BREAK.removeprefix("\\r\\n|"), limit))


def lines(c: str | Column) -> Column:
    """The lines of a text; no empty one after a last break."""
    return let(let(col(c), _split), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def normalize_unicode(c: str | Column) -> Column:
    t = nfkc(F.coalesce(col(c), F.lit("")))
    t = replaced(t, "\r", "\\r\\n?", "\n")
    t = F.replace(t, F.lit("\u00a0"), F.lit(" "))
    return F.regexp_replace(t, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\u00AD\\u200B-\\u200D\\uFEFF]", "")


def detection_line(c: str | Column) -> Column:
    """A line as repeated lines are told: lower case, digits as #."""
    t = F.lower(strip(c))
    return F.regexp_replace(F.regexp_replace(t, "\\p{Nd}+", "#"), "\\t[ \\t]*| [ \\t]+", " ")  # a single blank stays as it is


def compact(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), f"{WS}+", " "))


def compact_under(c: str | Column, n: int) -> Column:
    """Whether compact(c) has fewer than n characters; told by its beginning where that has as many already."""
    return F.when(F.length(compact(F.substring(col(c), 1, 2 * n))) >= n, F.lit(False)).otherwise(F.length(compact(c)) < n)


def _search_form(c: Column) -> Column:
    t = F.regexp_replace(F.lower(c), DIACRITICS, "")
    t = F.translate(t, FOLD_FROM + "ـ", FOLD_TO)
    return F.array_join(F.regexp_extract_all(t, F.lit(TOKEN), F.lit(1)), " ")


def search_text(c: str | Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, or of Arabic; other letters separate."""
    return _search_form(nfkc(F.coalesce(col(c), F.lit(""))))


def search_tokens(c: str | Column) -> Column:
    """search_text's words without stop words; never empty."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    words = F.filter(F.split(search_text(c), " "), lambda w: (w != "") & ~F.array_contains(stop, w))
    return F.when(F.size(words) == 0, F.array(F.lit("__empty__"))).otherwise(words)


def _marks_off(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, "\\p{Mn}+|\\u0640", ""), FOLD_FROM, FOLD_TO)


def _match_token(w: Column) -> Column:
    n = F.length(w)
    cut3 = F.lit(False)
    for p in PREFIXES:
        cut3 = cut3 | w.startswith(p)
    bare = F.when(cut3 & (n >= 6), F.substring(w, 4, 1 << 30)).when((n >= 5) & (w.startswith("لل") | w.startswith("ال")), F.substring(w, 3, 1 << 30)).otherwise(w)
    return F.when(w.rlike("[\\u0600-\\u06FF]"), bare).otherwise(w)


def _match_form(c: Column) -> Column:
    words = F.regexp_extract_all(_marks_off(c), F.lit("([\\p{L}\\p{N}]+)"), F.lit(1))
    return F.array_join(F.filter(F.transform(words, _match_token), lambda w: w != ""), " ")


def match_text(c: str | Column) -> Column:
    """Words of letters and digits, accents folded, Arabic articles off: the form phrases are matched in."""
    return _match_form(nfkd(strip(F.lower(F.coalesce(col(c), F.lit(""))))))


def has_phrase(matched: Column, phrases: Iterable[Column | str]) -> Column:
    """Whether any phrase (both sides in match form) is a run of whole words; an empty side never is."""
    out = F.lit(False)
    for p in phrases:
        q = F.lit(p) if isinstance(p, str) else p
        out = out | ((matched != "") & (q != "") & F.contains(F.concat(F.lit(" "), matched, F.lit(" ")), F.concat(F.lit(" "), q, F.lit(" "))))
    return out


def match_form(value: str) -> str:
    """match_text of a constant, on the driver, for dimension tables."""
    t = unicodedata.normalize("NFKD", value.lower().strip())
    table = str.maketrans(FOLD_FROM, FOLD_TO)
    t = "".join(ch for ch in t if unicodedata.category(ch) != "Mn" and ch != "ـ").translate(table)
    out = []
    for w in "".join(ch if ch.isalnum() else " " for ch in t).split():
        if any("؀" <= ch <= "ۿ" for ch in w):
            if w[:3] in PREFIXES and len(w) >= 6:
                w = w[3:]
            elif w[:2] in ("لل", "ال") and len(w) >= 5:
                w = w[2:]
        out.append(w)
    return " ".join(out)


def query_text(c: str | Column) -> Column:
    """compact; an empty query raises."""
    t = compact(c)
    return F.when(t == "", F.raise_error(F.lit("The query cannot be empty."))).otherwise(t)


def search_form(value: str) -> str:
    """search_text of one string, in Python."""
    t = re.sub(DIACRITICS, "", unicodedata.normalize("NFKC", value).lower())
    return " ".join(re.findall(TOKEN, t.translate(str.maketrans(FOLD_FROM, FOLD_TO, "\u0640"))))


def _distinct(values) -> list[str]:
    kept: dict[str, str] = {}
    for v in values:
        clean = " ".join((v or "").split())
        if not clean:
            raise ValueError("The query cannot be empty.")
        if key := search_form(clean):
            kept.setdefault(key, clean)
    return list(kept.values())


#: Marked as not deterministic so that the optimizer doesn't copy it into what reads its result.
_unique = F.pandas_udf(lambda s: s.map(_distinct), T.ArrayType(T.StringType())).asNondeterministic()


def unique_strings(values: str | Column) -> Column:
    """The distinct strings by search_text, in order, first spelling; those without a token go; a blank one raises."""
    return _unique(col(values))


def ascii_form(c: str | Column) -> Column:
    """search_text of ASCII text, which needs no compatibility forms and so no UDF."""
    return _search_form(col(c))


def distinct_by_form(pairs: list[tuple[Column, Column]]) -> Column:
    """unique_strings of a few (value, form) pairs, without a UDF of its own: Spark doesn't always take out a UDF that
    stands over another's result within a lambda, and then can't run the plan. Blank values go by their empty form."""
    items = F.array(*[F.struct(compact(v).alias("v"), f.alias("f")) for v, f in pairs])
    step = lambda a, x: F.when((x["f"] == "") | F.exists(a, lambda k: k["f"] == x["f"]), a).otherwise(F.array_append(a, x))
    return let(items, lambda i: F.transform(F.aggregate(i, F.slice(i, 1, 0), step), lambda k: k["v"]))


def first_lines(c: str | Column, most: int) -> Column:
    """The first `most` raw lines."""
    parts = let(F.coalesce(col(c), F.lit("")), lambda t: _split(t, most + 1))  # the rest of the text isn't cut
    return F.slice(parts, 1, most)


def solid(lines: Column) -> Column:
    """Without blank lines."""
    return F.filter(lines, lambda x: x.rlike(SOLID))


def page_lines(c: str | Column, most: int = 70) -> Column:
    """The first `most` raw lines, each compacted, without blank ones."""
    return F.transform(solid(first_lines(c, most)), compact)


def safe_html(c: str | Column) -> Column:
    t = F.coalesce(col(c), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t
