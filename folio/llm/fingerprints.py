"""Document fingerprints by closed syncmers, in DataFrame functions only.

A text is a sequence of tokens: runs without ASCII white space of up to 32 characters; a longer run is cut after each
vowel of a, e, i, o, u, digit, or letter without case (as of scripts that don't part words), or after 32 characters
where none comes, so an edit moves the cuts beside it only. Inner
substrings (s-mers) are runs of two tokens, by hash; a k-mer of six tokens has five of them, and is chosen if the
least lies at its first or last place. Whether a k-mer is chosen depends on nothing but itself, so an edit
changes only the anchors that touch it. Of four k-mers in a row one is chosen; texts of fewer than eight s-mers may
have none, so they keep all s-mers, and every text with a token has a fingerprint.

The fingerprint is the chosen k-mers' hashes, eight hex digits each, in order of first occurrence; the likeness
of two is the Jaccard index of their sets, 1 for two empty ones, 0 if one is empty. `anchors` gives them with
their places, for positional matching.

Cases: null text counts as empty and has an empty fingerprint; repeated rows are documents of their own, next
to each other in the descending order (ties of doc_id by hash of the text); a null doc_id comes last; a single
row's next document is itself; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import slim

GROUP, GROUPS = 32, 32
LEAST = -(1 << 63)


_SOLID = "[^ \\t\\n\\x0B\\f\\r]"
_WHOLE = f"(?<!{_SOLID}){_SOLID}{{1,32}}+(?!{_SOLID})"
_PIECE = f"{_SOLID}{{0,31}}?[aeiouAEIOU0-9\\p{{Lo}}]|{_SOLID}{{1,32}}"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"{_WHOLE}|{_PIECE}"), F.lit(0))


def with_anchors(df: DataFrame, text: str, out: str, places: bool = False) -> DataFrame:
    """Adds array `out` of the distinct 32-bit anchors of a text column; with places, of structs (place, hash)."""
    t, h = f"__t_{out}", f"__h_{out}"
    df = df.withColumn(t, tokens(F.col(text)))
    df = df.withColumn(h, F.transform(F.col(t), lambda x, i: F.xxhash64(x, F.get(F.col(t), i + 1))))
    s = F.col(h)
    n = F.size(s)
    mask = F.lit((1 << 32) - 1)

    def chosen(x: Column, i: Column) -> Column:
        edge = F.least(x, F.get(s, i + 4))
        inner = F.least(F.get(s, i + 1), F.get(s, i + 2), F.get(s, i + 3))
        value = F.xxhash64(x, F.get(s, i + 2), F.get(s, i + 4)).bitwiseAND(mask)
        return F.when((i <= n - 5) & (edge <= inner), F.struct(i.alias("place"), value.alias("hash")) if places else value)

    every = F.transform(s, lambda x, i: F.struct(i.alias("place"), x.bitwiseAND(mask).alias("hash")) if places else x.bitwiseAND(mask))
    some = F.filter(F.transform(s, chosen), lambda x: x.isNotNull())
    picked = F.when(n < 8, every).otherwise(some)
    return df.withColumn(out, picked if places else F.array_distinct(picked)).drop(t, h)


def likeness(a: str, b: str) -> Column:
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - both
    return F.when(total == 0, F.lit(1.0)).otherwise(both / total).cast("double")


def hexed(a: str) -> Column:
    return F.array_join(F.transform(F.col(a), lambda x: F.lpad(F.hex(x), 8, "0")), "")


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, place (token number), hash: every chosen k-mer of every text, for joins that match places."""
    d = slim(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    return with_anchors(d, "text", "a", places=True).select("doc_id", F.inline("a"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, anchors and the next document's (descending doc_id, then the first again).

    Ids are cut into ranges at up to GROUP * GROUPS quantiles that occur; the last row of a range finds its next
    in a copy of the first row of the range below. So no task sorts more than a range.
    """
    key = F.coalesce("doc_id", F.lit(LEAST))
    d = slim(docs, "doc_id", "text").withColumn("k", key)
    share = [i / (GROUP * GROUPS) for i in range(1, GROUP * GROUPS + 1)]
    got = d.agg(F.percentile_approx("k", share, 10 * GROUP * GROUPS).alias("q"), F.max("k").alias("top")).first()
    cuts = sorted({*(got["q"] or []), *([got["top"]] if got["top"] is not None else [LEAST])})
    parts = [cuts[i : i + GROUP] for i in range(0, len(cuts), GROUP)]
    arrays = F.array(*[F.array(*[F.lit(x).cast("long") for x in p]) for p in parts])
    last = F.array(*[F.lit(p[-1]).cast("long") for p in parts])
    group = F.size(F.filter(last, lambda x: x < F.col("k")))
    d = d.withColumn("g", group).withColumn("own", F.get(arrays, F.col("g")))
    inner = F.size(F.filter(F.col("own"), lambda x: x < F.col("k")))
    d = d.withColumn("i", inner)
    at = F.col("g") * GROUP + F.col("i")
    here = F.struct(at.alias("range"), F.lit(False).alias("copy"))
    above = F.struct(F.pmod(at + 1, F.lit(len(cuts))).alias("range"), F.lit(True).alias("copy"))
    top = F.get("own", F.col("i")) == F.col("k")
    d = d.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "k", F.explode(F.when(top, F.array(here, above)).otherwise(F.array(here))).alias("r"))
    d = d.select("doc_id", "text", "k", "r.range", "r.copy", F.xxhash64("text").alias("tie"))
    order = [F.col("copy").asc(), F.col("k").desc(), F.col("tie").asc()]
    d = d.repartition("range").sortWithinPartitions(F.col("range").asc(), *order)
    d = with_anchors(d, "text", "a")
    w = Window.partitionBy("range").orderBy(*order)
    d = d.withColumn("next_text", F.lead("text").over(w)).withColumn("next_a", F.lead("a").over(w))
    return d.where("not copy").select("doc_id", "text", "a", "next_text", "next_a")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row."""
    d = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - cut).cast("int"))
    edited = F.concat(kept, F.substring(F.col("next_text"), F.lit(1), cut))
    d = d.withColumn("edited", edited)
    d = with_anchors(d, "edited", "ea")
    return d.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), hexed("a").alias("fingerprint"),
        hexed("ea").alias("edited_fingerprint"), likeness("a", "ea").alias("near_edited"), likeness("a", "next_a").alias("near_next"),
    )
