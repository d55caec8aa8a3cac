"""Personal data: base patterns, and information-theoretic sanitisation of terms that reveal it.

Base spans are the leftmost matches, not overlapping, of four kinds of entity. A term (lower-cased word of
letters, three at least, outside the mentions) reveals an entity if the corpus ties the two. The one space of all
probabilities are the corpus's segments: sentences, or lines. With n_t segments that hold the term, n_e the entity and
n_te both, of N, the pointwise mutual information log p(e|t) / p(e), with p(e|t) = n_te / (n_t + 1/2), half a segment
without the entity being added as a doubt, must reach `alpha` times the entity's own information -log p(e). There is
no other gate: a rare word beside an entity that is mentioned once reveals it as well. Terms that reveal an entity are
spans of kind `term`, wherever they stand. Sanitising removes spans of terms and generalises base spans to their kind.

Pairs are counted with partial sums, so frequent entities and copies add little to the shuffle. A pair is dropped
early if the segments with a mention alone hold its term too often; the others' terms are counted over the corpus.

Terms are looked up by a bitmap of fixed size first; joins settle what it lets pass.

Cases: null text counts as empty and has no span; a very long text is scanned whole; repeated rows have equal
spans; ties of start go by kind as listed; an empty table gives no rows; extra
columns are ignored by `find` and kept by `sanitise`; rows are told apart by a number of their own, so repeated
or null doc_ids do no harm.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import as_schema, persist, slim, tidy

KINDS = ("email", "ip", "card", "phone", "term")
BITS = 23
ALPHA = 0.95
#: terms whose documents a task counts before it hands the counts on
HELD = 200_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# possessive: a run of digits is taken whole, as a shorter part of it can't match where the whole doesn't
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]+")
#: the end of a segment, for Python and for the plan alike
END = r"[.!?](?=[ \t\r\n])|\n"
_END = re.compile(END)


def _luhn(d: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """From each @, to the left over the local part as far as the last match, to the right over the domain."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        i = at
        while i > last and text[i - 1] in _LOCAL:
            i -= 1
        m = _DOMAIN.match(text, at) if i < at else None
        if m:
            out.append((i, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def entity(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else re.sub('[^0-9]', '', value)}"


def lowered(words: list[str]) -> list[str]:
    return pc.utf8_lower(pa.array(words, pa.string())).to_pylist()


def slots(words: pa.Array) -> np.ndarray:
    """The slot of each word, a non-empty one."""
    h, _ = K.words(*K.text_bytes(words), None)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def with_slot(terms: DataFrame) -> DataFrame:
    """terms (term first) with their slots."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(slots(b.column(0)))], [*b.schema.names, "slot"])

    return terms.mapInArrow(run, as_schema(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in terms.schema) + ", slot long"))


class Words:
    """The words of a text column whose slot is set: lower-cased terms, by row and segment."""

    def __init__(self, column: pa.Array, bits: np.ndarray):
        t = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
        t = pc.replace_substring_regex(t, r"[.!?]([ \t\r\n])", "\n\\1")
        t = pc.replace_substring_regex(t, r"[^\p{L}\p{Nl}\p{No}\n]+", " ")
        self.data, bounds = K.text_bytes(t)
        rows, starts, ends, found = [], [], [], []
        for i, j in K.row_pieces(bounds):
            own, rel = self.data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
            a, b, at = K.word_spans(own, rel)
            h = K.hash_spans(own, a, b)
            hit = np.flatnonzero(np.take(bits, h >> np.uint64(64 - BITS)))
            rows.append(i + np.searchsorted(at, hit, "right") - 1)
            starts.append(a[hit] + bounds[i])
            ends.append(b[hit] + bounds[i])
            found.append(h[hit])
        none = [np.zeros(0, np.int64)]
        self.row, self.start, self.end, self.hash = (np.concatenate(x or none) for x in (rows, starts, ends, found))
        self.bounds = bounds

    def term(self, k: int) -> str:
        return self.data[self.start[k] : self.end[k]].tobytes().decode()

    def by_segment(self) -> Iterator[tuple[str, int]]:
        """Each term with the number of segments that hold it."""
        cuts = np.union1d(np.flatnonzero(self.data == 10), self.bounds[1:])
        order = np.lexsort([np.searchsorted(cuts, self.start, "right"), self.hash])
        seg, h = np.searchsorted(cuts, self.start, "right")[order], self.hash[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        once = new.copy()
        once[1:] |= seg[1:] != seg[:-1]
        first = np.flatnonzero(new)
        for k, n in zip(order[first], np.add.reduceat(once, first, dtype=np.int64) if len(first) else [], strict=True):
            yield self.term(k), int(n)

    def by_row(self, n: int) -> list[list[str]]:
        """The distinct terms of each of n rows."""
        out: list[set[str]] = [set() for _ in range(n)]
        for k, r in enumerate(self.row):
            out[r].add(self.term(k))
        return [sorted(x) for x in out]


def terms(segment: str) -> list[str]:
    return sorted({w for w in lowered(_TERM.findall(segment)) if len(w) > 2})


def contexts(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[list[str], list[str]]]:
    """(entities, terms outside mentions) of each segment that holds a mention. A mention that goes over an end of
    segments joins them."""
    ends = [m.end() for m in _END.finditer(text)]
    at = 0
    while at < len(spans):
        k = bisect.bisect_right(ends, spans[at][1])
        lo, hi = ends[k - 1] if k else 0, spans[at][2]
        found, parts, last = set(), [], lo
        while True:
            k = bisect.bisect_left(ends, hi)
            stop = ends[k] if k < len(ends) else len(text)
            if at == len(spans) or spans[at][1] >= stop:
                break
            kind, a, b = spans[at]
            found.add(entity(kind, text[a:b]))
            parts.append(text[last : max(a, last)])
            last, hi, at = max(last, b), max(hi, b), at + 1
        yield sorted(found), terms("\n".join([*parts, text[last:stop]]))


class RowNumbers:
    """Numbers of rows, unlike in every task."""

    def __init__(self):
        from pyspark import TaskContext

        self.next = TaskContext.get().partitionId() << 33

    def __call__(self, n: int) -> pa.Array:
        self.next += n
        return pa.array(np.arange(self.next - n, self.next))


def revealing_terms(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """term, slot: the terms that reveal an entity, by the whole corpus."""
    lists = pa.list_(pa.string())

    @tidy
    def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [c for t in b.column(0).to_pylist() if t and (spans := base_spans(t)) for c in contexts(t, spans)]
            yield pa.RecordBatch.from_arrays([pa.array([c[k] for c in out], lists) for k in (0, 1)], ["entities", "terms"])

    text = slim(docs, "text").where("text <> ''")
    held, _ = persist(text.mapInArrow(mentions, as_schema("entities array<string>, terms array<string>")), "mentions", "zstd")
    total = text.agg(F.sum(F.regexp_count("text", F.lit(END)) + 1)).first()[0]
    n = F.count("*")
    by_entity = held.select(F.explode("entities").alias("entity")).groupBy("entity").agg(n.alias("n_e"))
    by_term = held.select(F.explode("terms").alias("term")).groupBy("term").agg(n.alias("n_t"))
    pairs = held.select("terms", F.explode("entities").alias("entity")).select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(n.alias("n_te"))

    def reveals(d: DataFrame) -> DataFrame:
        info = F.log(F.lit(float(total or 1)) / F.col("n_e"))
        return d.where((info > 0) & (F.log(F.col("n_te") / (F.col("n_t") + 0.5)) + info >= alpha * info))

    tied = reveals(pairs.join(by_entity, "entity").join(by_term, "term")).select("term", "entity", "n_te", "n_e")
    tied, _ = persist(with_slot(tied), "tied")
    if tied.isEmpty():
        return tied.select("term", "slot")
    bits = docs.sparkSession.sparkContext.broadcast(slot_bitmap(tied))

    @tidy
    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, count = slot_table(bits.value), Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["term", "n"])
            count.clear()
            return out

        for b in batches:
            for term, n in Words(b.column(0), table).by_segment():
                count[term] += n
            if len(count) >= HELD:
                yield flush()
        if count:
            yield flush()

    everywhere = text.mapInArrow(hits, as_schema("term string, n long")).groupBy("term").agg(F.sum("n").alias("n_t"))
    return reveals(tied.join(everywhere, "term")).select("term", "slot").distinct()


def slot_bitmap(terms: DataFrame) -> bytes:
    h = F.col("slot") + 1
    rows = terms.select(h.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("m")).collect()
    out = bytearray((1 << BITS) // 8)
    for r in rows:  # at most 2**BITS / 32768 rows of 4 KB
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = bytes(r["m"])
    return bytes(out)


def slot_table(bits: bytes) -> np.ndarray:
    """The bitmap as one boolean for each slot (8 MB)."""
    return np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)


def find(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """doc_id, base array<struct<kind,start,end>>, spans (base and term spans, by start, then kind) for every row."""
    d = slim(docs, "doc_id", "text")
    terms, _ = persist(revealing_terms(d, alpha), "terms")
    bits = docs.sparkSession.sparkContext.broadcast(slot_bitmap(terms))
    span = "array<struct<kind string, start long, end long>>"

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, number = slot_table(bits.value), RowNumbers()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        maybe_kind = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            texts = b.column(1).to_pylist()
            spans = [base_spans(t) if t else [] for t in texts]
            maybe: list[list[dict]] = [[] for _ in texts]
            for r in np.unique(Words(b.column(1), table).row) if table.any() else []:
                taken = np.zeros(len(texts[r]) + 1, bool)
                for _, a, e in spans[r]:
                    taken[a:e] = True
                at = [m.span() for m in _TERM.finditer(texts[r])]
                low = lowered([texts[r][a:e] for a, e in at])
                for k in np.flatnonzero(table[slots(pa.array(low))]):
                    if not taken[at[k][0] : at[k][1]].any():
                        maybe[r].append({"term": low[k], "start": at[k][0], "end": at[k][1]})
            base = [[{"kind": k, "start": a, "end": e} for k, a, e in s] for s in spans]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, kind), pa.array(maybe, maybe_kind), number(b.num_rows)], ["doc_id", "base", "maybe", "__row"])

    got = d.mapInArrow(run, as_schema(f"doc_id long, base {span}, maybe array<struct<term string, start long, end long>>, __row long"))
    got, _ = persist(got, "spans")
    sure = got.select("__row", F.inline("maybe")).join(terms.select("term"), "term").groupBy("__row").agg(F.collect_list(F.struct(F.lit("term").alias("kind"), "start", "end")).alias("more"))
    all_ = F.concat("base", F.coalesce("more", F.expr(f"cast(array() as {span})")))
    order = F.array_sort(F.transform(all_, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("no"), s["end"].alias("end"), s["kind"].alias("kind"))))
    spans = F.transform(order, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return got.join(sure, "__row", "left").select("doc_id", "base", spans.alias("spans"))


def text_of(spans: str) -> Column:
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans and all spans as text."""

    def of(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    count = [of(k) for k in KINDS[:4]]
    return found.select("doc_id", *count, F.sha2(text_of("base").cast("binary"), 256).alias("base_sha256"), text_of("spans").alias("spans"))


def redact(text: str, terms: set[str]) -> str:
    """Base spans become <KIND>; terms that reveal an entity go."""
    spans = base_spans(text)
    if terms:
        taken = [(a, b) for _, a, b in spans]
        words = [m.span() for m in _TERM.finditer(text)]
        hit = [w for w, low in zip(words, lowered([text[a:b] for a, b in words]), strict=True) if low in terms]
        spans += [("term", a, b) for a, b in hit if not any(x < b and a < y for x, y in taken)]
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < last:  # overlaps what is gone already
            last = max(last, b)
            continue
        out += [text[last:a], "" if kind == "term" else f"<{kind.upper()}>"]
        last = b
    return "".join([*out, text[last:]])


def sanitise(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """docs, all rows and columns, with text sanitised and n_chars, if there, counted anew.

    One scan finds each row's terms that may reveal something and clears the rows without one; the others' terms are
    settled by a join, come back as a list for each row, and the texts are cleared then.

    Cases: a null text stays null, an empty one empty; a very long one is cleared whole; repeated rows are cleared
    alike; an empty table gives no rows; a column of any name is kept.
    """
    at = [c.lower() for c in docs.columns].index("text")
    n_chars = next((i for i, c in enumerate(docs.columns) if c.lower() == "n_chars"), None)
    terms, _ = persist(revealing_terms(docs, alpha), "terms")
    bits = docs.sparkSession.sparkContext.broadcast(slot_bitmap(terms))
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names that can't clash
    plain = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    @tidy
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, number = slot_table(bits.value), RowNumbers()
        for b in batches:
            texts = b.column(at).to_pylist()
            maybe = Words(b.column(at), table).by_row(b.num_rows) if table.any() else [[]] * b.num_rows
            cols = list(b.columns)
            cols[at] = pa.array([t if t is None or m else redact(t, set()) for t, m in zip(texts, maybe, strict=True)], b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(maybe, pa.list_(pa.string())), number(b.num_rows)], [*b.schema.names, "maybe", "row"])

    @tidy
    def clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(b.columns[:-1])
            out = [redact(t, set(k or ())) for t, k in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)]
            cols[at] = pa.array(out, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, b.schema.names[:-1])

    scanned = rows.mapInArrow(first, as_schema(f"{plain}, maybe array<string>, row long"))
    if terms.isEmpty():
        done = scanned.drop("maybe", "row")
    else:
        scanned, _ = persist(scanned, "scanned", "zstd")
        some = scanned.where(F.size("maybe") > 0)
        sure = some.select("row", F.explode("maybe").alias("term")).join(terms.select("term"), "term").groupBy("row").agg(F.collect_set("term").alias("sure"))
        left = some.join(sure, "row", "left").drop("maybe", "row").mapInArrow(clear, as_schema(plain))
        done = scanned.where(F.size("maybe") == 0).drop("maybe", "row").unionByName(left)
    if n_chars is not None:
        done = done.withColumn(f"c{n_chars}", F.length(f"c{at}").cast(docs.schema[n_chars].dataType))
    return done.toDF(*docs.columns)
