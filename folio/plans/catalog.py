"""Registered queries over the driver's tables, each with its SQL where SQL can express it.

Views: a page is a document, its book the language, its number the rank of its id within the book.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..config import EngineConfig
from ..functions import text as X
from ..functions.store import settled
from ..functions.dims import CHAPTER_TITLES, ENERGY_DRINKS, EXCLUDED_CHAPTERS, EXCLUDED_SECTIONS, INFANT_MARKERS, SECTION_TITLES, SPECIAL_PHRASES, STOP_WORDS, TOPICS
from ..operators import answer, chunk, clean, embed, hierarchy, present, rank, retrieve, understand
from ..sources import pages as P
from . import retrieval

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Only ids are numbered in a window; the texts meet their numbers by id."""
    docs = load(spark, d, "documents")
    numbers = docs.select("doc_id", "lang").distinct().select("doc_id", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")).alias("page_number"))
    return docs.join(numbers, "doc_id").select("doc_id", F.col("lang").alias("book_id"), F.col("source").alias("book_title"), "page_number", "text")


def book_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pages of the two known books, with headings put in: every eleventh opens a chapter or section."""
    p = pages(spark, d).withColumn("n", F.col("page_number"))
    aap = F.col("book_id").isin("en", "de")
    head = F.when(F.col("n") % 11 != 0, "").when(aap, F.concat(F.lit("Chapter "), (F.col("n") / 11 % 52 + 1).cast("int").cast("string"), F.lit("\n"))).otherwise(
        F.concat((F.col("n") / 11 % 3 + 1).cast("int").cast("string"), F.lit("."), (F.col("n") / 33 % 9 + 1).cast("int").cast("string"), F.lit(" Growth and Feeding\n"))
    )
    book = F.when(aap, "aap8").otherwise("pnp3")
    title = F.when(aap, "Pediatric-Nutrition").otherwise("PNP 3rd Edition Book")
    numbers = load(spark, d, "documents").select("doc_id", F.col("lang").alias("book_id")).distinct()
    numbers = numbers.select("doc_id", F.row_number().over(Window.partitionBy(book).orderBy("doc_id")).alias("num"))
    return p.join(numbers, "doc_id").select("doc_id", book.alias("book_id"), title.alias("book_title"), F.col("num").alias("page_number"), F.concat(head, "text").alias("text"), F.lit("f.pdf").alias("source"))


WS = r"[ \t\n\x0B\f\r]"
PG = "(select doc_id, lang as book_id, source as book_title, row_number() over (partition by lang order by doc_id) as page_number, text from documents)"
STRIPPED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
COMPACT = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
MATCH = (
    rf"array_to_string(list_transform(regexp_extract_all(translate(replace(strip_accents(lower(coalesce({{0}}, ''))), 'ـ', ''), '{X.FOLD_FROM}', '{X.FOLD_TO}'), '[\p{{{{L}}}}\p{{{{N}}}}]+'), "
    rf"lambda w: case when length(w) >= 6 and w[1:3] in {X.PREFIXES} then w[4:] when length(w) >= 5 and w[1:2] in ('لل', 'ال') then w[3:] else w end), ' ')"
)
SEARCH = "array_to_string(regexp_extract_all(lower(coalesce(text, '')), '([A-Za-z0-9]+|[؀-ۿ]+)'), ' ')"
STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
TOKENS = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9]+|[؀-ۿ]+'), lambda w: w not in ({STOP}))"
TOK = f"(select doc_id, unnest(case when len({TOKENS}) = 0 then ['__empty__'] else {TOKENS} end) as term from documents)"


# scans and reports
@query(f"select doc_id, length(text)::bigint as n_chars from documents where length({STRIPPED}) >= 40")
def load_low_text_filter(spark, d):
    return P.usable_pages(load(spark, d, "documents").select("doc_id", "text"), 40).select("doc_id", F.length("text").cast("long").alias("n_chars"))


@query("select source as book_title, count(*)::bigint as pages, sum(length(text))::bigint as characters from documents group by rollup (source)")
def document_report(spark, d):
    return P.document_report(load(spark, d, "documents").select(F.col("source").alias("book_title"), "text"))


@query("select doc_id, sha256(text) as fingerprint from documents")
def fingerprint(spark, d):
    return load(spark, d, "documents").select("doc_id", P.fingerprint("text").alias("fingerprint"))


@query(r"""select page_id, case when s = '' then 'book' else replace(s, ' ', '_') end as book_id from (
    select page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g')) as s from pages)""")
def slug_book_id(spark, d):
    ident, _ = P.book_identity("url")
    return load(spark, d, "pages").select("page_id", ident.alias("book_id"))


# normalisers; DuckDB has no NFKC and NFKD, so their SQL holds for texts without compatibility forms, as the tables have
@query(f"select doc_id, {SEARCH} as normalized from documents")
def search_text(spark, d):
    return load(spark, d, "documents").select("doc_id", X.search_text("text").alias("normalized"))


@query(f"select doc_id, {COMPACT} as compacted from documents")
def compact_text(spark, d):
    return load(spark, d, "documents").select("doc_id", X.compact("text").alias("compacted"))


@query(f"select doc_id, {MATCH.format('text')} as matched from documents")
def match_text(spark, d):
    return load(spark, d, "documents").select("doc_id", X.match_text("text").alias("matched"))


@query("select doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') as html from documents")
def safe_html(spark, d):
    return load(spark, d, "documents").select("doc_id", X.safe_html("text").alias("html"))


LINE_LIST = r"list_filter(list_transform((string_split(text, chr(10)))[1:70], lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')"


@query(f"select doc_id, len({LINE_LIST})::int as n, array_to_string({LINE_LIST}, '|') as head from documents")
def page_lines(spark, d):
    ls = X.page_lines("text")
    return load(spark, d, "documents").select("doc_id", F.size(ls).alias("n"), F.array_join(ls, "|").alias("head"))


# cleaning
EDGES = r"""lines as (select book_id, doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as ls from pg),
forms as (select distinct book_id, doc_id, regexp_replace(regexp_replace(lower(l), '\d+', '#', 'g'), '[ \t]+', ' ', 'g') as line
    from (select book_id, doc_id, unnest(list_concat(ls[1:5], ls[greatest(1, len(ls) - 4):])) as l from lines)),
need as (select book_id, greatest(12, round_even(count(*) * 0.12, 0))::bigint as need from pg group by book_id)"""


@query(f"with pg as {PG}, {EDGES} select f.book_id, line, count(*)::bigint as pages from forms f join need n on f.book_id = n.book_id where length(line) >= 4 group by f.book_id, line, need having count(*) >= need")
def repeated_edge_lines(spark, d):
    return clean.repeated_edge_lines(pages(spark, d))



TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
#: clean.preprocess for RE2, which has no look-around: what stands on either side is taken and given back, twice where
#: one match may open the next; NFKC is left out, as the tables have no compatibility forms
CLEANED = rf"""with pg as {PG}, {EDGES},
rep as (select book_id, list(line) as rep from (select f.book_id, line from forms f join need n on f.book_id = n.book_id where length(line) >= 4 group by f.book_id, line, need having count(*) >= need) group by book_id),
n1 as (select doc_id, book_id, text as t0, regexp_replace(regexp_replace(replace(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(160), ' '), '[\x{{00AD}}\x{{200B}}-\x{{200D}}\x{{FEFF}}]', '', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') as t from pg),
n2 as (select *, regexp_replace(regexp_replace(t, '(?is)Downloaded\s+from\s+https?://.*?(?:on\s+\d{{1,2}}\s+[A-Za-z]+\s+\d{{4}}|by\s+guest\s+on\s+\d{{1,2}}\s+[A-Za-z]+\s+\d{{4}})', chr(10), 'g'),
    '(?i)\b\S+\.indd\s+\d+\s+\d{{1,2}}/\d{{1,2}}/\d{{2,4}}\s+\d{{1,2}}:\d{{2}}\s*(?:AM|PM)?', chr(10), 'g') as t2 from n1),
n3 as (select *, regexp_replace(regexp_replace(regexp_replace(t2, '(\d{{4}})(\d{{2,4}}\s+Chapter\s+\d+)', '\1' || chr(10) || '\2', 'g'), '(\d)(Section\s+[IVXLC]+:)', '\1' || chr(10) || '\2', 'g'), '(\d)(Chapter\s+\d+)', '\1' || chr(10) || '\2', 'g') as t3 from n2),
n4 as (select n3.*, rep, string_split(case when ends_with(t3, chr(10)) then t3[:-2] else t3 end, chr(10)) as a from n3 left join rep using (book_id)),
n5 as (select *, list_filter(range(1, len(a) + 1), lambda i: {TRIM.format('a[i]')} <> '') as solid from n4),
n6 as (select *, list_concat(solid[1:5], solid[greatest(1, len(solid) - 4):]) as edge from n5),
n7 as (select doc_id, t0, case when rep is null then t3 else array_to_string(list_filter(a, lambda x, i: not (list_contains(edge, i) and (list_contains(rep, regexp_replace(regexp_replace(lower({TRIM.format('x')}), '\d+', '#', 'g'), '[ \t]+', ' ', 'g'))
    or regexp_matches(x, '(?i)^\s*(?:page\s*)?\d+\s*$')))), chr(10)) end as t from n6),
n8 as (select doc_id, t0, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '([A-Za-z])[-‐‑]\s*\n\s*([A-Za-z])', '\1\2', 'g'), '([A-Za-z])[-‐‑]\s*\n\s*([A-Za-z])', '\1\2', 'g'), '[\x{{FFFD}}\x{{25A1}}\x{{25A0}}\x{{25C6}}]+', ' ', 'g'), '[ \t]+', ' ', 'g') as t from n7),
n9 as (select doc_id, t0, array_to_string(list_filter(list_transform(string_split(case when ends_with(t, chr(10)) then t[:-2] else t end, chr(10)), lambda x: {TRIM.format('x')}), lambda x: x = '' or not regexp_matches(x, '(?i)^\s*(?:https?://|www\.)\S+\s*$')), chr(10)) as t from n8),
n10 as (select doc_id, t0, {TRIM.format(r"regexp_replace(regexp_replace(regexp_replace(t, '(^|[^.!?:;\]])\n([a-z])', '\1 \2', 'g'), '(^|[^.!?:;\]])\n([a-z])', '\1 \2', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")} as text from n9),
cleaned as (select doc_id, text, length(t0)::int as original_character_count, length(text)::int as clean_character_count, '{clean.VERSION}' as preprocessing_version from n10 where length(text) >= 60)"""


@query(CLEANED + " select * from cleaned")
def clean_pages(spark, d):
    return clean.preprocess(pages(spark, d)).select("doc_id", "text", "original_character_count", "clean_character_count", "preprocessing_version")


@query(CLEANED + """ select a.*, b.*, characters_in - characters_out as characters_removed from (select count(*)::bigint as pages_in, sum(length(text))::bigint as characters_in from pg) a,
    (select count(*)::bigint as pages_out, coalesce(sum(length(text)), 0)::bigint as characters_out from cleaned) b""")
def preprocessing_report(spark, d):
    p = pages(spark, d)
    return clean.preprocessing_report(p, clean.preprocess(p))


# index statistics and BM25
@query(f"select term, count(distinct doc_id)::bigint as df from {TOK} group by term")
def term_stats(spark, d):
    idx = load(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return retrieve.term_stats(retrieve.postings(retrieve.tokens(idx, F.col("text"))), 1).select("term", "df")


@query(f"select doc_id as chunk_id, count(*)::bigint as dl from {TOK} group by doc_id")
def doc_len(spark, d):
    idx = load(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return retrieve.doc_lengths(retrieve.tokens(idx, F.col("text")))


BM25 = f"""with tok as {TOK}, post as (select term, doc_id, count(*) as tf from tok group by all), dl as (select doc_id, count(*) as dl from tok group by all),
n as (select count(*) as n from documents), av as (select avg(dl) as avgdl from dl), df as (select term, count(*) as df from post group by term),
raw as (select term, ln(n - df + 0.5) - ln(df + 0.5) as raw from df, n), mean as (select avg(raw) as mean from raw),
idf as (select term, case when raw < 0 then 0.25 * mean else raw end as idf from raw, mean),
q as (select item_id, term, count(*) as qtf from (select item_id, unnest(case when len({TOKENS}) = 0 then ['__empty__'] else {TOKENS} end) as term from benchmark) group by all),
sc as (select item_id, p.doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score from q join post p using (term) join idf using (term) join dl on dl.doc_id = p.doc_id, av group by item_id, p.doc_id),
rk as (select item_id, doc_id, score, row_number() over (partition by item_id order by round(score, 9) desc, doc_id) as rank from sc)"""


@query(BM25 + " select item_id, doc_id, rank::int as rank, round(score, 6) as score from rk where rank <= 50 and score > 0")
def bm25_topk(spark, d):
    idx = load(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    q = load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(0).alias("qi"), F.col("text").alias("q"))
    out = retrieve.bm25(q, idx, 50, F.col("text"))
    return out.select(F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


DENSE = "greatest(-1.0::double, least(1.0::double, list_inner_product(a.embedding::double[], b.embedding::double[])))"


@query(f"select q as query_id, c as chunk_id, rank::int as rank, round(s, 6) as score from (select b.vec_id as q, a.vec_id as c, {DENSE} as s, row_number() over (partition by b.vec_id order by {DENSE} desc, a.vec_id) as rank from embeddings a, embeddings b where b.vec_id % 100 = 0) where rank <= 10")
def dense_topk(spark, d):
    e = load(spark, d, "embeddings")
    idx = e.select(F.col("vec_id").alias("chunk_id"), "embedding")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.lit(0).alias("qi"), F.col("embedding").alias("qv"))  # the stated query set
    return retrieve.dense(q, idx, 10).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def _hits(spark, d):
    """BM25 over the documents and nearest vectors of the same ids, for one set of questions: the benchmark items."""
    docs = load(spark, d, "documents")
    q = load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(0).alias("qi"), F.col("text").alias("q"))
    lex = retrieve.bm25(q, docs.select(F.col("doc_id").alias("chunk_id"), "text"), 50, F.col("text"))
    e = load(spark, d, "embeddings")
    vec = q.join(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv")), "query_id")
    return retrieve.dense(vec, e.select(F.col("vec_id").alias("chunk_id"), "embedding"), 60), lex, q.withColumn("w", F.lit(1.0))


FUSE = f"""{BM25}, lex as (select item_id, doc_id, rank, score from rk where rank <= 50 and score > 0),
den as (select * from (select b.vec_id as item_id, a.vec_id as doc_id, {DENSE} as score, row_number() over (partition by b.vec_id order by {DENSE} desc, a.vec_id) as rank from embeddings a, embeddings b where b.vec_id in (select item_id from benchmark)) where rank <= 60),
u as (select item_id, doc_id, 1.0::double / (60 + rank) as part, score as sim, null::double as lexs from den union all select item_id, doc_id, 0.22::double / (60 + rank), null, score from lex),
f as (select item_id as query_id, doc_id as chunk_id, coalesce(max(sim), 0) as sim, coalesce(max(lexs), 0) as lexs, sum(part) as rrf from u group by all)"""


@query(FUSE + " select query_id, chunk_id, round(sim, 6) as semantic_similarity, round(lexs, 6) as bm25_score, round(rrf, 8) as rrf_score from f")
def rrf_fusion(spark, d):
    a, b, w = _hits(spark, d)
    return retrieve.fuse(a, b, w).select("query_id", "chunk_id", F.round("semantic_similarity", 6).alias("semantic_similarity"), F.round("bm25_score", 6).alias("bm25_score"), F.round("rrf_score", 8).alias("rrf_score"))


@query(FUSE + " select query_id, chunk_id, round(sim + 8 * rrf + 0.01 * lexs, 6) as score, row_number() over (partition by query_id order by round(sim + 8 * rrf + 0.01 * lexs, 9) desc, chunk_id)::int as rank from f")
def hybrid_stage(spark, d):
    a, b, w = _hits(spark, d)
    f = retrieve.fuse(a, b, w).withColumn("s", retrieve.hybrid_score())
    return f.select("query_id", "chunk_id", F.round("s", 6).alias("score"), F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("s", 9)), "chunk_id")).alias("rank"))


MM = "case when abs(max({0}) over w - min({0}) over w) <= 1e-9 * greatest(abs(max({0}) over w), abs(min({0}) over w)) then case when max({0}) over w > 0 then 1.0 else 0.0 end else ({0} - min({0}) over w) / (max({0}) over w - min({0}) over w) end"


@query(FUSE + f" select query_id, chunk_id, round({MM.format('sim')}, 6) as semantic, round({MM.format('lexs')}, 6) as bm25, round({MM.format('rrf')}, 6) as rrf from f window w as (partition by query_id)")
def minmax_features(spark, d):
    a, b, w = _hits(spark, d)
    f = retrieve.fuse(a, b, w)
    return f.select("query_id", "chunk_id", *[F.round(rank.min_max(c), 6).alias(n) for n, c in (("semantic", "semantic_similarity"), ("bm25", "bm25_score"), ("rrf", "rrf_score"))])


@query(FUSE + f" select query_id, chunk_id, round(0.25 * ({MM.format('sim')}) + 0.08 * ({MM.format('rrf')}), 6) as final_score from f window w as (partition by query_id)")
def weighted_score(spark, d):
    a, b, w = _hits(spark, d)
    f = retrieve.fuse(a, b, w).join(w.select("query_id", F.col("q").alias("rerank_query")), "query_id")
    f = f.select("*", *[F.lit("").alias(c) for c in ("book_title", "chapter_title", "section_title", "hierarchy_path", "text")])
    ordered = f.withColumn("hybrid_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(retrieve.hybrid_score()), "chunk_id")))
    scored = rank.score(rank.rerank(ordered, limit=1 << 30))
    return scored.select("query_id", "chunk_id", F.round("final_score", 6).alias("final_score"))


# questions
#: Questions that name every topic, beside the conversations, which name few
QUESTIONS = [f"What about {a} for a child of {i % 18} years" for i, a in enumerate(a for t in TOPICS for a in t.aliases)]
ASKED_SQL = "(select conv_id, turn, text from conversations union all values " + ", ".join(f"(-1, {i}, '{q}')" for i, q in enumerate(QUESTIONS)) + ")"


def asked(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, turn, text of every turn, and QUESTIONS as conversation -1."""
    c = load(spark, d, "conversations").select("conv_id", "turn", "text")
    more = spark.createDataFrame([(-1, i, q) for i, q in enumerate(QUESTIONS)], "conv_id long, turn int, text string")
    return c.unionByName(more)


def _named_sql(padded: str, table) -> str:
    """The names any of whose phrases, in match form, the padded text has, in order."""
    said = lambda ps: " or ".join(f"contains({padded}, ' {q} ')" for p in ps if (q := X.match_form(p)))
    return "list_filter([" + ", ".join(f"case when {said(ps)} then '{n}' end" for n, ps in table) + "], lambda x: x is not null)"


_DRINKS = " or ".join(f"contains(m, ' {X.match_form(p)} ')" for p in ENERGY_DRINKS)
#: q: compacted question, s and m its forms, base, found and useful its topics, age its scope
UNDERSTOOD = f"""with q as (select conv_id, turn, {COMPACT} as q, {SEARCH} as s, ' ' || {MATCH.format('text')} || ' ' as m from {ASKED_SQL}),
b as (select *, {_named_sql('m', [(t.name, t.aliases) for t in TOPICS])} as base, {_named_sql('m', SPECIAL_PHRASES.items())} as extra from q),
c as (select *, list_concat(base, list_filter(extra, lambda x: not list_contains(base, x))) as named from b),
e as (select *, case when {_DRINKS} then list_concat(list_filter(named, lambda x: x <> 'energy'), case when list_contains(named, 'sports') then [] else ['sports'] end) else named end as found from c),
u as (select *, case when len(found) > 1 then list_filter(found, lambda x: x <> 'adolescent') else found end as useful,
    try_cast(coalesce(nullif(regexp_extract(s, '\\bage\\s*(\\d{{1,2}})\\b|\\b(\\d{{1,2}})\\s*(?:years?|yrs?)\\b', 1), ''), regexp_extract(s, '\\bage\\s*(\\d{{1,2}})\\b|\\b(\\d{{1,2}})\\s*(?:years?|yrs?)\\b', 2)) as int) as years from e),
v as (select *, case when years <= 12 then 'school_age' when years > 12 or contains(s, 'adolescent') or contains(s, 'teen') or contains(s, 'puberty') then 'adolescent' else 'school_age_adolescent' end as age from u)"""


@query(UNDERSTOOD + " select conv_id, turn, array_to_string(base, ',') as topics from v")
def topic_detect(spark, d):
    q = asked(spark, d).withColumn("m", X.match_text("text"))
    return q.select("conv_id", "turn", F.array_join(understand.base_topics(F.col("m")), ",").alias("topics"))


@query(UNDERSTOOD + " select conv_id, turn, array_to_string(found, ',') as topics, array_to_string(useful, ',') as useful from v")
def topic_detect_enhanced(spark, d):
    q = asked(spark, d).withColumn("m", X.match_text("text")).withColumn("t", understand.topics(F.col("m")))
    return q.select("conv_id", "turn", F.array_join("t", ",").alias("topics"), F.array_join(understand.useful_topics(F.col("t")), ",").alias("useful"))


@query(UNDERSTOOD + " select conv_id, turn, age as age_scope from v")
def age_scope(spark, d):
    return asked(spark, d).select("conv_id", "turn", understand.age_scope(X.search_text("text")).alias("age_scope"))


_PHRASES = "map {" + ", ".join(f"'{t.name}': '{t.phrase}'" for t in TOPICS) + "}"
_AGES = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in understand.AGE_PHRASES.items()) + "}"
EXPANDED = UNDERSTOOD + f""", w as (select *, trim(array_to_string(list_concat(list_transform(found, lambda t: {_PHRASES}[t]), [{_AGES}[age], '{understand.SUFFIX}']), ' ')) as x from v),
z as (select conv_id, turn, x, q, s, array_to_string(regexp_extract_all(lower(x), '[a-z0-9]+'), ' ') as xs from w)"""


@query(EXPANDED + """ select conv_id, turn, case when q <> '' then x end as expansion, case when q = '' then null when s = '' then x when s = xs then q else q || '|' || x end as queries,
    case when q = '' then null when s in ('', xs) then x else x || ' | ' || q end as rerank_query from z""")
def query_understanding(spark, d):
    """Blank turns, which the operator refuses, have nulls."""
    c = asked(spark, d)
    blank = X.compact("text") == ""
    q = understand.understood(c.where(~blank).withColumnRenamed("text", "question"))
    q = q.select("conv_id", "turn", "expansion", F.array_join("queries", "|").alias("queries"), "rerank_query")
    none = F.lit(None).cast("string")
    return q.unionByName(c.where(blank).select("conv_id", "turn", none.alias("expansion"), none.alias("queries"), none.alias("rerank_query")))


@query("select conv_id, turn, case when len(regexp_extract_all(text, '[؀-ۿ]')) >= len(regexp_extract_all(text, '[A-Za-z]')) then 'Arabic' else 'English' end as language from conversations")
def language_detect(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", understand.language("text").alias("language"))


@query("select conv_id, turn, contains(l, 'nutritional needs') or contains(l, 'nutrition needs') or contains(l, 'healthy diet') or contains(l, 'balanced diet') or contains(l, 'what should') or contains(l, 'what does a child need') or contains(l, 'food groups') or contains(l, 'daily diet') as broad from (select conv_id, turn, lower(text) as l from conversations)")
def broad_question(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", understand.is_broad("text").alias("broad"))


@query(r"select doc_id, trim(text, chr(10) || ' ') as question, case when contains(text, 'é') then 'fr' else 'en' end as language from (select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as text from documents)")
def parse_sections(spark, d):
    made = F.concat(F.lit("USER QUESTION:\n"), X.strip("text"), F.lit("\n\nRESPONSE LANGUAGE:\n"), F.when(F.contains("text", F.lit("é")), "fr").otherwise("en"), F.lit("\n\nCHILD PROFILE AUTOMATICALLY SUPPLIED BY THE APPLICATION:\nnone"))
    p = load(spark, d, "documents").withColumn("a", understand.application_input(made))
    return p.select("doc_id", F.col("a.question").alias("question"), F.col("a.language").alias("language"))


# pages, hierarchy, chunks
#: RE2 forms of hierarchy.REFERENCE and hierarchy.YEAR
CITES, DATED = r"^\s*\d{1,3}[.)]?\s+[A-Z][A-Za-z''’-]+(?:\s+[A-Z][A-Za-z''’-]+)?(?:,|\s+[A-Z]{1,4},)", r"\b(?:19|20)\d{2}\b"


def _lines_sql(most: int, text: str = "text") -> str:
    """page_lines in SQL."""
    return rf"list_filter(list_transform((string_split({text}, chr(10)))[1:{most}], lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')"


NUMBERED = """d as (select doc_id, lang, text, case when lang in ('en', 'de') then 'aap8' else 'pnp3' end as book_id, row_number() over (partition by lang order by doc_id) as n,
    row_number() over (partition by case when lang in ('en', 'de') then 'aap8' else 'pnp3' end order by doc_id) as page_number from documents),
bp as (select doc_id, book_id, page_number, case when n % 11 <> 0 then '' when book_id = 'aap8' then 'Chapter ' || trunc(n / 11 % 52 + 1)::int::varchar || chr(10)
    else trunc(n / 11 % 3 + 1)::int::varchar || '.' || trunc(n / 33 % 9 + 1)::int::varchar || ' Growth and Feeding' || chr(10) end || text as text from d)"""
CLASSED = f"""{NUMBERED}, l as (select *, {_lines_sql(80)} as l80, {_lines_sql(55)} as l55, lower(array_to_string({_lines_sql(12)}, ' ')) as head from bp),
k as (select *, case when (book_id = 'aap8' and page_number < 13) or (book_id = 'pnp3' and page_number < 17) then 'front_matter'
    when contains(head, 'subject index') or contains(head, 'author index') or contains(head, 'index of terms') then 'index'
    when starts_with(head, 'references') or len(list_filter(l80, lambda x: regexp_matches(x, '{CITES}') and regexp_matches(x, '{DATED}'))) >= 5 then 'references'
    when length({COMPACT}) < 60 then 'low_text' else 'body' end as content_type from l)"""


@query(f"with {CLASSED} select doc_id, page_number, content_type from k")
def page_classify(spark, d):
    return book_pages(spark, d).select("doc_id", "page_number", hierarchy.page_class(EngineConfig()).alias("content_type"))


@query("""with p as (select doc_id, lang, row_number() over (partition by lang order by doc_id) as n from documents), h as (select *, case when n % 7 = 0 then 'part ' || (n // 7)::varchar end as head from p)
    select doc_id, coalesce(last_value(head ignore nulls) over (partition by lang order by n rows between unbounded preceding and current row), '') as part from h""")
def hierarchy_forward_fill(spark, d):
    head = F.when(F.col("page_number") % 7 == 0, F.concat(F.lit("part "), F.floor(F.col("page_number") / 7).cast("string")))
    p = pages(spark, d)
    none = F.lit(None).cast("string")
    state = hierarchy.carried(p.select("book_id", "page_number", head.alias("part_title"), *[none.alias(f) for f in hierarchy.FIELDS if f != "part_title"]))
    return p.select("doc_id", "book_id", "page_number").join(state, ["book_id", "page_number"]).select("doc_id", F.col("part_title").alias("part"))


_NO = ", ".join(map(str, EXCLUDED_CHAPTERS))
_LABEL = "map {" + ", ".join(f"{i}: ': {t.replace(chr(39), chr(39) * 2)}'" for i, t in enumerate(CHAPTER_TITLES, 1)) + "}"
_TITLED = "map {" + ", ".join(f"'{k}': '{v.replace(chr(39), chr(39) * 2)}'" for k, v in SECTION_TITLES.items()) + "}"
_OUT = " or ".join(f"number = '{p}' or starts_with(number, '{p}.')" for p in EXCLUDED_SECTIONS)
_INFANT = " or ".join(f"contains({MATCH.format('path')}, '{m}')" for m in INFANT_MARKERS)
_SECTION, _CHAPTER = r"(?i)^\s*(?:Section\s+)?([IVXLC]+)\s*[:.-]\s*([^\n]{3,120})$", r"(?i)^\s*(?:\d{1,4}\s+)?Chapter\s+(\d{1,3})(?:\s+.*)?$"
_HEADING = r"^\s*(\d{1,2}(?:\.\d{1,2}){1,2})\s+([A-Z][A-Za-z0-9 ,/&()''’\-–—:]{1,180})\s*$"
_NOT = " or ".join(f"contains(lower(h.t), '{m}')" for m in hierarchy.NOT_TITLES)
HIERARCHY = rf"""{CLASSED}, f1 as (select doc_id, book_id, page_number, content_type,
    list_filter(l55[1:12], lambda x: regexp_matches(x, '{_SECTION}') and contains(lower(x), 'section'))[1] as sec,
    list_filter(list_transform(list_filter(l55[1:25], lambda x: regexp_matches(x, '{_CHAPTER}')), lambda x: try_cast(regexp_extract(x, '{_CHAPTER}', 1) as int)), lambda c: c between 1 and {len(CHAPTER_TITLES)})[1] as chap,
    list_filter(list_transform(list_filter(l55, lambda x: regexp_matches(x, '{_HEADING}')), lambda x: {{'n': regexp_extract(x, '{_HEADING}', 1), 't': trim(regexp_extract(x, '{_HEADING}', 2))}}),
        lambda h: h.t <> '' and length(h.t) <= 180 and length(h.t) - length(replace(h.t, ',', '')) <= 3 and not ({_NOT}) and not regexp_matches(h.t, '{DATED}'))[1:4] as heads from k where content_type = 'body'),
f2 as (select *, coalesce(list_filter(heads, lambda h: length(h.n) - length(replace(h.n, '.', '')) = 2)[1], heads[1]) as best from f1),
f3 as (select doc_id, book_id, page_number, case when book_id = 'pnp3' then split_part(best.n, '.', 1) end as part,
    case when book_id = 'aap8' then 'Section ' || upper(regexp_extract(sec, '{_SECTION}', 1)) || ': ' || trim(regexp_replace(regexp_extract(sec, '{_SECTION}', 2), '\s+\d+$', ''))
        else trim(split_part(best.n, '.', 1) || '.' || split_part(best.n, '.', 2) || ' ' || coalesce({_TITLED}[split_part(best.n, '.', 1) || '.' || split_part(best.n, '.', 2)], '')) end as section,
    case when book_id = 'aap8' then 'Chapter ' || chap::varchar || coalesce({_LABEL}[chap], '') else trim(best.n || ' ' || coalesce({_TITLED}[best.n], best.t)) end as chapter,
    case when book_id = 'aap8' then chap::varchar else best.n end as number from f2),
f4 as (select doc_id, book_id, {', '.join(f"coalesce(last_value({c} ignore nulls) over w, '') as {c}" for c in ('part', 'section', 'chapter', 'number'))} from f3 window w as (partition by book_id order by page_number rows unbounded preceding)),
f5 as (select *, array_to_string(list_filter([part, case when section <> part then section else '' end, case when chapter not in (part, section) then chapter else '' end], lambda x: x not in ('', 'Front Matter')), ' > ') as path from f4),
f6 as (select *, case when book_id = 'aap8' then coalesce(try_cast(number as int) not in ({_NO}), false) else not ({_OUT}) and not ({_INFANT}) end as scope from f5)"""


@query(f"""with {HIERARCHY} select k.doc_id, case k.book_id when 'aap8' then 'aap_chapter' else 'pnp_numbered' end as book_layout, content_type, part as part_title, section as section_title, chapter as chapter_title,
    number as chapter_number, path as hierarchy_path, scope as school_scope, coalesce(path <> '' and number <> '' and scope, false) as indexable from k left join f6 on k.doc_id = f6.doc_id""")
def attach_hierarchy(spark, d):
    h = hierarchy.attach_hierarchy(book_pages(spark, d))
    return h.select("doc_id", "book_layout", "content_type", "part_title", "section_title", "chapter_title", "chapter_number", "hierarchy_path", "school_scope", "indexable")


@query("select doc_id, case when source = lang then source else source || ' > ' || lang end as path from documents")
def hierarchy_path(spark, d):
    p = load(spark, d, "documents").withColumn("front", F.lit("Front Matter"))
    return p.select("doc_id", hierarchy.hierarchy_path("source", "front", "lang").alias("path"))


@query(f"select doc_id, number, case when book = 'aap8' then try_cast(number as int) not in {EXCLUDED_CHAPTERS} else not ({' or '.join(f'number = {chr(39)}{p}{chr(39)} or starts_with(number, {chr(39)}{p}.{chr(39)})' for p in EXCLUDED_SECTIONS)}) end as allowed from (select doc_id, case when lang in ('en', 'de') then 'aap8' else 'pnp3' end as book, case when lang in ('en', 'de') then (doc_id % 52 + 1)::varchar else (doc_id % 5 + 1)::varchar || '.' || (doc_id // 5 % 20 + 1)::varchar end as number from documents)")
def scope_filter(spark, d):
    aap = F.col("lang").isin("en", "de")
    number = F.when(aap, (F.col("doc_id") % 52 + 1).cast("string")).otherwise(F.concat((F.col("doc_id") % 5 + 1).cast("string"), F.lit("."), (F.floor(F.col("doc_id") / 5) % 20 + 1).cast("string")))
    p = load(spark, d, "documents").select("doc_id", F.when(aap, "aap8").otherwise("pnp3").alias("book_id"), number.alias("chapter_number"), F.lit("").alias("hierarchy_path"))
    return p.select("doc_id", F.col("chapter_number").alias("number"), hierarchy.scope_allows().alias("allowed"))


@query("select doc_id, 'Chapter ' || (doc_id % 60)::varchar || case (doc_id % 60) " + " ".join(f"when {i} then ': {t.replace(chr(39), chr(39) * 2)}'" for i, t in enumerate(CHAPTER_TITLES, 1)) + " else '' end as label from documents")
def chapter_label(spark, d):
    return load(spark, d, "documents").select("doc_id", hierarchy.chapter_label(F.col("doc_id") % 60).alias("label"))


@query()
def recursive_chunks(spark, d):
    c = EngineConfig()
    p = load(spark, d, "documents").withColumn("p", chunk.splitter(c.chunk_size, c.chunk_overlap)("text"))
    return p.select("doc_id", F.posexplode("p").alias("n", "text"))


def _as_chunks(spark, d):
    return load(spark, d, "documents").select("doc_id", F.col("lang").alias("book_id"), F.col("source").alias("hierarchy_path"), F.col("doc_id").alias("page_number"), F.lit(1).alias("chunk_index_on_page"), "text")


@query(f"select doc_id from (select doc_id, row_number() over (partition by sha256(lang || '|' || lower({COMPACT})) order by doc_id) as r from documents) where r = 1")
def chunk_dedup(spark, d):
    return chunk.first_of_duplicates(_as_chunks(spark, d)).select("doc_id")


@query(f"select doc_id, lang || '_p' || doc_id::varchar || '_c1_' || substr(sha256(lang || '|' || doc_id::varchar || '|' || source || '|1|' || substr({COMPACT}, 1, 700)), 1, 18) as chunk_id from documents")
def chunk_id(spark, d):
    c = _as_chunks(spark, d)
    return c.select("doc_id", chunk.chunk_id(*[F.col(x) for x in ("book_id", "page_number", "hierarchy_path", "chunk_index_on_page", "text")]).alias("chunk_id"))


@query(f"""select doc_id, len(l) = 0 or (cites >= 4 and years >= 4 and cites * 5 >= len(l)) as reference_like from (select doc_id, l,
    len(list_filter(l, lambda x: regexp_matches(x, '{CITES}') or contains(lower(x), ' et al'))) as cites, len(list_filter(l, lambda x: regexp_matches(x, '{DATED}'))) as years from (select doc_id, {_lines_sql(80)} as l from documents))""")
def reference_like(spark, d):
    return load(spark, d, "documents").select("doc_id", chunk.reference_like("text").alias("reference_like"))


@query("""select case g when 1 then 'book' when 2 then 'chapter' else 'total' end as section, coalesce(case g when 1 then book when 2 then chapter end, '') as name, n as chunks, bad as suspicious
    from (select lang as book, source as chapter, grouping(lang, source) as g, count(*)::bigint as n, count(distinct case when source = 'src3' or n_chars < 100 then doc_id end)::bigint as bad from documents group by grouping sets ((lang), (source), ()))""")
def chunk_audit(spark, d):
    c = load(spark, d, "documents").select(F.col("lang").alias("book_title"), F.col("source").alias("chapter_title"), F.col("doc_id").alias("chunk_id"), F.when((F.col("source") == "src3") | (F.col("n_chars") < 100), "index").otherwise("body").alias("content_type"))
    return chunk.audit(c)


@query()
def create_chunks(spark, d):
    c = chunk.create_chunks(clean.preprocess(book_pages(spark, d)), dealt=True)
    return c.select("chunk_id", "book_id", "page_number", "chunk_index_on_page", "chapter_title", "hierarchy_path", "text", "chunk_size_characters")


# embeddings
@query("select count(*)::bigint as vectors, count(distinct len(embedding))::bigint as dimensions, count(*) filter (len(list_filter(embedding, lambda x: not isfinite(x))) > 0)::bigint as not_finite, count(*) filter (abs(sqrt(list_inner_product(embedding::double[], embedding::double[])) - 1) > 1e-3)::bigint as off_norm from embeddings")
def embedding_checks(spark, d):
    return embed.embedding_checks(load(spark, d, "embeddings"))


@query("select doc_id, 'passage: Book: ' || source || chr(10) || 'Chapter: ' || lang || case when text = '' or text like '%: ' then '' else chr(10) || 'Content: ' || text end as passage from documents")
def passage_text(spark, d):
    p = load(spark, d, "documents").select("doc_id", F.col("source").alias("book_title"), F.lit("").alias("hierarchy_path"), F.col("lang").alias("chapter_title"), F.lit(None).cast("string").alias("section_title"), "text")
    return p.select("doc_id", embed.passage_text().alias("passage"))


# ranking and context
@query()
def diversify(spark, d):
    """By text, book (the source) and chapter, over every document. What a dropped hit would have blocked stays open, so
    no SQL of windows says it; a plain fold is its test."""
    w = Window.partitionBy("lang").orderBy("doc_id")
    title = F.element_at(F.array(*map(F.lit, CHAPTER_TITLES)), (F.col("doc_id") % 52 + 1).cast("int"))
    h = load(spark, d, "documents").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("book_title"), F.lit("").alias("hierarchy_path"), title.alias("chapter_title"), F.row_number().over(w).alias("rank"))
    return rank.diversify(h)


@query("""with h as (select source as query_id, doc_id, row_number() over (partition by source order by doc_id)::int as position, lang, text from documents),
    b as (select query_id, position, '[SOURCE ' || position::varchar || ']' || chr(10) || 'Book: ' || lang || chr(10) || 'Hierarchy: ' || query_id || chr(10) || 'PDF page: ' || position::varchar || chr(10) || 'Text:' || chr(10) || text || chr(10) as b from h),
    u as (select *, sum(length(b)) over (partition by query_id order by position rows unbounded preceding) as used from b)
    select query_id, string_agg(b, chr(10) order by position) as context, count(*)::int as blocks from u where position = 1 or used <= 12000 group by query_id""")
def context_pack(spark, d):
    w = Window.partitionBy("source").orderBy("doc_id")
    n = F.row_number().over(w)
    h = load(spark, d, "documents").select(F.col("source").alias("query_id"), n.alias("position"), F.col("lang").alias("book_title"), F.col("source").alias("hierarchy_path"), n.alias("page_number"), "text")
    return answer.pack_context(h)


_WORDS = "(case when len(list_filter({0}, lambda w: w not in (" + STOP + "))) = 0 then ['__empty__'] else list_filter({0}, lambda w: w not in (" + STOP + ")) end)"
_PARTS = ", ".join(
    f"case when list_contains(base, '{t.name}') then case when contains(h, '{m}') then 1.0 else len(list_intersect(string_split(h, ' '), {sorted(set(m.split()))}))::double / {len(set(m.split()))} end end"
    for t in TOPICS for m in map(X.match_form, t.titles)
)
TITLE_SQL = "[" + ", ".join(f"'{t.replace(chr(39), chr(39) * 2)}'" for t in CHAPTER_TITLES) + "]"


@query(UNDERSTOOD + f""", p as (select conv_id, turn, s, base, {TITLE_SQL}[turn % 52 + 1] as title from v), r as (select conv_id, turn, base, {MATCH.format("('Part > ' || title)")} as h, list_distinct({_WORDS.format("string_split(s, ' ')").replace('w not in (', "w not in ('', ")}) as have_q,
    {_WORDS.format("regexp_extract_all(lower(title || ' Part > ' || title), '[a-z0-9]+')")} as have_h from p)
    select conv_id, turn, round(least(1.0, 0.45 * (len(list_intersect(have_q, have_h))::double / greatest(1, len(have_q))) + 0.55 * least(1.0, coalesce(list_max([{_PARTS}]), 0.0))), 6) as metadata_score from r""")
def metadata_score(spark, d):
    """Every question against one chapter each."""
    title = F.element_at(F.array(*map(F.lit, CHAPTER_TITLES)), (F.col("turn") % 52 + 1).cast("int"))
    q = asked(spark, d).withColumn("rerank_query", F.col("text")).withColumn("chapter_title", title).withColumn("section_title", F.lit("")).withColumn("hierarchy_path", F.concat(F.lit("Part > "), title))
    return rank.with_metadata_score(q).select("conv_id", "turn", F.round("metadata_score", 6).alias("metadata_score"))


_TITLES_OF = "list_filter([" + ", ".join(f"case when {' or '.join(f'contains(h, {chr(39)}{X.match_form(x)}{chr(39)})' for x in t.titles)} then '{t.name}' end" for t in TOPICS) + "], lambda x: x is not null)"


@query(FUSE + f""", hy as (select query_id, chunk_id, sim, row_number() over (partition by query_id order by round(sim + 8 * rrf + 0.01 * lexs, 9) desc, chunk_id) as rank from f),
    st as (select query_id, chunk_id, 'hybrid' as stage, rank, 0 as priority from hy union all select item_id, doc_id, 'dense', rank, 1 from den union all select query_id, chunk_id, 'reranked', rank, 2 from hy where rank <= 90),
    named as (select *, {MATCH.format(f"({TITLE_SQL}[chunk_id % 52 + 1])")} as h from st),
    m as (select *, {_TITLES_OF} as matched, case query_id % 3 when 0 then ['bone', 'sports', 'assessment'] when 1 then ['sports', 'iron', 'bone'] else ['assessment'] end as useful from named),
    top as (select query_id, arg_max(chunk_id, len(list_intersect(useful, matched)) * 10 - priority) as chunk_id from m where rank = 1 group by query_id),
    an as (select query_id, ord, arg_min(chunk_id, rank * 10 + priority) as chunk_id from (select query_id, chunk_id, rank, priority, matched, unnest(useful) as topic, generate_subscripts(useful, 1) as ord from m where rank <= 20) where topic in ('bone', 'sports', 'assessment') and list_contains(matched, topic) group by query_id, ord),
    items as (select m.query_id, m.chunk_id, h, stage, 0 as a, 0 as b, rank, priority from top join m using (query_id, chunk_id) union all select m.query_id, m.chunk_id, h, stage, 1, ord, rank, priority from an join m using (query_id, chunk_id)
        union all select query_id, chunk_id, h, stage, priority + 2, 0, rank, priority from m)
    select * from (select query_id, chunk_id, stage, row_number() over (partition by query_id order by a, b, rank, priority, chunk_id)::int as position from (
        select * from items qualify row_number() over (partition by query_id, h order by a, b, rank, priority, chunk_id) = 1)) where position <= 8""")
def anchored_ranking(spark, d):
    """The stages of every benchmark item over all documents, each document under one chapter, with useful topics by item."""
    a, b, w = _hits(spark, d)
    f = settled(retrieve.fuse(a, b, w).withColumn("hybrid_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round(retrieve.hybrid_score(), 9)), "chunk_id"))))
    some = [F.array(*map(F.lit, t)) for t in (("bone", "sports", "assessment"), ("sports", "iron", "bone"), ("assessment",))]
    useful = F.when(F.col("query_id") % 3 == 0, some[0]).when(F.col("query_id") % 3 == 1, some[1]).otherwise(some[2])
    title = F.element_at(F.array(*map(F.lit, CHAPTER_TITLES)), (F.col("chunk_id") % 52 + 1).cast("int"))
    stage = lambda x, name, at: x.select("query_id", "chunk_id", F.lit(name).alias("stage"), F.col(at).alias("rank"))
    st = stage(f, "hybrid", "hybrid_rank").unionByName(stage(a, "dense", "rank")).unionByName(stage(f.where("hybrid_rank <= 90"), "reranked", "hybrid_rank"))
    st = st.select("*", title.alias("chapter_title"), F.lit("").alias("section_title"), F.lit("").alias("hierarchy_path"), useful.alias("useful"))
    return rank.anchored_ranking(st, 8).select("query_id", "chunk_id", "stage", "position")


@query()
def topic_anchors(spark, d):
    return _ranked(spark, d)["chunks"].select("query_id", "position", "chunk_id", "stage")


def _index(spark, d):
    """Dealt by id, embedded once and kept, as every step of a search reads it."""
    p = book_pages(spark, d).repartition("doc_id")
    titled = p.withColumn("chapter_title", F.element_at(F.array(*map(F.lit, CHAPTER_TITLES)), (F.col("doc_id") % 52 + 1).cast("int")))
    index = titled.select(
        F.col("doc_id").cast("string").alias("chunk_id"), "text", "book_title", "source", "page_number", "chapter_title", F.lit("").alias("section_title"), F.lit("").alias("part_title"),
        F.col("chapter_title").alias("hierarchy_path"), embed.encoder()(F.col("text")).alias("embedding"),
    )
    return settled(index)


ASKED = ["calcium and bone mass", "sports nutrition of athletes", "growth charts and body mass index", "iron and anemia at 9 years", "What should be in a healthy diet", "school lunch and food safety"]


def _questions(spark, d):
    """ASKED, which name topics, and every benchmark item that isn't blank."""
    made = spark.createDataFrame([(f"q{i}", a) for i, a in enumerate(ASKED)], "query_id string, question string")
    items = load(spark, d, "benchmark").where(X.compact("text") != "").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("query_id"), F.col("text").alias("question"))
    return made.unionByName(items)


def _ranked(spark, d):
    return retrieval.retrieve_context(_questions(spark, d), _index(spark, d))


@query()
def retrieve_context(spark, d):
    return _ranked(spark, d)["candidates"].select("query_id", "chunk_id", "final_rank", F.round("final_score", 6).alias("final_score"), F.round("metadata_score", 6).alias("metadata_score"))


@query()
def answer_questions(spark, d):
    a = retrieval.answer_questions(_questions(spark, d), _index(spark, d), EngineConfig(generator=lambda s, p: F.concat(F.lit("As the sources say [SOURCE 1]. "), F.substring(p, 16, 40))))
    return present.presented(a).select("query_id", "answer", "retrieved_count", "age_scope", "status", "direction", "label", "html")


@query("select conv_id, turn, len(list_filter(regexp_extract_all(text || ' [source ' || (turn % 9)::varchar || ']', '\\[(?i:SOURCE)\\s+(\\d+)\\]', 1), lambda k: k::bigint between 1 and 5)) > 0 as cited from conversations")
def citation_check(spark, d):
    c = load(spark, d, "conversations").withColumn("a", F.concat("text", F.lit(" [source "), (F.col("turn") % 9).cast("string"), F.lit("]")))
    return c.select("conv_id", "turn", answer.cites_source("a", F.lit(5)).alias("cited"))


@query("""select c_custkey as id, case when h > 0 and w > 0 then round(w / ((h / 100.0) * (h / 100.0)), 4) else 0.0 end::double as bmi
    from (select c_custkey, (c_custkey % 200)::int as h, (c_custkey % 90)::int as w from customer)""")
def profile_bmi(spark, d):
    p = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 200).cast("int").alias("height_cm"), (F.col("c_custkey") % 90).cast("int").alias("weight_kg"))
    return p.select("id", F.round(present.bmi(), 4).alias("bmi"))


_GENDERS, _ACTIVITY = (str(list(v)) for v in (present.GENDERS, present.ACTIVITY))
PROFILES = f"""(select k, case when k % 5 = 0 then '' else name end as name, k % 19 as age, {_GENDERS}[k % {len(present.GENDERS)} + 1] as gender, case when k % 4 = 0 then '' else (k % 6)::varchar || 'B' end as grade, k % 200 as h, k % 90 as w,
    case when k % 3 = 0 then [] else ['Constipation', 'Anemia'][1:k % 3] end as ill, case when k % 2 = 0 then [] else ['Egg Allergy'] end as allergies, {_ACTIVITY}[k % {len(present.ACTIVITY)} + 1] as active,
    list_concat(case when k % 7 = 0 then [] else ['Fish'] end, case when k % 11 = 0 then [] else ['okra'] end) as foods from (select c_custkey as k, c_name as name from customer))"""


@query(f"""select k as id, concat_ws(chr(10), 'Child name: ' || case when name <> '' then name else 'Not provided' end, 'Age: ' || case when age > 0 then age::varchar else 'Not provided' end,
    'Gender: ' || case when gender <> '{present.GENDERS[0]}' then gender else 'Not provided' end, 'School class: ' || case when grade <> '' then grade else 'Not provided' end,
    'Height: ' || case when h > 0 then h::varchar || ' cm' else 'Not provided' end, 'Weight: ' || case when w > 0 then w::varchar || ' kg' else 'Not provided' end,
    'BMI: ' || case when h > 0 and w > 0 then printf('%.1f', w / ((h / 100.0::double) * (h / 100.0::double))) else 'Not available' end, 'Activity level: ' || active,
    'Health conditions: ' || case when len(ill) > 0 then array_to_string(ill, ', ') else 'None reported' end, 'Allergies and intolerances: ' || case when len(allergies) > 0 then array_to_string(allergies, ', ') else 'None reported' end,
    'Disliked foods: ' || case when len(foods) > 0 then array_to_string(foods, ', ') else 'None reported' end) as profile from {PROFILES}""")
def profile_context(spark, d):
    """A made profile for every customer."""
    k = F.col("c_custkey")
    pick = lambda of: F.element_at(F.array(*map(F.lit, of)), (k % len(of) + 1).cast("int"))
    none = F.array().cast("array<string>")
    p = load(spark, d, "customer").select(
        k.alias("id"), F.when(k % 5 == 0, " ").otherwise(F.col("c_name")).alias("child_name"), (k % 19).cast("int").alias("age"), pick(present.GENDERS).alias("gender"),
        F.when(k % 4 == 0, "").otherwise(F.concat((k % 6).cast("string"), F.lit("B "))).alias("school_class"), (k % 200).cast("int").alias("height_cm"), (k % 90).cast("int").alias("weight_kg"),
        F.slice(F.array(F.lit("Constipation"), F.lit("Anemia")), F.lit(1), (k % 3).cast("int")).alias("health_conditions"), F.when(k % 2 == 0, none).otherwise(F.array(F.lit("Egg Allergy"))).alias("allergies"),
        pick(present.ACTIVITY).alias("activity_level"), F.when(k % 7 == 0, F.array(F.lit(" "))).otherwise(F.array(F.lit("Fish"), F.lit(" "))).alias("disliked_foods"), F.when(k % 11 == 0, "").otherwise(" okra ").alias("other_disliked_foods"),
    )
    return p.select("id", present.profile_text().alias("profile"))


@query("""select doc_id, case when doc_id % 7 = 0 or draft = '' or upper(draft) = 'NO_RELIABLE_CONTEXT' then 'insufficient_context' when doc_id % 3 = 0 or doc_id % 2 = 0 then 'success' else 'citation_validation_failed' end as status
    from (select doc_id, case doc_id % 5 when 0 then '' when 1 then 'no_reliable_context' else 'x' end as draft from documents)""")
def answer_status(spark, d):
    i = F.col("doc_id")
    base = F.when(i % 5 == 0, "").when(i % 5 == 1, "no_reliable_context").otherwise("x")
    draft = F.when((i % 3 == 0) & (base == "x"), "x [SOURCE 2]").otherwise(base)
    s = load(spark, d, "documents").select("doc_id", F.when(i % 7 == 0, "").otherwise("c").alias("context"), F.lit(3).alias("retrieved_count"), draft.alias("draft"), F.when(i % 2 == 0, "y [SOURCE 1]").otherwise("y [SOURCE 9]").alias("repair"))
    return answer.answer_state(s).select("doc_id", "status")
