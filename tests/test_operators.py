import hashlib

import numpy as np
from pyspark.sql import functions as F

from folio.config import EngineConfig
from folio.functions import text as X
from folio.plans import catalog
from folio.operators import answer, chunk, clean, embed, hierarchy, present, rank, retrieve, understand


def one(spark, value, expr, name="text"):
    return spark.createDataFrame([(value,)], f"{name} string").select(expr.alias("r")).first()["r"]


def test_normalisers_differ(spark):
    assert one(spark, "Café ÉTÉ 12", X.search_text("text")) == "caf t 12"
    assert one(spark, "Café ÉTÉ 12", X.match_text("text")) == "cafe ete 12"
    assert one(spark, " a \n b ", X.compact("text")) == "a b"
    assert one(spark, "والمدرسة", X.match_text("text")) == X.match_form("المدرسة") == "مدرسة"
    assert one(spark, "the of", X.search_tokens("text")) == ["__empty__"]
    assert one(spark, "a­​b\r\nc\u0001", X.normalize_unicode("text")) == "ab\nc"


def test_unique_strings(spark):
    d = spark.createDataFrame([(["Iron  needs", "iron needs!", "?!", "zinc"],)], "v array<string>")
    assert d.select(X.unique_strings("v").alias("r")).first()["r"] == ["Iron needs", "zinc"]


def test_splitter_overlaps_and_recurses():
    parts = chunk.split_text("aaaa. bbbb. cccc. " + "d" * 30, 12, 4)
    assert parts[0] == "aaaa. bbbb" and all(len(p) <= 12 for p in parts)
    assert "".join(chunk.split_text("x" * 25, 10, 0)) == "x" * 25


def test_hierarchy_carries_forward(spark):
    body = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor."
    rows = [("aap8", i, t) for i, t in [(13, f"Chapter 19\n{body}"), (14, body), (15, "short"), (16, f"Chapter 99\n{body}"), (17, f"Chapter 3\n{body}")]]
    got = hierarchy.attach_hierarchy(spark.createDataFrame(rows, "book_id string, page_number int, text string"), EngineConfig()).orderBy("page_number").collect()
    assert [r["chapter_title"] for r in got] == ["Chapter 19: Iron", "Chapter 19: Iron", None, "Chapter 19: Iron", "Chapter 3: Breastfeeding"]
    assert [r["indexable"] for r in got] == [True, True, False, True, False]


def test_numbered_heading_takes_most_dots(spark):
    d = spark.createDataFrame([(["1.2 Nutritional Assessment", "1.2.1 Clinical Things", "x"],)], "l array<string>")
    r = d.select(hierarchy.numbered_headings("l").alias("r")).first()["r"]
    assert (r["part"], r["section"], r["chapter"]) == ("1", "1.2 Nutritional Assessment", "1.2.1 Clinical Evaluation and Anthropometry")


def test_topics_and_age(spark):
    d = spark.createDataFrame([("energy drinks for teens aged 14 years",), ("adolescent iron",)], "q string").withColumn("m", X.match_text("q"))
    got = d.select(understand.topics(F.col("m")).alias("t"), understand.useful_topics(understand.topics(F.col("m"))).alias("u"), understand.age_scope(X.search_text("q")).alias("a")).collect()
    assert got[0]["t"] == ["sports"] and got[0]["a"] == "adolescent"
    assert got[1]["t"] == ["adolescent", "iron"] and got[1]["u"] == ["iron"]


def test_application_input(spark):
    made = "USER QUESTION:\nIs milk fine?\n\nRESPONSE LANGUAGE:\nEnglish\n\nCHILD PROFILE AUTOMATICALLY SUPPLIED BY THE APPLICATION:\nAge: 9"
    r = one(spark, made, understand.application_input("text"))
    assert (r["question"], r["language"], r["profile"]) == ("Is milk fine?", "English", "Age: 9")
    r = one(spark, " plain  words ", understand.application_input("text"))
    assert (r["question"], r["language"], r["profile"]) == ("plain words", "same as the user question", "")


def test_bm25_by_hand(spark):
    idx = spark.createDataFrame([("a", "iron zinc"), ("b", "iron"), ("c", "iron milk")], "chunk_id string, text string")
    q = spark.createDataFrame([("q", 0, "zinc")], "query_id string, qi int, q string")
    rows = retrieve.bm25(q, idx, 5, F.col("text")).collect()
    import math

    idf = math.log(2.5) - math.log(1.5)
    assert [r["chunk_id"] for r in rows] == ["a"] and abs(rows[0]["score"] - idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / (5 / 3)))) < 1e-9


def test_greedy_diversity_is_not_two_filters(spark):
    """A hit that is dropped blocks nothing."""
    rows = [("q", "1", 1, "t1", "A"), ("q", "2", 2, "t2", "A"), ("q", "3", 3, "t2", "B"), ("q", "4", 4, "t1", "C")]
    d = spark.createDataFrame(rows, "query_id string, chunk_id string, rank int, text string, hierarchy_path string").withColumn("book_title", F.lit("b")).withColumn("chapter_title", F.lit(""))
    assert [r["chunk_id"] for r in rank.diversify(d).orderBy("position").collect()] == ["1", "3"]


def test_answer_states(spark):
    rows = [("c", 2, "ok [SOURCE 1]", ""), ("c", 2, "no", "mended [source 2]"), ("c", 2, "no", "no [SOURCE 9]"), ("c", 2, "NO_reliable_CONTEXT", ""), ("", 2, "x", "")]
    got = answer.answer_state(spark.createDataFrame(rows, "context string, retrieved_count int, draft string, repair string")).collect()
    assert [r["status"] for r in got] == ["success", "success", "citation_validation_failed", "insufficient_context", "insufficient_context"]
    assert got[1]["answer"] == "mended [source 2]"


def test_render():
    html = present.render("# Title\nIntro **b** [SOURCE 1]\n- x\n- y\n\n| a | b |\n|---|---|\n| 1 | 2 |\n| bad |\n## Next")
    assert html.startswith('<h2 class="answer-main-title">Title</h2><p class="answer-paragraph">Intro <strong>b</strong></p><ul class="answer-list"><li>x</li><li>y</li></ul>')
    assert '<td data-label="a">1</td><td data-label="b">2</td>' in html and "bad" not in html and html.endswith('<h2 class="answer-section-title">Next</h2>')


def test_top_k_is_cut_before_the_shuffle(spark):
    idx = spark.createDataFrame([(str(i), [float(i), 1.0]) for i in range(50)], "chunk_id string, embedding array<float>")
    q = spark.createDataFrame([("q", 0, [1.0, 0.0])], "query_id string, qi int, qv array<float>")
    plan = retrieve.dense(q, idx, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_queries_are_distinct_by_form(spark):
    asked = ["Iron  needs", "Café diets, teens", "calcium", "adolescents pediatric nutrition", "12 years: sports"]
    d = spark.createDataFrame([(i, a) for i, a in enumerate(asked)], "query_id int, question string")
    rows = understand.understood(d, rewriter=lambda s, c: F.concat(F.lit("Iron needs of "), F.element_at(F.split(c, "\n\n"), -1))).collect()
    for r in rows:
        new = r["rewritten"]
        assert r["queries"] == X._distinct([x for x in (r["question"], r["expansion"], new) if x])
        assert r["rerank_query"] == " | ".join(X._distinct([r["expansion"], new or r["question"], r["question"]]))
    assert any(r["rewritten"] for r in rows)
    assert [r["queries"] for r in understand.understood(d).collect()] == [X._distinct([r["question"], r["expansion"]]) for r in rows]


def test_answers_run_again_in_one_session(spark):
    from folio.operators import embed
    from folio.plans import retrieval

    rows = [(f"c{i}", t, "B", "f.pdf", i, c, "", "", c) for i, (t, c) in enumerate([("Iron helps blood.", "Iron"), ("Calcium helps bones.", "Calcium"), ("Fluids and sports.", "Sports Nutrition")])]
    idx = spark.createDataFrame(rows, "chunk_id string, text string, book_title string, source string, page_number int, chapter_title string, section_title string, part_title string, hierarchy_path string")
    idx = idx.withColumn("embedding", embed.encoder()(F.col("text")))
    q = spark.createDataFrame([("a", "iron and blood"), ("b", "calcium for bones")], "query_id string, question string")
    config = EngineConfig(generator=lambda s, p: F.concat(F.lit("Yes [SOURCE 1]. "), F.substring(p, 1, 4)))
    got = [sorted((r["query_id"], r["status"], r["retrieved_count"]) for r in retrieval.answer_questions(q, idx, config).collect()) for _ in range(2)]
    assert got[0] == got[1] == [("a", "success", 3), ("b", "success", 3)]


def plain_search(t):
    import re
    import unicodedata

    t = unicodedata.normalize("NFKC", t or "").lower()
    t = "".join(c for c in t if not any(a <= ord(c) <= b for a, b in ((0x610, 0x61A), (0x64B, 0x65F), (0x670, 0x670), (0x6D6, 0x6ED))))
    for a, b in ("\u0623\u0627", "\u0625\u0627", "\u0622\u0627", "\u0649\u064a", "\u0624\u0648", "\u0626\u064a"):
        t = t.replace(a, b)
    return " ".join(re.findall("[A-Za-z0-9]+|[\u0600-\u06ff]+", t.replace("\u0640", "")))


def test_normalisers_run_over_all_documents(spark, tmp_path):
    from folio.functions import text as X
    from folio.plans import catalog

    some = ["Plain ASCII 12", "Caf\u00e9 na\u00efve \ufb01ve", "\u0623\u064e\u0637\u0641\u0627\u0644 \u0648\u0627\u0644\u063a\u0630\u0627\u0621 12", "\u65e5\u672c \uff21\uff22", "", None]
    spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["normalized"] for r in catalog.QUERIES["search_text"](spark, str(tmp_path)).collect()}
    assert got == {i: plain_search(t) for i, t in enumerate(some)}
    got = {r["doc_id"]: r["matched"] for r in catalog.QUERIES["match_text"](spark, str(tmp_path)).collect()}
    assert got == {i: X.match_form(t or "") for i, t in enumerate(some)}
    assert got[1] == "cafe naive five" and got[2] == "\u0627\u0637\u0641\u0627\u0644 \u063a\u0630\u0627\u0621 12"


def test_questions_and_diversity_over_whole_tables(spark, tmp_path):
    from folio.functions.dims import TOPICS
    from folio.plans import catalog

    topic, alias = next((t.name, a) for t in TOPICS for a in t.aliases if not a.isascii())
    some = [f"x {alias} x", "calcium for a child of 9 years", "", "  ", None, "caf\u00e9 " * 500]
    spark.createDataFrame([(1, i, t) for i, t in enumerate(some)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    docs = [(1, "One text", "en", "s1"), (2, "one TEXT", "en", "s2"), (3, "another", "en", "s3"), (53, "a third", "en", "s1")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {n: {r["turn"]: r for r in catalog.QUERIES[n](spark, str(tmp_path)).where("conv_id = 1").collect()} for n in ("topic_detect", "topic_detect_enhanced", "age_scope", "query_understanding")}
    assert all(sorted(r) == list(range(len(some))) for r in rows.values())
    assert topic in rows["topic_detect"][0]["topics"].split(",") and rows["topic_detect"][4]["topics"] == ""
    assert topic in rows["topic_detect_enhanced"][0]["topics"].split(",") and rows["age_scope"][1]["age_scope"] == "school_age"
    assert [rows["query_understanding"][i]["queries"] is None for i in range(len(some))] == [False, False, True, True, True, False]
    assert [r["chunk_id"] for r in catalog.QUERIES["diversify"](spark, str(tmp_path)).orderBy("position").collect()] == [1, 3]


def test_rerank_fails_for_a_whole_question(spark):
    rows = [(q, f"{q}{i}", i, f"text {i}", "b", "h", "ask") for q in ("x", "y") for i in range(1, 13)]
    d = spark.createDataFrame(rows, "query_id string, chunk_id string, hybrid_rank int, text string, book_title string, hierarchy_path string, rerank_query string")

    def model(asked, pairs):
        if any("text 10" in p for p in pairs) and len(pairs) < 8:
            raise RuntimeError("no memory")
        return [float(p.rsplit(" ", 1)[1]) for p in pairs]

    failed = rank.rerank(d, reranker=model).orderBy("query_id", "rerank_rank").collect()
    assert {r["rerank_score"] for r in failed} == {0.0} and [r["hybrid_rank"] for r in failed[:12]] == list(range(1, 13))
    good = rank.rerank(d, reranker=model, batch=50).orderBy("query_id", "rerank_rank").collect()
    assert [r["hybrid_rank"] for r in good[:3]] == [12, 11, 10]


def test_hierarchy_carries_over_page_ranges(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "RANGE", 3)
    rows = [("b", n, "p%d" % n if n in (2, 11) else None, "s%d" % n if n == 7 else None) for n in range(1, 15)] + [("c", 9, None, None)]
    d = spark.createDataFrame(rows, "book_id string, page_number int, part_title string, section_title string")
    got = hierarchy.carried(d.withColumn("chapter_title", F.lit(None).cast("string")).withColumn("chapter_number", F.lit(None).cast("string"))).orderBy("book_id", "page_number").collect()
    assert [r["part_title"] for r in got] == [""] + ["p2"] * 9 + ["p11"] * 4 + [""]
    assert [r["section_title"] for r in got] == [""] * 6 + ["s7"] * 8 + [""] and {r["chapter_title"] for r in got} == {""}


def test_prompt_keeps_what_it_is_given(spark):
    d = spark.createDataFrame([("100% %s {x}?", "English", "", "ctx %d")], "q string, l string, p string, c string")
    got = d.select(answer.user_prompt(F.col("q"), F.col("l"), F.col("p"), F.col("c"), F.lit(False)).alias("r")).first()["r"]
    assert got.startswith("USER QUESTION:\n100% %s {x}?\n\nRESPONSE LANGUAGE:\nEnglish\n\nCHILD PROFILE:\nNo profile details supplied.\n\nRETRIEVED CONTEXT:\nctx %d\n")
    assert got.endswith("return exactly:\n   NO_RELIABLE_CONTEXT") and "1. Answer the specific" in got


def test_normal_forms_beyond_ascii(spark):
    assert one(spark, "ﬁn Ⅷ ١٢ إلى آخر ـ", X.search_text("text")) == X.search_form("ﬁn Ⅷ ١٢ إلى آخر ـ")
    assert one(spark, None, X.search_text("text")) == "" and one(spark, "Ångström NAÏVE", X.match_text("text")) == X.match_form("Ångström NAÏVE")


def test_terms_of_stored_postings_rank_as_before(spark):
    idx = spark.createDataFrame([("a", "iron zinc zinc"), ("b", "iron"), ("c", "iron milk")], "chunk_id string, text string")
    q = spark.createDataFrame([("q", 0, "zinc milk")], "query_id string, qi int, q string")
    post = retrieve.stored_postings(idx, F.col("text"))
    one_, two = (retrieve.bm25(q, idx, 5, F.col("text"), p).orderBy("rank").collect() for p in (None, post))
    assert one_ == two and {r["chunk_id"] for r in two} == {"a", "c"}


def test_models_are_told_asked_once_and_may_fail(spark):
    from folio.functions.models import text_model

    d = spark.createDataFrame([(1, "iron at school"), (2, "bad one")], "query_id int, question string")

    def model(told, prompt):
        if "bad" in prompt:
            raise RuntimeError("no answer")
        return f"{told} iron needs"

    got = {r["query_id"]: r for r in understand.understood(d, rewriter=text_model(model, ""), instructions="be brief").collect()}
    assert got[1]["rewritten"] == "be brief iron needs" and got[2]["rewritten"] == "" and len(got[2]["queries"]) == 2
    p = spark.createDataFrame([(None,), ("x",)], "p string")
    assert {r["r"] for r in p.select(text_model(lambda s, t: s + t)(F.lit("s"), F.col("p")).alias("r")).collect()} == {None, "sx"}


def plain_pages(content):
    return content.decode().split("\f")


def made_books(tmp_path):
    body = "Iron helps blood and growth in school children, and so do beans, lentils, meat and leafy greens. " * 3
    for name, head in (("Pediatric Nutrition", "Chapter 19\n"), ("PNP 3rd Edition", "1.2 Growth and Feeding\n")):
        (tmp_path / "books").mkdir(exist_ok=True)
        (tmp_path / "books" / f"{name}.pdf").write_bytes("\f".join(f"{head}Page {w} of it. {body}" for w in ("one", "two", "three")).encode())


def test_steps_over_a_folder_of_books(spark, tmp_path, capsys, monkeypatch):
    from folio import __main__ as m

    made_books(tmp_path)
    monkeypatch.setenv("RAG_AAP_BODY_START_PAGE", "1")
    monkeypatch.setenv("RAG_PNP_BODY_START_PAGE", "1")
    common = ["--books", str(tmp_path / "books"), "--index", str(tmp_path / "index"), "--extractor", "tests.test_operators:plain_pages", "--env", str(tmp_path / "none")]
    said = {}
    for step in m.STEPS:
        m.main([step, *common])
        said[step] = capsys.readouterr().out
    assert "pages: 6" in said["documents"] and "pages_out: 6" in said["preprocess"]
    assert "Chapter 19: Iron" in said["chunks"] and "not_finite: 0" in said["embeddings"]
    assert "position: 1" in said["context"] and "status: insufficient_context" in said["answer"]


def test_ingest_builds_whole_books_once(spark, tmp_path):
    from pyspark.sql import types as T

    from folio.schemas import PAGE
    from folio.sources import pages as P
    from folio.streaming.ingest import ingest_pages

    body = "Iron helps blood and growth in school children, and so do beans, lentils, meat and leafy greens. " * 3
    config = EngineConfig(aap_body_start=1, pnp_body_start=1)

    def deliver(book, numbers, head):
        rows = [(book, book, "T", "s.pdf", "/s.pdf", "0", n - 1, n, str(n), "pdf", (head if n == 1 else "") + f"Leaf {'abcdefgh'[n]}. {body}") for n in numbers]
        spark.createDataFrame(rows, T.StructType.fromDDL(PAGE)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        ingest_pages(spark, str(tmp_path / "in"), str(tmp_path / "index"), str(tmp_path / "check"), config).awaitTermination()
        return sorted((r["book_id"], r["page_number"], r["chapter_title"]) for r in P.read_index(spark, str(tmp_path / "index")).collect())

    deliver("aap8", [1, 2], "Chapter 19\n")
    deliver("pnp3", [1], "1.2 Growth and Feeding\n")
    assert run() == [("aap8", 1, "Chapter 19: Iron"), ("aap8", 2, "Chapter 19: Iron"), ("pnp3", 1, "1.2 Nutritional Assessment")]
    deliver("aap8", [2, 3], "")  # page 2 comes again, page 3 later than its heading
    assert [x[:2] for x in run()] == [("aap8", 1), ("aap8", 2), ("aap8", 3), ("pnp3", 1)] and {x[2] for x in run()[:3]} == {"Chapter 19: Iron"}


def test_diversity_equals_a_plain_fold(spark):
    import random

    r = random.Random(5)
    rows = [("q%d" % (i % 3), str(r.randrange(60)), i, "t%d" % r.randrange(40), "b%d" % r.randrange(3), "h%d" % r.randrange(20)) for i in range(150)]
    d = spark.createDataFrame(rows, "query_id string, chunk_id string, rank int, text string, book_title string, hierarchy_path string").withColumn("chapter_title", F.lit(""))
    kept: dict = {}
    for q, c, _, t, b, h in rows:
        k = kept.setdefault(q, [])
        if all(c != x[0] and t != x[1] and (b, h) != x[2] for x in k):
            k.append((c, t, (b, h)))
    got = rank.diversify(d).orderBy("query_id", "position").collect()
    assert [(x["query_id"], x["chunk_id"]) for x in got] == [(q, x[0]) for q in sorted(kept) for x in kept[q]]


def test_cleaning_is_worked_out_once(spark):
    """The filter on the cleaned length doesn't hold a copy of the cleaning."""
    rows = [("b", 1, "x" * 59), ("b", 2, "y" * 60), ("b", 3, None)]
    got = clean.preprocess(spark.createDataFrame(rows, "book_id string, page_number int, text string"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Downloaded") == 1
    assert [(r["page_number"], r["clean_character_count"]) for r in got.collect()] == [(2, 60)]


def test_lines_and_edges_as_plain_ones(spark):
    text = "\n".join(f" Line\t {i}  of\tthis " for i in range(90)) + "\n\u00a0\u200b"
    assert one(spark, text, X.page_lines("text", 80)) == [f"Line {i} of this" for i in range(80)]
    assert one(spark, "a\n", X.page_lines("text", 1)) == ["a"]
    assert one(spark, text, clean.edge_forms(F.col("text"))) == ["line # of this", "\u200b"]


def test_search_index_is_embedded_once(spark, tmp_path):
    spark.createDataFrame([(1, "iron and zinc", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    index = catalog._index(spark, str(tmp_path))
    assert "EvalPython" not in index._jdf.queryExecution().optimizedPlan().toString() and index.count() == 1
    plain = np.zeros(embed.DIM)
    for w in ("iron", "and", "zinc", "iron"):
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        plain[h % embed.DIM] += 1 if h >> 63 else -1
    assert (embed.hash_embedder(["Iron and zinc iron"])[0] == plain).all() and embed.hash_embedder([""])[0][0] == 1


def test_chunks_of_one_book_are_not_of_one_task_and_cut_once(spark):
    """Repeated lines go to each task, not pages to their book's; the kept chunks aren't cut again for their first ones."""
    rows = [("aap8", n, "Chapter 19\n" * (n == 1) + f"Leaf {'abcdefghijklmnop'[n - 1]} of many. " + "Iron helps blood and growth. " * 9) for n in range(1, 16)]
    cleaned = clean.preprocess(spark.createDataFrame(rows, "book_id string, page_number int, text string"))
    assert "strategy=broadcast" in cleaned._jdf.queryExecution().optimizedPlan().toString()
    got = chunk.create_chunks(cleaned, EngineConfig(aap_body_start=1))
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    kept = [(r["page_number"], r["chapter_title"].split(":")[0], r["chunk_id"]) for r in got.collect()]
    assert sorted(k[0] for k in kept) == list(range(1, 16)) and {k[1] for k in kept} == {"Chapter 19"}
    again = got.select(chunk.chunk_id(*[F.col(c) for c in ("book_id", "page_number", "hierarchy_path", "chunk_index_on_page", "text")]).alias("i")).collect()
    assert sorted(r["i"] for r in again) == sorted(k[2] for k in kept)


def test_texts_left_alone_are_those_that_do_not_match(spark):
    blank = "\t\x1c\x85\u00a0\u2003\u2028\u3000 "
    assert one(spark, f"{blank}a{blank}b{blank}", X.strip("text")) == f"a{blank}b" and one(spark, blank, X.strip("text")) == ""
    assert [one(spark, "a" + " " * 40 + "b" * k, X.compact_under("text", 10)) for k in (7, 8)] == [True, False]
    assert one(spark, "a\r\nb\n\u2028c\r", X.lines("text")) == one(spark, "a\nb\n\u2028c\n", X.lines("text")) == ["a", "b", "", "c"]
    for raw, clean_ in (("123412 Chapter 5", "1234\n12 Chapter 5"), ("7Section II: x", "7\nSection II: x"), ("a DOWNLOADED from https://x.org/y by guest on 1 May 2020 b", "a \n b"), ("a b.\u0130NDD 3 1/2/2020 10:30 AM b", "a \n b")):
        assert one(spark, raw, clean.without_artefacts(F.col("text"))) == clean_, raw
    assert one(spark, "cup-\n board -\n x 3-\ny", F.regexp_replace("text", clean.BROKEN_WORD, "")) == "cupboard -\n x 3-\ny"
    assert one(spark, "\na\nb.\nc\nD", F.regexp_replace("text", clean.BROKEN_LINE, " ")) == " a b.\nc\nD"
    cites = "\n".join(f"{i}.\u2003 Smith\t A, 200{i}" for i in range(3))
    for last, told in (("Who et \t al 2001", True), ("et al 2001", False)):
        assert one(spark, f"{cites}\n {last}", chunk.reference_like("text")) is told
    for head, kind in (("Author \t INDEX", "index"), ("Subject\n\n index", "index"), ("\n \u3000References", "references"), ("Index", "body")):
        d = spark.createDataFrame([("b", 1, f"{head}\n{'x' * 60}")], "book_id string, page_number int, text string")
        assert d.select(hierarchy.page_class(EngineConfig())).first()[0] == kind, head
