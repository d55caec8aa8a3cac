"""The pipeline's stages on a small hard table, against plain versions of their decisions."""

import numpy as np
import pytest

import corpus_pipeline
from folio.llm import mixing, packing, pii, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tokens long, rate double, `__n` int, kept string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(21)
    words = [a + b for a in ("an", "er", "tion", "the", "is", "ou", "nd") for b in ("st", "ea", "or", "ly", "in", "")]
    good = [" ".join(rng.choice(words, 50)) + f". Write to person{i}@mail.org or 10.0.0.{i}." for i in range(60)]
    bad = [" | ".join(f"$${x}##{x}!!" for x in rng.integers(0, 9, 30)) for _ in range(30)]
    rows = [(i, t, "en", "s", len(t), 1, 0.5, 3, "k") for i, t in enumerate(good + bad)]
    rows += [(100 + i, good[i] + " more", "en", "s", 0, 1, 0.5, 3, "k") for i in range(5)]  # near copies
    rows += [rows[7], rows[8], (200, None, None, None, None, None, None, None, None), (201, "", "en", "s", 0, 0, 0.0, 0, ""), (None, good[9] + " x", None, None, None, None, None, None, None), (202, " ".join(rng.choice(words, 30000)), "en", "s", 0, 0, 0.0, 0, "")]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), int(i % 17 == 0)) for i in range(90)] + [(5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def stage(spark, k, docs, at):
    return corpus_pipeline.STAGES[k][1](spark, docs, at)


def key(rows):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in rows)


def test_stages_decide_as_plain_versions_do(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    scores = quality.quality(docs, labels).collect()
    good = stage(spark, 0, docs, tables)
    assert good.columns == docs.columns and good.count() == sum(r["predicted"] for r in scores)
    assert {r["doc_id"] for r in good.collect()} >= set(range(60))

    sets = {}
    for r in docs.collect():
        w = (r["text"] or "").lower().split()
        sets.setdefault(r["doc_id"], {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    drop = {b for b in sets for a in sets if None not in (a, b) and a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    once = stage(spark, 1, docs, tables)
    ids = [r["doc_id"] for r in once.collect()]
    assert once.columns == docs.columns and sorted(i for i in ids if i is not None) == sorted(set(sets) - drop - {None}) and ids.count(None) == 1
    assert {100, 101, 102, 103, 104} <= drop

    clean = stage(spark, 2, docs, tables)
    terms = {r["term"] for r in pii.revealing_terms(docs).collect()}
    assert clean.columns == docs.columns
    assert key(clean.collect()) == sorted((r["doc_id"] is None, r["doc_id"] or 0, pii.redact(r["text"], terms) if r["text"] else "") for r in docs.collect())

    mixed = stage(spark, 3, docs, tables)
    rates = {r["doc_id"]: r["rate"] for r in mixing.rates(docs, labels).collect()}
    times = {d: [r["doc_id"] for r in mixed.collect()].count(d) for d in rates}
    many = {r["doc_id"]: r["count"] for r in docs.groupBy("doc_id").count().collect()}
    assert mixed.columns == docs.columns and all(np.floor(rates[d]) * many[d] <= times[d] <= np.ceil(rates[d]) * many[d] for d in rates)

    packed = stage(spark, 4, docs, tables).toPandas()
    encode = packing.encoder(packing.tokenizer_path())
    assert packed["length"].sum() == sum(len(x) + 1 for x in encode([r["text"] or "" for r in docs.collect()]))


def test_whole_run_and_empty_table(spark, tables, tmp_path):
    out = corpus_pipeline.run(spark, tables).toPandas()
    assert len(out) and out.groupby("sequence_id")["length"].sum().max() <= 2048
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum()[:-1]]
    for name in ("documents", "labels"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
