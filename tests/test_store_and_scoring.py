"""Stored search tables that grow by batches, and register scores of new texts."""

import pytest
from lexispark.operators import grams, register, scoring, skew
from lexispark.plans import views as V
from lexispark.sources.store import KEYS, SearchStore, batch_tables, merge_stream
from pyspark.sql import functions as F

TEXTS = [
    (1, "en", "a", "The house of wood. A river ran by the house!\nThe river."), (2, "en", "b", "House of stone of wood."), (3, "de", "a", "Haus der Kunst. The house of wood."),
    (4, "de", "a", "The house of wood. River house."), (5, "es", "c", "Casa de madera. The house of wood; nothing else of wood."), (6, "fr", "c", ""),
]
SCHEMA = "doc_id long, lang string, source string, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, SCHEMA)


def tables(docs):
    s = V.sentences_of(docs)
    return batch_tables(V.chunk_rows_of(s), V.tokens_of(s))


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def whole(spark, docs, tmp_path_factory):
    store = SearchStore(spark, f"file://{tmp_path_factory.mktemp('whole')}")
    assert store.merge("all", tables(docs))
    return store


def test_batches_add_up(spark, docs, whole, tmp_path):
    store = SearchStore(spark, f"file://{tmp_path}")
    parts = [docs.where("lang = 'en'"), docs.where("lang = 'de'"), docs.where("lang NOT IN ('en', 'de')")]
    broken = tables(parts[1]) | {"tokens": spark.range(1).select(F.raise_error(F.lit("lost")).alias("orth_base"))}
    assert store.merge("one", tables(parts[0])) and not store.merge("one", tables(parts[0]))
    with pytest.raises(Exception, match="lost"):
        store.merge("two", broken)
    assert store.batches() == {"one"}
    assert store.merge("two", tables(parts[1])) and store.merge(3, tables(parts[2])) and not store.merge("two", tables(parts[1]))
    assert store.batches() == {"one", "two", "3"}
    for _ in range(2):
        for name in KEYS:
            assert rows(store.read(name)) == rows(whole.read(name)), name
        for n in (1, 2, 3):
            assert rows(store.search_gram(n)) == rows(whole.search_gram(n))
        store.compact()
    assert len(store.parts()) == 1 and not store.merge("one", tables(parts[0]))


def test_marginals_are_sums_over_grams(whole):
    for n, right in ((2, "string_2"), (3, "string_3")):
        g = [r.asDict() for r in whole.search_gram(n).collect()]
        assert g
        for r in g:
            same = lambda x, s, r=r: x["type"] == r["type"] and x["genre"] == r["genre"] and x[s] == r[s]
            assert r["f_ix"] == sum(x["count"] for x in g if same(x, "string_1")) and r["f_xi"] == sum(x["count"] for x in g if same(x, right))


def test_stream_merges_each_batch_once(spark, docs, whole, tmp_path):
    for i, lang in enumerate(("en", "de")):
        docs.where(F.col("lang") == lang).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        store = SearchStore(spark, f"file://{tmp_path}/store", max_deltas=1)
        merge_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), tables, store, f"{tmp_path}/checkpoint").awaitTermination()
        assert len(store.batches()) == i + 1
    docs.where("lang NOT IN ('en', 'de')").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    merge_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), tables, store, f"{tmp_path}/checkpoint").awaitTermination()
    assert len(store.parts()) == 1
    for name in KEYS:
        assert rows(store.read(name)) == rows(whole.read(name)), name


def placed(docs):
    return scoring.placed_grams(V.chunk_rows_of(V.sentences_of(docs), "offset"))


def test_spans_hold_their_parts(docs):
    """The text that the spans count in: sentences one after another, a line end between paragraphs."""
    texts, last = {}, {}
    for r in V.sentences_of(docs).orderBy("sentence_id").collect():
        if last.get(r["source_id"], r["paragraph_order_id"]) != r["paragraph_order_id"]:
            texts[r["source_id"]] += "\n"
        texts[r["source_id"]] = texts.get(r["source_id"], "") + r["text"]
        last[r["source_id"]] = r["paragraph_order_id"]
    got = placed(docs).collect()
    assert {r["n"] for r in got} == {1, 2, 3, 4}
    for r in got:
        for i, span in enumerate(r["spans"]):
            assert "".join(texts[r["text_id"]][span["begin"] : span["end"]].lower().split()) == r[f"string_{i + 1}"]


def test_seen_and_unseen(spark, docs, tmp_path):
    store = SearchStore(spark, f"file://{tmp_path}")
    store.merge("registers", tables(docs.where("lang IN ('en', 'de', 'fr')")))
    own = placed(docs)
    known = {tuple(r) for r in placed(docs.where("lang IN ('en', 'de', 'fr')")).select(*scoring.KEYS).collect()}
    got = {tuple(r[k] for k in scoring.KEYS): r for r in scoring.score_grams(own.select(*scoring.KEYS).distinct(), store, ("en",), ("de", "fr")).collect()}
    every = {tuple(r) for r in own.select(*scoring.KEYS).collect()}
    assert {k for k, r in got.items() if r["seen"]} == {k for k in known if k[1] not in register.UNSCORED_TYPES}
    assert {k for k, r in got.items() if not r["seen"]} == {k for k in every - known if k[0] > 1 and k[1] not in register.UNSCORED_TYPES}
    assert any(not r["seen"] for r in got.values())
    assert all((r["mi"] is None) == (k[0] == 1) for k, r in got.items()) and all(r["good"] is None and r["count"] == 0 for r in got.values() if not r["seen"])
    count = {tuple(r[k] for k in scoring.KEYS): r["c"] for r in placed(docs.where("lang IN ('en', 'de', 'fr')")).groupBy(*scoring.KEYS).agg(F.count("*").alias("c")).collect()}
    assert all(r["count"] == count[k] for k, r in got.items() if r["seen"])
    assert scoring.score_texts(own, store, ("en",), ("de", "fr")).count() == own.join(spark.createDataFrame(list(got), own.select(*scoring.KEYS).schema), scoring.KEYS).count()


def test_paths_are_the_same_from_rows_and_arrays(docs):
    r = V.chunk_rows_of(V.sentences_of(docs))
    flat = r.select("sentence_id", "source_id", "genre", F.explode("cs").alias("c")).select("sentence_id", "source_id", "genre", "c.*")
    for f in (grams.follow_links, grams.extract_collocations, grams.extract_unigrams):
        assert rows(f(r)) == rows(f(flat))


def test_hot_keys_are_dealt(spark, monkeypatch):
    many = spark.range(9000).select(F.when(F.col("id") < 6000, 0).otherwise(F.col("id") % 700).alias("k"), "id")
    one = spark.range(650).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        assert rows(skew.dealt_join(many, one, ["k"], ["id"], how)) == rows(many.join(one, "k", how))
    held = skew.may_be_in(many, one, ["k"], "maybe").where("NOT maybe").select("k").distinct()
    assert held.join(one, "k").isEmpty() and not held.isEmpty()


def test_long_sentences_are_cut_right(spark):
    text = "Word the other " * 700
    got = V.chunk_rows_of(V.sentences_of(spark.createDataFrame([(1, "en", "a", text)], SCHEMA))).select(F.explode("cs").alias("c")).select("c.*").collect()
    own = text.strip()
    assert len(got) == 701 and got[-1]["link"] == -1
    assert all(own[r["tail_from"] : r["tail_to"]] == "the" for r in got[:-1]) and all(own[r["head_from"] : r["head_to"]].replace(" ", "").lower() == r["head_string"] for r in got)
    assert all(r["head_end"] - r["head_begin"] == len(r["head_string"]) for r in got)
