"""Hand-made cases: measures, paths, text rules, chunks, register scores, evaluation, sources and sinks."""

import collections
import hashlib
import math
import random

import pytest
from lexispark import catalog
from lexispark.functions import measures as M
from lexispark.functions import paths, text
from lexispark.operators import annotate, embed, evaluate, readability, register, sampling, textprep, topics
from lexispark.plans import stats_queries
from lexispark.sources import readers, writers
from lexispark.streaming import append
from pyspark.sql import functions as F


def one(spark, col, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("_")).select(col.alias("x")).first()[0]


@pytest.mark.parametrize(
    "measure, expected",
    [("t", abs((10 - 20 * 40 / 1000) / math.sqrt(10))), ("mi", math.log2(10 * 1000 / 800)), ("mi_3", math.log2(1000 * 1000 / 800)), ("min_sensitivity", 0.25), ("dice", 20 / 60), ("rf", 50.0), ("mi_log_prod", math.log2(12.5) * math.log10(11))],
)
def test_measures(spark, measure, expected):
    row = spark.createDataFrame([(10, 20, 40, 1000)], "f_ii long, f_ix long, f_xi long, f_xx long")
    assert M.all_measures(row).first()[measure] == pytest.approx(expected)


def test_unseen_pairs_score_zero(spark):
    r = M.all_measures(spark.createDataFrame([(0, 20, 40, 1000)], "f_ii long, f_ix long, f_xi long, f_xx long")).first()
    assert [r[k] for k in ("t", "chi_sq", "mi", "mi_3", "llr", "dice")] == [0.0] * 6


def test_cells_and_marginals_agree(spark):
    a = M.contingency(spark.createDataFrame([(10, 20, 40, 3_000_000_000)], "f_ii long, f_ix long, f_xi long, f_xx long"))
    b = M.contingency_from_cells(a.select("f_ii", "f_io", "f_oi", "f_oo")).first()
    assert b["f_xx"] == 3_000_000_000 and b["f_ix"] == 20 and b["f_xi"] == 40
    chi = a.select(M.chi_sq(), M.llr()).first()
    assert chi[0] > 0 and chi[1] > 0


@pytest.mark.parametrize(
    "path, query, fits",
    [("a.b.c", "a.*", True), ("a.b.c", "*.c", True), ("a.b.c", "a.*{1}.c", True), ("a.b.c", "a.*{2}.c", False), ("a.b", "a.!b", False), ("a.x", "a.!b", True), ("a.b", "a|z.b", True), ("abc.d", "ab*.d", True), ("ABC.d", "abc@.d", True), ("a.b", "a", False), ("a", "a.*", True), ("a.b.c.d", "a.*{0,2}.d", True)],
)
def test_path_match(spark, path, query, fits):
    assert one(spark, paths.path_match(F.col("p"), query), p=path) is fits


def test_word_query(spark):
    got = spark.createDataFrame([(["x", "y"],), (["z"],)], "g array<string>").select(paths.word_query(F.col("g"), "x & (y | w) & !z").alias("v")).collect()
    assert [r["v"] for r in got] == [True, False]
    with pytest.raises(ValueError):
        paths.word_query(F.col("g"), "(x")


def test_sanitize_path(spark):
    got = spark.createDataFrame([(["a b", "", None, "ü-1", "x" * 300],)], "g array<string>").select(paths.sanitize_path(F.col("g"))).first()[0]
    assert got == ["a_b", "ü_1"]


@pytest.mark.parametrize("line, parts", [("「よ」。次", ["「よ」。次"]), ("だ。。。次", ["だ。", "。。次"]), ("5.5％だ。次", ["5.5％だ。", "次"]), ("そう。違う！はい", ["そう。", "違う！", "はい"]), ("", [])])
def test_sentences(spark, line, parts):
    assert one(spark, text.split_sentences(F.col("l")), l=line) == parts


def test_paragraphs(spark):
    lines = [(1, i, x) for i, x in enumerate(["a", "b", "", "　c", "　d", "e", None, "f"])]
    got = textprep.split_paragraphs(spark.createDataFrame(lines, "doc_id int, line_no int, line string")).orderBy("line_no").collect()
    assert [(r["line"], r["paragraph"]) for r in got] == [("a", 1), ("b", 1), ("　c", 2), ("　d", 2), ("e", 3), ("f", 4)]


def test_kwic_is_whole(spark):
    rows = spark.createDataFrame([("xabyabz",), ("ab",), ("none",)], "t string").select("t", F.explode(text.kwic(F.col("t"), "ab")).alias("m")).select("t", F.concat("m.before", "m.key", "m.after").alias("w")).collect()
    assert len(rows) == 3 and all(r["t"] == r["w"] for r in rows)
    with pytest.raises(ValueError):
        text.kwic(F.col("t"), "a*")


def test_character_counts(spark):
    counts = text.char_class_counts(F.col("t"))
    got = {n: one(spark, c, t="ひら漢字カナabc［1，。") for n, c in counts.items()}
    assert got == {"hiragana": 2, "kanji": 2, "katakana": 2, "romaji": 5, "commas": 1, "symbols": 1}


def test_normalize(spark):
    assert one(spark, text.normalize_text(F.col("t")), t="éｶﾞ a．") == "éガ　ａ。"


def test_aspect_tags(spark):
    got = spark.createDataFrame([(["aspect", "iru", "past"],), (["iru"],), (["past"],)], "t array<string>").select(text.unify_aspect_tags(F.col("t")).alias("u")).collect()
    assert [r["u"] for r in got] == [["past", "aspect-iru"], [], ["past"]]


TOKEN = "array<struct<pos:string,tags:array<string>,orth:string,orth_base:string,lemma:string,goshu:string,c_type:string,c_form:string>>"


def tok(pos, orth, base=None, lemma=None, c_type="*", c_form="*"):
    return (pos, [], orth, base or orth, lemma or base or orth, "和", c_type, c_form)


def test_type_chunks(spark):
    rows = [([tok("noun", "先生"), tok("particle", "に")],), ([tok("verb", "続け", "続ける", c_form="未然形-一般"), tok("auxiliary-verb", "られ", "られる", c_form="連用形-一般"), tok("auxiliary-verb", "た", "た", c_type="助動詞-タ")],)]
    got = spark.createDataFrame(rows, f"t {TOKEN}").select(annotate.type_chunks(F.col("t")).alias("c")).select("c.*").collect()
    assert (got[0]["head_string"], got[0]["head_pos"], got[0]["tail_string"], got[0]["tail_pos"]) == ("先生", "noun", "に", "particle")
    assert got[1]["head_string"] == "続けられる" and got[1]["tail_string"] is None


def test_display_strings_by_class(spark):
    verb = [tok("verb", "続け", "続ける", c_form="未然形-一般"), tok("auxiliary-verb", "られ", "られる", c_form="連用形-一般"), tok("auxiliary-verb", "た", "た", c_type="助動詞-タ")]
    rows = [("verb", verb), ("noun", verb), ("noun", [tok("noun", "先生"), tok("particle", "に"), tok("symbol", "。")]), ("particle", [tok("particle", "に")])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, pos string, t {TOKEN}")
    got = [r["x"] for r in df.orderBy("i").select(annotate.display_string(F.col("pos"), F.col("t")).alias("x")).collect()]
    assert got == ["続けられる", "続ける", "先生", "に"]


def test_merge_chunks(spark):
    e = "struct<id:int,link:int,head_string:string,head_tags:array<string>,head_pos:string,tail_string:string,tail_tags:array<string>,tail_pos:string,tokens:array<struct<pos:string,orth:string,lemma:string,c_form:string>>>"
    a = (0, 1, "先生", [], "noun", "に", [], "particle", [("noun", "先生", "先生", "*"), ("particle", "に", "に", "*")])
    b = (1, 2, "なる", [], "verb", None, None, None, [("verb", "なる", "成る", "終止形-一般")])
    c = (2, -1, "こと", [], "noun", None, None, None, [("noun", "こと", "事", "*")])
    got = spark.createDataFrame([([a, b, c],)], f"c array<{e}>").select(F.explode(annotate.merge_chunks(F.col("c"), e)).alias("m")).select("m.*").collect()
    assert [(r["id"], r["link"], r["head_string"]) for r in got] == [(0, 1, "先生になる"), (1, -1, "こと")]


def test_depth_and_distance(spark):
    rows = [(1, 0, 2), (1, 1, 2), (1, 2, 3), (1, 3, -1), (2, 0, -1)]
    c = spark.createDataFrame(rows, "sentence_id int, chunk_id int, link int")
    assert {r[0]: r[1] for r in readability.chunk_depth(c).collect()} == {1: 3, 2: 0}
    assert {r[0]: r[1] for r in readability.link_distance(c).collect()} == {1: 4, 2: 0}


def test_register_verdicts(spark):
    tokens = spark.createDataFrame([("g", 1_000_000), ("b", 1_000_000), ("o", 1_000_000)], "group string, tokens long")
    counts = spark.createDataFrame([("up", "g", 900), ("down", "b", 900), ("even", "g", 10), ("even", "b", 10), ("even", "o", 10)], "item string, group string, count long")
    got = {r["item"]: r["verdict"] for r in register.register_score(counts, tokens, ["g"], ["b"], "item").collect()}
    assert got == {"up": True, "down": False, "even": None}


def test_confusion(spark):
    vals = [True, False, None]
    df = spark.createDataFrame([(a, b) for a in vals for b in vals], "t boolean, p boolean")
    assert set(evaluate.confusion_matrix_na(df, "t", "p").first()) == {1}
    r = evaluate.scores(evaluate.confusion_matrix(df, "t", "p")).first()
    assert (r["na"], r["precision"], r["recall"], r["f1"]) == (5, 0.5, 0.5, 0.5)
    none = evaluate.scores(evaluate.confusion_matrix(df.where("false"), "t", "p")).first()
    assert none["precision"] == 0.0 and none["f1"] is None


def test_samples(spark):
    d = spark.range(100).withColumnRenamed("id", "source_id")
    a = [r[0] for r in sampling.sample_docs(d, 0.1).collect()]
    assert len(set(a)) == 11 and a == [r[0] for r in sampling.sample_docs(d, 0.1).collect()]
    assert sampling.sample_docs(d, 0.5, replace=True).count() == 51


def test_sources_tsv(spark, tmp_path):
    (tmp_path / "sources.tsv").write_text('t"1\ta\t1999\tb1\tx\tx\ty\ty\t1\nt2\ta\t2001\tb2\tx\ty\tx\tx\tTRUE\nt3\ta\t2001\tb3\tx\t\t\t\t0\n')
    got = readers.read_sources_tsv(spark, str(tmp_path)).orderBy("basename").collect()
    assert [r["permission"] for r in got] == [True, True, False] and [r["genre"][:3] for r in got][:2] == [["x", "y"], ["x", "y", "x"]] and got[0]["title"] == 't"1'


def test_text_docs(spark, tmp_path):
    (tmp_path / "topic-news").mkdir()
    (tmp_path / "topic-news" / "n1.txt").write_text("http://u\n2011-01-02T03\n題\n本文\n終わり（記者）\n")
    got = readers.parse_header_docs(readers.read_text_docs(spark, str(tmp_path))).first()
    assert (got["basename"], got["title"], got["year"], got["author"], got["genre"][2], len(got["body"])) == ("n1", "題", 2011, "記者", "総合", 2)


def test_tagged_docs(spark):
    lines = ["＼ＩＤ＼1", "＼ＡＤ＼０７", "＼Ｃ０＼９３０１０１００１", "＼Ｔ１＼題", "＼Ｔ２＼段落一", "＼Ｔ２＼段落二", "＼ＩＤ＼2", "＼Ｃ０＼２００５０１０１００１", "＼Ｔ２＼【現在著作権交渉中の為、本文は表示できません】", "＼Ｔ２＼後", "＼ＩＤ＼3", "＼Ｙ６＼Ｙ１０", "＼ＡＦ＼２００５０１０１００２", "＼ＨＯＮ＼段"]
    got = readers.parse_tagged_docs(spark.createDataFrame([("p", i, x) for i, x in enumerate(lines)], "path string, line_no int, line string")).orderBy("record").collect()
    assert [(r["record"], r["year"], r["genre"][-1], len(r["paragraphs"])) for r in got] == [(1, 1993, "国際", 2), (3, 2005, "国土・都市計画", 1)]


def test_tagged_files_of_many_splits(spark, tmp_path):
    """Records read in splits are those of the lines in order, whatever the size of splits; no window or shuffle is in the plan."""
    lines = []
    for i in range(120):
        own = [f"＼ＩＤ＼{i}", "＼ＡＤ＼０７", f"＼Ｃ０＼9{i % 10}{i:07}", f"＼Ｔ１＼題{i}", f"＼Ｔ１＼題{i}b", *[f"＼Ｔ２＼段{i}-{j}" for j in range(i % 4)], "no tag"]
        if i % 7 == 3:
            own[5:5] = ["＼Ｔ２＼【現在著作権交渉中の為、本文は表示できません】"]
        lines.append((f"f{i % 2}", own))
    rows, n = [], 0
    for name in ("f0", "f1"):
        mine = [x for f, own in lines if f == name for x in own]
        (tmp_path / f"path={name}").mkdir()
        (tmp_path / f"path={name}" / "part.txt").write_text("\n".join(mine) + "\n")
        rows += [(name, n := n + 1, x) for x in mine]
    want = readers.parse_tagged_docs(spark.createDataFrame(rows, "path string, line_no int, line string")).drop("record")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("300b", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        read = readers.read_tagged_records(spark, str(tmp_path))
        got = readers.parse_tagged_records(read)
        assert (read.rdd.getNumPartitions() > 20) == (size == "300b")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect())) and got.count() > 60
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_append_and_stream(spark, tmp_path):
    sources = spark.createDataFrame([(1, "a")], "source_id long, basename string")
    children = spark.createDataFrame([("a", "t")], "basename string, text string")
    for _ in range(2):  # a retry
        writers.append_batch(sources, children, str(tmp_path / "c"), 0)
    with pytest.raises(ValueError):
        writers.append_batch(sources, spark.createDataFrame([("z", "t")], "basename string, text string"), str(tmp_path / "c"), 1)
    assert spark.read.parquet(str(tmp_path / "c/sentences")).count() == 1
    q = append.append_stream(append.stream_documents(spark, str(tmp_path / "c/sentences/batch=0"), "text string, source_id long"), lambda b: b, str(tmp_path / "o"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1


def test_saved_matches(spark, tmp_path):
    path = writers.save_matches(spark.range(3), str(tmp_path), "q", "g", ["b", "a"])
    assert spark.read.parquet(path).count() == 3 and path.endswith(writers.matches_name("q", "g", ["a", "b"]))


def test_topics_are_trained_whole(spark, sf, monkeypatch):
    train, models = topics.train_topics, []

    def short(docs, **given):
        assert not given
        models.append(train(docs, iterations=2))
        return models[-1]

    monkeypatch.setattr(topics, "train_topics", short)
    told = catalog.queries()["m01_train_topics"](spark, sf).collect()
    assert len(told) == 100 and all(len(r["termIndices"]) == 5 for r in told)
    docs = stats_queries._words(spark, sf)
    vocabulary = models[0][0].vocabulary
    assert len(vocabulary) == docs.select(F.explode("words")).distinct().count() > 5000
    best = catalog.queries()["m02_infer_topics"](spark, sf).groupBy("source_id").agg(F.count("*").alias("n")).collect()
    assert len(best) == docs.count() and {r["n"] for r in best} == {5}


def test_topics_that_were_planted(spark, tmp_path):
    """Two sets of words: texts with one strongest topic are of one set, also with the saved models and in a second run."""
    rows = [(i, [f"{'ab'[i % 2]}{(i * 7 + j * j) % 12}" for j in range(30)]) for i in range(240)]
    docs = spark.createDataFrame(rows, "source_id long, words array<string>").coalesce(1)
    models = topics.train_topics(docs, topics=8)
    topics.save_topics(models, f"file://{tmp_path}/m")
    best = lambda m: {r["source_id"]: r["topic"] for r in topics.infer_topics(m, docs, "source_id", n=1).collect()}
    got = best(models)
    assert got == best(topics.load_topics(f"file://{tmp_path}/m")) == best(topics.train_topics(docs, topics=8))
    sets = collections.Counter((t, i % 2) for i, t in got.items())
    assert sum(max(sets[t, 0], sets[t, 1]) for t in range(8)) >= 0.9 * len(rows)


def test_measures_of_empty_margins(spark):
    """Cells that divide by zero give null, not an error."""
    rows = spark.createDataFrame([(1, 0, 4, 10), (1, 3, 0, 10), (0, 0, 0, 0), (1, 2, 3, 0)], "f_ii long, f_ix long, f_xi long, f_xx long")
    got = M.all_measures(rows).collect()
    assert [r["min_sensitivity"] for r in got] == [None, None, None, pytest.approx(1 / 3)] and [r["rf"] for r in got][:3] == [None, pytest.approx(100 / 3), None]
    assert one(spark, M.idf("n", "df"), n=3, df=0) is None and one(spark, text.shibasaki_grade(F.col("h"), F.col("c"), F.col("k")), h=1, c=0, k=2) is None


@pytest.mark.parametrize("ratio", [0.001, 0.3, 0.999, 1.0])
def test_threshold_sample_is_the_sorted_one(spark, ratio, monkeypatch):
    docs = spark.range(500).select((F.col("id") % 450).alias("source_id"), "id")
    k = int(ratio * 500) + 1
    order = sorted((hashlib.md5(f"7{r['source_id']}".encode()).hexdigest(), r["source_id"]) for r in docs.collect())[:k]
    for digits in (1, 4):
        monkeypatch.setattr(sampling, "DIGITS", digits)
        df = sampling.sample_docs(docs, ratio, "source_id", "7")
        assert sorted(r["source_id"] for r in df.collect()) == sorted(i for _, i in order)


def test_topics_of_rare_words(spark):
    docs = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["a", "c"]), (3, [])], "source_id long, words array<string>")
    models = topics.train_topics(docs, topics=2, iterations=2)
    assert sorted(models[0].vocabulary) == ["a", "b", "c"]
    got = topics.infer_topics(models, docs, "source_id", n=5, words=2).collect()
    assert sorted((r["source_id"], r["rank"]) for r in got) == [(i, k) for i in (1, 2, 3) for k in (1, 2)]


def test_embeddings_are_trained_whole(spark, sf):
    got = catalog.queries()["l01_train_embeddings"](spark, sf)
    words = stats_queries._words(spark, sf).select(F.explode("words").alias("w")).groupBy("w").count().where("count >= 2").count()
    assert got.columns == ["word", "vector"] and got.where(F.size("vector") == 100).count() == words


def test_path_and_type_queries_read_whole_texts(spark, sf):
    q, docs = catalog.queries(), spark.read.parquet(f"{sf}/documents.parquet")
    long = docs.where(F.exists(F.split("text", "\n"), lambda x: F.octet_length(x) >= 300))
    assert long.count() > 0
    got = q["b05_sanitize_line_path"](spark, sf)
    assert got.where(F.exists(F.split("path", r"\."), lambda x: F.octet_length(x) >= 256)).count() == 0 < got.where(F.length("path") > 256).count()
    assert q["k03_infer_whole_corpus_type"](spark, sf).exceptAll(q["k03_infer_corpus_type"](spark, sf)).count() > 0


def test_scored_items_stand_at_their_places(spark, sf):
    from lexispark.catalog import queries
    from lexispark.plans import views

    texts = {}
    for r in views.sentences(spark, sf).orderBy("sentence_id").collect():
        paragraph, text = texts.get(r["source_id"], (r["paragraph_order_id"], ""))
        texts[r["source_id"]] = r["paragraph_order_id"], text + "\n" * (r["paragraph_order_id"] != paragraph) + r["text"]
    rows = queries()["h06_score_texts"](spark, sf).collect()
    assert {r["kind"] for r in rows} == {"token", "collocation"}
    for r in rows:
        found = texts[r["text_id"]][1][r["begin"] : r["end"]].lower()
        if r["kind"] == "token":
            assert found == r["item"]
        else:
            head, tail = r["item"].rsplit("-", 1)
            assert found.endswith(tail) and "".join(found.removesuffix(tail).split()) == head


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("accuracy", [0.5, 0.75, 0.9])
def test_similar_pairs_are_all_found(spark, accuracy):
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 11))) for _ in range(160)} | {"", "a", "abababababababababab", "babababababababababab"}
    df = spark.createDataFrame([(w,) for w in [*words, "a", None]], "w string")
    got = {(r["query"], r["item"]): r["similarity"] for r in embed.similar_pairs(df, df, "w", accuracy).collect()}
    want = {(a, b): 1 - edits(a, b) / max(len(a), len(b)) for a in words for b in words if a and b}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= accuracy - 1e-9})
