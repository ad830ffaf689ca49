"""Queries over the corpus views: text preparation, search, grams, search tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import aggregates, cutting, grams, search, textprep
from ..sources import writers
from . import views as V
from .registry import query

NL = "chr(10)"


@query("b01_split_paragraphs", r"""
SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY part) AS paragraph, line_no, line FROM (
  SELECT *, bool_or(line <> '') OVER (PARTITION BY doc_id, part) AS keep FROM (
    SELECT *, sum(CASE WHEN flag <> prev THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS part FROM (
      SELECT *, lag(flag) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev FROM (
        SELECT doc_id, line, i - 1 AS line_no, line = '' OR starts_with(line, chr(12288)) AS flag FROM pars0)))) WHERE keep AND line <> ''""")
def split_paragraphs(spark, sf):
    lines = V.read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return textprep.split_paragraphs(lines).select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), F.col("line_no").cast("long").alias("line_no"), "line")


def _cut_sql(line: str) -> str:
    """The sentence rule without look-around: each match takes the characters beside the break along, so two passes find neighbours too."""
    before, ends = rf"[^{text.CLOSERS}{text.DELIMITERS}\n]", "\\n\\r\\x{85}\\x{2028}\\x{2029}"
    after_other = rf"({before}。|[^{text.CLOSERS}{text.DELIMITERS}{text.ALNUM}\n][{text.DELIMITERS}])([^{ends}])"
    before_other = rf"({before}[{text.DELIMITERS}])([^{text.ALNUM}{ends}])"
    for rule in (after_other, after_other, before_other, before_other):
        line = f"regexp_replace({line}, '{rule}', '\\1' || {NL} || '\\2', 'g')"
    return f"list_filter(string_split({line}, {NL}), lambda x: x <> '')"


_CUT = f", cut AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, unnest(ss) AS sentence, CAST(generate_subscripts(ss, 1) - 1 AS INTEGER) AS pos FROM (SELECT doc_id, i, {_cut_sql('line')} AS ss FROM pars0))"


@query("b02_split_sentences", _CUT + " SELECT * FROM cut")
def split_sentences(spark, sf):
    return V.read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select("doc_id", "line_no", F.posexplode(text.split_sentences(F.col("line"))).alias("pos", "sentence"))


@query("b03_number_sentences", "SELECT source_id, CAST(paragraph_order_id AS BIGINT) AS paragraph_order_id, CAST(sentence_order_id AS BIGINT) AS sentence_order_id, text FROM sentences")
def number_sentences(spark, sf):
    s = V.sentences(spark, sf)
    return s.select("source_id", F.col("paragraph_order_id").cast("long").alias("paragraph_order_id"), F.col("sentence_order_id").cast("long").alias("sentence_order_id"), "text")


@query("b03_number_reference_sentences", _CUT + """ SELECT doc_id, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY line_no) AS INTEGER) AS paragraph_order_id,
 CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no, pos) AS INTEGER) AS sentence_order_id, sentence AS text FROM cut""")
def number_reference_sentences(spark, sf):
    pars = V.read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "text"))
    return textprep.number_sentences(pars)


# no half-width kana, which only the test of the operator has
_NARROW = "".join(map(chr, range(0x20, 0x7F)))
_WIDE = "　" + "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))


@query("b04_normalize_text", f"SELECT doc_id, translate(translate(translate(nfc_normalize(text), '{_NARROW.replace(chr(39), chr(39) * 2)}', '{_WIDE}'), '｡｢｣､･', '。「」、・'), '．，', '。、') AS text FROM documents", with_views=False)
def normalize_text(spark, sf):
    return V.read(spark, sf, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("text"))


@query("b05_sanitize_path", r"""
SELECT doc_id, array_to_string(list_filter(list_transform(list_filter([lang, source, text], lambda x: x <> ''), lambda x: regexp_replace(x, '[^\p{L}\p{N}]+', '_', 'g')), lambda x: strlen(x) < 256), '.') AS path FROM documents""")
def sanitize_path(spark, sf):
    d = V.read(spark, sf, "documents")
    return d.select("doc_id", paths.path_string(paths.sanitize_path(F.array("lang", "source", "text"))).alias("path"))


@query("b05_sanitize_line_path", r"""
SELECT doc_id, array_to_string(list_filter(list_transform(list_filter(list_concat([lang, source], string_split(text, chr(10))), lambda x: x <> ''), lambda x: regexp_replace(x, '[^\p{L}\p{N}]+', '_', 'g')), lambda x: strlen(x) < 256), '.') AS path FROM documents""")
def sanitize_line_path(spark, sf):
    """Whole lines as labels, so that some are too long."""
    d = V.read(spark, sf, "documents")
    return d.select("doc_id", paths.path_string(paths.sanitize_path(F.concat(F.array("lang", "source"), F.split("text", "\n")))).alias("path"))


@query("b06_strip_token_space", r"SELECT sentence_id, regexp_replace(text, '[\s\x{3000}]+', '', 'g') AS stripped FROM sentences")
def strip_token_space(spark, sf):
    return V.sentences(spark, sf).select("sentence_id", text.strip_token_space(F.col("text")).alias("stripped"))


_CLASSES_SQL = r"""
SELECT doc_id, h AS hiragana, k AS kanji, t AS katakana, r AS romaji, c AS commas, length(text) - h - k - t - r - c AS symbols FROM (
  SELECT doc_id, text, length(text) - length(regexp_replace(text, '[\x{3041}-\x{309f}]', '', 'g')) AS h, length(text) - length(regexp_replace(text, '[\x{4e00}-\x{9fff}]', '', 'g')) AS k,
    length(text) - length(regexp_replace(text, '[\x{30a0}-\x{30ff}]', '', 'g')) AS t, length(text) - length(regexp_replace(text, '[A-z0-9\x{ff21}-\x{ff5a}\x{ff10}-\x{ff19}]', '', 'g')) AS r,
    length(text) - length(regexp_replace(text, '[\x{3001}\x{ff0c},]', '', 'g')) AS c FROM documents)"""


@query("b07_char_class_counts", _CLASSES_SQL)
def char_class_counts(spark, sf):
    d = V.read(spark, sf, "documents")
    return d.select("doc_id", *[c.cast("long").alias(n) for n, c in text.char_class_counts(F.col("text")).items()])


_RUNS = r"""
, runs AS (SELECT doc_id, text, len(h) + len(k) + len(t) + len(r) AS total, {'hiragana': h, 'kanji': k, 'katakana': t, 'romaji': r} AS x FROM (
  SELECT doc_id, text, regexp_extract_all(text, '[\x{3041}-\x{309f}]+') AS h, regexp_extract_all(text, '[\x{4e00}-\x{9fff}]+') AS k, regexp_extract_all(text, '[\x{30a0}-\x{30ff}]+') AS t,
    regexp_extract_all(text, '[^\x{3041}-\x{309f}\x{4e00}-\x{9fff}\x{30a0}-\x{30ff}]+') AS r FROM documents)),
shares AS (SELECT doc_id, text, """ + ", ".join(
    f"coalesce(100.0 * len(x.{n}) / nullif(total, 0), 0) AS {n}_percent, coalesce(length(array_to_string(x.{n}, '')) / nullif(len(x.{n}), 0), 0) AS {n}_mean" for n in text.CLASSES
) + " FROM runs)"


@query("b08_char_runs", _RUNS + " SELECT doc_id, " + ", ".join(f"round({n}_{m}, 6) AS {n}_{m}" for n in text.CLASSES for m in ("percent", "mean")) + " FROM shares")
def char_runs(spark, sf):
    return V.read(spark, sf, "documents").select("doc_id", *[F.round(c, 6).alias(n) for n, c in text.char_runs(F.col("text")).items()])


@query("b15_highlight_spans", """
SELECT sentence_id, substr(text, 1, 2) || '<span class="key 2">' || substr(text, 3, 4) || '</span>' || substr(text, 7) AS t0,
  '<span class="key 1">' || substr(text, 1, 1) || '</span>' || substr(text, 2, 1) || '<span class="key 2">' || substr(text, 3, 4) || '</span>' || substr(text, 7) AS t FROM sentences WHERE length(text) > 8""")
def highlight_spans(spark, sf):
    s = V.sentences(spark, sf).where("length > 8")
    one, two = (F.lit(0), F.lit(1), "key 1"), (F.lit(2), F.lit(6), "key 2")
    return s.select("sentence_id", text.highlight_spans(F.col("text"), [two]).alias("t0"), text.highlight_spans(F.col("text"), [one, two]).alias("t"))


KWIC_QUERY = r"\bth\w+"


@query("b16_split_regex_kwic", r"""
SELECT sentence_id, CAST(i - 1 AS BIGINT) AS match, array_to_string(list_transform(range(1, i), lambda j: p[j] || k[j]), '') || p[i] AS before, k[i] AS key,
       substr(text, length(array_to_string(list_transform(range(1, i), lambda j: p[j] || k[j]), '') || p[i] || k[i]) + 1) AS after
FROM (SELECT sentence_id, text, regexp_split_to_array(text, '\bth\w+') AS p, regexp_extract_all(text, '\bth\w+') AS k FROM sentences WHERE regexp_matches(text, '\bth\w+')), unnest(range(1, len(k) + 1)) AS u(i)""")
def split_regex_kwic(spark, sf):
    s = V.sentences(spark, sf).where(F.col("text").rlike(KWIC_QUERY))
    return s.select("sentence_id", F.posexplode(text.kwic(F.col("text"), KWIC_QUERY)).alias("match", "m")).select("sentence_id", F.col("match").cast("long").alias("match"), "m.before", "m.key", "m.after")


_SEARCH = r"""
, near AS (
  SELECT s.*, title, author, year, genre_path, lag(text) OVER w AS bt, lead(text) OVER w AS aft FROM sentences s JOIN sources USING (source_id) WHERE {genre}
  WINDOW w AS (PARTITION BY source_id, paragraph_order_id ORDER BY sentence_order_id)),
hits AS (
  SELECT *, regexp_split_to_array(text, '{q}') AS p, regexp_extract_all(text, '{q}') AS k FROM near WHERE regexp_matches(text, '{q}') AND NOT list_has_any(tags, {tags})),
found AS (
  SELECT sentence_id, source_id, title, author, year, genre_path, CAST(i - 1 AS BIGINT) AS match,
    coalesce(bt, '') || array_to_string(list_transform(range(1, i), lambda j: p[j] || k[j]), '') || p[i] AS before, k[i] AS key,
    substr(text, length(array_to_string(list_transform(range(1, i), lambda j: p[j] || k[j]), '') || p[i] || k[i]) + 1) || coalesce(aft, '') AS after
  FROM hits, unnest(range(1, len(k) + 1)) AS u(i))
"""


def _search_sql(q: str, genre: str = "true", tags: str = "CAST([] AS VARCHAR[])") -> str:
    return _SEARCH.replace("{q}", q).replace("{genre}", genre).replace("{tags}", tags)


def _found(spark, sf, q="thha[a-z]+", **k):
    f = search.fulltext_search(V.sentences(spark, sf), V.sources(spark, sf), q, **k)
    return f.withColumn("match", F.col("match").cast("long"))


_ENGLISH_SEARCH = _search_sql("thha[a-z]+", "regexp_matches(genre_path || '.', '^(?:(?:en))\\.(?:[^.]+\\.)*$')", "['speech']") + "SELECT * FROM found"


@query("c01_fulltext_search", _ENGLISH_SEARCH)
def fulltext_search(spark, sf):
    return _found(spark, sf, genre="en.*", remove_tags=["speech"], literal="thha")


@query("c02_sentence_context", """SELECT sentence_id, lag(text) OVER w AS before_text, text, lead(text) OVER w AS after_text FROM sentences WINDOW w AS (PARTITION BY source_id, paragraph_order_id ORDER BY sentence_order_id)""")
def sentence_context(spark, sf):
    return search.sentence_context(V.sentences(spark, sf)).select("sentence_id", "before_text", "text", "after_text")


@query("c03_search_boolean_path", _search_sql("thha[a-z]+", "list_contains(s.genre, 'en') AND (list_contains(s.genre, 'src1') OR list_contains(s.genre, 'src2') OR NOT list_contains(s.genre, 'src0') AND list_contains(s.genre, 'src5'))") + "SELECT * FROM found")
def search_boolean_path(spark, sf):
    return _found(spark, sf, words="en & (src1 | src2 | !src0 & src5)", literal="thha")


@query("c04_pattern_frequencies", _search_sql("thha[a-z]+") + "SELECT key, count(*) AS count FROM found GROUP BY key")
def pattern_frequencies(spark, sf):
    return search.pattern_frequencies(_found(spark, sf, literal="thha"))


@query("c05_filter_tags", "SELECT sentence_id, text FROM sentences WHERE NOT list_has_any(tags, ['speech', 'quotation'])")
def filter_tags(spark, sf):
    return search.filter_tags(V.sentences(spark, sf), ["speech", "quotation"]).select("sentence_id", "text")


@query("c06_paginate", _search_sql("thha[a-z]+") + "SELECT sentence_id, match, key FROM found ORDER BY sentence_id, match LIMIT 50 OFFSET 100")
def paginate(spark, sf):
    return search.paginate(_found(spark, sf, literal="thha").select("sentence_id", "match", "key"), ["sentence_id", "match"], 50, 100)


@query("c07_expand_document", f"""
SELECT source_id, string_agg(t, {NL} ORDER BY paragraph_order_id) AS text FROM (
  SELECT source_id, paragraph_order_id, string_agg(text, '' ORDER BY sentence_order_id) AS t FROM sentences GROUP BY ALL)
WHERE source_id IN (SELECT source_id FROM sentences WHERE contains(text, 'thha')) GROUP BY source_id""")
def expand_document(spark, sf):
    s = V.sentences(spark, sf)
    return search.expand_documents(s, s.where(F.contains("text", F.lit("thha"))).select("sentence_id"))


_SAMPLE = """
, hit AS ({hit}), ranked AS (SELECT *, row_number() OVER (PARTITION BY genre[1] ORDER BY {sort} md5('0' || sentence_id), sentence_id) AS r FROM hit)
SELECT sentence_id, source_id, array_to_string(genre, '.') AS genre FROM ranked WHERE r <= 6"""


def _sampled(df, **k):
    return search.sample_per_group(df, F.get("genre", F.lit(0)), **k).select("sentence_id", "source_id", F.array_join("genre", ".").alias("genre"))


@query("c08_sample_sentences", _SAMPLE.replace("{hit}", "SELECT DISTINCT sentence_id, source_id, genre FROM grams WHERE n = 2 AND type = 'noun_particle' AND parts[2].string = 'the'").replace("{sort}", ""))
def sample_sentences(spark, sf):
    g = cutting.grams(V.read(spark, sf, "documents"), 2, min_n=2)
    return _sampled(search.gram_hits(g, "noun_particle", {2: "the"}))


@query("c08_sample_sentences_sorted", _SAMPLE.replace("{hit}", "SELECT sentence_id, source_id, genre, any_value(c) AS c FROM grams JOIN (SELECT sentence_id, count(*) AS c FROM chunks GROUP BY 1) USING (sentence_id) WHERE n = 2 AND type = 'noun_particle' AND parts[2].string = 'the' GROUP BY ALL").replace("{sort}", "abs(4 - c),"))
def sample_sentences_sorted(spark, sf):
    g = cutting.grams(V.read(spark, sf, "documents"), 2, min_n=2, more=["chunks"])
    return _sampled(search.gram_hits(g, "noun_particle", {2: "the"}, "chunks"), sort=F.abs(4 - F.col("chunks")), order="sorted")


@query("c09_sample_sentences_by_token", _SAMPLE.replace("{hit}", "SELECT DISTINCT sentence_id, source_id, genre FROM tokens WHERE lemma = 'the' AND pos_1 = 'particle'").replace("{sort}", ""))
def sample_sentences_by_token(spark, sf):
    t = search.equality_filter(V.tokens(spark, sf), {"lemma": "the", "pos_1": "particle"})
    return _sampled(t.select("sentence_id", "source_id", "genre").distinct())


@query("c10_path_match", r"""
SELECT source_id, regexp_matches(genre_path || '.', '^(?:(?:en|de))\.(?:[^.]+\.)*$') AS a, regexp_matches(genre_path || '.', '^(?:[^.]+\.)*(?:(?:src1)[^.]*)\.$') AS b, regexp_matches(genre_path || '.', '^(?i:(?:EN))\.(?:[^.]+\.){1,1}$') AS c FROM sources""")
def path_match(spark, sf):
    p = F.col("genre_path")
    return V.sources(spark, sf).select("source_id", paths.path_match(p, "en|de.*").alias("a"), paths.path_match(p, "*.src1*").alias("b"), paths.path_match(p, "EN@.*{1,1}").alias("c"))


@query("c11_genres", "SELECT DISTINCT genre_path FROM sources")
def listing_genres(spark, sf):
    return search.genres(V.sources(spark, sf))


@query("c11_genre_counts", "SELECT genre_path, count(*) AS count FROM sources GROUP BY 1")
def listing_genre_counts(spark, sf):
    return search.genre_counts(V.sources(spark, sf))


@query("c11_sentences_by_genre", "SELECT sentence_id, genre_path, text FROM sentences JOIN sources USING (source_id) WHERE starts_with(genre_path || '.', 'de.')")
def listing_sentences_by_genre(spark, sf):
    return search.sentences_by_genre(V.sentences(spark, sf), V.sources(spark, sf), paths.widen("de")).select("sentence_id", "genre_path", "text")


@query("c11_source_genres", "SELECT DISTINCT source_id, genre_path FROM sources")
def listing_source_genres(spark, sf):
    return search.source_genres(V.sources(spark, sf))


@query("c11_sentences_with_genre", "SELECT sentence_id, text, genre_path FROM sentences JOIN sources USING (source_id)")
def listing_sentences_with_genre(spark, sf):
    return search.sentences_with_genre(V.sentences(spark, sf), V.sources(spark, sf))


@query("c11_source_ids_by_genre", "SELECT source_id FROM sources WHERE starts_with(genre_path || '.', 'fr.')")
def listing_source_ids(spark, sf):
    return search.source_ids_by_genre(V.sources(spark, sf), paths.widen("fr"))


@query("c11_source_text", "SELECT source_id, sentence_id, text FROM sentences WHERE source_id IN (SELECT source_id FROM sources WHERE starts_with(genre_path || '.', 'fr.'))")
def listing_source_text(spark, sf):
    """The texts of all sources of a genre."""
    return search.source_text(V.sentences(spark, sf), search.source_ids_by_genre(V.sources(spark, sf), paths.widen("fr")))


@query("c11_basename_ids", "SELECT basename, source_id FROM sources")
def listing_basenames(spark, sf):
    return search.basename_ids(V.sources(spark, sf))


@query("c12_document_tokens", "SELECT source_id, string_agg(lemma, ' ' ORDER BY sentence_id, position) AS text FROM tokens WHERE regexp_matches(pos_1, 'noun|verb') AND NOT regexp_matches(pos_2, 'odd') GROUP BY 1")
def document_tokens(spark, sf):
    return search.document_tokens(V.tokens(spark, sf), "lemma", ["noun", "verb"], ["odd"])


@query("c12_sentence_tokens", "SELECT sentence_id, string_agg(orth, ' ' ORDER BY position) AS text FROM tokens GROUP BY 1")
def sentence_tokens(spark, sf):
    return search.document_tokens(V.tokens(spark, sf), unit="sentence_id")


@query("c13_simple_context_search", "SELECT sentence_id, source_id, text, title, author, year, genre_path FROM sentences JOIN sources USING (source_id) WHERE regexp_matches(text, 'thha.*tion')")
def simple_context_search(spark, sf):
    return search.simple_context_search(V.sentences(spark, sf), V.sources(spark, sf), "thha.*tion").select("sentence_id", "source_id", "text", "title", "author", "year", "genre_path")


_COUNTED = """count(*) AS count, count(DISTINCT sentence_id) AS sentences_count, count(DISTINCT source_id) AS sources_count"""
_G = "array_to_string(genre, '.') AS genre"
_ST = f", st AS (SELECT pos_1, pos_2, c_form, orth_base, lemma, genre, {_COUNTED} FROM tokens GROUP BY ALL)"


def genre_text(df):
    return df.withColumn("genre", F.array_join("genre", "."))


@query("c14_equality_filter", "SELECT sentence_id, orth FROM tokens WHERE pos_1 = 'verb' AND c_form = 'final'")
def equality_filter(spark, sf):
    return search.equality_filter(V.tokens(spark, sf), {"pos_1": "verb", "c_form": "final"}).select("sentence_id", "orth")


@query("c15_token_listing", _ST + " SELECT orth_base, count, sentences_count, sources_count FROM st WHERE lemma = 'the' AND pos_1 = 'particle'")
def token_listing(spark, sf):
    return search.token_listing(aggregates.search_tokens(V.tokens(spark, sf)), {"lemma": "the", "pos_1": "particle"}, ["lemma", "orth_base"])


@query("d01_follow_links", """, at1 AS MATERIALIZED (SELECT sentence_id, chunk_id, 1 AS steps, chunk_id AS last, link FROM chunks),
at2 AS MATERIALIZED (SELECT a.sentence_id, a.chunk_id, steps + (b.chunk_id IS NOT NULL)::INT AS steps, coalesce(b.chunk_id, last) AS last, b.link FROM at1 a LEFT JOIN chunks b ON b.sentence_id = a.sentence_id AND b.chunk_id = a.link),
at3 AS MATERIALIZED (SELECT a.sentence_id, a.chunk_id, steps + (b.chunk_id IS NOT NULL)::INT AS steps, coalesce(b.chunk_id, last) AS last, b.link FROM at2 a LEFT JOIN chunks b ON b.sentence_id = a.sentence_id AND b.chunk_id = a.link),
at4 AS MATERIALIZED (SELECT a.sentence_id, a.chunk_id, steps + (b.chunk_id IS NOT NULL)::INT AS steps, coalesce(b.chunk_id, last) AS last, b.link FROM at3 a LEFT JOIN chunks b ON b.sentence_id = a.sentence_id AND b.chunk_id = a.link),
at5 AS MATERIALIZED (SELECT a.sentence_id, a.chunk_id, steps + (b.chunk_id IS NOT NULL)::INT AS steps, coalesce(b.chunk_id, last) AS last, b.link FROM at4 a LEFT JOIN chunks b ON b.sentence_id = a.sentence_id AND b.chunk_id = a.link)
SELECT sentence_id, chunk_id, CAST(steps AS BIGINT) AS steps, last FROM at5""")
def follow_links(spark, sf):
    p = grams.follow_links(V.chunk_rows(spark, sf))
    return p.select("sentence_id", "chunk_id", F.size("path").cast("long").alias("steps"), F.element_at("path", -1)["chunk_id"].alias("last"))


_SHOWN_GRAMS = "SELECT sentence_id, chunk_id, n, type, array_to_string(list_transform(parts, lambda x: x.string || ':' || x.begin || ':' || x.\"end\"), ' ') AS parts FROM grams"


@query("d02_extract_collocations", _SHOWN_GRAMS)
def extract_collocations(spark, sf):
    return _shown_grams(grams.extract_collocations(V.chunk_rows(spark, sf)))


def _shown_grams(g):
    shown = F.array_join(F.transform("parts", lambda x: F.concat_ws(":", x["string"], x["begin"], x["end"])), " ")
    return g.select("sentence_id", "chunk_id", "n", "type", shown.alias("parts"))


_UNI = """, uni AS (SELECT sentence_id, source_id, genre, row_number() OVER (PARTITION BY sentence_id ORDER BY chunk_id, k) AS position, p.string AS string, p.pos AS pos
  FROM (SELECT *, unnest(parts) AS p, generate_subscripts(parts, 1) AS k FROM cparts))"""


@query("d03_extract_unigrams", _UNI + " SELECT sentence_id, position, string, pos FROM uni")
def extract_unigrams(spark, sf):
    return grams.extract_unigrams(V.chunk_rows(spark, sf)).select("sentence_id", F.col("position").cast("long").alias("position"), "string", "pos")


@query("d04_gram_view_2", "SELECT sentence_id, parts[1].string AS string_1, parts[1].pos AS pos_1, parts[1].begin AS begin_1, parts[1].\"end\" AS end_1, parts[2].string AS string_2, parts[2].pos AS pos_2, parts[2].begin AS begin_2, parts[2].\"end\" AS end_2 FROM grams WHERE n = 2")
def gram_view_2(spark, sf):
    return grams.gram_view(grams.extract_collocations(V.chunk_rows(spark, sf), 2, min_n=2), 2).drop("source_id", "genre")


@query("d05_complete_trigrams", "SELECT sentence_id, parts[1].string AS string_1, parts[2].string AS string_2, parts[3].string AS string_3 FROM grams WHERE n = 3 UNION SELECT sentence_id, parts[1].string, parts[2].string, parts[3].string FROM grams WHERE n = 4")
def complete_trigrams(spark, sf):
    g = cutting.grams(V.read(spark, sf, "documents"), 4, min_n=3)  # both tables at once, so that texts are cut once
    return g.select("sentence_id", *[F.get("parts", F.lit(i))["string"].alias(f"string_{i + 1}") for i in range(3)]).distinct()


@query("d06_sort_cluster_grams", _SHOWN_GRAMS)
def sort_cluster_grams(spark, sf):
    return _shown_grams(grams.sort_cluster(cutting.grams(V.read(spark, sf, "documents")), 8))


@query("d07_token_table", "SELECT sentence_id, position, orth, lemma FROM tokens")
def token_table(spark, sf):
    t = V.tokens(spark, sf).groupBy("sentence_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "orth", "lemma"))), lambda x: F.struct(x["orth"].alias("orth"), x["lemma"].alias("lemma"))).alias("tokens"))
    return grams.token_table(t)


def sentence_sizes(spark, sf):
    """length, tokens and chunks of each sentence."""
    c = V.chunks(spark, sf).groupBy("sentence_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("chunks"))
    return V.sentences(spark, sf).join(c, "sentence_id")


_NORM = """, norm AS (SELECT genre, CAST(sum(length) AS BIGINT) AS character_count, CAST(sum(t) AS BIGINT) AS token_count, CAST(sum(c) AS BIGINT) AS chunk_count, count(*) AS sentences_count, count(DISTINCT source_id) AS sources_count
  FROM sentences JOIN (SELECT sentence_id, sum(n_tokens) AS t, count(*) AS c FROM chunks GROUP BY 1) USING (sentence_id) GROUP BY 1)"""


def genre_norm_table(spark, sf):
    return aggregates.genre_norm(sentence_sizes(spark, sf))


@query("e01_genre_norm", _NORM + f" SELECT * REPLACE ({_G.removesuffix(' AS genre')} AS genre) FROM norm")
def genre_norm(spark, sf):
    return genre_text(genre_norm_table(spark, sf))


_GN = f", gn AS (SELECT type, genre, {_COUNTED} FROM grams GROUP BY ALL)"


def gram_norm_table(spark, sf):
    return cutting.counted_types(V.read(spark, sf, "documents")).drop("n")


@query("e02_gram_norm", _GN + f" SELECT * REPLACE ({_G.removesuffix(' AS genre')} AS genre) FROM gn")
def gram_norm(spark, sf):
    return genre_text(gram_norm_table(spark, sf))


@query("e03_search_tokens", _ST + f" SELECT * REPLACE ({_G.removesuffix(' AS genre')} AS genre) FROM st")
def search_tokens(spark, sf):
    return genre_text(aggregates.search_tokens(V.tokens(spark, sf)))


def gram_table(spark, sf, n, right_part=None, type_=None):
    """``type_``: the rows of this type; marginals stand on rows of one type, so they are the same."""
    return aggregates.with_marginals(cutting.counted_grams(V.read(spark, sf, "documents"), n, n, type_=type_).drop("n"), n, right_part)


def gram_sql(n: int) -> str:
    cols = ", ".join(f"parts[{i + 1}].string AS string_{i + 1}" for i in range(n))
    names = ", ".join(f"string_{i + 1}" for i in range(n))
    marginals = "" if n == 1 else f", CAST(sum(count) OVER (PARTITION BY type, string_1, genre) AS BIGINT) AS f_ix, CAST(sum(count) OVER (PARTITION BY type, string_{2 if n == 2 else 3}, genre) AS BIGINT) AS f_xi"
    return f""", sg{n} AS (SELECT *{marginals} FROM (SELECT type, {names}, genre, {_COUNTED} FROM (SELECT *, {cols} FROM grams WHERE n = {n}) GROUP BY ALL))"""


for _n in (1, 2, 3, 4):
    query(f"e0{4 if _n == 1 else 7}_search_gram_{_n}", gram_sql(_n) + f" SELECT * REPLACE (array_to_string(genre, '.') AS genre) FROM sg{_n}")(lambda spark, sf, n=_n: genre_text(gram_table(spark, sf, n)))


@query("e05_marginal_f_ix", "SELECT type, parts[1].string AS string_1, array_to_string(genre, '.') AS genre, count(*) AS f_ix FROM grams WHERE n = 2 GROUP BY ALL")
def marginal_f_ix(spark, sf):
    g = grams.extract_collocations(V.chunk_rows(spark, sf), 2, min_n=2).withColumn("string_1", F.get("parts", F.lit(0))["string"])
    return genre_text(aggregates.marginal(g, "string_1", "f_ix"))


@query("e06_marginal_f_xi", "SELECT type, parts[3].string AS string_3, array_to_string(genre, '.') AS genre, count(*) AS f_xi FROM grams WHERE n = 4 GROUP BY ALL")
def marginal_f_xi(spark, sf):
    g = grams.extract_collocations(V.chunk_rows(spark, sf), 4, min_n=4).withColumn("string_3", F.get("parts", F.lit(2))["string"])
    return genre_text(aggregates.marginal(g, "string_3", "f_xi"))


@query("e08_pos_summary", _UNI + f" SELECT pos, {_G}, count(*) AS count FROM uni GROUP BY ALL")
def pos_summary(spark, sf):
    return genre_text(aggregates.pos_summary(grams.extract_unigrams(V.chunk_rows(spark, sf))))


def tree_sql(table: str, values: str, by: str = "") -> str:
    """Sums below each prefix of ``genre``."""
    sums = ", ".join(f"CAST(sum({v}) AS BIGINT) AS {v}" for v in values.split())
    return f"SELECT {by}array_to_string(genre[1:k], '.') AS node, {sums} FROM {table}, unnest(range(0, 3)) AS u(k) GROUP BY ALL"


def node_text(df):
    return df.withColumn("node", F.array_join("node", "."))


@query("e09_path_rollup", _NORM + " " + tree_sql("norm", "character_count token_count sentences_count"))
def path_rollup(spark, sf):
    return node_text(paths.path_rollup(genre_norm_table(spark, sf), "genre", ["character_count", "token_count", "sentences_count"]))


@query("e10_normalize_by_path", _NORM + ", hits AS (SELECT genre, count(*) AS n FROM tokens WHERE lemma = 'the' GROUP BY 1), a AS (" + tree_sql("hits", "n") + "), b AS (" + tree_sql("norm", "token_count") + ") SELECT node, n, round(n * 1e6 / token_count, 6) AS normalized FROM a JOIN b USING (node)")
def normalize_by_path(spark, sf):
    hits = V.tokens(spark, sf).where("lemma = 'the'").groupBy("genre").agg(F.count("*").alias("n"))
    norm = paths.path_rollup(genre_norm_table(spark, sf), "genre", ["token_count"])
    out = paths.normalize_by_path(paths.path_rollup(hits, "genre", ["n"]), norm, "n", "token_count")
    return node_text(out).withColumn("normalized", F.round("normalized", 6))


@query("e11_top_level_totals", "SELECT genre[1] AS name, count(*) AS tokens FROM tokens GROUP BY 1")
def top_level_totals(spark, sf):
    t = paths.path_rollup(genre_norm_table(spark, sf), "genre", ["token_count"]).where(F.size("node") == 1)
    return t.select(F.get("node", F.lit(0)).alias("name"), F.col("token_count").alias("tokens"))


@query("e12_gram_totals", _GN + " " + tree_sql("gn", "count sentences_count", "type, "))
def gram_totals(spark, sf):
    return node_text(paths.path_rollup(gram_norm_table(spark, sf), "genre", ["count", "sentences_count"], "type"))


@query("e12_gram_types", "SELECT DISTINCT type FROM grams")
def gram_types(spark, sf):
    return grams.extract_collocations(V.chunk_rows(spark, sf)).select("type").distinct()


@query("e13_totals_by_order", _GN + " SELECT CAST(len(string_split(type, '_')) AS INTEGER) AS n, CAST(sum(count) AS BIGINT) AS count FROM gn GROUP BY 1")
def totals_by_order(spark, sf):
    return aggregates.totals_by_order(gram_norm_table(spark, sf))


_GOSHU = ", ".join(f"count(*) FILTER (goshu = '{k}') AS {v}" for k, v in aggregates.GOSHU.items())


@query("e14_goshu_counts", f"SELECT sentence_id, {_GOSHU} FROM tokens GROUP BY 1")
def goshu_counts(spark, sf):
    return aggregates.goshu_counts(V.tokens(spark, sf), "sentence_id")


@query("a06_scan_parquet", "SELECT doc_id, lang, source, n_chars FROM documents", with_views=False)
def scan_parquet(spark, sf):
    return V.read(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")


@query("a07_export_corpus_lines", "SELECT source_id, string_agg(orth, ' ' ORDER BY sentence_id, position) AS text FROM tokens GROUP BY 1")
def export_corpus_lines(spark, sf):
    return search.document_tokens(V.tokens(spark, sf))


@query("a08_export_labeled_lines", "SELECT '__label__' || genre_path || ' ' || t AS line FROM sources JOIN (SELECT source_id, string_agg(orth, ' ' ORDER BY sentence_id, position) AS t FROM tokens GROUP BY 1) USING (source_id)")
def export_labeled_lines(spark, sf):
    t = search.document_tokens(V.tokens(spark, sf)).join(V.sources(spark, sf).select("source_id", "genre_path"), "source_id")
    return writers.labeled_lines(t)


@query("a09_extract_units", "SELECT sentence_id, s.genre[1] AS corpus, basename, array_to_string(list_sort(tags), ',') AS tags, t AS text FROM sentences s JOIN sources USING (source_id) JOIN (SELECT sentence_id, string_agg(orth, ' ' ORDER BY position) AS t FROM tokens GROUP BY 1) USING (sentence_id)")
def extract_units(spark, sf):
    return writers.extracted_units(V.tokens(spark, sf), V.sentences(spark, sf), V.sources(spark, sf))
