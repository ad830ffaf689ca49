"""Corpus views over the driver tables: sources, sentences, tokens, chunks, grams, and product pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import bound, running

SENTENCE = r"[^.!?]+[.!?]*"
TOKEN = r"\p{L}+|[0-9]+|[^\p{L}0-9\s]"
CONTENT, FUNCTIONAL = ("noun", "verb", "adjective"), ("particle",)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("source_id"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("title"),
        F.col("source").alias("author"),
        (F.lit(2000) + F.col("doc_id") % 20).cast("int").alias("year"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("basename"),
        F.array("lang", "source").alias("genre"),
        F.concat_ws(".", "lang", "source").alias("genre_path"),
        (F.col("doc_id") % 2 == 0).alias("permission"),
    )


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences_of(read(spark, sf_dir, "documents")).drop("offset")


def sentences_of(d: DataFrame) -> DataFrame:
    """Cut inside the rows, so no shuffle is needed to number paragraphs and sentences. offset: characters before a sentence in the text that the
    sentences make, with a line end between paragraphs."""

    def cut(line: Column) -> Column:
        return F.filter(F.transform(F.regexp_extract_all(line, F.lit(SENTENCE), F.lit(0)), lambda x: F.trim(x)), lambda x: x != "")

    pars = F.filter(F.transform(F.split("text", "\n"), cut), lambda x: F.size(x) > 0)
    flat = F.flatten(F.transform(pars, lambda ss, i: F.transform(ss, lambda s, j: F.struct((i + 1).alias("par"), s.alias("text"), F.when((i > 0) & (j == 0), 1).otherwise(0).alias("step")))))

    def placed(x: Column) -> Column:
        ends = running(F.transform(x, lambda s: F.length(s["text"]) + s["step"]))
        return bound(ends, lambda e: F.transform(x, lambda s, i: F.struct(s["par"].alias("par"), s["text"].alias("text"), (F.get(e, i) - F.length(s["text"])).alias("offset"))))

    e = d.select("doc_id", "lang", "source", F.posexplode(bound(flat, placed)).alias("pos", "s"))
    order = F.col("pos") + 1
    length = F.length("s.text")
    return e.select(
        (F.col("doc_id") * 1_000_000 + order).alias("sentence_id"),
        F.col("doc_id").alias("source_id"),
        F.col("s.par").alias("paragraph_order_id"),
        order.alias("sentence_order_id"),
        F.col("s.text").alias("text"),
        F.when(length % 7 == 0, F.array(F.lit("speech"))).when(length % 5 == 0, F.array(F.lit("quotation"))).otherwise(F.array().cast("array<string>")).alias("tags"),
        length.alias("length"),
        F.array("lang", "source").alias("genre"),
        F.col("s.offset").alias("offset"),
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_of(sentences(spark, sf_dir))


def tokens_of(s: DataFrame) -> DataFrame:
    t = s.select("sentence_id", "source_id", "genre", F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("position", "orth"))
    n = F.length("orth")
    number, word = F.col("orth").rlike("^[0-9]"), F.col("orth").rlike(r"^\p{L}")
    pos = F.when(~number & ~word, "symbol").when(number, "noun").when(n <= 3, "particle").when(n % 3 == 0, "verb").when(n % 3 == 1, "noun").otherwise("adjective")
    return t.select(
        "sentence_id", "source_id", "genre", "position", "orth",
        F.lower("orth").alias("lemma"), F.lower("orth").alias("orth_base"),
        pos.alias("pos_1"), F.when(n % 2 == 0, "even").otherwise("odd").alias("pos_2"),
        F.when(F.col("orth").endswith("e"), "final").otherwise("other").alias("c_form"),
        F.element_at(F.array(*map(F.lit, ("和", "漢", "外", "記号", "混", "不明", "固"))), (n % 7 + 1).cast("int")).alias("goshu"),
    )


def token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sentence_id, position, begin, end): where each token stands in its sentence, in characters."""
    spaced = F.posexplode(F.regexp_extract_all("text", F.lit(rf"\s*(?:{TOKEN})"), F.lit(0))).alias("position", "m")
    t = sentences(spark, sf_dir).select("sentence_id", spaced)
    end = F.sum(F.length("m")).over(Window.partitionBy("sentence_id").orderBy("position")).cast("int")
    return t.select("sentence_id", "position", (end - F.length(F.regexp_replace("m", r"^\s+", ""))).alias("begin"), end.alias("end"))


def _tokens_of(text: Column) -> Column:
    """The tokens of a sentence: lower-cased form, class, characters, and the characters that it and the space before it take."""

    def token(m: Column) -> Column:
        orth = F.regexp_replace(m, r"^\s+", "")
        return bound(orth, lambda x: F.struct(F.lower(x).alias("base"), word_class(x).alias("pos"), F.length(x).alias("size"), F.length(m).alias("room")))

    return F.transform(F.regexp_extract_all(text, F.lit(rf"\s*(?:{TOKEN})"), F.lit(0)), token)


def word_class(orth: Column) -> Column:
    n = F.length(orth)
    word = F.when(n <= 3, "particle").when(n % 3 == 0, "verb").when(n % 3 == 1, "noun").otherwise("adjective")
    return F.when(orth.rlike(r"^\p{L}"), word).when(orth.rlike("^[0-9]"), "noun").otherwise("symbol")


def chunk_array(text: Column) -> Column:
    """The chunks of a sentence in order. A chunk ends at a particle or symbol, or with the sentence. begin and end count the characters of tokens alone, from and to
    those of the sentence's text. Nothing leaves the row: ends are found by position, and chunks are slices between them."""

    def made(t: Column, upto: Column, reach: Column) -> Column:
        last = F.size(t) - 1
        ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | F.get(t, i)["pos"].isin("particle", "symbol"))

        def chunk(stops: Column, b: Column, k: Column) -> Column:
            a = F.when(k == 0, F.lit(0)).otherwise(F.get(stops, k - 1) + 1)
            closing = F.get(t, b)["pos"].isin("particle", "symbol")
            head = F.when(closing, b - 1).otherwise(b)  # the last content token
            some, tail = head >= a, F.get(t, b)["pos"] == "particle"
            n = F.size(stops)
            link = F.when(k == n - 1, -1).when((k % 3 == 0) & (k + 2 < n), k + 2).otherwise(k + 1)

            def first(ends_: Column, size: str, i: Column) -> Column:
                return F.get(ends_, i) - F.get(t, i)[size]

            fields = {
                "chunk_id": k, "link": link,
                "head_string": F.when(some, F.array_join(F.transform(F.slice(t, a + 1, head - a + 1), lambda x: x["base"]), "")),
                "head_pos": F.when(some, F.get(t, head)["pos"]),
                "head_begin": F.when(some, first(upto, "size", a)), "head_end": F.when(some, F.get(upto, head)),
                "head_from": F.when(some, first(reach, "size", a)), "head_to": F.when(some, F.get(reach, head)),
                "tail_string": F.when(tail, F.get(t, b)["base"]), "tail_pos": F.when(tail, F.get(t, b)["pos"]),
                "tail_begin": F.when(tail, first(upto, "size", b)), "tail_end": F.when(tail, F.get(upto, b)),
                "tail_from": F.when(tail, first(reach, "size", b)), "tail_to": F.when(tail, F.get(reach, b)),
                "n_tokens": (b - a + 1).cast("long"),
            }
            return F.struct(*[v.alias(name) for name, v in fields.items()])

        return bound(ends, lambda stops: F.transform(stops, lambda b, k: chunk(stops, b, k)))

    def placed(t: Column) -> Column:
        sums = lambda f: running(F.transform(t, lambda x: x[f]))
        return bound(sums("size"), lambda upto: bound(sums("room"), lambda reach: made(t, upto, reach)))

    return bound(_tokens_of(text), lambda t: F.when(F.size(t) > 0, placed(t)))


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sentence_id, source_id, genre, cs): a row for each sentence with its chunks, without a shuffle."""
    return chunk_rows_of(sentences(spark, sf_dir))


def chunk_rows_of(s: DataFrame, *more: str) -> DataFrame:
    return s.select("sentence_id", "source_id", "genre", chunk_array(F.col("text")).alias("cs"), *more).where("cs IS NOT NULL")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each chunk."""
    return chunk_rows(spark, sf_dir).select("sentence_id", "source_id", "genre", F.explode("cs").alias("c")).select("sentence_id", "source_id", "genre", "c.*").drop("head_from", "head_to", "tail_from", "tail_to")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The larger corpus: brand and type of each order line, in the order as source, by region and nation."""
    line, part, orders, customer, nation, region = (read(spark, sf_dir, t) for t in ("lineitem", "part", "orders", "customer", "nation", "region"))
    placed = customer.join(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"))
    bought = orders.join(placed, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "r_name", "n_name")
    return (
        line.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("l_orderkey").alias("source_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sentence_id"),
            F.col("p_brand").alias("string_1"), F.col("p_type").alias("string_2"), F.lit("brand_type").alias("type"), F.array("r_name", "n_name").alias("genre"),
        )
    )


#: The same views as DuckDB common table expressions.
SQL = r"""
sources AS (
  SELECT doc_id AS source_id, 'doc-' || doc_id AS title, source AS author, CAST(2000 + doc_id % 20 AS INTEGER) AS year, 'doc-' || doc_id AS basename,
         [lang, source] AS genre, lang || '.' || source AS genre_path, doc_id % 2 = 0 AS permission FROM documents),
pars0 AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
pars AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS par FROM (
    SELECT *, list_filter(list_transform(regexp_extract_all(line, '[^.!?]+[.!?]*'), lambda x: trim(x, ' ')), lambda x: x <> '') AS ss FROM pars0) WHERE len(ss) > 0),
sents0 AS (SELECT doc_id, lang, source, par, unnest(ss) AS text, generate_subscripts(ss, 1) AS j FROM pars),
sentences AS MATERIALIZED (
  SELECT doc_id * 1000000 + n AS sentence_id, doc_id AS source_id, CAST(par AS INTEGER) AS paragraph_order_id, CAST(n AS INTEGER) AS sentence_order_id, text,
         CASE WHEN length(text) % 7 = 0 THEN ['speech'] WHEN length(text) % 5 = 0 THEN ['quotation'] ELSE CAST([] AS VARCHAR[]) END AS tags,
         CAST(length(text) AS INTEGER) AS length, [lang, source] AS genre
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY par, j) AS n FROM sents0)),
toks0 AS (SELECT sentence_id, source_id, genre, unnest(regexp_extract_all(text, '\p{L}+|[0-9]+|[^\p{L}0-9\s]')) AS orth,
                 generate_subscripts(regexp_extract_all(text, '\p{L}+|[0-9]+|[^\p{L}0-9\s]'), 1) - 1 AS position FROM sentences),
tokens AS MATERIALIZED (
  SELECT sentence_id, source_id, genre, CAST(position AS INTEGER) AS position, orth, lower(orth) AS lemma, lower(orth) AS orth_base,
         CASE WHEN NOT regexp_matches(orth, '^[0-9]') AND NOT regexp_matches(orth, '^\p{L}') THEN 'symbol' WHEN regexp_matches(orth, '^[0-9]') THEN 'noun'
              WHEN length(orth) <= 3 THEN 'particle' WHEN length(orth) % 3 = 0 THEN 'verb' WHEN length(orth) % 3 = 1 THEN 'noun' ELSE 'adjective' END AS pos_1,
         CASE WHEN length(orth) % 2 = 0 THEN 'even' ELSE 'odd' END AS pos_2, CASE WHEN ends_with(orth, 'e') THEN 'final' ELSE 'other' END AS c_form,
         ['和', '漢', '外', '記号', '混', '不明', '固'][length(orth) % 7 + 1] AS goshu
  FROM toks0),
toks1 AS (
  SELECT *, coalesce(sum(CASE WHEN pos_1 IN ('particle', 'symbol') THEN 1 ELSE 0 END) OVER (PARTITION BY sentence_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk_id,
         sum(length(orth)) OVER (PARTITION BY sentence_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM tokens),
chunks0 AS (
  SELECT sentence_id, source_id, genre, chunk_id, string_agg(orth_base, '' ORDER BY position) FILTER (pos_1 IN ('noun', 'verb', 'adjective')) AS head_string,
         arg_max(pos_1, position) FILTER (pos_1 IN ('noun', 'verb', 'adjective')) AS head_pos,
         min(e - length(orth)) FILTER (pos_1 IN ('noun', 'verb', 'adjective')) AS head_begin, max(e) FILTER (pos_1 IN ('noun', 'verb', 'adjective')) AS head_end,
         max(orth_base) FILTER (pos_1 = 'particle') AS tail_string, max(pos_1) FILTER (pos_1 = 'particle') AS tail_pos,
         max(e - length(orth)) FILTER (pos_1 = 'particle') AS tail_begin, max(e) FILTER (pos_1 = 'particle') AS tail_end, count(*) AS n_tokens
  FROM toks1 GROUP BY ALL),
chunks AS MATERIALIZED (
  SELECT sentence_id, source_id, genre, CAST(chunk_id AS INTEGER) AS chunk_id,
         CAST(CASE WHEN chunk_id = n - 1 THEN -1 WHEN chunk_id % 3 = 0 AND chunk_id + 2 < n THEN chunk_id + 2 ELSE chunk_id + 1 END AS INTEGER) AS link,
         head_string, head_pos, CAST(head_begin AS INTEGER) AS head_begin, CAST(head_end AS INTEGER) AS head_end, tail_string, tail_pos,
         CAST(tail_begin AS INTEGER) AS tail_begin, CAST(tail_end AS INTEGER) AS tail_end, n_tokens
  FROM (SELECT *, count(*) OVER (PARTITION BY sentence_id) AS n FROM chunks0)),
cparts AS MATERIALIZED (
  SELECT *, list_filter([{'string': head_string, 'pos': head_pos, 'begin': head_begin, 'end': head_end}, {'string': tail_string, 'pos': tail_pos, 'begin': tail_begin, 'end': tail_end}], lambda x: x.string IS NOT NULL) AS parts FROM chunks),
paths0 AS MATERIALIZED (SELECT sentence_id, source_id, genre, chunk_id, link, parts FROM cparts),
paths1 AS MATERIALIZED (SELECT a.sentence_id, a.source_id, a.genre, a.chunk_id, b.link, list_concat(a.parts, coalesce(b.parts, [])) AS parts FROM paths0 a LEFT JOIN cparts b ON b.sentence_id = a.sentence_id AND b.chunk_id = a.link),
paths2 AS MATERIALIZED (SELECT a.sentence_id, a.source_id, a.genre, a.chunk_id, b.link, list_concat(a.parts, coalesce(b.parts, [])) AS parts FROM paths1 a LEFT JOIN cparts b ON b.sentence_id = a.sentence_id AND b.chunk_id = a.link),
paths3 AS MATERIALIZED (SELECT a.sentence_id, a.source_id, a.genre, a.chunk_id, b.link, list_concat(a.parts, coalesce(b.parts, [])) AS parts FROM paths2 a LEFT JOIN cparts b ON b.sentence_id = a.sentence_id AND b.chunk_id = a.link),
paths AS MATERIALIZED (SELECT a.sentence_id, a.source_id, a.genre, a.chunk_id, b.link, list_concat(a.parts, coalesce(b.parts, [])) AS parts FROM paths3 a LEFT JOIN cparts b ON b.sentence_id = a.sentence_id AND b.chunk_id = a.link),
grams AS MATERIALIZED (
  SELECT sentence_id, source_id, genre, chunk_id, CAST(n AS INTEGER) AS n, parts[1:n] AS parts, array_to_string(list_transform(parts[1:n], lambda x: x.pos), '_') AS type
  FROM paths, unnest(range(1, 5)) AS u(n) WHERE n <= len(parts)),
pairs AS (
  SELECT l_orderkey AS source_id, l_orderkey * 10 + l_linenumber AS sentence_id, p_brand AS string_1, p_type AS string_2, 'brand_type' AS type, [r_name, n_name] AS genre
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""
