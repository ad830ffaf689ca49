"""Search tables: counts with distinct sentences and sources, marginals, totals.

Distinct counts go through one group for each sentence, then each source, so no row is multiplied for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counted(df: DataFrame, *keys: str) -> DataFrame:
    """keys, count, sentences_count, sources_count."""
    by_sentence = df.groupBy(*keys, "source_id", "sentence_id").agg(F.count("*").alias("count"))
    by_source = by_sentence.groupBy(*keys, "source_id").agg(F.sum("count").alias("count"), F.count("*").alias("sentences_count"))
    return by_source.groupBy(*keys).agg(F.sum("count").alias("count"), F.sum("sentences_count").alias("sentences_count"), F.count("*").alias("sources_count"))


def genre_norm(sentences: DataFrame) -> DataFrame:
    """Per genre: characters, tokens, chunks, sentences, sources. ``sentences`` has length, tokens and chunks, a row for each sentence."""
    by_source = sentences.groupBy("genre", "source_id").agg(*[F.sum(c).alias(c) for c in ("length", "tokens", "chunks")], F.count("*").alias("n"))
    return by_source.groupBy("genre").agg(
        F.sum("length").alias("character_count"), F.sum("tokens").alias("token_count"), F.sum("chunks").alias("chunk_count"), F.sum("n").alias("sentences_count"), F.count("*").alias("sources_count")
    )


def gram_norm(grams: DataFrame) -> DataFrame:
    return counted(grams, "type", "genre")


def search_tokens(tokens: DataFrame) -> DataFrame:
    return counted(tokens, "pos_1", "pos_2", "c_form", "orth_base", "lemma", "genre")


def search_gram(grams: DataFrame, n: int, right_part: int | None = None) -> DataFrame:
    """Per (type, strings, genre): f_ix, f_xi (n > 1), count, sentences_count, sources_count. The marginals are sums over the already
    counted rows: f_ix by the first string, f_xi by string ``right_part`` (2 for n = 2, else 3). ``grams`` is wide, string_1 to string_n."""
    strings = [f"string_{i + 1}" for i in range(n)]
    return with_marginals(counted(grams, "type", *strings, "genre"), n, right_part)


def with_marginals(c: DataFrame, n: int, right_part: int | None = None) -> DataFrame:
    """Counted n-grams with f_ix and f_xi."""
    if n == 1:
        return c
    right = f"string_{right_part or (2 if n == 2 else 3)}"
    return c.withColumns({
        "f_ix": F.sum("count").over(Window.partitionBy("type", "string_1", "genre")),
        "f_xi": F.sum("count").over(Window.partitionBy("type", right, "genre")),
    })


def marginal(grams: DataFrame, string: str, name: str) -> DataFrame:
    """Per (type, string, genre): the count, as ``name``."""
    return grams.groupBy("type", string, "genre").agg(F.count("*").alias(name))


def pos_summary(unigrams: DataFrame) -> DataFrame:
    return unigrams.groupBy("pos", "genre").agg(F.count("*").alias("count"))


def totals_by_order(norm: DataFrame) -> DataFrame:
    """Grams for each number of parts; "auxiliary-verb" is one part."""
    order = F.size(F.split("type", "_")).cast("int")
    return norm.groupBy(order.alias("n")).agg(F.sum("count").alias("count"))


# Word origins and their names.
GOSHU = {"和": "japanese", "漢": "chinese", "外": "gairai", "記号": "symbolic", "混": "mixed", "不明": "unk", "固": "pn"}


def goshu_counts(tokens: DataFrame, *by: str) -> DataFrame:
    """Tokens of each word origin, zero where there is none."""
    return tokens.groupBy(*by).agg(*[F.count_if(F.col("goshu") == k).alias(v) for k, v in GOSHU.items()])
