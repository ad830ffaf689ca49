"""Readability features of sentences and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import char_class_counts, char_runs, shibasaki_grade, tateishi_score
from .aggregates import GOSHU, goshu_counts

# Classes of content tokens, and forms that mark predicates.
CONTENT = "(名詞|形容詞|動詞|副詞|形状詞|接頭辞|助動詞|接尾辞)"
FINAL_FORM = "終止形-一般"


def chunk_depth(chunks: DataFrame) -> DataFrame:
    """Per sentence, the sum of depths up to the first root (link -1): each chunk's depth is the last plus one if its link is further than the next."""
    order = Window.partitionBy("sentence_id").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, 0)
    roots = F.sum((F.col("link") == -1).cast("int")).over(order)
    depth = F.sum((F.col("link") - F.col("chunk_id") > 1).cast("int")).over(order)
    own = chunks.select("sentence_id", roots.alias("r"), depth.alias("d"))
    return own.groupBy("sentence_id").agg(F.coalesce(F.sum(F.when(F.col("r") == 0, F.col("d"))), F.lit(0)).alias("chunk_depth"))


def link_distance(chunks: DataFrame) -> DataFrame:
    """Per sentence, the sum of link - id over all chunks but the last."""
    last = F.max("chunk_id").over(Window.partitionBy("sentence_id"))
    own = chunks.select("sentence_id", "chunk_id", "link", last.alias("last"))
    return own.groupBy("sentence_id").agg(F.coalesce(F.sum(F.when(F.col("chunk_id") != F.col("last"), F.col("link") - F.col("chunk_id"))), F.lit(0)).alias("link_dist"))


def word_log_freq(tokens: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Per sentence, the sum of log10(freq + 1); frequencies: (pos_1, lemma, freq). The lexicon joins by hash; Spark broadcasts it if it is small."""
    met = tokens.join(frequencies, ["pos_1", "lemma"], "left")
    return met.groupBy("sentence_id").agg(F.sum(F.log10(F.coalesce("freq", F.lit(0)) + 1)).alias("log_freq"))


def word_level(tokens: DataFrame, levels: DataFrame, content: str = CONTENT) -> DataFrame:
    """Per sentence, the mean over content tokens of the higher level of written and base form, over 4; levels: (word, level)."""
    own = tokens.where(F.col("pos_1").rlike(content))
    a = levels.select(F.col("word").alias("orth_base"), F.col("level").alias("_a"))
    b = levels.select(F.col("word").alias("lemma"), F.col("level").alias("_b"))
    met = own.join(a, "orth_base", "left").join(b, "lemma", "left")
    top = F.greatest(F.coalesce("_a", F.lit(0)), F.coalesce("_b", F.lit(0)))
    scored = met.groupBy("sentence_id").agg((F.sum(top) / F.count("*") / 4).alias("word_level"))
    return tokens.select("sentence_id").distinct().join(scored, "sentence_id", "left").select("sentence_id", F.coalesce("word_level", F.lit(0.0)).alias("word_level"))


def predicate_count(tokens: DataFrame, broad: bool = True, is_predicate: Column | None = None) -> DataFrame:
    """Per sentence, the chunks with a predicate token; narrow: only by the final form."""
    narrow = F.coalesce(F.col("c_form") == FINAL_FORM, F.lit(False))
    if is_predicate is None and broad:
        copula = (F.col("pos_1") == "助動詞") & (F.col("orth") != "な") & F.col("lemma").rlike("(だ|です)")
        is_predicate = narrow | F.coalesce((F.col("pos_1") == "動詞") | copula | F.col("pos_2").isin("終助詞", "句点"), F.lit(False))
    flag = narrow if is_predicate is None else is_predicate
    per = tokens.groupBy("sentence_id", "chunk_id").agg(F.max(flag.cast("int")).alias("p"))
    return per.groupBy("sentence_id").agg(F.sum("p").alias("predicates"))


def sentence_statistics(sentences: DataFrame, tokens: DataFrame, chunks: DataFrame, frequencies: DataFrame | None = None, levels: DataFrame | None = None, is_predicate: Column | None = None, content: str = CONTENT) -> DataFrame:
    """One row for each sentence with all features; zero where a sentence has no tokens or chunks. All parts are grouped by sentence, so they join on one shuffle."""
    text = F.col("text")
    base = sentences.select("sentence_id", "source_id", F.length(text).alias("length"), *[c.alias(n) for n, c in char_class_counts(text).items()])
    parts = [
        tokens.groupBy("sentence_id").agg(F.count("*").alias("tokens")),
        goshu_counts(tokens, "sentence_id"),
        chunks.groupBy("sentence_id").agg(F.count("*").alias("chunks")),
        chunk_depth(chunks), link_distance(chunks), predicate_count(tokens, is_predicate=is_predicate),
    ]
    parts += [word_log_freq(tokens, frequencies)] if frequencies is not None else []
    parts += [word_level(tokens, levels, content)] if levels is not None else []
    for p in parts:
        base = base.join(p, "sentence_id", "left")
    return base.fillna(0)


def document_readability(statistics: DataFrame, texts: DataFrame) -> DataFrame:
    """Averages of sentence statistics for each source, the school grade and the reading ease. texts: (source_id, text)."""
    scripts = ("hiragana", "kanji", "katakana", "romaji", "symbols", "commas")
    sums = [c for c in ("length", "tokens", "chunks", "predicates", "chunk_depth", "link_dist", *scripts, *GOSHU.values())]
    s = statistics.groupBy("source_id").agg(*[F.sum(c).alias(c) for c in sums], F.count("*").alias("sentences"))
    runs = texts.select("source_id", *[c.alias(n) for n, c in char_runs(F.col("text")).items()])
    s = s.join(runs, "source_id")
    over = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), b), F.lit(0.0))
    n = F.col("sentences")
    return s.select(
        "source_id", "sentences",
        *[over(c, F.col("length")).alias(c) for c in scripts if c != "commas"], *[over(c, F.col("tokens")).alias(c) for c in GOSHU.values()],
        *[over(c, n).alias(c) for c in ("length", "tokens", "chunks", "predicates", "commas")],
        over("chunk_depth", F.col("chunks")).alias("chunk_depth"), over("link_dist", F.greatest(F.col("chunks") - 1, F.lit(1))).alias("link_dist"),
        shibasaki_grade(F.col("hiragana"), over("length", n), over("chunks", n)).alias("grade"),
        tateishi_score(over("length", n), F.col("commas"), n, {c: F.col(c) for c in runs.columns if c != "source_id"}).alias("ease"),
    )
