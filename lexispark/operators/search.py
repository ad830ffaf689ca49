"""Full-text search with context, document queries, example sentences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import path_match, word_query
from ..functions.text import kwic


def sentence_context(sentences: DataFrame) -> DataFrame:
    """Adds before_text and after_text: the neighbours in the same source and paragraph. Order ids have no gaps, so lag and lead find them."""
    order = Window.partitionBy("source_id", "paragraph_order_id").orderBy("sentence_order_id")
    return sentences.withColumns({"before_text": F.lag("text").over(order), "after_text": F.lead("text").over(order)})


def filter_tags(df: DataFrame, remove: Sequence[str], tags: str = "tags") -> DataFrame:
    """Rows without any of the removed tags; rows without tags stay."""
    return df.where(~F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, remove))), F.lit(False))) if remove else df


def fulltext_search(sentences: DataFrame, sources: DataFrame, query: str, genre: str | None = None, remove_tags: Sequence[str] = (), literal: str | None = None, words: str | None = None) -> DataFrame:
    """One row for each match with before, key, after; these hold the neighbour sentences too. ``literal``: a substring that every match
    holds, by which rows are dropped before the pattern is tried. ``genre`` is a path query, ``words`` a word query on the path.

    Only sources that fit reach the join; context is made before rows are dropped, from the sentence's own paragraph."""
    near = sentence_context(sentences.drop("genre").join(fitting_sources(sources, genre, words), "source_id"))
    hit = F.col("text").rlike(query)
    if literal:
        hit = F.contains(F.col("text"), F.lit(literal)) & hit
    return match_rows(filter_tags(near.where(hit), remove_tags), query)


def indexed_search(index, sources: DataFrame, query: str, genre: str | None = None, remove_tags: Sequence[str] = (), words: str | None = None) -> DataFrame:
    """The rows of `fulltext_search` over the sentences of a `PostingIndex`: only sentences that hold the grams of the pattern are tried."""
    found = index.matching(query).drop("genre").join(fitting_sources(sources, genre, words), "source_id")
    return match_rows(filter_tags(found, remove_tags), query)


def fitting_sources(sources: DataFrame, genre: str | None = None, words: str | None = None) -> DataFrame:
    """Sources under a path query and a word query on the path."""
    own = sources
    if genre:
        own = own.where(path_match(F.col("genre_path"), genre))
    if words:
        own = own.where(word_query(F.col("genre"), words))
    return own.select("source_id", "title", "author", "year", "genre_path")


def match_rows(found: DataFrame, query: str) -> DataFrame:
    """One row for each match in sentences with context."""
    rows = found.select("sentence_id", "source_id", "title", "author", "year", "genre_path", "before_text", "after_text", F.posexplode(kwic(F.col("text"), query)).alias("match", "m"))
    return rows.select(
        "sentence_id", "source_id", "title", "author", "year", "genre_path", "match",
        F.concat(F.coalesce("before_text", F.lit("")), F.col("m.before")).alias("before"), F.col("m.key").alias("key"),
        F.concat(F.col("m.after"), F.coalesce("after_text", F.lit(""))).alias("after"),
    )


def pattern_frequencies(matches: DataFrame) -> DataFrame:
    return matches.groupBy("key").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "key")


def paginate(df: DataFrame, order: Sequence[Column | str], limit: int = 1000, offset: int = 0) -> DataFrame:
    """A page of an ordered result; ``order`` must decide all ties for pages to be stable."""
    return df.orderBy(*order).offset(offset).limit(limit)


def expand_documents(sentences: DataFrame, ids: DataFrame) -> DataFrame:
    """The whole document around each sentence of ``ids`` (sentence_id): sentences joined by nothing, paragraphs by line ends."""
    wanted = sentences.join(ids, "sentence_id", "left_semi").select("source_id").distinct()
    own = sentences.join(wanted, "source_id", "left_semi")
    texts = own.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("sentence_order_id", "paragraph_order_id", "text"))).alias("s"))
    last = F.aggregate(
        "s", F.struct(F.lit("").alias("text"), F.lit(None).cast("int").alias("par")),
        lambda a, x: F.struct(F.concat(a["text"], F.when(a["par"] != x["paragraph_order_id"], "\n").otherwise(""), x["text"]).alias("text"), x["paragraph_order_id"].alias("par")),
        lambda a: a["text"],
    )
    return texts.select("source_id", last.alias("text"))


def sample_per_group(hits: DataFrame, group: Column, id_: str = "sentence_id", limit: int = 6, sort: Column | None = None, order: str = "sampled", seed: str = "0", offset: int = 0) -> DataFrame:
    """At most ``limit`` rows of each group after the first ``offset``: a fixed pseudo-random order by MD5 of seed and id, or with
    ``order='sorted'`` by ``sort`` first."""
    chance = F.md5(F.concat(F.lit(seed), F.col(id_).cast("string")).cast("binary"))
    keys = ([sort, chance] if order == "sorted" else [chance]) if sort is not None else [chance]
    place = F.row_number().over(Window.partitionBy("_group").orderBy(*keys, id_))
    return hits.withColumn("_group", group).withColumn("_place", place).where((F.col("_place") > offset) & (F.col("_place") <= offset + limit)).drop("_group", "_place")


def gram_hits(grams: DataFrame, type_: str, strings: Mapping[int, str], *more: str) -> DataFrame:
    """Distinct sentences with an n-gram of this type whose parts have the given strings (numbered from 1). ``more``: columns that a sentence has once."""
    n = len(type_.split("_"))
    fits = [F.get("parts", F.lit(i - 1))["string"] == s for i, s in strings.items()]
    return grams.where((F.col("n") == n) & (F.col("type") == type_)).where(reduce(Column.__and__, fits, F.lit(True))).select("sentence_id", "source_id", "genre", *more).distinct()


def equality_filter(df: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    return df.where(reduce(Column.__and__, [F.col(k) == F.lit(v) for k, v in wanted.items()], F.lit(True)))


def token_listing(search_tokens: DataFrame, query: Mapping[str, object], selected: Sequence[str]) -> DataFrame:
    """The rows that fit, with the selected and the counted columns less those that the query fixes."""
    cols = [c for c in (*selected, "count", "sentences_count", "sources_count") if c not in query]
    return equality_filter(search_tokens, query).select(*dict.fromkeys(cols))


def document_tokens(tokens: DataFrame, feature: str = "orth", pos: Sequence[str] = (), not_pos_2: Sequence[str] = (), unit: str = "source_id") -> DataFrame:
    """One string for each source (or sentence): a feature of its tokens in order, joined by spaces."""
    own = tokens
    if pos:
        own = own.where(F.col("pos_1").rlike("|".join(pos)))
    if not_pos_2:
        own = own.where(~F.col("pos_2").rlike("|".join(not_pos_2)))
    words = F.sort_array(F.collect_list(F.struct("sentence_id", "position", F.col(feature).alias("f"))))
    return own.groupBy(unit).agg(words.alias("w")).select(unit, F.array_join(F.transform("w", lambda x: x["f"]), " ").alias("text"))


def simple_context_search(sentences: DataFrame, sources: DataFrame, query: str) -> DataFrame:
    """Matching sentences with their source; `paginate` puts them in order."""
    hit = sentences.where(F.col("text").rlike(query)).select("sentence_id", "source_id", "text")
    return hit.join(sources.select("source_id", "title", "author", "year", "genre_path"), "source_id")


def genres(sources: DataFrame) -> DataFrame:
    return sources.select("genre_path").distinct()


def genre_counts(sources: DataFrame) -> DataFrame:
    return sources.groupBy("genre_path").agg(F.count("*").alias("count"))


def sentences_by_genre(sentences: DataFrame, sources: DataFrame, genre: str) -> DataFrame:
    return sentences.drop("genre").join(sources.where(path_match(F.col("genre_path"), genre)).select("source_id", "genre_path"), "source_id")


def source_genres(sources: DataFrame) -> DataFrame:
    """The genres of each source id."""
    return sources.select("source_id", "genre_path").distinct()


def sentences_with_genre(sentences: DataFrame, sources: DataFrame) -> DataFrame:
    """Every sentence with the genre of its source."""
    return sentences.select("sentence_id", "source_id", "text").join(sources.select("source_id", "genre_path"), "source_id").select("sentence_id", "text", "genre_path")


def source_ids_by_genre(sources: DataFrame, genre: str) -> DataFrame:
    return sources.where(path_match(F.col("genre_path"), genre)).select("source_id")


def source_text(sentences: DataFrame, source_ids: DataFrame) -> DataFrame:
    """The sentences of the given sources: (source_id, sentence_id, text)."""
    return sentences.select("source_id", "sentence_id", "text").join(source_ids.select("source_id"), "source_id", "left_semi")


def basename_ids(sources: DataFrame) -> DataFrame:
    return sources.select("basename", "source_id")
