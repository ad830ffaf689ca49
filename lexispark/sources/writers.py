"""Sinks: exports, saved searches, search tables, appended batches."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_token_space


def labeled_lines(docs: DataFrame, genre_path: str = "genre_path", text: str = "text") -> DataFrame:
    """One column, ``__label__<genre> <tokens>``."""
    return docs.select(F.concat_ws(" ", F.concat(F.lit("__label__"), F.col(genre_path)), F.col(text)).alias("line"))


def export_corpus(docs: DataFrame, path: str, text: str = "text") -> None:
    """A line for each document."""
    docs.select(F.regexp_replace(text, "[\r\n]", " ")).write.mode("overwrite").text(path)


def export_labeled_corpus(docs: DataFrame, path: str) -> None:
    labeled_lines(docs).write.mode("overwrite").text(path)


def extracted_units(tokens: DataFrame, sentences: DataFrame, sources: DataFrame, feature: str = "orth", unit: str = "suw") -> DataFrame:
    """(corpus, basename, tags, text) for each sentence: its text (unit text), its tokens (suw), or heads and tails (unigrams, given as tokens with ``string``)."""
    base = sentences.drop("genre").join(sources.select("source_id", "basename", F.get("genre", F.lit(0)).alias("corpus")), "source_id")
    tags = F.array_join(F.array_sort("tags"), ",")
    if unit == "text":
        return base.select("sentence_id", "corpus", "basename", tags.alias("tags"), F.regexp_replace("text", "[\n\t]", " ").alias("text"))
    words = F.sort_array(F.collect_list(F.struct("position", strip_token_space(F.col("string" if unit == "unigrams" else feature)).alias("f"))))
    own = tokens.groupBy("sentence_id").agg(words.alias("w")).select("sentence_id", F.array_join(F.transform("w", lambda x: x["f"]), " ").alias("units"))
    return base.join(own, "sentence_id").select("sentence_id", "corpus", "basename", tags.alias("tags"), F.regexp_replace("units", "[\n\t]", " ").alias("text"))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("quote", "").csv(path)


def matches_name(query: str, genre: str | None, tags: list[str]) -> str:
    """The name under which a search result is saved."""
    return hashlib.sha256(f"{query}#{genre or ''}#{','.join(sorted(tags))}".encode()).hexdigest()


def save_matches(matches: DataFrame, folder: str, query: str, genre: str | None = None, tags: list[str] = ()) -> str:
    path = f"{folder}/{matches_name(query, genre, list(tags))}"
    matches.write.mode("overwrite").parquet(path)
    return path


def write_search_tables(tables: Mapping[str, DataFrame], folder: str, partition_by: Mapping[str, str] = {}) -> None:
    """Every derived table as Parquet, sorted inside partitions by its first string for row-group skipping."""
    for name, df in tables.items():
        sort = [c for c in ("type", "string_1", "orth_base") if c in df.columns]
        out = df.repartitionByRange(*sort).sortWithinPartitions(*sort) if sort else df
        writer = out.write.mode("overwrite")
        (writer.partitionBy(partition_by[name]) if name in partition_by else writer).parquet(f"{folder}/{name}")


def append_batch(sources: DataFrame, children: DataFrame, folder: str, batch: str | int) -> None:
    """Appends documents and their sentences keyed by basename, in folders of this batch: a retry replaces its own files alone. Sources are
    written last, so what `sources` lists is whole. A child of an unknown basename is an error and nothing is written."""
    known = sources.select("basename", "source_id")
    unknown = children.join(known, "basename", "left_anti").select("basename").limit(5).collect()
    if unknown:
        raise ValueError("no source for " + ", ".join(r["basename"] for r in unknown))
    children.join(known, "basename").drop("basename").write.mode("overwrite").parquet(f"{folder}/sentences/batch={batch}")
    sources.write.mode("overwrite").parquet(f"{folder}/sources/batch={batch}")
