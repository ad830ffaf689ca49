"""Collocations along dependency links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bound

#: Chunks on a path, the first included, are one more than the links followed.
MAX_LINKS = 4


def _parts(c: Column, span: tuple[str, str] = ("begin", "end")) -> Column:
    def part(side: str) -> Column:
        return F.struct(c[f"{side}_string"].alias("string"), c[f"{side}_pos"].alias("pos"), c[f"{side}_{span[0]}"].alias("begin"), c[f"{side}_{span[1]}"].alias("end"))

    whole = lambda p: p["string"].isNotNull() & p["pos"].isNotNull() & p["begin"].isNotNull() & p["end"].isNotNull()
    return F.filter(F.array(part("head"), part("tail")), whole)


def _gathered(chunks: DataFrame) -> DataFrame:
    """A row for each sentence with its chunks as the array `cs`; rows that are so already stay."""
    if "cs" in chunks.columns:
        return chunks
    cols = [c for c in chunks.columns if c not in ("sentence_id", "source_id", "genre", "chunk_id")]
    return chunks.groupBy("sentence_id", "source_id", "genre").agg(F.sort_array(F.collect_list(F.struct("chunk_id", *cols))).alias("cs"))


def follow_links(chunks: DataFrame, max_links: int = MAX_LINKS) -> DataFrame:
    """(sentence_id, source_id, genre, chunk_id, path): from each chunk the chunks it leads to, itself first. chunks: a row for each, which are gathered
    once by sentence, or for each sentence an array `cs` of them in order, which needs no shuffle. Links are followed inside the row."""

    def path(own: Column, c: Column) -> Column:
        steps = [c]
        for _ in range(max_links):
            at = steps[-1]["link"]
            steps.append(F.when(at >= 0, F.get(own, at)))
        return F.filter(F.array(*steps), lambda x: x.isNotNull())

    # paths are made inside the row, so that only they are exploded, not the sentence beside each of them
    paths = bound(F.col("cs"), lambda cs: F.transform(cs, lambda c: F.struct(c["chunk_id"].alias("chunk_id"), path(cs, c).alias("path"))))
    return _gathered(chunks).select("sentence_id", "source_id", "genre", F.explode(paths).alias("p")).select("sentence_id", "source_id", "genre", "p.chunk_id", "p.path")


def part_paths(chunks: DataFrame, max_n: int = 4, max_links: int = MAX_LINKS, min_n: int = 1, span: tuple[str, str] = ("begin", "end"), more: Sequence[str] = ()) -> DataFrame:
    """(sentence_id, source_id, genre, chunk_id, all, more...): the first ``max_n`` parts along the path of each chunk that has ``min_n``. ``span`` names the columns of their places.
    Parts are made once a chunk, and paths of them inside the row, so only they are exploded."""
    rows = _gathered(chunks)

    def path(own: Column, c: Column) -> Column:
        steps = [c]
        for _ in range(max_links):
            at = steps[-1]["link"]
            steps.append(F.when(at >= 0, F.get(own, at)))
        return F.slice(F.flatten(F.transform(F.array(*steps), lambda x: F.coalesce(x["parts"], F.array_except(c["parts"], c["parts"])))), 1, max_n)

    own = F.transform("cs", lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["link"].alias("link"), _parts(c, span).alias("parts")))
    paths = bound(own, lambda p: F.filter(F.transform(p, lambda c: F.struct(c["chunk_id"].alias("chunk_id"), path(p, c).alias("all"))), lambda x: F.size(x["all"]) >= min_n))
    return rows.select("sentence_id", "source_id", "genre", *more, F.explode(paths).alias("p")).select("sentence_id", "source_id", "genre", "p.chunk_id", "p.all", *more)


def extract_collocations(chunks: DataFrame, max_n: int = 4, max_links: int = MAX_LINKS, min_n: int = 1, span: tuple[str, str] = ("begin", "end")) -> DataFrame:
    """(sentence_id, source_id, genre, chunk_id, n, parts, type): every prefix of ``min_n`` to ``max_n`` parts along each path."""
    p = part_paths(chunks, max_n, max_links, min_n, span)
    g = p.withColumn("n", F.lit(min_n) if min_n == max_n else F.explode(F.sequence(F.lit(min_n), F.size("all"))))
    parts = F.slice("all", F.lit(1), F.col("n"))
    return g.select("sentence_id", "source_id", "genre", "chunk_id", "n", parts.alias("parts"), F.array_join(F.transform(parts, lambda x: x["pos"]), "_").alias("type"))


def extract_unigrams(chunks: DataFrame) -> DataFrame:
    """(sentence_id, position, string, pos): heads and tails of chunks in order, numbered from 1."""
    flat = F.flatten(F.transform("cs", lambda c: _parts(c)))
    u = _gathered(chunks).select("sentence_id", "source_id", "genre", F.posexplode(flat).alias("k", "p"))
    return u.select("sentence_id", "source_id", "genre", (F.col("k") + 1).alias("position"), F.col("p.string").alias("string"), F.col("p.pos").alias("pos"))


def gram_view(grams: DataFrame, n: int) -> DataFrame:
    """Wide rows of the n-grams."""
    cols = [F.get("parts", F.lit(i))[f].alias(f"{f}_{i + 1}") for i in range(n) for f in ("string", "pos", "begin", "end")]
    return grams.where(F.col("n") == n).select("sentence_id", "source_id", "genre", *cols)


def complete_trigrams(three: DataFrame, four: DataFrame) -> DataFrame:
    """The distinct 3-grams and first three parts of 4-grams."""
    return three.union(four.select(*three.columns)).distinct()


def sort_cluster(grams: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows in (type, first string, sentence) order, for row-group skipping after a write."""
    by = [F.col("type"), F.get("parts", F.lit(0))["string"], F.col("sentence_id")]
    ranged = grams.repartitionByRange(partitions, *by) if partitions else grams.repartitionByRange(*by)
    return ranged.sortWithinPartitions(*by)


def token_table(token_arrays: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Position-numbered rows of an array-of-struct column."""
    return token_arrays.select("sentence_id", F.posexplode(tokens).alias("position", "t")).select("sentence_id", "position", "t.*")
