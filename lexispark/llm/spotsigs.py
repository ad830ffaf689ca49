"""Document fingerprints by chains of content words after common-word anchors, in built-in functions only.

A signature is an anchor (a stop word) with the next ``CHAIN`` content words after it, as a 64-bit hash. A fingerprint is the
set of a text's signatures; the likeness of two is their Jaccard coefficient. Words are lower-cased runs of letters and digits.
A text without any full chain has its whole text as its only signature, so it is like equal texts alone.

Defined results: null text counts as empty; null ids are one id below all others; rows that repeat both doc_id and text
each give the same row and take one place in the order; different texts under one id are ordered by a hash of the text. With a single document the next
document is itself. Tables may be empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._text import key, let, stored, unkey
from .quality import STOP_WORDS

CHAIN = 2
#: A sorted part of the id order for each so many rows.
ROWS_A_PART = 100_000


def signatures(text: Column) -> Column:
    """array<long>: the distinct signatures of a text, never empty."""
    body = F.coalesce(text, F.lit(""))
    tokens = F.split(F.lower(F.regexp_replace(body, r"[^\p{L}\p{N}\x20\x09-\x0D]+", "")), r"[\x20\x09-\x0D]+")

    def chains(w: Column) -> Column:
        # positions of anchors; before the k-th anchor at p stand p - k content words
        marks = F.filter(F.transform(w, lambda x, i: F.when(x.isin(STOP_WORDS), i)), lambda i: i.isNotNull())
        content = F.filter(w, lambda x: ~x.isin(STOP_WORDS) & (x != ""))
        blanks = F.when(F.get(w, F.lit(0)) == "", 1).otherwise(0)  # a leading empty piece is no content word

        def all_of(c: Column) -> Column:
            def one(p: Column, k: Column) -> Column:
                at = p - k - blanks
                return F.when(at + CHAIN <= F.size(c), F.xxhash64(F.get(w, p), *[F.get(c, at + j) for j in range(CHAIN)]))

            return F.filter(F.transform(marks, one), lambda h: h.isNotNull())

        return let(content, all_of)

    found = F.array_distinct(let(tokens, chains))
    return let(found, lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(F.xxhash64(body))))


def fingerprint(sigs: Column) -> Column:
    """A printable digest of a signature set: its size and the MD5 of its sorted members."""
    return F.concat(F.size(sigs).cast("string"), F.lit(":"), F.md5(F.array_join(F.sort_array(sigs), ",").cast("binary")))


def likeness(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return let(shared, lambda n: n.cast("double") / (F.size(a) + F.size(b) - n))


def length_part(size: Column, threshold: float) -> Column:
    """Part by set length: sets in parts that differ by more than one cannot reach ``threshold``."""
    return F.floor(F.log(size.cast("double")) / F.lit(-math.log(threshold)) + F.lit(1e-9)).cast("int")


def near_pairs(df: DataFrame, threshold: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pairs (a, b, likeness) of ids whose distinct fingerprints reach ``threshold``; equal fingerprints count as one, under
    their least id, which is null where one of them is null. A set's prefix under a fixed order of signatures shares a member with every set it can reach; prefixes meet
    only in the same or a neighbouring part by length, and bounds on the sizes prune before sets are compared."""
    own = df.groupBy(signatures(df[text]).alias("s")).agg(F.min(key(df[doc_id])).alias("id")).select("id", fingerprint(F.col("s")).alias("f"), "s", F.size("s").alias("n"))
    own = stored(own.withColumn("part", length_part(F.col("n"), threshold)), "spotsigs")
    # sorted by value, so that frequent signatures are spread: the first n - ceil(t * n) + 1 are the prefix
    prefix = F.slice(F.sort_array("s"), F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))
    heads = own.select(F.struct("id", "f").alias("k"), "n", "part", F.explode(prefix).alias("sig"))
    left = heads.select("sig", F.col("k").alias("a"), F.col("n").alias("na"), F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    right = heads.select("sig", "part", F.col("k").alias("b"), F.col("n").alias("nb"))
    met = left.join(right, ["sig", "part"]).where((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
    met = met.where(F.col("na") >= F.col("nb") * threshold).select("a", "b").distinct()
    sets = own.select(F.struct("id", "f").alias("k"), "s")
    both = met.join(sets.select(F.col("k").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("k").alias("b"), F.col("s").alias("sb")), "b")
    return both.select(unkey(F.col("a.id")).alias("a"), unkey(F.col("b.id")).alias("b"), likeness(F.col("sa"), F.col("sb")).alias("likeness")).where(F.col("likeness") >= threshold)


def ring(ids: DataFrame) -> DataFrame:
    """Of rows (d, h, n): also the next row's key and the one before's key and half length, by descending d, then h; the
    last is followed by the first. Only ids move; no window spans more than a part of the order."""
    parts = max(1, math.ceil(ids.count() / ROWS_A_PART))
    ordered = stored(ids.repartitionByRange(parts, F.desc("d"), "h").withColumn("part", F.spark_partition_id()), "ring")
    w = Window.partitionBy("part").orderBy(F.desc("d"), "h")
    me = F.struct("d", "h", "n")
    # the ends of each part: as many rows as parts
    ends = ordered.groupBy("part").agg(F.min_by(me, F.struct(-F.col("d").cast("decimal(20,0)"), F.col("h"))).alias("top"), F.max_by(me, F.struct(-F.col("d").cast("decimal(20,0)"), F.col("h"))).alias("low"))
    every = Window.orderBy("part")
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lead("top").over(every), F.first("top").over(whole)).alias("after"), F.coalesce(F.lag("low").over(every), F.last("low").over(whole)).alias("before"))
    inner = ordered.select("d", "h", "n", "part", F.lead(me).over(w).alias("_next"), F.lag(me).over(w).alias("_prev"))
    out = inner.join(ends, "part").withColumns({"_next": F.coalesce("_next", "after"), "_prev": F.coalesce("_prev", "before")})
    return out.select("d", "h", "n", F.col("_prev.d").alias("pd"), F.col("_prev.h").alias("ph"), F.floor(F.col("_prev.n") / 2).cast("int").alias("p_half"))


def compare_edited(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """For each document of (doc_id, text): its fingerprint, that of the text whose latter half is replaced by the beginning of
    the next document (ids descending), and the likeness to both."""
    texts = df.select(key(df["doc_id"]).alias("d"), F.coalesce(df["text"], F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ids = df.select(key(df["doc_id"]).alias("d"), F.xxhash64(F.coalesce(df["text"], F.lit(""))).alias("h"), F.length(F.coalesce(df["text"], F.lit(""))).alias("n"))
    order = stored(ring(ids.distinct()), "order")
    placed = texts.join(order.hint("shuffle_merge"), ["d", "h"])
    heads = placed.select(F.col("pd").alias("d"), F.col("ph").alias("h"), F.substring("text", F.lit(1), F.col("p_half")).alias("head"), signatures(F.col("text")).alias("next_sigs"))
    heads = heads.groupBy("d", "h").agg(F.first("head").alias("head"), F.first("next_sigs").alias("next_sigs"))
    both = placed.select("d", "h", "text", "n").join(heads.hint("shuffle_merge"), ["d", "h"])
    edited = F.concat(F.substring("text", F.lit(1), F.col("n") - F.floor(F.col("n") / 2).cast("int")), F.col("head"))
    full = both.select("d", "n", edited.alias("edited"), signatures(F.col("text")).alias("own"), "next_sigs").withColumn("edited_sigs", signatures(F.col("edited")))
    return full.select(
        unkey(F.col("d")).alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_sigs")).alias("near_next"),
        F.size("own").cast("long").alias("n_signatures"),
        length_part(F.size("own"), threshold).alias("length_part"),
    )
