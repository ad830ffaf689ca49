"""Line dedup by a distributed suffix structure over line sequences.

Lines with a word are named by a 128-bit hash; only positions whose line occurs elsewhere go on. Prefix doubling names the
runs of 1, 2, 4, ... lines from each position, as long as any run repeats. The doubling levels are then descended: positions
that share a prefix move together into longer and longer common prefixes, each group leaving its first position behind in the
interval it came from. What results are the longest-common-prefix intervals: for each, its length in lines and its members. In each
interval all members but the first in the corpus are later copies of that many lines, and each position is a later member of one
interval at most, that of its longest run with an earlier copy. Runs of at least ``MIN_WORDS`` words are deleted.

The order of suffixes inside an interval is not needed, so ranks are names without order and no global sort is made.

The corpus order is by doc_id, then text hash, then line. Defined results: null text has no lines and stays null; null ids
come first; rows that repeat both doc_id and text are one document, and all of them get its result; lines without words
belong to the run around them; a document may lose all its lines and then has an empty text. Tables may be empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._text import SPACE, key, stored

MIN_WORDS = 50
PLACE = ("d", "h", "k")


def _first_and_last():
    at = F.struct(*PLACE)
    return F.min(at).alias("first"), F.max(at).alias("last")


def lines(docs: DataFrame) -> DataFrame:
    """(d, h, k, line, name, before, words): each line with a word, its number among those and among all, its name, the words
    before it in the document and its own."""
    text = F.coalesce(docs["text"], F.lit(""))
    cut = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line"), F.unhex(F.md5(x.cast("binary"))).alias("name"), F.size(F.filter(F.split(x, SPACE), lambda w: w != "")).alias("words")))
    rows = docs.select(key(docs["doc_id"]).alias("d"), F.xxhash64(text).alias("h"), F.posexplode(F.filter(cut, lambda x: x["words"] > 0)).alias("k", "x"))
    return rows.select("d", "h", "k", "x.line", "x.name", "x.words")


def repeated(rows: DataFrame, *names: str) -> DataFrame:
    """The rows whose ``names`` also stand at another place."""
    twice = rows.groupBy(*names).agg(*_first_and_last()).where("first <> last").select(*names)
    return rows.join(twice, list(names), "left_semi")


def doubling(base: DataFrame) -> list[DataFrame]:
    """Names (d, h, k, name) of the repeated runs of 1, 2, 4, ... lines from each position."""
    levels = [base]
    while True:
        j = len(levels) - 1
        right = levels[j].select("d", "h", (F.col("k") - 2**j).alias("k"), F.col("name").alias("next"))
        longer = levels[j].join(right, list(PLACE)).select(*PLACE, F.unhex(F.md5(F.concat("name", "next"))).alias("name"))
        level = stored(repeated(longer, "name"), f"runs-{j + 1}")
        if level.isEmpty():
            return levels
        levels.append(level)


def intervals(levels: list[DataFrame]) -> DataFrame:
    """(d, h, k, length, prefix): members of longest-common-prefix intervals of ``length`` lines, named by ``prefix``."""
    members = levels[0].select(*PLACE, F.lit(0).alias("length"), F.lit(b"").alias("prefix"))
    for j in reversed(range(len(levels))):
        names = levels[j].select("d", "h", F.col("k").alias("at"), "name")
        met = members.withColumn("at", F.col("k") + F.col("length")).join(names, ["d", "h", "at"], "left").drop("at")
        met = stored(met, f"met-{j}")
        named = met.where(F.col("name").isNotNull())
        groups = named.groupBy("prefix", "name").agg(*_first_and_last(), F.first("length").alias("length")).where("first <> last")
        groups = stored(groups.select("prefix", "name", "first", "length"), f"groups-{j}")
        joined = met.join(groups.select("prefix", "name", F.lit(True).alias("moves")), ["prefix", "name"], "left")
        moved = F.col("moves").isNotNull()
        after = joined.select(
            *PLACE,
            F.when(moved, F.col("length") + 2**j).otherwise(F.col("length")).alias("length"),
            F.when(moved, F.unhex(F.md5(F.concat("prefix", "name")))).otherwise(F.col("prefix")).alias("prefix"),
        )
        stay = groups.select("first.d", "first.h", "first.k", "length", "prefix")
        members = after.unionByName(stay)
    return stored(members.where("length > 0"), "intervals")


def later_copies(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, h, a, b): original line numbers, both inclusive, of maximal repeated runs of enough words that occur earlier in the corpus;
    overlapping runs of a document are one. ``rows`` as by lines()."""
    base = stored(repeated(rows, "name").dropDuplicates(list(PLACE)), "lines-0")
    found = intervals(doubling(base.select(*PLACE, "name")))
    firsts = found.groupBy("prefix").agg(F.min(F.struct(*PLACE)).alias("first"))
    later = found.join(firsts, "prefix").where(F.struct(*PLACE) != F.col("first")).select(*PLACE, "length")
    # the words of a run: words before its end less words before its start, counted over the repeated lines of the document
    order = Window.partitionBy("d", "h").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    summed = base.select(*PLACE, "line", "words", F.sum("words").over(order).alias("until"))
    runs = later.join(summed.select(*PLACE, F.col("line").alias("a"), (F.col("until") - F.col("words")).alias("since")), list(PLACE))
    ends = summed.select("d", "h", F.col("k").alias("end"), F.col("line").alias("b"), "until")
    runs = runs.withColumn("end", F.col("k") + F.col("length") - 1).join(ends, ["d", "h", "end"]).where(F.col("until") - F.col("since") >= min_words)
    by_start = Window.partitionBy("d", "h").orderBy("a", "b")
    reach = runs.select("d", "h", "a", "b").withColumn("reach", F.max("b").over(by_start.rowsBetween(Window.unboundedPreceding, -1)))
    fresh = F.when(F.col("reach").isNull() | (F.col("a") > F.col("reach") + 1), 1).otherwise(0)
    island = reach.withColumn("island", F.sum(fresh).over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("d", "h", "island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("island")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, report: bool = False) -> DataFrame:
    """The rows of ``docs`` without later copies, ``n_chars`` (where there is one) set anew; or with ``report``: doc_id, n_lines,
    n_removed lines, and text."""
    cuts = later_copies(stored(lines(docs), "lines"), min_words)
    cuts = cuts.groupBy("d", "h").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("_cuts"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), key(docs["doc_id"]).alias("d"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("h"))
    met = rows.join(cuts, ["d", "h"], "left")
    all_lines = F.split("_row.text", "\n")
    starts = F.concat(F.array(F.lit(0)), F.transform("_cuts", lambda c: c["b"] + 1))
    ends = F.concat(F.transform("_cuts", lambda c: c["a"]), F.array(F.size(all_lines)))
    spans = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e")))
    from ._text import let

    kept = let(all_lines, lambda x: F.array_join(F.flatten(F.transform(spans, lambda p: F.slice(x, p["s"] + 1, p["e"] - p["s"]))), "\n"))
    text = F.when(F.col("_cuts").isNull(), F.col("_row.text")).otherwise(kept)
    if report:
        removed = F.aggregate(F.coalesce("_cuts", F.array().cast("array<struct<a:int,b:int>>")), F.lit(0), lambda n, c: n + c["b"] - c["a"] + 1)
        n_lines = F.when(F.col("_row.text").isNull(), 0).otherwise(F.size(all_lines))
        return met.select(F.col("_row.doc_id").alias("doc_id"), n_lines.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"), text.alias("text"))
    out = met.select(*[text.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
