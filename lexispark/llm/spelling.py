"""Spelling variants by generation over a reduced alphabet.

Letters are hashed to ``SYMBOLS`` symbols, and every word becomes a reduced word. Of each reduced word the full neighbourhood of one edit is
generated (itself, each symbol deleted, replaced or inserted) and joined to the reduced words of the vocabulary: two words at one edit have reduced
words at one edit or none. The pairs that meet are verified on the original strings. Reduced words and their neighbours are 64-bit polynomial hashes
from running sums, so a neighbour costs a few operations whatever the length of the word; a filter of fixed size drops neighbours that are no
reduced word before they are shuffled.

Each word's form is its near word with the largest count, if that is at least twice its own; counts grow along forms, so following them
ends, and is done by pointer jumping: a word that has arrived takes no part in later rounds.

Defined results: null texts have no words; a null doc_id is written as the empty string where runs are chosen for deletion; rows that repeat are
counted again; of near words with equal counts the one first in code-point order wins; runs of fewer than ``MIN_CHARS`` letters never become words;
texts and runs of any length are read whole; an empty table gives no row; other columns, of any name, are not read.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shingles import mix
from ._text import Scratch, maybe_in, stored

MIN_CHARS, MIN_COUNT, ONE_IN, FACTOR = 5, 3, 97, 2
LETTERS = r"[A-Za-zÀ-ÿ]"
#: With 8 symbols few different words of a length have one reduced word; a word of n letters has 16 n + 9 neighbours at most.
SYMBOLS = 8
#: Neighbours made at once by a worker, unless a single word has more.
AT_ONCE = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def occurrences(docs: DataFrame, one_in: int = ONE_IN) -> DataFrame:
    """(word): the runs of letters of all texts in lower case; of those whose hash with the document's id is divisible by ``one_in``
    one letter is deleted. Only words of enough letters."""
    runs = F.regexp_extract_all(docs["text"], F.lit(f"{LETTERS}{{{MIN_CHARS},}}"), F.lit(0))
    rows = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("d"), F.explode(runs).alias("run"))
    # most runs are in lower case already
    lower = F.when(F.col("run") == F.lower("run"), F.col("run")).otherwise(F.translate("run", string.ascii_uppercase, string.ascii_lowercase))
    rows = rows.select("d", lower.alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat("d", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return rows.select(F.when(F.col("h") % one_in == 0, less).otherwise(F.col("run")).alias("word")).where(F.length("word") >= MIN_CHARS)


def vocabulary(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    return occurrences(docs).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _symbols(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The symbols (1 to SYMBOLS) of all words one after another, and n + 1 offsets."""
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), "<u4").astype(np.uint64)
    return mix(points) % np.uint64(SYMBOLS) + np.uint64(1), np.concatenate([[0], np.cumsum(lengths)])


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def reduced(symbols: np.ndarray) -> np.ndarray:
    """Hashes of reduced words of one length, a row each: the sum of symbol i times base to the power i."""
    return mix((symbols * _powers(symbols.shape[1])[:-1]).sum(axis=1, dtype=np.uint64))


def neighbours(symbols: np.ndarray) -> np.ndarray:
    """(words x (2 SYMBOLS + 1) length + SYMBOLS + 1): hashes of all reduced words within one edit of each row, with repeats."""
    n, length = symbols.shape
    powers = _powers(length)
    before = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(symbols * powers[:-1], axis=1, dtype=np.uint64)], axis=1)
    whole = before[:, -1:]
    after = whole - before  # from symbol i on
    out = [whole, before[:, :-1] + after[:, 1:] * _INVERSE]
    for symbol in np.arange(1, SYMBOLS + 1, dtype=np.uint64):
        out += [whole + (symbol - symbols) * powers[:-1], before + symbol * powers + after * _BASE]
    return mix(np.concatenate(out, axis=1))


def _by_length(batch: pa.RecordBatch, at_once: int):
    """Rows of a batch whose words have one length, at most so many that they have ``at_once`` neighbours, and their symbols."""
    flat, at = _symbols(batch.column(0))
    lengths = np.diff(at)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        step = max(1, at_once // int((2 * SYMBOLS + 1) * length + SYMBOLS + 1))
        for i in range(0, len(rows), step):
            some = rows[i : i + step]
            yield batch.take(pa.array(some)), flat[at[some][:, None] + np.arange(length)]


def with_reduced(words: DataFrame) -> DataFrame:
    """(word, n, r): r is the hash of the reduced word."""

    def work(batches):
        for batch in batches:
            for rows, symbols in _by_length(batch, AT_ONCE):
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(reduced(symbols).view(np.int64))], ["word", "n", "r"])

    return words.select("word", "n").mapInArrow(work, "word string, n long, r long")


def generated(words: DataFrame) -> DataFrame:
    """(word, n, r): a row for each different neighbour r of a word's reduced word."""

    def work(batches):
        for batch in batches:
            for rows, symbols in _by_length(batch, AT_ONCE):
                near = np.sort(neighbours(symbols), axis=1)
                new = np.concatenate([np.ones((len(near), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
                ends = np.concatenate([[0], np.cumsum(new.sum(axis=1))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(near[new].view(np.int64)))
                yield pa.RecordBatch.from_arrays([*rows.columns, lists], ["word", "n", "rs"])

    return words.select("word", "n").mapInArrow(work, "word string, n long, rs array<long>").select("word", "n", F.explode("rs").alias("r"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all pairs of words that differ by exactly one edit, in both orders. words: (word, n, r), stored."""
    # a merge join: Spark sizes the generated rows as the vocabulary, a hundredth of what they are, and would broadcast them
    met = maybe_in(generated(words), words, "r").hint("merge").join(words.select("r", F.col("word").alias("near"), F.col("n").alias("near_n")), "r")
    return met.where((F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1)).drop("r")


def with_forms(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, n, n_near, form, form_n)."""
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    met = words.select("word", "n").join(near, "word", "left")
    taken = -F.col("best.m") >= factor * F.col("n")
    return met.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.m")).alias("form_n"))


def roots(forms: DataFrame, keep: Scratch) -> DataFrame:
    """(word, root) of the words that have a form. forms: (word, form), stored."""
    now = keep(forms.where("form IS NOT NULL").select("word", F.col("form").alias("at")), "jumps")
    arrived = None
    while True:
        ends = now.toDF("at", "far")
        ends = ends if arrived is None else ends.unionByName(arrived.toDF("at", "far"))
        after = keep(now.hint("merge").join(ends, "at", "left"), "jumps")  # stored tables are sized by their compressed files
        done = after.where("far IS NULL").select("word", "at")
        arrived = done if arrived is None else arrived.unionByName(done)
        now = after.where("far IS NOT NULL").select("word", F.col("far").alias("at"))
        if now.isEmpty():
            return arrived.toDF("word", "root")


def groups(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n for each word."""
    with Scratch(docs.sparkSession, "spelling") as keep:
        words = keep(with_reduced(keep(vocabulary(docs), "vocabulary")), "words")
        forms = stored(with_forms(words), "spelling-forms")
        found = stored(roots(forms, keep), "spelling-roots")
    return forms.hint("merge").join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
