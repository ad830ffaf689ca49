"""Quality rules: a threshold table compiled into one projection, without user functions.

Defined results: null text counts as empty; a text without words has all ratios 0 and is rejected by the base rule
(fewer than ``MIN_WORDS`` words); rows are judged one by one, so repeated rows get equal verdicts; other columns,
also those named like a measure, are never read. The tables may be empty.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import SPACE, let, words

MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
SYMBOLS = "#*$%&|<>"

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that for with on as was by are be at or an it this a "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les en un une du que qui dans est pour par sur au avec "
    "el los las del se por con una su al lo"
).split()


class Rule(NamedTuple):
    """A document passes if ``numerator / denominator`` of its measures lies in [low, high]; None is no bound."""

    name: str
    numerator: str
    denominator: str
    low: float | None
    high: float | None


RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols", "n_symbols", "word_chars", None, 0.05),
    Rule("shouting", "n_exclaims", "n_words", None, 0.25),
    Rule("stop_words", "n_stop_words", "n_words", 0.05, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
)


def _repeat_words(tokens: Column) -> Column:
    """Words inside windows that occur twice or more. Windows are compared by 64-bit hashes; only a text in which some
    window repeats pays for the sort that finds where."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            def twin(x: Column, k: Column) -> Column:
                return F.coalesce((F.get(s, k - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce((F.get(s, k + 1)["h"] == x["h"]), F.lit(False))

            return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

        def union_length(p: Column) -> Column:
            steps = F.transform(p, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - at, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return let(let(pairs, positions), union_length)

    def windows(h: Column) -> Column:
        starts = F.when(F.size(h) >= WINDOW, F.sequence(F.lit(1), F.size(h) - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, WINDOW)))

    hashed = let(F.transform(tokens, lambda w: F.xxhash64(w)), windows)
    return let(hashed, lambda x: F.when(F.size(F.array_distinct(x)) < F.size(x), covered(x)).otherwise(F.lit(0)))


def measures(df: DataFrame, text: str = "text", keep: Iterable[str] = ()) -> DataFrame:
    """Per row the columns ``keep``, and long measures of the whole text."""
    body = F.coalesce(df[text], F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = df.select(*[df[c] for c in keep], body.alias("_body"), words(df[text]).alias("_words"), lines.alias("_lines"))
    out = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.regexp_replace("_body", SPACE, "")),
        "n_symbols": F.length("_body") - F.length(F.translate("_body", SYMBOLS, "")),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": _repeat_words(F.col("_words")),
        "n_lines": F.size("_lines"),
        "n_exclaims": F.length("_body") - F.length(F.replace(F.col("_body"), F.lit("!"), F.lit(""))),
        "n_stop_words": F.size(F.filter("_words", lambda w: w.isin([f for s in STOP_WORDS for f in (s, s.capitalize())]))),
    }
    return first.select(*keep, *[c.cast("long").alias(n) for n, c in out.items()])


def compile_rules(rules: Iterable[Rule] = RULES) -> Column:
    """The table as one boolean expression over measures; products instead of quotients, so no division by zero."""

    def one(r: Rule) -> Column:
        n, d = F.col(r.numerator), F.col(r.denominator)
        bounds = [n >= d * r.low] * (r.low is not None) + [n <= d * r.high] * (r.high is not None)
        return reduce(Column.__and__, bounds, F.lit(True))

    return reduce(Column.__and__, map(one, rules), F.lit(True))


def judge(df: DataFrame, text: str = "text", keep: Iterable[str] = ("doc_id",), rules: Iterable[Rule] = RULES) -> DataFrame:
    """``keep``, the measures, ``base_failed`` and ``kept``."""
    m = measures(df, text, keep)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return m.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def filter_documents(df: DataFrame, text: str = "text", rules: Iterable[Rule] = RULES) -> DataFrame:
    """The rows of ``df`` that pass, with exactly its columns."""
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), df[text].alias("_text"))
    return judge(packed, "_text", ["_row"], rules).where("kept").select("_row.*")
