"""URL filters: host and path rules, then a character language-model ratio, in built-in functions only.

Two variable-order Markov models, of accepted and of rejected URLs, give each character a probability from the longest
context (up to ORDER characters) that was seen, interpolated with shorter ones. A URL that no rule decides is judged by the
difference of the two log-likelihoods divided by its length, against a cut calibrated on the ruled URLs. Training counts every ruled URL;
for the calibration each ruled URL is scored by models of the other half (by hash), so the cut never rests on URLs a model has seen.

Defined results: a null URL or one without ``://`` has empty host and path, no rule, and is allowed; so is every undecided URL when
either class has no training URL. Where one half of the ruled URLs lacks a class, its model gives each character of that class the same
probability. Very long URLs are scored whole; of the table's other columns only those to keep are read, so clashing names do no harm. A URL whose host is empty after ``://`` is undecided like others. Repeated rows get equal verdicts. Tables may be empty.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import stored

ORDER = 3
#: Characters outside are folded into one. With the start mark that makes 40**3 + 2 * 40**2 + 3 * 40 + 4 = 67,324 contexts of up to 3
#: characters, of 40 next characters at most: what is broadcast has a bound without leaving out any context that was seen.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789/.-"
FOLDED = "~"
STRENGTH = 4.0
URLS_A_TASK = 20_000


class UrlRule(NamedTuple):
    allow: bool
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


RULES = (UrlRule(False, "net", "/"), UrlRule(True, "example.net", "/en/"), UrlRule(False, "example.com", "/de/"), UrlRule(True, "org", "/fr/"))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[UrlRule] = RULES) -> Column:
    """struct<name, allow> of the longest rule that fits, or null; of equally long ones the first listed."""
    out = None
    for r in sorted(rules, key=lambda r: -len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.name).alias("name"), F.lit(r.allow).alias("allow"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def _grams(df: DataFrame, *keep: str) -> DataFrame:
    """A row for each character of ``folded``: the character and its contexts of each length up to ORDER."""
    padded = F.concat(F.lit("^" * ORDER), F.col("folded"))
    at = df.select(*keep, padded.alias("p"), F.explode(F.sequence(F.lit(1), F.length("folded"))).alias("i"))
    return at.select(*keep, F.substring("p", F.col("i"), F.lit(ORDER + 1)).alias("gram"))


def fold(url: Column) -> Column:
    """What the models read: lower case, the scheme left off, unusual characters as one."""
    return F.regexp_replace(F.lower(F.regexp_replace(url, r"(?s)^.*?://", "")), r"[^a-z0-9/.\-]", FOLDED)


def train(labelled: DataFrame) -> DataFrame:
    """Of rows (folded, good boolean): for each context that was seen (length, context, good_c, bad_c) and the
    counts of the characters that follow it, ``next`` map<string, struct<good, bad>>."""
    grams = _grams(labelled, "good").groupBy("gram", "good").agg(F.count("*").alias("n"))
    every = grams.select(F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("length"), "gram", "good", "n")
    every = every.groupBy("length", F.left(F.right("gram", F.col("length") + 1), F.col("length")).alias("context"), F.right("gram", F.lit(1)).alias("char")).agg(
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(~F.col("good"), F.col("n")).otherwise(0)).alias("bad")
    )
    return every.groupBy("length", "context").agg(
        F.sum("good").alias("good_c"), F.sum("bad").alias("bad_c"), F.map_from_entries(F.collect_list(F.struct("char", F.struct("good", "bad")))).alias("next")
    )


def score(urls: DataFrame, model: DataFrame) -> DataFrame:
    """Of distinct rows (folded): ``ratio``, the mean over its characters of log p(good) - log p(bad)."""
    at = _grams(urls, "folded")
    p = {c: F.lit(1.0 / (len(ALPHABET) + 1)) for c in ("good", "bad")}
    char = F.right("gram", F.lit(1))
    for k in range(ORDER + 1):
        level = model.where(F.col("length") == k).select(F.col("context").alias(f"x{k}"), F.col("good_c").alias(f"good{k}"), F.col("bad_c").alias(f"bad{k}"), F.col("next").alias(f"next{k}"))
        at = at.withColumn(f"x{k}", F.left(F.right("gram", F.lit(k + 1)), F.lit(k))).join(F.broadcast(level), f"x{k}", "left")
        for c in p:
            seen = F.coalesce(F.try_element_at(f"next{k}", char)[c], F.lit(0))
            p[c] = F.when(F.col(f"{c}{k}").isNull(), p[c]).otherwise((seen + STRENGTH * p[c]) / (F.col(f"{c}{k}") + STRENGTH))
    return at.groupBy("folded").agg(F.avg(F.log(p["good"]) - F.log(p["bad"])).alias("ratio"))


def held_out(ruled: DataFrame, tasks: int) -> DataFrame:
    """Of rows (folded, good): distinct rows (folded, ratio), each scored by models of the rows of the other half."""
    half = F.pmod(F.xxhash64("folded"), F.lit(2))
    parts = []
    for k in (0, 1):
        model = stored(train(ruled.where(half != k)), "urlhalf")
        parts.append(score(ruled.where(half == k).select("folded").distinct().repartition(tasks), model))
    return stored(parts[0].unionByName(parts[1]), "urlheld")


def calibrate(scored: DataFrame) -> DataFrame:
    """One row (one, cut) of rows (good, ratio): where both classes, taken as normal, are equally many deviations away."""
    m = scored.where(F.col("good").isNotNull()).agg(
        *[f(F.when(F.col("good") == g, F.col("ratio"))).alias(n + c) for g, c in ((True, "g"), (False, "b")) for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))]
    )
    cut = (F.col("mg") * (F.col("sb") + 1e-9) + F.col("mb") * (F.col("sg") + 1e-9)) / (F.col("sg") + F.col("sb") + 2e-9)
    return m.select(F.lit(1).alias("one"), cut.alias("cut"))


def judge(pages: DataFrame, rules: Sequence[UrlRule] = RULES, url: str = "url", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """keep..., host, path, rule, verdict, and the model's ``ratio`` and ``cut`` (null where it has none)."""
    host, path = split_url(pages[url])
    rows = pages.select(*[pages[c] for c in keep], host.alias("host"), path.alias("path"), fold(F.coalesce(pages[url], F.lit(""))).alias("folded"))
    rows = rows.withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    judged = rows.select(*keep, "host", "path", F.col("_rule.name").alias("rule"), F.col("_rule.allow").alias("good"), "folded")
    ruled = judged.where(F.col("good").isNotNull()).select("folded", "good")
    model = stored(train(ruled), "urlmodel")
    different = stored(judged.select("folded").where("folded <> ''").distinct(), "urls")
    # few bytes that become many rows: spread by rows, where Spark would gather them by bytes
    tasks = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-different.count() // URLS_A_TASK))
    scored = stored(score(different.repartition(tasks), model), "urlscores")
    all_rows = judged.join(scored, "folded", "left").withColumn("one", F.lit(1))
    cut = calibrate(ruled.join(held_out(ruled, tasks), "folded"))
    verdict = F.when(F.col("good"), "allow").when(F.col("good").isNotNull(), "block")
    verdict = verdict.when(F.col("ratio").isNull() | F.col("cut").isNull() | (F.col("ratio") >= F.col("cut")), "allow").otherwise("block")
    return all_rows.join(F.broadcast(cut), "one", "left").select(*keep, "host", "path", "rule", verdict.alias("verdict"), "ratio", "cut")
