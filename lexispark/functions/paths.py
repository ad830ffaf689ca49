"""Hierarchical label paths: sanitising, queries, prefixes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LABEL_BYTES = 256


def sanitize_path(labels: Column) -> Column:
    """Labels without empty ones, each run of other than letters and digits as ``_``, none of 256 bytes or more."""
    full = F.filter(labels, lambda x: x.isNotNull() & (x != ""))
    plain = F.transform(full, lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}]+", "_"))
    return F.filter(plain, lambda x: F.octet_length(x) < MAX_LABEL_BYTES)


def path_string(labels: Column) -> Column:
    return F.array_join(labels, ".")


def _label(text: str) -> str:
    flags = re.search(r"[*@%]*$", text)[0]
    name = text[: len(text) - len(flags)]
    body = "|".join(re.escape(x) for x in name.split("|"))
    body = f"(?:{body})"
    if "%" in flags:  # words inside a label
        body = rf"(?:[^.]+_)?{body}(?:[^._]*_[^.]+)?" if "*" not in flags else rf"(?:[^.]+_)?{body}[^.]*"
    elif "*" in flags:
        body = rf"{body}[^.]*"
    return f"(?i:{body})" if "@" in flags else body


def path_regex(query: str) -> str:
    """An anchored pattern for a path followed by a full stop: labels, ``*``, ``*{n,m}``, ``a|b``, ``!a``, flags ``*@%``."""
    out = []
    for part in query.split("."):
        if part == "*":
            out.append(r"(?:[^.]+\.)*")
        elif m := re.fullmatch(r"\*\{(\d*),?(\d*)\}", part):
            low = m[1] or "0"
            high = m[2] if "," in part else m[1]
            out.append(rf"(?:[^.]+\.){{{low},{high}}}")
        elif part.startswith("!"):
            out.append(rf"(?!(?:{_label(part[1:])})\.)[^.]+\.")
        else:
            out.append(rf"(?:{_label(part)})\.")
    return "^" + "".join(out) + "$"


def path_match(path: Column, query: str) -> Column:
    """Whether a path string fits a query."""
    return F.concat(path, F.lit(".")).rlike(path_regex(query))


def widen(query: str, levels: int = 4) -> str:
    """A query of fewer levels also finds what lies below."""
    return query if len(query.split(".")) >= levels else f"{query}.*"


def word_query(labels: Column, query: str) -> Column:
    """Whether labels, in any order, satisfy words joined by ``&``, ``|``, ``!`` and parentheses."""
    tokens = re.findall(r"[&|!()]|[^&|!()\s]+", query)
    at = 0

    def either() -> Column:
        nonlocal at
        left = both()
        while at < len(tokens) and tokens[at] == "|":
            at += 1
            left = left | both()
        return left

    def both() -> Column:
        nonlocal at
        left = one()
        while at < len(tokens) and tokens[at] == "&":
            at += 1
            left = left & one()
        return left

    def one() -> Column:
        nonlocal at
        if at >= len(tokens):
            raise ValueError(f"incomplete word query: {query!r}")
        token = tokens[at]
        at += 1
        if token == "!":
            return ~one()
        if token == "(":
            inside = either()
            if at >= len(tokens) or tokens[at] != ")":
                raise ValueError(f"missing parenthesis: {query!r}")
            at += 1
            return inside
        pattern = f"^{_label(token)}$"
        return F.exists(labels, lambda x: x.rlike(pattern))

    out = either()
    if at != len(tokens):
        raise ValueError(f"unexpected {tokens[at]!r} in {query!r}")
    return out


def prefixes(path: Column) -> Column:
    """All prefixes of a path, the empty one first."""
    return F.transform(F.sequence(F.lit(0), F.size(path)), lambda i: F.slice(path, F.lit(1), i))


def path_rollup(df: DataFrame, path: str, values: list[str], *by: str) -> DataFrame:
    """The sums of ``values`` below each prefix of a path column. Rows are summed by full path first, so few are multiplied."""
    leaves = df.groupBy(*by, path).agg(*[F.sum(v).alias(v) for v in values])
    return leaves.select(*by, *values, F.explode(prefixes(F.col(path))).alias("node")).groupBy(*by, "node").agg(*[F.sum(v).alias(v) for v in values])


def normalize_by_path(tree: DataFrame, norm: DataFrame, value: str, norm_value: str, scale: float = 1e6) -> DataFrame:
    """Adds ``normalized``: a node's value per ``scale`` of the same node's norm. Both have a ``node`` column."""
    n = norm.select("node", F.col(norm_value).alias("_norm"))
    return tree.join(n, "node").withColumn("normalized", F.try_divide(F.col(value) * F.lit(scale), F.col("_norm"))).drop("_norm")
