"""Association measures and related statistics as column expressions (f_ii: pair count, f_ix, f_xi: marginals, f_xx: total)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _d(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def _zero_if_unseen(f_ii: Column | str, value: Column) -> Column:
    return F.when(_d(f_ii) == 0, F.lit(0.0)).otherwise(value)


def contingency(df: DataFrame, f_ii="f_ii", f_ix="f_ix", f_xi="f_xi", f_xx="f_xx") -> DataFrame:
    """All nine cells from the pair count, the marginals and the total."""
    ii, ix, xi, xx = map(_d, (f_ii, f_ix, f_xi, f_xx))
    cells = {"f_io": ix - ii, "f_oi": xi - ii}
    out = df.withColumns({"f_ii": ii, "f_ix": ix, "f_xi": xi, "f_xx": xx, **cells})
    out = out.withColumn("f_oo", F.col("f_xx") - F.col("f_ii") - F.col("f_io") - F.col("f_oi"))
    return out.withColumns({"f_xo": F.col("f_oo") + F.col("f_io"), "f_ox": F.col("f_oo") + F.col("f_oi")})


def contingency_from_cells(df: DataFrame) -> DataFrame:
    """Marginals and total from the four cells f_ii, f_io, f_oi, f_oo."""
    ii, io, oi, oo = (_d(c) for c in ("f_ii", "f_io", "f_oi", "f_oo"))
    return df.withColumns({"f_ix": ii + io, "f_xi": ii + oi, "f_xo": io + oo, "f_ox": oi + oo, "f_xx": ii + io + oi + oo})


def display_frequency(f_ii="f_ii") -> Column:
    return F.log(_d(f_ii) + 0.5)


def log_dice(f_ii: Column | str, f_sum: Column | str, f_xi: Column | str) -> Column:
    """``f_sum``: the total of the counts that share the fixed part."""
    return 14 + F.log2(F.try_divide(2 * _d(f_ii), _d(f_sum) + _d(f_xi)))


def t_score(f_ii="f_ii", f_ix="f_ix", f_xi="f_xi", f_xx="f_xx") -> Column:
    ii, ix, xi, xx = map(_d, (f_ii, f_ix, f_xi, f_xx))
    return _zero_if_unseen(ii, F.abs(F.try_divide(ii - F.try_divide(ix * xi, xx), F.sqrt(ii))))


def chi_sq(f_ii="f_ii", f_ix="f_ix", f_xi="f_xi", f_xx="f_xx") -> Column:
    ii, ix, xi, xx = map(_d, (f_ii, f_ix, f_xi, f_xx))
    io, oi = ix - ii, xi - ii
    oo = xx - ii - io - oi
    return _zero_if_unseen(ii, F.try_divide(xx * (ii * oo - io * oi) * (ii * oo - io * oi), (ii + io) * (ii + oi) * (io + oo) * (oi + oo)))


def mi(f_ii="f_ii", f_ix="f_ix", f_xi="f_xi", f_xx="f_xx") -> Column:
    ii, ix, xi, xx = map(_d, (f_ii, f_ix, f_xi, f_xx))
    return _zero_if_unseen(ii, F.log2(F.try_divide(ii * xx, ix * xi)))


def mi_3(f_ii="f_ii", f_ix="f_ix", f_xi="f_xi", f_xx="f_xx") -> Column:
    ii, ix, xi, xx = map(_d, (f_ii, f_ix, f_xi, f_xx))
    return _zero_if_unseen(ii, F.log2(F.try_divide(ii * ii * ii * xx, ix * xi)))


def llr(f_ii="f_ii", f_ix="f_ix", f_xi="f_xi", f_xx="f_xx") -> Column:
    """Log-likelihood ratio."""
    ii, ix, xi, xx = map(_d, (f_ii, f_ix, f_xi, f_xx))

    def h(x: Column) -> Column:
        return F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))

    cells = h(ii) + h(ix - ii) + h(xi - ii) + h(xx) + h(xx + ii - ix - xi)
    return _zero_if_unseen(ii, 2 * (cells - h(ix) - h(xi) - h(xx - ix) - h(xx - xi)))


def min_sensitivity(f_ii="f_ii", f_ix="f_ix", f_xi="f_xi") -> Column:
    """Null where a marginal is 0."""
    return F.try_divide(_d(f_ii), F.when(F.least(_d(f_xi), _d(f_ix)) > 0, F.greatest(_d(f_xi), _d(f_ix))))


def mi_log_prod(f_ii="f_ii", f_ix="f_ix", f_xi="f_xi", f_xx="f_xx") -> Column:
    return mi(f_ii, f_ix, f_xi, f_xx) * F.log10(_d(f_ii) + 1)


def dice(f_ii="f_ii", f_ix="f_ix", f_xi="f_xi") -> Column:
    return _zero_if_unseen(f_ii, F.try_divide(2 * _d(f_ii), _d(f_ix) + _d(f_xi)))


def relative_frequency(f_ii="f_ii", f_ix="f_ix") -> Column:
    """Null where the marginal is 0."""
    return F.try_divide(100 * _d(f_ii), _d(f_ix))


def weighted_frequency(tf: Column | str) -> Column:
    return F.when(_d(tf) == 0, F.lit(0.0)).otherwise(1 + F.log(_d(tf)))


def idf(n: Column | str, df: Column | str) -> Column:
    """Null where no text has the item."""
    return F.log(F.try_divide(_d(n), _d(df)))


def tf_idf_ln(tf: Column | str, n: Column | str, df: Column | str) -> Column:
    return F.when(_d(tf) == 0, F.lit(0.0)).otherwise((1 + F.log(_d(tf))) * F.log(F.try_divide(_d(n), _d(df))))


def tf_idf_log10(tf: Column | str, n: Column | str, df: Column | str) -> Column:
    return F.when(_d(tf) == 0, F.lit(0.0)).otherwise((1 + F.log(_d(tf))) * F.log10(F.try_divide(_d(n), _d(df))))


def compact_number(x: Column | str) -> Column:
    """Two decimals, half to even; for display only."""
    return F.bround(_d(x), 2)


MEASURES = {
    "t": t_score, "chi_sq": chi_sq, "mi": mi, "mi_3": mi_3, "llr": llr,
    "min_sensitivity": lambda ii, ix, xi, xx: min_sensitivity(ii, ix, xi), "mi_log_prod": mi_log_prod,
    "dice": lambda ii, ix, xi, xx: dice(ii, ix, xi), "rf": lambda ii, ix, xi, xx: relative_frequency(ii, ix),
}


def all_measures(df: DataFrame, f_ii="f_ii", f_ix="f_ix", f_xi="f_xi", f_xx="f_xx") -> DataFrame:
    """Every measure in one projection."""
    return df.withColumns({name: m(f_ii, f_ix, f_xi, f_xx) for name, m in MEASURES.items()})


def yules_k(df: DataFrame, item: str, *by: str) -> DataFrame:
    """Vocabulary richness of each group: 10000 * (sum over r of V_r * r^2 / N^2 - 1 / N)."""
    per = df.groupBy(*by, item).agg(F.count("*").cast("double").alias("r"))
    n = F.sum("r")
    return per.groupBy(*by).agg((10000 * (F.sum(F.col("r") * F.col("r")) / (n * n) - 1 / n)).alias("yules_k"))


def spread(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean, sample variance and sample standard deviation of a column in each group."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.var_samp(value).alias("variance"), F.stddev_samp(value).alias("sd"))
