"""Column expressions for moments, shares and quantiles that agree with the usual dataframe libraries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def quantile(x: Column | str, p: float) -> Column:
    """Exact quantile with linear interpolation, for counts, lengths and the like: the aggregate holds each different value. exact_quantiles is for amounts."""
    return F.percentile(x, F.lit(p))


def share(part: Column, whole: Column, digits: int = 6) -> Column:
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def skewness(x: Column | str) -> Column:
    """Bias-corrected; null for fewer than three values and 0 without variance."""
    x = as_double(x)
    n = F.count(x)
    g = F.sqrt(n * (n - 1.0)) / (n - 2.0) * F.coalesce(F.skewness(x), F.lit(0.0))
    return F.when(n > 2, g)


def kurtosis(x: Column | str) -> Column:
    """Bias-corrected excess; null for fewer than four values and 0 without variance."""
    x = as_double(x)
    n = F.count(x)
    spread = F.stddev_pop(x) > 0
    g = (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * F.coalesce(F.kurtosis(x), F.lit(0.0)) + 6.0)
    return F.when(n > 3, F.when(spread, g).otherwise(0.0))


def mean_and_sigma(x: Column, mean: str = "mu", sigma: str = "sigma") -> list[Column]:
    """Mean and population sigma of whole numbers from exact sums, so that they don't depend on the order of rows."""
    n, s = F.count(x).cast("double"), F.sum(x.cast("decimal(20,0)"))
    squares = F.sum((x * x).cast("decimal(28,0)"))
    top = (F.count(x).cast("decimal(12,0)") * squares - s * s).cast("double")
    return [F.try_divide(s.cast("double"), n).alias(mean), F.try_divide(F.sqrt(top), n).alias(sigma)]


def finite_or_zero(x: Column) -> Column:
    """Nulls, NaN and infinities to 0."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, 0.0).otherwise(x)


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero, in the arithmetic of doubles and without a decimal for every value. Numbers too large to have so many digits stay as they are."""
    scale = 10.0**digits
    near = F.floor(F.abs(x) * scale + 0.5) / scale
    return F.when(F.abs(x) < 2.0**51 / scale, F.when(x < 0, -near).otherwise(near)).otherwise(x)


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))
