"""Typed conversion of a column with a report of what failed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that are truth values.
TRUE = ("true", "t", "yes", "y", "1", "1.0")
FALSE = ("false", "f", "no", "n", "0", "0.0")
TARGETS = ("int", "Int64", "float", "bool", "datetime", "string", "category")


@dataclass
class Report:
    column: str
    target: str
    success: bool
    n_rows: int
    n_failed: int
    failure_rate: float
    #: Up to 20 values that failed, with their counts, most frequent first.
    failed_values: list[tuple[str, int]]


def converted(value: Column, target: str, fmt: str | None = None, utc: bool = False) -> Column:
    """value as target; null where it can't be. Whole-number targets take fractions only if they are whole, but for `int`, which cuts them."""
    text = F.trim(value.cast("string"))
    number = text.try_cast("double")
    if target == "int":
        return F.when(F.isnan(number) | (F.abs(number) == float("inf")), F.lit(None)).otherwise(F.signum(number) * F.floor(F.abs(number))).cast("bigint")
    if target == "Int64":
        return F.when(number == F.floor(number), number).cast("bigint")
    if target == "float":
        return F.when(~F.isnan(number), number)
    if target == "bool":
        low = F.lower(text)
        return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)
    if target == "datetime":
        found = F.try_to_timestamp(text, F.lit(fmt)) if fmt else F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in FORMATS])
        return found if utc else found.cast("timestamp_ntz")
    if target in ("string", "category"):
        return value.cast("string")
    raise ValueError(f"not a target: {target!r}")


FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "MM/dd/yyyy")


def failures(df: DataFrame, column: str, target: str, fmt: str | None = None) -> DataFrame:
    """(value, count) of values that fail, most frequent first, at most 20."""
    value = F.col(column)
    bad = df.where(value.isNotNull() & converted(value, target, fmt).isNull())
    return bad.groupBy(value.cast("string").alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(20)


def convert_column(df: DataFrame, column: str, target: str, *, fmt: str | None = None, utc: bool = False) -> tuple[DataFrame, Report]:
    """df with the converted column, and the report. A whole-number conversion that fails anywhere because of a fraction, beside nulls, fails for every value and leaves the column as it is."""
    if column not in df.columns:
        raise KeyError(column)
    if target not in TARGETS:
        raise ValueError(f"not a target: {target!r}")
    value = F.col(column)
    new = converted(value, target, fmt, utc)
    number = F.trim(value.cast("string")).try_cast("double")
    row = df.agg(
        F.count("*").alias("n"),
        F.count(value).alias("given"),
        F.count_if(value.isNotNull() & new.isNull()).alias("failed"),
        F.count_if(number.isNotNull() & (number != F.floor(number))).alias("fractions"),
    ).first()
    whole = target == "Int64" or (target == "int" and row["given"] < row["n"])
    if whole and row["fractions"]:
        values = df.where(value.isNotNull()).groupBy(value.cast("string").alias("v")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "v").limit(20).collect()
        return df, Report(column, target, False, row["n"], row["given"], row["given"] / max(row["n"], 1), [(r["v"], r["c"]) for r in values])
    bad = [(r["value"], r["count"]) for r in failures(df, column, target, fmt).collect()] if row["failed"] else []
    return df.withColumn(column, new), Report(column, target, row["failed"] == 0, row["n"], row["failed"], row["failed"] / max(row["n"], 1), bad)
