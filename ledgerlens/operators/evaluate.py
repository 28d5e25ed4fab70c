"""Flags against the label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.numeric import share


def agg_report(df: DataFrame, flags: dict[str, object], label: str | None = "is_laundering", weight: str | None = None) -> DataFrame:
    """(grp, n_flagged, share_of_data, n_laundering, laundering_share_among_flagged) for each named condition and all rows, from one pass.

    weight names the column that says for how many rows a row stands; the label's column then says how many of these have it.
    """
    has = label is not None and label in df.columns
    named = {**flags, "all_rows": F.lit(True)}
    parts = []
    for name, condition in named.items():
        if weight is None:
            hit = F.count_if(condition)
            bad = F.count_if(condition & (F.col(label) == 1)) if has else F.lit(None).cast("long")
        else:
            held = lambda c, on=condition: F.coalesce(F.sum(F.when(on, F.col(c))), F.lit(0).cast("long"))
            hit, bad = held(weight), held(label) if has else F.lit(None).cast("long")
        rate = F.when(hit == 0, 0.0).otherwise(share(bad, hit)) if has else F.lit(None).cast("double")
        parts.append(
            F.struct(
                F.lit(name).alias("grp"), hit.alias("n_flagged"), share(hit, F.count("*") if weight is None else F.sum(weight)).alias("share_of_data"), bad.alias("n_laundering"), rate.alias("laundering_share_among_flagged")
            )
        )
    return df.agg(F.array(*parts).alias("all")).select(F.explode("all").alias("r")).select("r.*")


def confusion(df: DataFrame, predicted: str, label: str = "is_laundering") -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, f1 (0 where undefined) and the correlation (null if either is constant)."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    counts = df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    precision, recall = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))
    phi = F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return counts.select("tp", "fp", "fn", "tn", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"), F.round(phi, 6).alias("corr"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of both columns' values with margins, which are called All."""
    cube = df.groupBy(F.col(a).cast("string").alias("_a"), F.col(b).cast("string").alias("_b")).agg(F.count("*").alias("c"))
    margins = cube.cube("_a", "_b").agg(F.sum("c").alias("n"), F.grouping("_a").alias("_ga"), F.grouping("_b").alias("_gb"))
    return margins.select(
        F.when(F.col("_ga") == 1, "All").otherwise(F.col("_a")).alias(a), F.when(F.col("_gb") == 1, "All").otherwise(F.col("_b")).alias(b), "n"
    )
