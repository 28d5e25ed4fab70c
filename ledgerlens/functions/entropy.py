"""Binned Shannon entropy of each key's amounts.

A key's amounts are cut at min(10, different amounts) quantiles, equal edges are merged, bins are closed on the right and the first on both
sides; the result is the entropy of the bins' shares in bits. Fewer than two amounts have entropy 0. The quantiles are interpolated in the same order
of operations as numpy's, since edges often fall exactly on amounts.

No key's amounts are gathered, nor do they all go to one task: different amounts are counted first and sorted into ranges by key and amount, so that a busy key spans several;
running counts within a range and the key's ranges' totals say which amounts the quantiles fall on, at most 11 edges a key come back by a join, and the bins are
counted in two steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.functions.storage import stored

BINS = 10


def _place(i: Column, q: Column, n: Column) -> Column:
    """Where quantile i of q stands among n sorted amounts, counted from 0."""
    p = F.when(i == q, F.lit(1.0)).otherwise(i.cast("double") * (F.lit(1.0) / q.cast("double")) * 100 / 100)
    return p * (n - 1).cast("double")


def binned_entropy(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """(key, out) for every key of df, null keys and null amounts left out."""
    rows = df.select(F.col(key), F.col(value).cast("double").alias("_x")).where(F.col(key).isNotNull())
    counts = rows.where(F.col("_x").isNotNull()).groupBy(key, "_x").agg(F.count("*").alias("_k"))
    ranged = stored(counts.repartitionByRange(key, "_x").sortWithinPartitions(key, "_x").withColumn("_range", F.spark_partition_id()), "amounts")
    parts = ranged.groupBy(key, "_range").agg(F.sum("_k").alias("_s"), F.count("*").alias("_d"))
    whole = W.partitionBy(key)  # a row for each range that a key spans
    bases = parts.select(
        key, "_range",
        (F.sum("_s").over(whole.orderBy("_range").rowsBetween(W.unboundedPreceding, 0)) - F.col("_s")).alias("_base"),
        F.sum("_s").over(whole).alias("_n"),
        F.least(F.lit(BINS), F.sum("_d").over(whole)).cast("int").alias("_q"),
    )
    own = F.sum("_k").over(W.partitionBy("_range", key).orderBy("_x").rowsBetween(W.unboundedPreceding, 0))
    ranked = ranged.join(bases, [key, "_range"]).select(key, "_x", (F.col("_base") + own).alias("_upto"), "_k", "_n", "_q")
    ranked = ranked.select(key, "_x", (F.col("_upto") - F.col("_k")).alias("_before"), "_upto", "_n", "_q")

    def ends(i: int) -> list[Column]:
        """Both amounts that quantile i lies between. Aggregates of a fixed number take far less time than a look at each quantile in each row."""
        low = F.floor(_place(F.lit(i), F.col("_q"), F.col("_n")))
        high = F.least(low + 1, F.col("_n") - 1)
        within = lambda at: (F.lit(i) <= F.col("_q")) & (at >= F.col("_before")) & (at < F.col("_upto"))
        return [F.max(F.when(within(low), F.col("_x"))).alias(f"_a{i}"), F.max(F.when(within(high), F.col("_x"))).alias(f"_b{i}")]

    found = ranked.groupBy(key).agg(F.max("_n").alias("_n"), F.max("_q").alias("_q"), *[e for i in range(BINS + 1) for e in ends(i)])

    def edge(i: int) -> Column:
        a, b, h = F.col(f"_a{i}"), F.col(f"_b{i}"), _place(F.lit(i), F.col("_q"), F.col("_n"))
        t = h - F.floor(h)
        return F.when(t < 0.5, a + (b - a) * t).otherwise(b - (b - a) * (F.lit(1.0) - t))

    edges = found.select(key, F.array_sort(F.array_distinct(F.array_compact(F.array(*[edge(i) for i in range(BINS + 1)])))).alias("_edges"))
    edges = edges.select(key, *[F.get("_edges", F.lit(i)).alias(f"_e{i}") for i in range(BINS + 1)])
    lower = sum((F.coalesce((F.col(f"_e{i}") < F.col("_x")).cast("int"), F.lit(0)) for i in range(BINS + 1)), F.lit(0))
    held = ranged.join(edges, key).groupBy(key, F.greatest(lower, F.lit(1)).alias("_bin")).agg(F.sum("_k").alias("_k"))
    total = held.groupBy(key).agg(F.sum("_k").cast("double").alias("n"), F.collect_list(F.col("_k").cast("double")).alias("ks"))
    bits = F.aggregate(F.array_sort("ks"), F.lit(0.0), lambda s, k: s - (k / F.col("n")) * F.log2(k / F.col("n")))
    found = total.select(F.col(key).alias("_key"), (bits + F.lit(0.0)).alias(out))
    keys = rows.select(key).distinct()
    return keys.join(found, F.col(key) == F.col("_key"), "left").select(key, F.coalesce(F.col(out), F.lit(0.0)).alias(out))
