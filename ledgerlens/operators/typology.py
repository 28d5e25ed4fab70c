"""Laundering typologies: fan-out, fan-in, scatter-gather, gather-scatter."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.functions.numeric import mean_and_sigma, quantile

_UNITS = {"s": 1, "sec": 1, "min": 60, "t": 60, "h": 3600, "d": 86400}


def seconds_of(freq: str) -> int:
    """'1H', '30min', '10h', '1D' in seconds."""
    found = re.fullmatch(r"\s*(\d*)\s*([a-zA-Z]+)\s*", freq)
    if not found or found[2].lower() not in _UNITS:
        raise ValueError(f"not a width: {freq!r}")
    return int(found[1] or 1) * _UNITS[found[2].lower()]


def bucket(df: DataFrame, freq: str, ts: str = "ts") -> Column:
    """Start of ts' bucket. Buckets are counted from midnight of the first day in the data; for widths that divide a day that is the same as from any midnight."""
    width = seconds_of(freq)
    if 86400 % width == 0:
        return F.window(ts, f"{width} seconds")["start"].cast("timestamp_ntz")
    first = df.agg(F.date_trunc("day", F.min(ts)).cast("timestamp_ntz")).first()[0]
    if first is None:
        return F.col(ts)
    origin = F.lit(first).cast("timestamp_ntz")
    passed = F.timestamp_diff("SECOND", origin, F.col(ts))
    return F.timestamp_add("SECOND", (F.floor(passed / width) * width).cast("int"), origin).cast("timestamp_ntz")


def account_key(bank: str, account: str) -> Column:
    """Bank and account as one key that is never null."""
    return F.concat_ws("_", F.coalesce(bank, F.lit("nan")), F.coalesce(account, F.lit("nan")))


def fan_out_groups(tx: DataFrame, freq: str = "1H") -> DataFrame:
    """Different recipients and the amount received, per sending bank, account and bucket."""
    rows = tx.withColumn("bucket", bucket(tx, freq)).dropna(subset=["from_bank", "account", "bucket"])
    return rows.groupBy("from_bank", "account", "bucket").agg(
        F.count_distinct(account_key("to_bank", "account_1")).alias("unique_recipients"),
        F.coalesce(F.sum("amount_received"), F.lit(0)).cast("double").alias("total_amount"),
    )


def fan_in_groups(tx: DataFrame, freq: str = "1H") -> DataFrame:
    """Different senders, the amount received and the transactions, per receiving account and bucket."""
    rows = tx.withColumn("bucket", bucket(tx, freq)).dropna(subset=["account_1", "bucket"])
    return rows.groupBy("bucket", "account_1").agg(
        F.count_distinct("account").alias("unique_senders"),
        F.coalesce(F.sum("amount_received"), F.lit(0)).cast("double").alias("total_received"),
        F.count("amount_received").alias("transaction_count"),
    )


def with_zscore(groups: DataFrame, column: str, threshold: float = 3.0) -> DataFrame:
    """z over all groups with population sigma; no spread means no outlier."""
    facts = groups.agg(*mean_and_sigma(F.col(column)))  # one row
    z = F.try_divide(F.col(column) - F.col("mu"), F.col("sigma"))
    return (
        groups.crossJoin(F.broadcast(facts))
        .withColumn("z_score", F.round(z, 6))
        .withColumn("is_outlier", F.coalesce(z > threshold, F.lit(False)))
        .drop("mu", "sigma")
    )


def with_percentile(groups: DataFrame, column: str, percent: float) -> DataFrame:
    """Outliers lie above the percentile of all groups."""
    facts = groups.agg(quantile(column, percent / 100).alias("percentile_threshold"))  # one row
    return groups.crossJoin(F.broadcast(facts)).withColumn(
        "is_outlier", F.coalesce(F.col(column) > F.col("percentile_threshold"), F.lit(False))
    )


def fan_out_zscore(tx: DataFrame, freq: str = "1H", threshold: float = 3.0) -> DataFrame:
    return with_zscore(fan_out_groups(tx, freq), "unique_recipients", threshold)


def fan_out_percentile(tx: DataFrame, freq: str = "1H", percent: float = 95) -> DataFrame:
    return with_percentile(fan_out_groups(tx, freq), "unique_recipients", percent).drop("percentile_threshold")


def fan_out_suspicious(tx: DataFrame, freq: str = "1H", threshold: float = 3.0) -> DataFrame:
    """Only the outliers, most recipients first."""
    return fan_out_zscore(tx, freq, threshold).where("is_outlier").drop("is_outlier").orderBy(F.desc("unique_recipients"), "from_bank", "account", "bucket")


def fan_in_zscore(tx: DataFrame, freq: str = "1H", threshold: float = 3.0) -> DataFrame:
    return with_zscore(fan_in_groups(tx, freq), "unique_senders", threshold)


def fan_in_percentile(tx: DataFrame, freq: str = "1H", percent: float = 99) -> DataFrame:
    return with_percentile(fan_in_groups(tx, freq), "unique_senders", percent)


def fan_in_percent_rank(tx: DataFrame, threshold: float = 95) -> DataFrame:
    """Every transaction, with the day and whether the receiver's senders of that day rank above the percent of the receiver's own days."""
    rows = tx.withColumn("date", F.to_date("ts"))
    sender, receiver = account_key("from_bank", "account"), account_key("to_bank", "account_1")
    days = rows.groupBy(receiver.alias("_receiver"), F.col("date").alias("_date")).agg(F.count_distinct(sender).alias("n"))
    rank = F.cume_dist().over(W.partitionBy("_receiver").orderBy("n")) * 100
    flags = days.withColumn("is_fan_in", rank > threshold)
    at = (receiver == F.col("_receiver")) & F.col("date").eqNullSafe(F.col("_date"))
    return rows.join(flags, at, "left").select(*rows.columns, F.coalesce("is_fan_in", F.lit(False)).alias("is_fan_in"))


def _partners(tx: DataFrame, key: str, other: str) -> DataFrame:
    """Different partners per account, counted over different pairs."""
    return tx.dropna(subset=[key]).groupBy(key).agg(F.count_distinct(other).alias("partners"))


def _many(counts: DataFrame, key: str, percent: float) -> DataFrame:
    limit = counts.agg(quantile("partners", percent / 100).alias("threshold"))
    return counts.crossJoin(F.broadcast(limit)).where(F.col("partners") >= F.col("threshold")).select(key, "partners", "threshold")


def scatter_accounts(tx: DataFrame, percent: float = 95) -> DataFrame:
    return _many(_partners(tx, "account", "account_1"), "account", percent)


def gather_accounts(tx: DataFrame, percent: float = 95) -> DataFrame:
    return _many(_partners(tx, "account_1", "account"), "account_1", percent)


def scatter_gather(tx: DataFrame, percent: float = 95) -> DataFrame:
    """Transactions from a scatter account or to a gather account."""
    out = scatter_accounts(tx, percent).select(F.col("account").alias("_s"), F.lit(True).alias("_from"))
    into = gather_accounts(tx, percent).select(F.col("account_1").alias("_g"), F.lit(True).alias("_to"))
    marked = tx.join(out, F.col("account") == F.col("_s"), "left").join(into, F.col("account_1") == F.col("_g"), "left")
    return marked.where(F.coalesce("_from", "_to")).select(tx.columns)


def gather_scatter_accounts(tx: DataFrame, percent: float = 95) -> DataFrame:
    """Gather accounts that also scatter, by the percentile among the gather accounts."""
    gather = gather_accounts(tx, percent).select(F.col("account_1").alias("account"))
    return _many(_partners(tx.join(gather, "account", "left_semi"), "account", "account_1"), "account", percent)


def gather_scatter(tx: DataFrame, percent: float = 95) -> DataFrame:
    """The different transactions from or to those accounts."""
    chosen = gather_scatter_accounts(tx, percent).select("account")
    out, into = chosen.select(F.col("account").alias("_s"), F.lit(True).alias("_from")), chosen.select(F.col("account").alias("_g"), F.lit(True).alias("_to"))
    marked = tx.join(out, F.col("account") == F.col("_s"), "left").join(into, F.col("account_1") == F.col("_g"), "left")
    return marked.where(F.coalesce("_from", "_to")).select(tx.columns).distinct()


def fan_report(groups: DataFrame, partners: str) -> DataFrame:
    """One row: groups, groups with more than one partner, flagged groups, most partners."""
    flagged = F.count_if("is_outlier") if "is_outlier" in groups.columns else F.lit(0).cast("long")
    return groups.agg(
        F.count("*").alias("n_groups"),
        F.count_if(F.col(partners) > 1).alias("n_with_several"),
        flagged.alias("n_flagged"),
        F.max(partners).alias("most_partners"),
    )


def recipients_histogram(groups: DataFrame, account: str = "account", partners: str = "unique_recipients") -> DataFrame:
    """How many accounts have which largest number of partners in a bucket."""
    most = groups.groupBy(account).agg(F.max(partners).alias("most_partners"))
    return most.groupBy("most_partners").agg(F.count("*").alias("n_accounts")).orderBy("most_partners")


def scatter_gather_report(tx: DataFrame, percent: float = 95) -> DataFrame:
    """One row: the sizes of the scatter, gather and gather-scatter account sets and of the transactions that they select."""
    counts = [
        scatter_accounts(tx, percent).agg(F.count("*").alias("n_scatter"), F.max("threshold").alias("scatter_threshold")),
        gather_accounts(tx, percent).agg(F.count("*").alias("n_gather"), F.max("threshold").alias("gather_threshold")),
        scatter_gather(tx, percent).agg(F.count("*").alias("n_transactions")),
    ]
    out = counts[0]
    for other in counts[1:]:
        out = out.crossJoin(F.broadcast(other))  # one row each
    return out
