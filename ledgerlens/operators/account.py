"""Deep dive into one account."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.numeric import share


def slice_of(tx: DataFrame, account: str) -> DataFrame:
    """All transactions from or to the account."""
    return tx.where((F.col("account") == account) | (F.col("account_1") == account))


def dataset_stats(tx: DataFrame, account: str) -> DataFrame:
    """One row over all transactions: rows, the account's rows, first and last time."""
    mine = (F.col("account") == account) | (F.col("account_1") == account)
    return tx.agg(
        F.count("*").alias("total_rows"),
        F.count_if(mine).alias("rows_for_account"),
        F.min("ts").alias("min_ts"),
        F.max("ts").alias("max_ts"),
    )


def both_ways(tx: DataFrame, account: str) -> DataFrame:
    """(direction, counterparty, amount and the transaction's columns); a transfer to itself counts both ways."""
    out = tx.where(F.col("account") == account).select(F.lit("out").alias("direction"), F.col("account_1").alias("counterparty"), F.col("amount_paid").alias("amount"), "*")
    into = tx.where(F.col("account_1") == account).select(F.lit("in").alias("direction"), F.col("account").alias("counterparty"), F.col("amount_received").alias("amount"), "*")
    return out.unionByName(into)


def stats(tx: DataFrame, account: str) -> DataFrame:
    """One row of totals."""
    out, into = F.col("direction") == "out", F.col("direction") == "in"
    return both_ways(tx, account).agg(
        F.lit(account).alias("account"),
        F.count("*").alias("total_tx"),
        F.count_if(into).alias("inbound_tx"),
        F.count_if(out).alias("outbound_tx"),
        F.count_distinct("counterparty").alias("unique_counterparties"),
        F.count_distinct(F.when(into, F.col("counterparty"))).alias("unique_inbound"),
        F.count_distinct(F.when(out, F.col("counterparty"))).alias("unique_outbound"),
        F.round(F.try_divide(F.sum("amount").cast("double"), F.count("amount").cast("double")), 6).alias("mean_amount"),
        F.max("amount").cast("double").alias("max_amount"),
    )


def daily(tx: DataFrame, account: str) -> DataFrame:
    """Inbound and outbound sums for every day with either."""
    rows = both_ways(tx, account).dropna(subset=["ts"])
    held = [F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("amount"))), F.lit(0)).cast("double").alias(n) for d, n in (("in", "inbound"), ("out", "outbound"))]
    return rows.groupBy(F.to_date("ts").alias("date")).agg(*held)


def distribution(tx: DataFrame, account: str, column: str) -> DataFrame:
    """Values of a column over the account's transactions both ways, with counts and percentages."""
    counts = both_ways(tx, account).groupBy(F.col(column).alias("category")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("category", "n", F.round(F.col("n") * 100.0 / F.col("total"), 2).alias("percent"))


def currency_column(tx: DataFrame, account: str) -> str:
    """The payment currency if any of the account's rows has one, else the receiving currency."""
    any_paid = slice_of(tx, account).where(F.col("payment_currency").isNotNull()).limit(1).count()
    return "payment_currency" if any_paid else "receiving_currency"


def outbound_summary(tx: DataFrame) -> DataFrame:
    """Per sender: count, sum, mean and largest payment, and the payment formats with their counts as a map."""
    per = tx.dropna(subset=["account"]).groupBy("account", "payment_format").agg(
        F.count("*").alias("n"), F.count("amount_paid").alias("n_paid"), F.sum("amount_paid").alias("s"), F.max("amount_paid").alias("m")
    )
    formats = F.array_sort(F.collect_list(F.when(F.col("payment_format").isNotNull(), F.struct("payment_format", "n"))))
    return per.groupBy("account").agg(
        F.sum("n").alias("tx_count"),
        F.sum("s").cast("double").alias("total_paid"),
        F.round(F.try_divide(F.sum("s").cast("double"), F.sum("n_paid").cast("double")), 6).alias("mean_paid"),
        F.max("m").cast("double").alias("max_paid"),
        F.map_from_entries(formats).alias("formats"),
    )


def label_share(tx: DataFrame, column: str) -> DataFrame:
    """Counts and percentages of a column's values."""
    counts = tx.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(column, "n", F.round(share(F.col("n"), F.col("total"), 12) * 100, 2).alias("pct"))
