"""Fan-out and fan-in over a stream of transactions, with event-time windows.

Exact distinct counts need unbounded state, so partners are counted approximately here; the batch operators are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.typology import account_key


def _timed(tx: DataFrame, delay: str) -> DataFrame:
    return tx.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def fan_out_stream(tx: DataFrame, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    rows = _timed(tx, delay).groupBy(F.window("ts", width), "from_bank", "account").agg(
        F.approx_count_distinct(account_key("to_bank", "account_1")).alias("unique_recipients"), F.sum("amount_received").alias("total_amount")
    )
    return rows.select(F.col("window.start").alias("bucket"), "from_bank", "account", "unique_recipients", "total_amount")


def fan_in_stream(tx: DataFrame, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    rows = _timed(tx, delay).groupBy(F.window("ts", width), "account_1").agg(
        F.approx_count_distinct("account").alias("unique_senders"), F.sum("amount_received").alias("total_received"), F.count("amount_received").alias("transaction_count")
    )
    return rows.select(F.col("window.start").alias("bucket"), "account_1", "unique_senders", "total_received", "transaction_count")
