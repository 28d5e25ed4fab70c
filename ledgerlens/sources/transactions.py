"""The transactions view over the order tables: one row per transfer from an account to another.

Columns: ts, from_bank, account, to_bank, account_1, amount_received, receiving_currency, amount_paid, payment_currency, payment_format,
is_laundering. Names with a suffix follow the raw file, which repeats the header of the account column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources.tables import table

COLUMNS = (
    "ts",
    "from_bank",
    "account",
    "to_bank",
    "account_1",
    "amount_received",
    "receiving_currency",
    "amount_paid",
    "payment_currency",
    "payment_format",
    "is_laundering",
)


def _holders(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Customers with their bank and currency. Nation and region are fixed lists of a few rows."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"]).select("n_nationkey", "r_name")
    customer = table(spark, sf_dir, "customer")
    return customer.join(F.broadcast(places), customer["c_nationkey"] == places["n_nationkey"]).select(
        F.col("c_custkey").alias(f"{side}_key"),
        F.col("c_nationkey").cast("string").alias(f"{side}_bank"),
        F.col("r_name").alias(f"{side}_currency"),
    )


#: Bytes of a holder's row at most: key, bank and currency.
HOLDER_BYTES = 64
#: Bytes of holders up to which they may be broadcast.
BROADCAST_BYTES = 64 << 20


def transactions(spark: SparkSession, sf_dir: str, wide: bool = True) -> DataFrame:
    """wide=False is for queries that shuffle the transactions once more anyway and read few columns: holders are broadcast, as long as they fit, so the joins with them shuffle nothing."""
    lineitem, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").count()  # from the files' footers
    lines = lineitem.join(orders, lineitem["l_orderkey"] == orders["o_orderkey"]).withColumn(
        "receiver", (F.col("l_partkey") * 31 + F.col("l_suppkey")) % F.lit(customers)
    )
    payer, payee = _holders(spark, sf_dir, "payer"), _holders(spark, sf_dir, "payee")
    if not wide and customers * HOLDER_BYTES <= BROADCAST_BYTES:
        payer, payee = F.broadcast(payer), F.broadcast(payee)
    joined = lines.join(payer, lines["o_custkey"] == payer["payer_key"]).join(payee, lines["receiver"] == payee["payee_key"])
    seconds = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 86400
    paid = F.col("l_extendedprice").cast("decimal(18,2)")
    received = (paid * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(18,2)")
    account, account_1 = F.col("o_custkey").cast("string"), F.col("payee_key").cast("string")
    return joined.select(
        (F.col("o_orderdate") + F.make_dt_interval(secs=seconds)).alias("ts"),
        F.col("payer_bank").alias("from_bank"),
        account.alias("account"),
        F.col("payee_bank").alias("to_bank"),
        account_1.alias("account_1"),
        received.alias("amount_received"),
        F.col("payee_currency").alias("receiving_currency"),
        paid.alias("amount_paid"),
        F.col("payer_currency").alias("payment_currency"),
        F.when(account == account_1, "Reinvestment").otherwise(F.col("o_orderpriority")).alias("payment_format"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09), 1).otherwise(0).alias("is_laundering"),
    )


#: The same view in DuckDB; queries go on with ", x as (...)" or " select ...".
SQL = """
with tx as (
  select o_orderdate + to_seconds((l_orderkey * 7919 + l_linenumber * 104729) % 86400) as ts,
    cast(c1.c_nationkey as varchar) as from_bank, cast(o_custkey as varchar) as account,
    cast(c2.c_nationkey as varchar) as to_bank, cast(c2.c_custkey as varchar) as account_1,
    cast(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2))) as decimal(18,2)) as amount_received,
    r2.r_name as receiving_currency, cast(l_extendedprice as decimal(18,2)) as amount_paid, r1.r_name as payment_currency,
    case when o_custkey = c2.c_custkey then 'Reinvestment' else o_orderpriority end as payment_format,
    case when l_returnflag = 'R' and l_discount >= 0.09 then 1 else 0 end as is_laundering
  from lineitem join orders on l_orderkey = o_orderkey join customer c1 on o_custkey = c1.c_custkey
  join customer c2 on c2.c_custkey = (l_partkey * 31 + l_suppkey) % (select count(*) from customer)
  join nation n1 on c1.c_nationkey = n1.n_nationkey join region r1 on n1.n_regionkey = r1.r_regionkey
  join nation n2 on c2.c_nationkey = n2.n_nationkey join region r2 on n2.n_regionkey = r2.r_regionkey
)"""
