"""Account and bank graphs, ego networks, busiest accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.storage import stored


def account_edges(tx: DataFrame) -> DataFrame:
    """Directed edges with their transactions; self-loops stay."""
    return tx.dropna(subset=["account", "account_1"]).groupBy(F.col("account").alias("source"), F.col("account_1").alias("target")).agg(
        F.count("*").alias("weight")
    )


def account_nodes(tx: DataFrame) -> DataFrame:
    both = tx.select(F.col("account").alias("id")).union(tx.select("account_1"))
    return both.dropna().distinct()


def bank_edges(tx: DataFrame) -> DataFrame:
    """Undirected edges between banks; a pair is ordered as numbers if both are numbers and else as text."""
    a, b = F.expr("try_cast(from_bank as bigint)"), F.expr("try_cast(to_bank as bigint)")
    turned = F.coalesce(a > b, F.col("from_bank") > F.col("to_bank"))
    low = F.when(turned, F.col("to_bank")).otherwise(F.col("from_bank"))
    high = F.when(turned, F.col("from_bank")).otherwise(F.col("to_bank"))
    return tx.dropna(subset=["from_bank", "to_bank"]).groupBy(low.alias("source"), high.alias("target")).agg(
        F.count("*").alias("number_of_transactions")
    )


def bank_nodes(tx: DataFrame) -> DataFrame:
    """Banks with their number of different accounts."""
    held = tx.select(F.col("from_bank").alias("id"), "account").union(tx.select("to_bank", "account_1")).dropna(subset=["id"])
    return held.distinct().groupBy("id").agg(F.count("account").alias("number_of_accounts")).select("id", F.col("id").alias("label"), "number_of_accounts")


def directed_edges(tx: DataFrame) -> DataFrame:
    """Directed edges without self-loops."""
    return account_edges(tx).where(F.col("source") != F.col("target"))


def directed_nodes(tx: DataFrame) -> DataFrame:
    edges = directed_edges(tx)
    return edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()


def _amount(preference: str) -> Column:
    paid, received = F.col("amount_paid"), F.col("amount_received")
    if preference == "paid":
        return F.coalesce(paid, received, F.lit(0))
    if preference == "received":
        return F.coalesce(received, paid, F.lit(0))
    if preference == "both_sum":
        return F.coalesce(paid, F.lit(0)) + F.coalesce(received, F.lit(0))
    raise ValueError(f"not an amount preference: {preference!r}")


def undirected_edges(tx: DataFrame, preference: str = "paid") -> DataFrame:
    """Pairs in the order of text, without self-loops."""
    rows = tx.dropna(subset=["account", "account_1"]).where(F.col("account") != F.col("account_1"))
    return rows.groupBy(F.least("account", "account_1").alias("source"), F.greatest("account", "account_1").alias("target")).agg(
        F.count("*").alias("tx_count"), F.sum(_amount(preference)).cast("double").alias("amount_sum")
    )


def ego_ball(tx: DataFrame, ego: str, k: int = 1) -> DataFrame:
    """(id): accounts within k steps of ego, itself included; empty if ego has no transaction with another account.

    Each step joins the frontier with the edges and leaves out what was reached before; every third step is a table of the shared folder.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    pairs = undirected_edges(tx)
    steps = pairs.select(F.col("source").alias("a"), F.col("target").alias("b"))
    steps = steps.union(steps.select("b", "a"))
    seen = steps.where(F.col("a") == ego).select(F.col("a").alias("id")).distinct()
    frontier = seen
    for step in range(k):
        reached = frontier.join(steps, frontier["id"] == steps["a"]).select(F.col("b").alias("id")).distinct()
        frontier = reached.join(seen, "id", "left_anti")
        if step % 3 == 2 and step + 1 < k:
            frontier = stored(frontier, "frontier")
        seen = seen.union(frontier)
    return seen


def ego_nodes(tx: DataFrame, ego: str, k: int = 1) -> DataFrame:
    return ego_ball(tx, ego, k).where(F.col("id") != ego)


def ego_edges(tx: DataFrame, ego: str, k: int = 1, preference: str = "paid", alters: bool = True) -> DataFrame:
    """Edges with both ends in the ball; without alters, only those at ego."""
    ball = stored(ego_ball(tx, ego, k), "ball")  # read for both ends
    rows = tx.join(ball.select(F.col("id").alias("account")), "account", "left_semi").join(
        ball.select(F.col("id").alias("account_1")), "account_1", "left_semi"
    )
    edges = undirected_edges(rows, preference)
    if not alters:
        edges = edges.where((F.col("source") == ego) | (F.col("target") == ego))
    return edges.select("source", "target", F.lit("Undirected").alias("type"), "tx_count", "amount_sum")


def busiest(tx: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n accounts with most transactions in a column; blank names don't count."""
    if column not in tx.columns:
        raise KeyError(column)
    named = tx.where(F.col(column).isNotNull() & ~F.trim(column).isin("", "nan", "NaN"))
    return named.groupBy(F.col(column).alias("account")).agg(F.count("*").alias("tx_count")).orderBy(F.desc("tx_count"), "account").limit(n)


def date_range(tx: DataFrame) -> DataFrame:
    return tx.agg(F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))
