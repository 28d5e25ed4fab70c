"""Transaction and account features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.entropy import binned_entropy
from ledgerlens.functions.numeric import as_double, finite_or_zero
from ledgerlens.functions.storage import stored

#: Columns of the account features, in order.
ACCOUNT_FEATURES = (
    "total_out_tx total_out_amt max_out_amt entropy_out_amt total_in_tx total_in_amt max_in_amt entropy_in_amt net_flow_amt unique_receivers unique_senders hhi_out hhi_in"
).split()


def basic_casts(raw: DataFrame) -> DataFrame:
    """Amounts to numbers, the label to 0 or 1 with null as 0, the rest to text."""
    out = []
    for c in raw.columns:
        if c.startswith("amount"):
            out.append(F.expr(f"try_cast(`{c}` as double)").alias(c))
        elif c == "is_laundering":
            out.append(F.coalesce(F.expr(f"try_cast(`{c}` as int)"), F.lit(0)).alias(c))
        elif c == "ts":
            out.append(F.col(c))
        else:
            out.append(F.col(c).cast("string").alias(c))
    return raw.select(*out)


def ensure_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """df with a null double for every name that it lacks."""
    return df.select("*", *[F.lit(None).cast("double").alias(n) for n in names if n not in df.columns])


def tx_features(tx: DataFrame) -> DataFrame:
    """tx with same_bank, amount_ratio (paid to received), is_reinvestment, weekday (Monday 0) and hour."""
    paid, received = as_double("amount_paid"), as_double("amount_received")
    return tx.select(
        "*",
        F.coalesce((F.col("from_bank") == F.col("to_bank")).cast("int"), F.lit(0)).alias("same_bank"),
        F.when(received > 0, F.round(paid / received, 6)).alias("amount_ratio"),
        F.coalesce(F.lower("payment_format").contains("reinvest").cast("int"), F.lit(0)).alias("is_reinvestment"),
        F.weekday("ts").alias("weekday_of_transaction"),
        F.hour("ts").alias("hour_of_transaction"),
    )


def model_features(tx: DataFrame) -> DataFrame:
    """The smaller feature set of the detectors that work on transactions alone."""
    return tx.select(
        "*",
        F.hour("ts").alias("hour"),
        F.abs(F.col("amount_paid") - F.col("amount_received")).cast("double").alias("amount_diff"),
        F.coalesce((F.col("account") == F.col("account_1")).cast("int"), F.lit(0)).alias("same_account"),
        F.coalesce((F.col("from_bank") == F.col("to_bank")).cast("int"), F.lit(0)).alias("same_bank"),
    )


def categories(df: DataFrame, column: str) -> list[str]:
    """The sorted categories of a column. A one-hot column is made for each, so they have to be few."""
    value = F.coalesce(F.nullif(F.lower(F.trim(F.col(column).cast("string"))), F.lit("nan")), F.lit("unknown"))
    return [r[0] for r in df.select(value.alias("v")).distinct().orderBy("v").collect()]


def one_hot(df: DataFrame, column: str, prefix: str, drop_first: bool = False, keep: bool = False) -> DataFrame:
    """A 0/1 column prefix_<category> for every category, in place of the column."""
    value = F.coalesce(F.nullif(F.lower(F.trim(F.col(column).cast("string"))), F.lit("nan")), F.lit("unknown"))
    found = categories(df, column)[1 if drop_first else 0 :]
    rest = [F.col(c) for c in df.columns if keep or c != column]
    return df.select(*rest, *[(value == v).cast("int").alias(f"{prefix}_{v}") for v in found])


def collapse_rare(df: DataFrame, column: str, k: int = 6) -> DataFrame:
    """df with all but the k most frequent values of a column as Other."""
    top = df.groupBy(column).agg(F.count("*").alias("n")).dropna(subset=[column]).orderBy(F.desc("n"), column).limit(k).select(F.col(column).alias("_kept"))
    joined = df.join(F.broadcast(top), F.col(column) == F.col("_kept"), "left")  # k rows
    return joined.select(*[F.coalesce("_kept", F.lit("Other")).alias(c) if c == column else F.col(c) for c in df.columns])


def clean_numeric(df: DataFrame) -> DataFrame:
    """Nulls and infinities of numeric columns to 0."""
    out = []
    for c, kind in df.dtypes:
        if kind in ("double", "float"):
            out.append(finite_or_zero(F.col(c)).alias(c))
        elif kind in ("int", "bigint", "smallint", "tinyint") or kind.startswith("decimal"):
            out.append(F.coalesce(F.col(c), F.lit(0).cast(kind)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def _one_way(tx: DataFrame, account: str, other: str, amount: str, way: str, partners: str) -> DataFrame:
    """All features of one direction. Totals, partners and their concentration come from one aggregate by pair, so a busy account's rows are added up before they meet."""
    keyed = tx.dropna(subset=[account]).select(F.col(account).alias("account"), F.col(other).alias("partner"), F.col(amount).alias("amount"))
    pairs = keyed.groupBy("account", "partner").agg(F.count("*").alias("c"), F.sum("amount").alias("s"), F.max("amount").alias("m"))
    c = F.col("c").cast("double")
    money = pairs.groupBy("account").agg(
        F.sum("c").alias(f"total_{way}_tx"),
        F.coalesce(F.sum("s"), F.lit(0)).cast("double").alias(f"total_{way}_amt"),
        F.max("m").cast("double").alias(f"max_{way}_amt"),
        F.count("partner").alias(partners),
        F.round(F.sum(c * c) / (F.sum(c) * F.sum(c)), 6).alias(f"hhi_{way}"),
    )
    bits = binned_entropy(keyed, "account", "amount", "_entropy")
    return money.join(bits.select("account", F.round("_entropy", 6).alias(f"entropy_{way}_amt")), "account")


def account_features(tx: DataFrame) -> DataFrame:
    """One row per account that sends or receives: counts, sums, maxima and entropies each way, net flow, partners and their concentration."""
    tx = stored(tx.select("account", "account_1", "amount_paid", "amount_received"), "amounts")  # read four times, for totals and entropy each way
    out = _one_way(tx, "account", "account_1", "amount_paid", "out", "unique_receivers")
    into = _one_way(tx, "account_1", "account", "amount_received", "in", "unique_senders")
    both = out.join(into, "account", "full")
    net = F.round(F.coalesce("total_out_amt", F.lit(0.0)) - F.coalesce("total_in_amt", F.lit(0.0)), 6)
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("unique_receivers", "unique_senders", "hhi_out", "hhi_in")}
    return both.withColumn("net_flow_amt", net).select("account", *[zero.get(c, F.col(c)) for c in ACCOUNT_FEATURES])


def attach_context(tx: DataFrame, accounts: DataFrame) -> DataFrame:
    """tx with the sender's features under _s and the receiver's under _r."""
    sender = accounts.select(*[F.col(c).alias(f"{c}_s") for c in accounts.columns])
    receiver = accounts.select(*[F.col(c).alias(f"{c}_r") for c in accounts.columns])
    return tx.join(sender, tx["account"] == F.col("account_s"), "left").join(receiver, tx["account_1"] == F.col("account_r"), "left")
