"""Queries: model matrices, profiles, conversion, detectors, evaluation. Each stands beside its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions.numeric import rounded
from ledgerlens.functions.storage import stored
from ledgerlens.operators import columns as cols
from ledgerlens.operators import convert, evaluate, features, models, prep, profile
from ledgerlens.plans.detection import _ACCOUNTS, _CURRENCIES, _FEATURES, _FORMATS
from ledgerlens.plans.runs import build_features, points_report
from ledgerlens.sources import csv
from ledgerlens.sources.transactions import SQL, transactions

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, **view):
    def register(f):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(transactions(spark, sf_dir, **view))
        if sql:
            ORACLES[name] = SQL + sql
        return f

    return register


def _rounded(df, digits=6):
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes])


NUMBERS = ("amount_paid", "amount_received", "is_laundering")
TEXTS = ("from_bank", "account", "to_bank", "account_1", "payment_currency", "payment_format", "receiving_currency")
ALL = ("ts", *TEXTS, *NUMBERS)


def _each(columns, template: str) -> str:
    return " union all ".join(template.format(c=c) for c in columns)


def _scaled(columns, keep: str, table: str = "m") -> str:
    """SQL that scales the columns of a table by their medians and quartiles."""
    q = ", ".join(f"quantile_cont({c}::double, [0.25, 0.5, 0.75]) as q_{c}" for c in columns)
    each = ", ".join(f"round(({c}::double - q_{c}[2]) / coalesce(nullif(q_{c}[3] - q_{c}[1], 0), 1), 6) as {c}" for c in columns)
    return f", q as (select {q} from {table}) select {keep}, {each} from {table}, q"


_LOGS = ("total_out_amt", "max_out_amt", "total_in_amt", "max_in_amt")
_ZERO = ("entropy_out_amt", "entropy_in_amt", "hhi_out", "hhi_in", "unique_receivers", "unique_senders")
_NET = "sign(coalesce(net_flow_amt, 0)) * ln(1 + abs(coalesce(net_flow_amt, 0))) as net_flow_amt"


@query(_FEATURES + _ACCOUNTS + ", m as (select account, " + ", ".join(
    [f"coalesce({c}, 0) as {c}" for c in ("total_out_tx", "total_in_tx", *_ZERO)] + [f"ln(1 + greatest(coalesce({c}, 0), 0)) as {c}" for c in _LOGS] + [_NET]
) + " from acc)" + _scaled(features.ACCOUNT_FEATURES, "account"))
def pre_model_accounts(tx):
    clean = features.clean_numeric(features.account_features(tx))
    return _rounded(prep.pre_model(clean, prep.MatrixConfig(keep=("account",))))


_GAPS = ", ".join(f"case when account::int % 3 = 0 then null else {c} end as {c}" for c in ("total_out_amt", "entropy_out_amt", "hhi_in", "unique_senders"))
_FLAGGED = tuple(f"{c}_missing" for c in ("entropy_out_amt", "hhi_in", "unique_senders"))


@query(_FEATURES + _ACCOUNTS + f", g as (select account, net_flow_amt, {_GAPS} from acc), h as (select account, " + ", ".join(
    [f"coalesce({c}, 0) as {c}" for c in ("entropy_out_amt", "hhi_in", "unique_senders")]
    + [f"cast({c} is null as double) as {c}_missing" for c in ("entropy_out_amt", "hhi_in", "unique_senders")] + [_NET, "case when total_out_amt is not null then ln(1 + greatest(total_out_amt, 0)) end as total_out_amt"]
) + " from g), m as (select * replace (coalesce(total_out_amt, (select quantile_cont(total_out_amt, 0.5) from h)) as total_out_amt) from h)"
  + _scaled(("total_out_amt", "entropy_out_amt", "hhi_in", "unique_senders", "net_flow_amt", *_FLAGGED), "account"))
def pre_model_gaps(tx):
    """The matrix of accounts a third of which lack some features: flags, zeros and medians."""
    lacks = F.col("account").cast("int") % 3 == 0
    some = features.account_features(tx).select("account", "net_flow_amt", *[F.when(~lacks, F.col(c)).alias(c) for c in ("total_out_amt", "entropy_out_amt", "hhi_in", "unique_senders")])
    return _rounded(prep.pre_model(some, prep.MatrixConfig(keep=("account",))))


@query(""", m as (select account, ts, ln(1 + greatest(amount_paid::double, 0)) as amount_paid, isodow(ts) - 1 as weekday_of_transaction, hour(ts) as hour_of_transaction from tx)"""
  + _scaled(("amount_paid", "weekday_of_transaction", "hour_of_transaction"), "account, ts"))
def pre_model_times(tx):
    """Weekday and hour are derived where the table has none."""
    return _rounded(prep.pre_model(tx.select("account", "ts", "amount_paid"), prep.MatrixConfig(keep=("account", "ts"))))


@query(""", m as (select account, ts, 1.0::double as same, is_laundering, ln(1 + greatest(amount_paid::double, 0)) as amount_paid, ln(1 + greatest((amount_paid - amount_received)::double, 0)) as net_flow_amt from tx)"""
  + _scaled(("same", "is_laundering", "amount_paid", "net_flow_amt"), "account, ts"))
def pre_model_legacy(tx):
    df = tx.select("account", "ts", F.lit(1.0).alias("same"), "is_laundering", "amount_paid", (F.col("amount_paid") - F.col("amount_received")).alias("net_flow_amt"))
    cfg = prep.MatrixConfig.legacy()
    cfg.keep = ("account", "ts")
    return _rounded(prep.pre_model(df, cfg))


_TX_COLUMNS = ("amount_paid", "amount_received", "same_bank", "amount_ratio", "is_reinvestment", "weekday_of_transaction", "hour_of_transaction")


@query(_FEATURES + """, m as (select is_laundering, ln(1 + cast(amount_paid as double)) as amount_paid, ln(1 + cast(amount_received as double)) as amount_received, same_bank, amount_ratio, is_reinvestment, weekday_of_transaction,
  hour_of_transaction from t)""" + _scaled(_TX_COLUMNS, "is_laundering"))
def pre_model_tx(tx):
    return _rounded(prep.pre_model(features.tx_features(tx), prep.MatrixConfig(keep=("is_laundering",))))


@query(""", q as (select quantile_cont(cast(amount_paid as double), [0.25, 0.5, 0.75]) as p, quantile_cont(cast(amount_received as double), [0.25, 0.5, 0.75]) as r from tx)
select account, account_1, ts, round((amount_paid::double - p[2]) / (p[3] - p[1]), 6) as amount_paid, round((amount_received::double - r[2]) / (r[3] - r[1]), 6) as amount_received from tx, q""")
def robust_scale(tx):
    return _rounded(prep.robust_scale(tx.select("account", "account_1", "ts", "amount_paid", "amount_received"), ["amount_paid", "amount_received"]))


@query(""", q as (select avg(amount_paid::double) as mp, stddev_pop(amount_paid::double) as sp, avg(amount_received::double) as mr, stddev_pop(amount_received::double) as sr from tx)
select account, account_1, ts, round((amount_paid::double - mp) / sp, 5) as amount_paid, round((amount_received::double - mr) / sr, 5) as amount_received from tx, q""")
def standard_scale(tx):
    return _rounded(prep.standard_scale(tx.select("account", "account_1", "ts", "amount_paid", "amount_received"), ["amount_paid", "amount_received"]), 5)


_KINDS = {"ts": "timestamp_ntz", "amount_paid": "decimal(18,2)", "amount_received": "decimal(18,2)", "is_laundering": "int"}


@query(" " + " union all ".join(
    f"select '{c}' as \"column\", '{_KINDS.get(c, 'string')}' as dtype, count(*) - count({c}) as missing_count, round((count(*) - count({c}))::double / count(*), 6) as missing_ratio, count(distinct {c}) as n_unique_nonnull from tx"
    for c in ALL
))
def missingness(tx):
    return profile.missingness(tx)


_COUNTED = """count(*) filter ({out}) as outlier_count, round(count(*) filter ({out})::double / count({{c}}), 6) as outlier_ratio"""


@query(" " + _each(NUMBERS, """select '{c}' as "column", 'IQR(k=1.5)' as method, count({c}) as nonnull, """ + _COUNTED.format(out="b > a and ({c}::double < lo or {c}::double > hi)")
  + """, round(any_value(case when b > a then lo else a end), 6) as bound_lo, round(any_value(case when b > a then hi else b end), 6) as bound_hi, null::double as mad_center, null::double as mad_scale,
  min({c})::double as min, max({c})::double as max
  from tx, (select a, b, a - 1.5::double * (b - a) as lo, b + 1.5::double * (b - a) as hi from (select quantile_cont({c}::double, 0.25) as a, quantile_cont({c}::double, 0.75) as b from tx))"""))
def outliers_iqr(tx):
    return profile.outliers_iqr(tx)


@query(" " + _each(NUMBERS, """select '{c}' as "column", 'MAD(z>3.5)' as method, count({c}) as nonnull, """ + _COUNTED.format(out="abs({c}::double - m) * 0.6745::double / nullif(d, 0) > 3.5")
  + """, null::double as bound_lo, null::double as bound_hi, round(any_value(m), 6) as mad_center, round(any_value(d), 6) as mad_scale, min({c})::double as min, max({c})::double as max
  from tx, (select m, (select quantile_cont(abs({c}::double - m), 0.5) from tx) as d from (select quantile_cont({c}::double, 0.5) as m from tx))"""))
def outliers_mad(tx):
    return profile.outliers_mad(tx)


_HINTED = (*NUMBERS, "spread")


@query(", y as (select amount_paid, amount_received, is_laundering, exp(amount_paid::double / 5000) as spread from tx) " + _each(_HINTED, """select '{c}' as "column", wide or skewed as suggest_scale, skewed as suggest_robust_scaler,
  mn >= 0 and skewed as suggest_log1p, round(sk, 6) as skew, round(p01, 6) as p01, round(p99, 6) as p99,
  concat_ws(';', case when wide then 'wide_scale(p99/p01≈' || format('{{:.1f}}', ratio) || ')' end, case when skewed then 'skew≈' || format('{{:.2f}}', sk) end, case when mn >= 0 and skewed then 'nonnegative+skew→log1p_candidate' end) as rationale
  from (select *, abs(p99) / greatest(abs(p01), 1e-12::double) as ratio, abs(p99) / greatest(abs(p01), 1e-12::double) >= 1000 as wide, abs(sk) >= 1 as skewed from (select skewness({c}::double) as sk, quantile_cont({c}::double, 0.01) as p01, quantile_cont({c}::double, 0.99) as p99, min({c})::double as mn from y))"""))
def scaling_hints(tx):
    return profile.scaling_hints(tx.select(*NUMBERS, F.exp(F.col("amount_paid").cast("double") / 5000).alias("spread")))


#: Columns with names and numbers of values that the rules turn on: 20 and 200 are few and many, an id's name counts in any case, gaps don't.
_CODED = {
    "payment_format": "payment_format", "twenty": "cast(account as int) % 20", "twenty_one": "cast(account as int) % 21", "two_hundred": "cast(account as int) % 200", "below": "cast(account as int) % 199", "Customer": "'c'",
    "acct id": "cast(account as int) % 3", "order_no": "cast(account as int) % 3", "some": "case when cast(account as int) % 50 = 7 then account || to_bank || ts end",
}


def _coded(tx):
    k = F.col("account").cast("int")
    made = {
        "payment_format": F.col("payment_format"), **{n: (k % m).cast("string") for n, m in (("twenty", 20), ("twenty_one", 21), ("two_hundred", 200), ("below", 199))}, "Customer": F.lit("c"),
        "acct id": (k % 3).cast("string"), "order_no": (k % 3).cast("string"), "some": F.when(k % 50 == 7, F.concat("account", "to_bank", F.col("ts").cast("string"))),
    }
    return tx.select(*[v.alias(n) for n, v in made.items()], (F.col("is_laundering") == 1).alias("flag"))


def _id_like(c: str, e: str) -> str:
    return "true" if c in ("Customer", "acct id") else f"count(distinct {e}) >= 0.98 * count({e})"


@query(" " + " union all ".join(
    f"select *, case when id_like then 'avoid_onehot_idlike' when n_unique_nonnull <= 20 then 'one_hot_ok' when n_unique_nonnull >= 200 then 'high_cardinality' else 'moderate_cardinality' end as encoding_hint "
    f"from (select '{c}' as \"column\", count(distinct {e}) as n_unique_nonnull, {_id_like(c, e)} as id_like from tx)" for c, e in {**_CODED, "flag": "is_laundering = 1"}.items() if c != "flag")
  + " union all select 'flag', count(distinct is_laundering), false, 'one_hot_ok' from tx")
def encoding_hints(tx):
    return profile.encoding_hints(_coded(tx)).drop("note")


@query(" " + " union all ".join(
    f"select '{c}' as \"column\", '{'bool' if c == 'flag' else 'categorical'}' as role, count(distinct {e}) <= 1 as is_constant, {'false' if c == 'flag' else _id_like(c, e)} as is_id_like from tx"
    for c, e in {**_CODED, "flag": "is_laundering = 1"}.items()))
def roles_of_names(tx):
    return profile.roles(_coded(tx))


@query(" " + _each(NUMBERS, "select '{c}' as \"column\", count({c}) as n, round(avg({c}::double), 6) as mean, round(stddev_samp({c}::double), 6) as std, min({c})::double as min, "
  + ", ".join(f"round(quantile_cont({{c}}::double, {p / 100}), 6) as p{p:02d}" for p in (1, 5, 50, 95, 99))
  + ", max({c})::double as max, round(skewness({c}::double), 6) as skew, round(kurtosis({c}::double), 6) as kurtosis from tx"))
def numeric_summary(tx):
    return profile.numeric_summary(tx)


@query(" " + _each(("payment_format", "payment_currency"), """select '{c}' as "column", '{{' || string_agg('"' || v || '":' || n, ',' order by n desc, v) || '}}' as top
  from (select {c} as v, count(*) as n from tx group by 1 order by 2 desc, 1 limit 15)"""))
def top_values(tx):
    return profile.top_values(tx, ["payment_format", "payment_currency"])


@query(""" select account as value, cast(row_number() over (order by count(*) desc, account) as int) as rank, count(*) as count,
  round(count(*) * 100.0::double / (select count(*) from tx), 6) as pct from tx group by 1 order by count(*) desc, account limit 20""")
def value_counts(tx):
    return profile.value_counts(tx, "account", 20)


@query(", c as (select payment_format, count(*)::double as n from tx group by 1), p as (select n / (select sum(n) from c) as p from c) select round(-sum(p * log2(p + 1e-12::double)), 6) as entropy_bits from p")
def category_entropy(tx):
    return profile.category_entropy(tx, "payment_format")


_CORR = _FEATURES + " " + " union all ".join(
    f"select '{a}' as a, '{b}' as b, round(corr({a}::double, {b}::double), 6) as r from t"
    for a, b in (("amount_paid", "amount_received"), ("amount_paid", "amount_ratio"), ("amount_received", "amount_ratio"))
).replace("'amount_paid' as a, 'amount_ratio'", "'amount_paid' as a, 'amount_ratio'")
_PAIRED = ["amount_paid", "amount_received", "amount_ratio"]


@query(_CORR)
def corr_matrix(tx):
    return profile.correlations(features.tx_features(tx), _PAIRED)


@query(_FEATURES + """ select 'amount_paid' as a, 'amount_received' as b, round(corr(amount_paid::double, amount_received::double), 6) as r from t having abs(corr(amount_paid::double, amount_received::double)) >= 0.85""")
def high_corr_pairs(tx):
    return profile.high_correlations(features.tx_features(tx), _PAIRED)


@query(""", k as (select amount_paid::double as p, amount_received::double as r from tx),
rk as (select rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0::double as a, rank() over (order by r) + (count(*) over (partition by r) - 1) / 2.0::double as b from k)
select 'amount_paid' as a, 'amount_received' as b, round(corr(a, b), 6) as r from rk""")
def corr_spearman(tx):
    return profile.correlations(tx, ["amount_paid", "amount_received"], "spearman")


_METRICS = {
    "count": "count(x)", "missing": "count(*) - count(x)", "unique": "count(distinct x)", "min": "min(x)", "q01": "quantile_cont(x, 0.01)", "q05": "quantile_cont(x, 0.05)", "q25": "quantile_cont(x, 0.25)",
    "median": "quantile_cont(x, 0.5)", "q75": "quantile_cont(x, 0.75)", "q95": "quantile_cont(x, 0.95)", "q99": "quantile_cont(x, 0.99)", "max": "max(x)", "mean": "avg(x)", "std": "stddev_samp(x)",
    "mad": "quantile_cont(abs(x - md), 0.5)", "iqr": "quantile_cont(x, 0.75) - quantile_cont(x, 0.25)", "skew": "skewness(x)", "kurtosis": "kurtosis(x)", "zeros": "count(*) filter (x = 0)",
    "positive": "count(*) filter (x > 0)", "negative": "count(*) filter (x < 0)", "iqr_outliers": "count(*) filter (x < q1 - 1.5 * (q3 - q1) or x > q3 + 1.5 * (q3 - q1))", "z_outliers": "count(*) filter (abs(x - mu) / sd > 3)",
}


@query(", f as (select quantile_cont(amount_paid::double, 0.25) as q1, quantile_cont(amount_paid::double, 0.5) as md, quantile_cont(amount_paid::double, 0.75) as q3, avg(amount_paid::double) as mu, stddev_samp(amount_paid::double) as sd from tx), v as (select amount_paid::double as x, f.* from tx, f) "
  + " union all ".join(f"select '{k}' as metric, round(({e})::double, 4) as value from v" for k, e in _METRICS.items()))
def univariate_numeric(tx):
    return profile.univariate_numeric(tx, "amount_paid")


@query(""" select 'count' as metric, '' as key, count(ts)::double as value from tx union all select 'span_days', '', round(date_diff('second', min(ts), max(ts)) / 86400::double, 6) from tx
  union all select 'min', strftime(min(ts), '%Y-%m-%d %H:%M:%S'), null from tx union all select 'max', strftime(max(ts), '%Y-%m-%d %H:%M:%S'), null from tx
  union all select 'weekday', strftime(ts, '%a'), count(*)::double from tx group by 2
  union all (select 'month', strftime(ts, '%Y-%m') as m, count(*)::double from tx group by 2 order by 3 desc, 2 limit 12)""")
def univariate_datetime(tx):
    return profile.univariate_datetime(tx, "ts")


@query(" " + " union all ".join(f"select '{k}' as metric, round(({e})::double, 4) as value from tx" for k, e in {
    "min": "min(length(payment_format))", "q25": "quantile_cont(length(payment_format), 0.25)", "median": "quantile_cont(length(payment_format), 0.5)", "mean": "avg(length(payment_format))",
    "q75": "quantile_cont(length(payment_format), 0.75)", "q95": "quantile_cont(length(payment_format), 0.95)", "max": "max(length(payment_format))"}.items()))
def univariate_text(tx):
    return profile.text_lengths(tx, "payment_format")


@query(" select 'true' as metric, count(*) filter (is_laundering = 1)::double as value from tx union all select 'false', count(*) filter (is_laundering = 0)::double from tx union all select 'true_pct', round(round(count(*) filter (is_laundering = 1)::double / count(*), 8) * 100, 6) from tx")
def univariate_boolean(tx):
    return profile.univariate_boolean(tx.withColumn("flag", F.col("is_laundering") == 1), "flag")


@query(""", f as (select min(amount_paid)::double as a, max(amount_paid)::double as b from tx)
select cast(least(floor((amount_paid::double - a) / ((b - a) / 10)), 9) as int) as bin, round(any_value(a) + least(floor((amount_paid::double - a) / ((b - a) / 10)), 9) * any_value((b - a) / 10), 6) as low,
  round(any_value(a) + (least(floor((amount_paid::double - a) / ((b - a) / 10)), 9) + 1) * any_value((b - a) / 10), 6) as high, count(*) as n from tx, f group by bin, least(floor((amount_paid::double - a) / ((b - a) / 10)), 9)""")
def histogram(tx):
    return profile.histogram(tx, "amount_paid", 10)


@query(" " + " union all ".join(
    f"select '{c}' as \"column\", '{'datetime' if c == 'ts' else 'numeric' if c in NUMBERS else 'categorical'}' as role, count(distinct {c}) <= 1 as is_constant, "
    + ("false" if c in (*NUMBERS, "ts") else "true" if c in ("account", "account_1") else f"count(distinct {c}) >= 0.98 * count({c})") + " as is_id_like from tx" for c in ALL))
def roles(tx):
    return profile.roles(tx)


@query(", n as (select payment_format as value, count(*) as count, max(payment_format) as k from tx group by 1) select value, count from n where try_cast(substr(k, 1, 1) as int) is null order by 2 desc, 1 limit 20")
def convert_failures(tx):
    short = tx.withColumn("code", F.when(F.col("payment_format") == "Reinvestment", F.col("payment_format")).otherwise(F.substring("payment_format", 1, 1)))
    return convert.failures(short, "code", "int")


@query(""" select account, account_1, ts, round(cast(amount_paid as double) * 2) / 2 = round(cast(amount_paid as double)) as is_whole, cast(trunc(cast(amount_paid as double)) as bigint) as as_int,
  case when is_laundering = 1 then true else false end as as_bool, ts as as_time from tx""")
def convert_values(tx):
    text = tx.select("account", "account_1", "ts", F.col("amount_paid").cast("string").alias("a"), F.col("is_laundering").cast("string").alias("b"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("c"), F.col("amount_paid").cast("double").alias("d"))
    return text.select(
        "account", "account_1", "ts", (F.round(F.col("d") * 2) / 2 == F.round("d")).alias("is_whole"),
        convert.converted(F.col("a"), "int").alias("as_int"), convert.converted(F.col("b"), "bool").alias("as_bool"), convert.converted(F.col("c"), "datetime").alias("as_time"),
    )


_PROFILED = {"account": "int", "payment_format": "string", "is_laundering": "bool", "amount_paid": "float", "ts": "datetime"}


@query(" " + " union all ".join(f"select '{c}' as \"column\", cast(0 as bigint) as missing_count, 0.0::double as missing_pct, count({c}) as non_null_count, '{k}' as inferred_dtype from tx" for c, k in _PROFILED.items()))
def csv_profile(tx):
    text = tx.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c == "ts" else F.col(c).cast("string").alias(c) for c in _PROFILED])
    return csv.column_profile(text, list(_PROFILED))


_FLAGS = ", p as (select quantile_cont(amount_paid::double, 0.95) as hi, quantile_cont(amount_received::double, 0.05) as lo from tx), k as (select tx.*, cast(amount_paid::double > hi as int) as big, cast(amount_received::double < lo as int) as small from tx, p)"


def _flags(tx):
    a = models.flagged(tx.withColumn("_p", F.col("amount_paid").cast("double")), "_p", "big", 0.05)
    b = models.flagged(a.withColumn("_r", -F.col("amount_received").cast("double")), "_r", "small", 0.05)
    return b.drop("_p", "_r")


@query(_FLAGS + """ select count(*) filter (is_laundering = 1 and big = 1) as tp, count(*) filter (is_laundering <> 1 and big = 1) as fp, count(*) filter (is_laundering = 1 and big <> 1) as fn, count(*) filter (is_laundering <> 1 and big <> 1) as tn,
  coalesce(round(count(*) filter (is_laundering = 1 and big = 1)::double / nullif(count(*) filter (big = 1), 0), 6), 0) as precision, coalesce(round(count(*) filter (is_laundering = 1 and big = 1)::double / nullif(count(*) filter (is_laundering = 1), 0), 6), 0) as recall,
  coalesce(round(2 * count(*) filter (is_laundering = 1 and big = 1)::double / nullif(count(*) filter (big = 1) + count(*) filter (is_laundering = 1), 0), 6), 0) as f1, round(corr(is_laundering, big), 6) as corr from k""")
def confusion(tx):
    return evaluate.confusion(_flags(tx), "big")


@query(_FLAGS + " select coalesce(cast(is_laundering as varchar), 'All') as is_laundering, coalesce(cast(big as varchar), 'All') as big, count(*) as n from k group by cube (is_laundering, big)")
def crosstab_margins(tx):
    return evaluate.crosstab(_flags(tx), "is_laundering", "big")


@query(_FLAGS + " " + " union all ".join(
    f"select '{n}' as grp, count(*) filter ({w}) as n_flagged, round(count(*) filter ({w})::double / count(*), 6) as share_of_data, count(*) filter ({w} and is_laundering = 1) as n_laundering, "
    f"coalesce(round(count(*) filter ({w} and is_laundering = 1)::double / nullif(count(*) filter ({w}), 0), 6), 0) as laundering_share_among_flagged from k"
    for n, w in (("big", "big = 1"), ("small", "small = 1"), ("both", "big + small = 2"), ("all_rows", "true"))))
def agg_report(tx):
    df = _flags(tx)
    return evaluate.agg_report(df, {"big": F.col("big") == 1, "small": F.col("small") == 1, "both": F.col("big") + F.col("small") == 2})


@query(_FLAGS + " select big + small as anomaly_votes, count(*) as n from k group by 1")
def ensemble_votes(tx):
    return models.vote_distribution(models.votes(_flags(tx), ["big", "small"]))


@query(_FLAGS + " " + " union all ".join(f"select '{f}' as algorithm, cast(sum({f}) as bigint) as n_flagged, round(sum({f})::double / count(*), 6) as share from k" for f in ("big", "small")))
def detector_summary(tx):
    return models.detector_summary(_flags(tx), ["big", "small"])


@query(_FLAGS + """ select account, account_1, ts, big + small as anomaly_votes, 1 as consensus_anomaly, round((amount_paid::double + amount_received::double) / 2, 6) as avg_score from k
  where big + small >= 1 order by anomaly_votes desc, avg_score desc, account, account_1, ts limit 25""")
def top_consensus(tx):
    voted = models.votes(_flags(tx), ["big", "small"], 1).select(
        "account", "account_1", "ts", F.col("amount_paid").cast("double").alias("p"), F.col("amount_received").cast("double").alias("r"), "anomaly_votes", "consensus_anomaly"
    )
    return models.top_consensus(voted, ["p", "r"], 25).drop("p", "r")


_TX = ["amount_paid", "amount_received", "hour_of_transaction"]


@query(_FEATURES + ", n as (select account, account_1, ts, " + ", ".join(f"{c}::double as {c}, -ln(cume_dist() over (order by {c}::double)) as {c}_l, -ln(cume_dist() over (order by {c}::double desc)) as {c}_r" for c in _TX)
  + " from t), s as (select " + ", ".join(f"sign(skewness({c})) as {c}_s" for c in _TX) + " from n) select account, account_1, ts, round("
  + " + ".join(f"greatest(case when {c}_s < 0 then {c}_l when {c}_s > 0 then {c}_r else {c}_l + {c}_r end, ({c}_l + {c}_r) / 2)" for c in _TX) + ", 6) as copod_score from n, s")
def copod_scores(tx):
    df = features.tx_features(tx)
    return models.copod_scores(df, _TX).select("account", "account_1", "ts", "copod_score")


_POINTS = ["total_out_amt", "total_in_amt"]
_SPACE = _ACCOUNTS + """, raw as (select account, coalesce(total_out_amt, 0) as a, coalesce(total_in_amt, 0) as b from acc),
k as (select avg(a) as ma, stddev_pop(a) as sa, avg(b) as mb, stddev_pop(b) as sb from raw), pt as (select account, (a - ma) / sa as x, (b - mb) / sb as y from raw, k),
d as (select p.account, o.account as other, sqrt((p.x - o.x) * (p.x - o.x) + (p.y - o.y) * (p.y - o.y)) as d from pt p, pt o)"""


def _points(tx):
    accounts = features.clean_numeric(features.account_features(tx)).select("account", *_POINTS)
    return prep.standard_scale(accounts, _POINTS)


@query(_SPACE + ", nk as (select account, d, row_number() over (partition by account order by d) as k from d) select account, round(avg(d), 6) as knn_score from nk where k <= 3 group by 1")
def knn_scores(tx):
    return models.knn_scores(_points(tx), _POINTS, 3).select("account", "knn_score")


@query(_SPACE + """, nk as (select account, other, d, row_number() over (partition by account order by d, other) as k from d where account <> other),
near as (select account, other, d from nk where k <= 20), reach as (select account, max(d) as kd from near group by 1),
lrd as (select n.account, 1 / (avg(greatest(d, kd)) + 1e-10) as l from near n join reach on reach.account = other group by 1)
select n.account, round(avg(o.l) / any_value(m.l), 6) as lof_score from near n join lrd o on o.account = other join lrd m on m.account = n.account group by 1""")
def lof_scores(tx):
    return models.lof_scores(_points(tx), _POINTS, 20).select("account", "lof_score")


@query(_SPACE + """, core as (select account from d where d <= 0.15 group by 1 having count(*) >= 5)
select account, not exists (select 1 from d join core on core.account = d.other where d.account = pt.account and d.d <= 0.15) as is_noise from pt""")
def dbscan_noise(tx):
    return models.dbscan(_points(tx), _POINTS, 0.15, 5).select("account", (F.col("cluster") == -1).alias("is_noise"))


@query()
def iforest_scores(tx):
    return models.isolation_forest(features.tx_features(tx), _TX).select("account", "account_1", "ts", "iforest_score")


@query()
def kmeans_scores(tx):
    return models.kmeans_scores(_points(tx), _POINTS)


@query(wide=False)
def ensemble_report_full(tx):
    return points_report(features.tx_features(tx), ["amount_paid", "amount_received"])


_HOT = {**{f"PF_{v}": ("payment_format", v) for v in _FORMATS}, **{f"PC_{v}": ("payment_currency", v) for v in _CURRENCIES}}
_MATRIX = (
    ["amount_received", "amount_paid", *_TX_COLUMNS[2:]] + [f'"{c}"' for c in _HOT] + [f"{c}_{end}" for end in "sr" for c in features.ACCOUNT_FEATURES]
)


@query(_FEATURES + _ACCOUNTS + ", m as (select t.is_laundering, ln(1 + t.amount_received::double) as amount_received, ln(1 + t.amount_paid::double) as amount_paid, t.same_bank, coalesce(t.amount_ratio, 0) as amount_ratio, "
  "t.is_reinvestment, t.weekday_of_transaction, t.hour_of_transaction, " + ", ".join(f"cast(lower(trim(t.{c})) = '{v}' as int) as \"{k}\"" for k, (c, v) in _HOT.items()) + ", "
  + ", ".join(f"coalesce({a}.{c}, 0) as {c}_{end}" for a, end in (("s", "s"), ("g", "r")) for c in features.ACCOUNT_FEATURES)
  + " from t left join acc s on t.account = s.account left join acc g on t.account_1 = g.account)"
  + ", q as (select " + ", ".join(f"quantile_cont({c}::double, [0.25, 0.5, 0.75]) as q{k}" for k, c in enumerate(_MATRIX)) + " from m) select is_laundering, "
  + ", ".join(f"round(({c}::double - q{k}[2]) / coalesce(nullif(q{k}[3] - q{k}[1], 0), 1), 5) as {c}" for k, c in enumerate(_MATRIX)) + " from m, q")
def feature_matrix(tx):
    matrix = build_features(tx)["tx_matrix"]
    near = matrix.select(*[rounded(F.col(f"`{c}`"), 5).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in matrix.dtypes])
    return stored(near, "feature_matrix")  # in small methods, which a lazy result can't ask for


@query(_SPACE + """, nk as (select account, d, row_number() over (partition by account order by d) as k from d), sc as (select account, round(avg(d), 6) as knn_score from nk where k <= 3 group by 1),
top as (select account from sc order by knn_score desc, account limit 3) select account, knn_score, cast(account in (select account from top) as int) as knn_flag from sc""")
def knn_top_flags(tx):
    return models.top_flags(models.knn_scores(_points(tx), _POINTS, 3).select("account", "knn_score"), "knn_score", "knn_flag", 3)


@query(" select * exclude payment_format, " + ", ".join(f"cast(lower(payment_format) = '{v}' as int) as \"PF_{v}\"" for v in ("2-high", "3-medium", "4-not specified", "5-low", "reinvestment")) + " from tx")
def one_hot_drop_first(tx):
    return features.one_hot(tx, "payment_format", "PF", drop_first=True)


@query(_FEATURES + """ select account, account_1, ts, coalesce(cast(amount_paid as double), 0) as amount_paid, coalesce(amount_ratio, (select quantile_cont(amount_ratio, 0.5) from t)) as amount_ratio from t""")
def drop_constant_fill(tx):
    df = features.tx_features(tx).select("account", "account_1", "ts", "amount_paid", "amount_ratio", F.lit(1.0).alias("one"))
    return prep.drop_constant_then_fill(df, ["amount_paid", "amount_ratio", "one"])


@query(" select account, case when account::int % 7 in (1, 2, 3) then null else payment_format end as payment_format, case when account::int % 7 = 4 then '' else to_bank end as to_bank from tx")
def blank_recode(tx):
    k = F.col("account").cast("int") % 7
    blank = F.when(k == 1, "").when(k == 2, "nan").when(k == 3, "NaN").otherwise(F.col("payment_format"))
    return cols.blanks_to_null(tx.select("account", blank.alias("payment_format"), F.when(k == 4, "").otherwise(F.col("to_bank")).alias("to_bank")), ["payment_format"])


@query(" select * from tx order by md5(concat_ws('|', ts::varchar, from_bank, account, to_bank, account_1, amount_received::varchar, receiving_currency, amount_paid::varchar, payment_currency, payment_format, is_laundering::varchar, '42')) limit 1000")
def sample_rows(tx):
    return cols.sample_rows(tx.select("ts", "from_bank", "account", "to_bank", "account_1", "amount_received", "receiving_currency", "amount_paid", "payment_currency", "payment_format", "is_laundering"), 1000)


@query(""" select 'SUMMARY' as section, 'n_rows' as key, count(*)::varchar as value, '' as feature_name from tx union all select 'SUMMARY', 'n_total_columns_in_input', '11', '' union all select 'SUMMARY', 'n_requested_feature_cols', '5', ''
  union all select 'SUMMARY', 'n_numeric_feature_cols_used', '2', '' union all select 'SUMMARY', 'n_non_numeric_excluded', '3', '' union all select 'FEATURE_USED', '', '', unnest(['amount_received', 'amount_paid'])
  union all select 'REQUESTED_BUT_EXCLUDED_NON_NUMERIC', '', '', unnest(['receiving_currency', 'payment_currency', 'payment_format'])""")
def feature_report(tx):
    return cols.feature_report(tx)
