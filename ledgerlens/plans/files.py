"""Queries over files: raw tables written and scanned again, sinks read back, and the small table operators around them. Each stands beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.storage import shared_folder, stored
from ledgerlens.operators import account as one
from ledgerlens.operators import columns as cols
from ledgerlens.operators import features, graph, models, prep, profile
from ledgerlens.plans.detection import _ACCOUNTS, _WAYS, FOCUS
from ledgerlens.plans.profiling import _POINTS, _SPACE, _points
from ledgerlens.sinks import writers
from ledgerlens.sources import csv
from ledgerlens.sources.transactions import SQL, transactions

#: Lines, about, of a file that is put together as one text.
LINES = 10_000

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(transactions(spark, sf_dir))
        if sql:
            ORACLES[name] = SQL + sql
        return f

    return register


def _folder(df: DataFrame, name: str) -> str:
    return f"{shared_folder(df.sparkSession)}/ledgerlens/{name}-{uuid.uuid4().hex}"


def _raw_file(tx: DataFrame, name: str) -> str:
    """The transactions as a raw semicolon file with the usual header."""
    path = _folder(tx, name)
    text = tx.select(*[(F.date_format(c, "yyyy-MM-dd HH:mm:ss") if c == "ts" else F.col(c).cast("string")).alias(writers.RAW_NAMES[c]) for c in tx.columns])
    writers.write_csv(text, path, ";")
    return path


_TS = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
_SCANNED = f"""{_TS} as "Timestamp", cast(from_bank as double) as "From Bank", account as "Account", cast(to_bank as double) as "To Bank", account_1 as "Account.1", amount_received::double as "Amount Received",
  receiving_currency as "Receiving Currency", amount_paid::double as "Amount Paid", payment_currency as "Payment Currency", payment_format as "Payment Format", is_laundering::double as "Is Laundering\""""


def _raw_order(df: DataFrame) -> DataFrame:
    return df.select(*[csv.column(n) for n in writers.RAW_NAMES.values()])


@query(f" select {_SCANNED} from tx")
def csv_scan(tx):
    return _raw_order(csv.read_csv(tx.sparkSession, _raw_file(tx, "raw")))


@query(" select least(count(*), 100) as n from tx")
def csv_scan_nrows(tx):
    return csv.read_csv(tx.sparkSession, _raw_file(tx, "raw"), nrows=100).agg(F.count("*").alias("n"))


_NUMBERED = ", nx as (select *, max(cast(account as int)) as ka, max(cast(account_1 as int)) as kb from tx group by all)"
_LINE = f"{_TS} || ';' || account || ';' || account_1 || ';' || payment_format"


@query(_NUMBERED + f" select {_TS} as ts, account as \"Account\", case when ka % 5 = 0 then null else account_1 end as \"Account.1\", case when ka % 5 = 0 then null when ka % 3 = 0 then payment_format || chr(10) || 'x;y' else payment_format end as fmt from nx where ka % 5 = 0 or ka % 7 <> 0")
def csv_ragged_scan(tx):
    """Lines with too few values are filled, those with too many left out, and quoted values hold delimiters and line breaks."""
    path, k = _folder(tx, "ragged"), F.col("account").cast("int")
    fmt = F.when(k % 3 == 0, F.concat(F.lit('"'), "payment_format", F.lit('\nx;y"'))).otherwise(F.col("payment_format"))
    start = F.concat_ws(";", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "account")
    line = F.when(k % 5 == 0, start).when(k % 7 == 0, F.concat_ws(";", start, "account_1", fmt, F.lit("more"))).otherwise(F.concat_ws(";", start, "account_1", fmt))
    files = max(1, tx.count() // LINES)
    chunk = F.pmod(F.xxhash64("value"), F.lit(files)).alias("chunk")
    texts = tx.select(line.alias("value")).groupBy(chunk).agg(F.array_join(F.concat(F.array(F.lit("ts;Account;Account.1;fmt")), F.collect_list("value")), "\n").alias("value"))
    texts.select("value").write.option("maxRecordsPerFile", 1).text(path)  # each file has its header, as those of a scan of several files have
    return csv.read_csv(tx.sparkSession, path, sep=";")


_MISSING = "cast(account as int) % 4 = 1"
_KINDS = {
    "Timestamp": "datetime", "From Bank": "int", "Account": "int", "To Bank": "int", "Account.1": "int", "Amount Received": "float", "Receiving Currency": "string", "Amount Paid": "float", "Payment Currency": "string",
    "Payment Format": "string", "Is Laundering": "bool",
}


@query(", m as (select count(*) as n, count(*) filter (" + _MISSING + ") as gone from tx) " + " union all ".join(
    f"select '{c}' as \"column\", {'gone' if c == 'Payment Currency' else '0::bigint'} as missing_count, round({'gone * 100.0::double / n' if c == 'Payment Currency' else '0::double'}, 4) as missing_pct, "
    f"{'n - gone' if c == 'Payment Currency' else 'n'} as non_null_count, '{k}' as inferred_dtype from m" for c, k in _KINDS.items()))
def csv_inspection(tx):
    gaps = tx.withColumn("payment_currency", F.when(F.col("account").cast("int") % 4 == 1, "N/A").otherwise(F.col("payment_currency")))
    info = csv.inspect_csv(tx.sparkSession, _raw_file(gaps, "raw"))["columns_info"]
    rows = [(c, i["missing_count"], i["missing_pct"], i["non_null_count"], i["inferred_dtype"]) for c, i in info.items()]
    return tx.sparkSession.createDataFrame(rows, "column string, missing_count long, missing_pct double, non_null_count long, inferred_dtype string")


@query(_NUMBERED + f""" select {_TS} as "Timestamp", from_bank as "From Bank", account as "Account", to_bank as "To Bank", account_1 as "Account.1", amount_received::varchar as "Amount Received",
  receiving_currency as "Receiving Currency", amount_paid::varchar as "Amount Paid", payment_currency as "Payment Currency", payment_format as "Payment Format", is_laundering::varchar as "Is Laundering" from nx where ka = {FOCUS} or kb = {FOCUS}""")
def account_scan(tx):
    return _raw_order(csv.read_account(tx.sparkSession, _raw_file(tx, "raw"), f" {FOCUS}​ ")[0])


@query(_NUMBERED + f" select count(*) as total_rows, count(*) filter (ka = {FOCUS} or kb = {FOCUS}) as rows_for_account, min(ts) as dataset_min_date, max(ts) as dataset_max_date from nx")
def account_scan_stats(tx):
    return csv.read_account(tx.sparkSession, _raw_file(tx, "raw"), FOCUS)[1]


@query(f" select line from (select {_LINE} as line from tx order by 1 limit 250)")
def csv_head(tx):
    path = _folder(tx, "lines")
    line = F.concat_ws(";", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "account", "account_1", "payment_format")
    tx.select(line.alias("value")).orderBy("value").limit(300).coalesce(1).write.text(path)
    return csv.head_lines(tx.sparkSession, path, 250)


@query(' select amount_paid::double as "Amount Paid" from tx')
def csv_numeric_column(tx):
    spaced = tx.withColumn("amount_paid", F.concat(F.lit(" "), F.replace(F.col("amount_paid").cast("string"), F.lit("."), F.lit(","))))
    return csv.read_numeric_column(tx.sparkSession, _raw_file(spaced, "raw"), "Amount Paid")


#: The first rows of the raw layout, as a literal.
SAMPLE = """Timestamp;From Bank;Account;To Bank;Account;Amount Received
2022-09-01 00:20:00;10;8000EBD30;10;8000EBD30;369734
2022-09-01 00:20:00;3208;8000F4580;1;8000F5340;1
2022-09-01 00:26:00;12;8000EC280;2439;8017BF800;766,5
"""


@query(""" select * from (values ('2022-09-01 00:20:00', 10.0::double, '8000EBD30', 10.0::double, '8000EBD30', 369734.0::double), ('2022-09-01 00:20:00', 3208, '8000F4580', 1, '8000F5340', 1), ('2022-09-01 00:26:00', 12, '8000EC280', 2439, '8017BF800', 766.5))
  as v("Timestamp", "From Bank", "Account", "To Bank", "Account.1", "Amount Received")""")
def inline_rows(tx):
    return csv.inline_table(tx.sparkSession, SAMPLE)


@query(' select account as "Source", account_1 as "Target", count(*)::varchar as "Weight" from tx group by 1, 2')
def graph_file_edges(tx):
    path = _folder(tx, "graph")
    writers.write_graph(graph.account_nodes(tx), graph.account_edges(tx), path)
    return tx.sparkSession.read.option("header", True).csv(f"{path}/edges")


@query(' select id as "Id", id as "Label", n::varchar as "Number_Of_Accounts" from (select id, count(distinct a) as n from (select from_bank as id, account as a from tx union select to_bank, account_1 from tx) group by 1)')
def graph_file_nodes(tx):
    path = _folder(tx, "graph")
    writers.write_graph(graph.bank_nodes(tx), graph.bank_edges(tx), path)
    return tx.sparkSession.read.option("header", True).csv(f"{path}/nodes")


@query(_ACCOUNTS + " select * from acc")
def feature_files(tx):
    path = _folder(tx, "features")
    writers.write_features({"account_features": features.account_features(tx)}, path)
    return tx.sparkSession.read.parquet(f"{path}/account_features")


@query(_WAYS + """ select payment_format as category, count(*)::varchar as n, round(count(*) * 100.0::double / sum(count(*)) over (), 2)::varchar as percent from w group by 1""")
def workbook_sheet(tx):
    path, spark = _folder(tx, "workbook"), tx.sparkSession
    sheets = dict(zip(writers.SHEETS, (one.stats(tx, FOCUS), one.daily(tx, FOCUS), one.distribution(tx, FOCUS, "payment_format"), one.distribution(tx, FOCUS, "payment_currency")), strict=True))
    writers.write_account_report(spark, FOCUS, sheets, path)
    return spark.read.option("header", True).csv(f"{path}/PaymentFormatDist")


@query(' select \'is_laundering\' as "column", count(*)::varchar as nonnull from tx union all select \'amount_paid\', count(*)::varchar from tx union all select \'amount_received\', count(*)::varchar from tx')
def profile_files(tx):
    from ledgerlens.plans.runs import ProfileConfig, run_profile

    path = _folder(tx, "profile")
    writers.write_step("outliers", run_profile(tx, ProfileConfig(only=("outliers",)))["outliers"], path)
    return tx.sparkSession.read.option("header", True).csv(f"{path}/outliers/outlier_summary_numeric").select("column", "nonnull")


@query(""" select * from (values ('entropy_out_amt', 'account', 'account aggregation', 'Shannon entropy of binned amounts, bits'), ('total_in_tx', 'account', 'account aggregation', 'total of a direction'),
  ('PF_cheque', 'transaction', 'transaction, sender, receiver', 'payment format, one-hot'), ('hhi_in_missing', 'transaction', 'transaction, sender, receiver', '1 where the value was missing'),
  ('weekday_r', 'transaction', 'transaction, sender, receiver', 'receiver''s account feature')) as v(feature_name, level, source, description)""")
def feature_dictionary(tx):
    return writers.data_dictionary(tx.sparkSession, {"account": ["total_in_tx", "entropy_out_amt"], "transaction": ["PF_cheque", "weekday_r", "hhi_in_missing"]})


_SCORES = _SPACE + """, near as (select account, d, row_number() over (partition by account order by d) as k from d), kn as (select account, round(avg(d), 6) as knn_score from near where k <= 3 group by 1),
nk as (select account, other, d, row_number() over (partition by account order by d, other) as k from d where account <> other), n20 as (select account, other, d from nk where k <= 20),
reach as (select account, max(d) as kd from n20 group by 1), lrd as (select n.account, 1 / (avg(greatest(d, kd)) + 1e-10) as l from n20 n join reach on reach.account = other group by 1),
lo as (select n.account, round(avg(o.l) / any_value(m.l), 6) as lof_score from n20 n join lrd o on o.account = other join lrd m on m.account = n.account group by 1),
tails as (select account, """ + ", ".join(f"-ln(cume_dist() over (order by {c})) as {c}_l, -ln(cume_dist() over (order by {c} desc)) as {c}_r" for c in "xy") + """ from pt),
sg as (select sign(skewness(x)) as xs, sign(skewness(y)) as ys from pt),
co as (select account, round(""" + " + ".join(f"greatest(case when {c}s < 0 then {c}_l when {c}s > 0 then {c}_r else {c}_l + {c}_r end, ({c}_l + {c}_r) / 2)" for c in "xy") + """, 6) as copod_score from tails, sg),
sc as (select account, knn_score, lof_score, copod_score from kn join lo using (account) join co using (account)),
lim as (select quantile_cont(knn_score, 0.95) as a, quantile_cont(lof_score, 0.95) as b, quantile_cont(copod_score, 0.95) as c from sc),
fl as (select sc.*, cast(knn_score > a as int) as knn_is_outlier, cast(lof_score > b as int) as lof_is_outlier, cast(copod_score > c as int) as copod_is_outlier from sc, lim),
vo as (select *, knn_is_outlier + lof_is_outlier + copod_is_outlier as anomaly_votes from fl)"""
_THREE = ("knn", "lof", "copod")


def _three(tx):
    df = _points(tx)
    df = models.copod_scores(models.lof_scores(models.knn_scores(df, _POINTS, 3), _POINTS, 20), _POINTS)
    df = stored(df.select("account", *[f"{d}_score" for d in _THREE]), "scores")
    for d in _THREE:
        df = models.flagged(df, f"{d}_score", f"{d}_is_outlier", 0.05)
    return models.votes(df, [f"{d}_is_outlier" for d in _THREE])


@query(_SCORES + " select account, knn_is_outlier, lof_is_outlier, copod_is_outlier, anomaly_votes, cast(anomaly_votes >= 2 as int) as consensus_anomaly from vo")
def detector_votes(tx):
    return _three(tx).drop(*[f"{d}_score" for d in _THREE])


@query(_SCORES + " select account, anomaly_votes::varchar as anomaly_votes from vo where anomaly_votes >= 2")
def ensemble_files(tx):
    scored, path = _three(tx), _folder(tx, "ensemble")
    top = models.top_consensus(scored, [f"{d}_score" for d in _THREE])
    writers.write_ensemble(scored, models.detector_summary(scored, [f"{d}_is_outlier" for d in _THREE]), cols.feature_report(scored), top, path)
    return tx.sparkSession.read.option("header", True).option("sep", ";").csv(f"{path}/top").select("account", "anomaly_votes")


@query(_SCORES + " select account, copod_score from vo where knn_is_outlier = 1 or lof_is_outlier = 1")
def flagged_accounts(tx):
    return cols.flagged_rows(_three(tx), ["knn_is_outlier", "lof_is_outlier"]).select("account", "copod_score")


@query(_ACCOUNTS + " select account, true as is_nearest from acc")
def kmeans_nearest(tx):
    """No other cluster's centre is nearer to a point than its own; the centres are the means of the clusters' points."""
    scored = models.kmeans_scores(_points(tx), _POINTS)
    centres = scored.groupBy("cluster").agg(F.array(*[F.avg(c) for c in _POINTS]).alias("centre"))  # three rows
    apart = F.sqrt(F.aggregate(F.zip_with(F.array(*_POINTS), "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    every = scored.select("account", *_POINTS, "cluster", "kmeans_score").crossJoin(F.broadcast(centres.withColumnRenamed("cluster", "other")))
    own = F.min(F.when(F.col("cluster") == F.col("other"), apart))
    return every.groupBy("account").agg((own <= F.min(apart) + 0.02).alias("is_nearest"))


@query(" select (ab.a * ab.b / (ab.a * ab.b - ab.c * ab.c)) > 1 as above_one, round(ab.a * ab.b / (ab.a * ab.b - ab.c * ab.c), 3) as vif from (select sum(amount_paid::double * amount_paid::double) as a, sum(amount_received::double * amount_received::double) as b, sum(amount_paid::double * amount_received::double) as c from tx) ab")
def vif_amounts(tx):
    found = dict(profile.vif(tx, ["amount_paid", "amount_received"]))["amount_paid"]
    return tx.sparkSession.createDataFrame([(found > 1, round(found, 3))], "above_one boolean, vif double")


@query(" select ts, from_bank, account, to_bank, account_1, amount_received::double as amount_received, receiving_currency, amount_paid::double as amount_paid, payment_currency, payment_format, is_laundering, null::double as fee from tx")
def casts_and_missing_columns(tx):
    text = tx.select("ts", *[F.col(c).cast("string").alias(c) for c in tx.columns if c != "ts"])
    return features.ensure_columns(features.basic_casts(text), ["fee", "account"])


@query(' select ts as "Timestamp", account as "From_Account", account_1 as "To_Account", is_laundering as "Label" from tx')
def short_names(tx):
    return cols.standard_names(cols.renamed(tx.select(F.col("ts"), "account", "account_1", "is_laundering")).withColumnRenamed("From_Account", " From Account "))


@query(" select payment_format, account from (select nullif(payment_format, '5-LOW') as payment_format, account, is_laundering from tx) where is_laundering = 1")
def matching_rows(tx):
    some = tx.select(F.nullif("payment_format", F.lit("5-LOW")).alias("payment_format"), F.when(F.col("is_laundering") == 1, F.col("account")).alias("account"), "is_laundering")
    return cols.matching_rows(some.where("is_laundering = 1 or payment_format is null").select("payment_format", "account"), F.col("account").isNotNull() | F.col("payment_format").isNull())


@query(" select count(*) as n from tx")
def checked_features(tx):
    prep.check_numeric(tx, ["amount_paid", "amount_received"])
    return tx.agg(F.count("*").alias("n"))


def _number(x: str) -> str:
    """DuckDB for a number as the reports write it."""
    return f"regexp_replace(regexp_replace(format('{{:,.6f}}', ({x})::double), '0+$', ''), '\\.$', '')"


_EMPTY = "null::int as rank, null::varchar as key, null::bigint as count, null::double as pct"


@query(", c as (select payment_format as v, count(*) as n from tx group by 1), t as (select sum(n) as t from c) " + " union all ".join([
    f"select 'Overview' as section, '{m}' as metric, {v} as value, {_EMPTY} from tx" for m, v in {
        "column": "any_value('payment_format')", "dtype": "any_value('string')", "logical_type": "any_value('categorical')", "rows_total": _number("count(*)"), "missing_count": "any_value('0')", "missing_pct": "any_value('0')",
        "unique_count": _number("count(distinct payment_format)"), "unique_pct": _number("count(distinct payment_format) * 100.0::double / count(*)"), "unique_count_approx": "any_value('False')"}.items()
] + [
    "select 'Top Values / Text', 'top_value', null, cast(row_number() over (order by n desc, v) as int), v, n, round(n * 100.0::double / t, 6) from c, t",
    f"select 'Top Values / Text', 'shannon_entropy_bits', {_number('round(-sum((n / t::double) * log2(n / t::double + 1e-12::double)), 6)')}, null, null, null, null from c, t",
]))
def report_on_text(tx):
    return profile.univariate_report(tx, "payment_format")


@query(", x as (select ts from tx) select 'Overview' as section, 'rows_total' as metric, " + _number("count(*)") + f" as value, {_EMPTY} from x"
  " union all select 'Datetime', 'min_datetime', strftime(min(ts), '%Y-%m-%d %H:%M:%S'), null, null, null, null from x union all select 'Datetime', 'max_datetime', strftime(max(ts), '%Y-%m-%d %H:%M:%S'), null, null, null, null from x"
  " union all select 'Datetime', 'weekday_top', null, cast(row_number() over (order by count(*) desc, strftime(ts, '%a')) as int), strftime(ts, '%a'), count(*), round(count(*) * 100.0::double / sum(count(*)) over (), 6) from x group by strftime(ts, '%a')"
  " union all (select 'Datetime', 'month_top', null, cast(row_number() over (order by count(*) desc, strftime(ts, '%Y-%m')) as int) as r, strftime(ts, '%Y-%m'), count(*), round(count(*) * 100.0::double / sum(count(*)) over (), 6) from x group by strftime(ts, '%Y-%m') order by r limit 12)")
def report_on_times(tx):
    return profile.univariate_report(tx, "ts").where("metric in ('rows_total', 'min_datetime', 'max_datetime', 'weekday_top', 'month_top')")
