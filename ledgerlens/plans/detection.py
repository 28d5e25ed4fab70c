"""Queries: typologies, graphs, one account, features. Each stands beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import account as one
from ledgerlens.operators import features, graph, typology
from ledgerlens.sources.transactions import SQL, transactions

#: The account that deep dives look at, and that of the small ego network.
FOCUS = "7"

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, go_on: bool = True):
    def register(f):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(transactions(spark, sf_dir))
        if sql:
            ORACLES[name] = SQL + sql if go_on else sql
        return f

    return register


_OUT = """, g as (
  select from_bank, account, {b} as bucket, count(distinct to_bank || '_' || account_1) as unique_recipients, cast(sum(amount_received) as double) as total_amount
  from tx group by 1, 2, 3
)"""
_IN = """, g as (
  select {b} as bucket, account_1, count(distinct account) as unique_senders, cast(sum(amount_received) as double) as total_received, count(amount_received) as transaction_count
  from tx group by 1, 2
)"""
_DAY, _HOUR = "date_trunc('day', ts)", "date_trunc('hour', ts)"
_TEN = "time_bucket(interval '10 hours', ts, (select date_trunc('day', min(ts)) from tx))"
_Z = """, s as (
  select cast(count({c}) as double) as n, cast(sum({c}) as double) as s, cast(count({c}) * sum({c} * {c}) - sum({c}) * sum({c}) as double) as v from g
), f as (select s / n as mu, sqrt(v) / n as sigma from s),
z as (select g.*, ({c} - mu) / nullif(sigma, 0) as raw from g, f)
"""


def _day(ts: str = "ts") -> str:
    return f"date_trunc('day', {ts})"


@query(_OUT.format(b=_HOUR) + " select * from g")
def fan_out_groups(tx):
    return typology.fan_out_groups(tx, "1H")


@query(_OUT.format(b=_TEN) + " select * from g")
def fan_out_groups_10h(tx):
    return typology.fan_out_groups(tx, "10H")


@query(_OUT.format(b=_DAY) + _Z.format(c="unique_recipients") + "select * exclude raw, round(raw, 6) as z_score, coalesce(raw > 3, false) as is_outlier from z")
def fan_out_zscore(tx):
    return typology.fan_out_zscore(tx, "1D")


@query(_OUT.format(b=_DAY) + " select *, unique_recipients > (select quantile_cont(unique_recipients, 0.95) from g) as is_outlier from g")
def fan_out_percentile(tx):
    return typology.fan_out_percentile(tx, "1D")


@query(_OUT.format(b=_DAY) + _Z.format(c="unique_recipients") + "select * exclude raw, round(raw, 6) as z_score from z where raw > 3")
def fan_out_suspicious(tx):
    return typology.fan_out_suspicious(tx, "1D")


@query(_OUT.format(b=_DAY) + " select most_partners, count(*) as n_accounts from (select account, max(unique_recipients) as most_partners from g group by account) group by 1")
def recipients_histogram(tx):
    return typology.recipients_histogram(typology.fan_out_groups(tx, "1D"))


@query(_OUT.format(b=_DAY) + _Z.format(c="unique_recipients") + "select count(*) as n_groups, count(*) filter (unique_recipients > 1) as n_with_several, count(*) filter (raw > 3) as n_flagged, max(unique_recipients) as most_partners from z")
def fan_out_report(tx):
    return typology.fan_report(typology.fan_out_zscore(tx, "1D"), "unique_recipients")


@query(_IN.format(b=_HOUR) + " select * from g")
def fan_in_groups(tx):
    return typology.fan_in_groups(tx, "1H")


@query(_IN.format(b=_DAY) + _Z.format(c="unique_senders") + "select * exclude raw, round(raw, 6) as z_score, coalesce(raw > 3, false) as is_outlier from z")
def fan_in_zscore(tx):
    return typology.fan_in_zscore(tx, "1D")


@query(_IN.format(b=_DAY) + ", q as (select quantile_cont(unique_senders, 0.99) as p from g) select g.*, cast(p as double) as percentile_threshold, unique_senders > p as is_outlier from g, q")
def fan_in_percentile(tx):
    return typology.fan_in_percentile(tx, "1D")


@query(_IN.format(b=_DAY) + _Z.format(c="unique_senders") + "select count(*) as n_groups, count(*) filter (unique_senders > 1) as n_with_several, count(*) filter (raw > 3) as n_flagged, max(unique_senders) as most_partners from z")
def fan_in_report(tx):
    return typology.fan_report(typology.fan_in_zscore(tx, "1D"), "unique_senders")


@query(""", d as (
  select to_bank || '_' || account_1 as r, cast(ts as date) as day, count(distinct from_bank || '_' || account) as n from tx group by 1, 2
), k as (select r, day, cume_dist() over (partition by r order by n) * 100 > 95 as flag from d)
select tx.*, cast(ts as date) as date, coalesce(flag, false) as is_fan_in from tx left join k on r = to_bank || '_' || account_1 and day = cast(ts as date)""")
def fan_in_percent_rank(tx):
    return typology.fan_in_percent_rank(tx)


_SCATTER = """, s as (select account, count(distinct account_1) as partners from tx group by 1),
st as (select s.*, cast(t as double) as threshold from s, (select quantile_cont(partners, 0.95) as t from s) where partners >= t)"""
_GATHER = """, g as (select account_1, count(distinct account) as partners from tx group by 1),
gt as (select g.*, cast(t as double) as threshold from g, (select quantile_cont(partners, 0.95) as t from g) where partners >= t)"""
_BOTH = _GATHER + """, h as (select account, count(distinct account_1) as partners from tx where account in (select account_1 from gt) group by 1),
ht as (select h.*, cast(t as double) as threshold from h, (select quantile_cont(partners, 0.95) as t from h) where partners >= t)"""


@query(_SCATTER + " select * from st")
def scatter_accounts(tx):
    return typology.scatter_accounts(tx)


@query(_GATHER + " select * from gt")
def gather_accounts(tx):
    return typology.gather_accounts(tx)


@query(_SCATTER + _GATHER + " select * from tx where account in (select account from st) or account_1 in (select account_1 from gt)")
def scatter_gather_tx(tx):
    return typology.scatter_gather(tx)


@query(_SCATTER + _GATHER + """ select (select count(*) from st) as n_scatter, (select max(threshold) from st) as scatter_threshold, (select count(*) from gt) as n_gather,
  (select max(threshold) from gt) as gather_threshold, (select count(*) from tx where account in (select account from st) or account_1 in (select account_1 from gt)) as n_transactions""")
def scatter_gather_report(tx):
    return typology.scatter_gather_report(tx)


@query(_BOTH + " select * from ht")
def gather_scatter_accounts(tx):
    return typology.gather_scatter_accounts(tx)


@query(_BOTH + " select * from tx where account in (select account from ht) union select * from tx where account_1 in (select account from ht)")
def gather_scatter_tx(tx):
    return typology.gather_scatter(tx)


@query(" select account as source, account_1 as target, count(*) as weight from tx group by 1, 2")
def account_edges(tx):
    return graph.account_edges(tx)


@query(" select account as id from tx union select account_1 from tx")
def account_nodes(tx):
    return graph.account_nodes(tx)


@query(""" select cast(least(cast(from_bank as int), cast(to_bank as int)) as varchar) as source, cast(greatest(cast(from_bank as int), cast(to_bank as int)) as varchar) as target,
  count(*) as number_of_transactions from tx group by 1, 2""")
def bank_edges(tx):
    return graph.bank_edges(tx)


@query(", b as (select from_bank as id, account as a from tx union select to_bank, account_1 from tx) select id, id as label, count(distinct a) as number_of_accounts from b group by 1")
def bank_nodes(tx):
    return graph.bank_nodes(tx)


@query(" select account as source, account_1 as target, count(*) as weight from tx where account <> account_1 group by 1, 2")
def directed_edges(tx):
    return graph.directed_edges(tx)


@query(" select account as id from tx where account <> account_1 union select account_1 from tx where account <> account_1")
def directed_nodes(tx):
    return graph.directed_nodes(tx)


_STEPS = ", e as (select account as a, account_1 as b from tx where account <> account_1 union select account_1, account from tx where account <> account_1)"
_EGO = """ select least(account, account_1) as source, greatest(account, account_1) as target, 'Undirected' as type, count(*) as tx_count, cast(sum(coalesce(amount_paid, amount_received, 0)) as double) as amount_sum
  from tx where account <> account_1 and account in (select id from ball) and account_1 in (select id from ball) {more} group by 1, 2"""
_ONE = _STEPS + f", ball as (select a as id from e where a = '{FOCUS}' union select b from e where a = '{FOCUS}')"
_TWO = _STEPS + f", near as (select a as id from e where a = '{FOCUS}' union select b from e where a = '{FOCUS}'), ball as (select id from near union select b from e where a in (select id from near))"


@query(_ONE + f" select id from ball where id <> '{FOCUS}'")
def ego_nodes_k1(tx):
    return graph.ego_nodes(tx, FOCUS, 1)


@query(_TWO + f" select id from ball where id <> '{FOCUS}'")
def ego_nodes_k2(tx):
    return graph.ego_nodes(tx, FOCUS, 2)


@query(_ONE + _EGO.format(more=""))
def ego_edges_k1(tx):
    return graph.ego_edges(tx, FOCUS, 1)


@query(_TWO + _EGO.format(more=""))
def ego_edges_k2(tx):
    return graph.ego_edges(tx, FOCUS, 2)


@query(_ONE + _EGO.format(more=f"and (account = '{FOCUS}' or account_1 = '{FOCUS}')"))
def ego_edges_star(tx):
    return graph.ego_edges(tx, FOCUS, 1, alters=False)


@query(" select account, count(*) as tx_count from tx group by 1 order by 2 desc, 1 limit 10")
def top_senders(tx):
    return graph.busiest(tx, "account")


@query(" select account_1 as account, count(*) as tx_count from tx group by 1 order by 2 desc, 1 limit 10")
def top_receivers(tx):
    return graph.busiest(tx, "account_1")


@query(" select min(ts) as min_ts, max(ts) as max_ts from tx")
def date_range(tx):
    return graph.date_range(tx)


#: The view has no equal rows. This DuckDB build fails on selective filters over joins' dictionary-coded columns; filters over aggregates work.
_NUMBERED = ", nx as (select *, max(account) as ka, max(account_1) as kb from tx group by all)"


@query(_NUMBERED + f" select * exclude (ka, kb) from nx where ka = '{FOCUS}' or kb = '{FOCUS}'")
def account_slice(tx):
    return one.slice_of(tx, FOCUS)


@query(f" select count(*) as total_rows, count(*) filter (account = '{FOCUS}' or account_1 = '{FOCUS}') as rows_for_account, min(ts) as min_ts, max(ts) as max_ts from tx")
def account_dataset_stats(tx):
    return one.dataset_stats(tx, FOCUS)


_WAYS = _NUMBERED + f""", w as (
  select 'out' as d, account_1 as c, amount_paid as amount, * from nx where ka = '{FOCUS}'
  union all select 'in', account, amount_received, * from nx where kb = '{FOCUS}')"""


@query(_WAYS + f""" select '{FOCUS}' as account, count(*) as total_tx, count(*) filter (d = 'in') as inbound_tx, count(*) filter (d = 'out') as outbound_tx,
  count(distinct c) as unique_counterparties, count(distinct c) filter (d = 'in') as unique_inbound, count(distinct c) filter (d = 'out') as unique_outbound,
  round(cast(sum(amount) as double) / count(amount), 6) as mean_amount, cast(max(amount) as double) as max_amount from w""")
def account_stats(tx):
    return one.stats(tx, FOCUS)


@query(_WAYS + """ select cast(ts as date) as date, cast(coalesce(sum(amount) filter (d = 'in'), 0) as double) as inbound,
  cast(coalesce(sum(amount) filter (d = 'out'), 0) as double) as outbound from w group by 1""")
def account_daily(tx):
    return one.daily(tx, FOCUS)


_DIST = _WAYS + " select {c} as category, count(*) as n, round(count(*) * 100.0::double / sum(count(*)) over (), 2) as percent from w group by 1"


@query(_DIST.format(c="payment_format"))
def account_format_dist(tx):
    return one.distribution(tx, FOCUS, "payment_format")


@query(_DIST.format(c="payment_currency"))
def account_currency_dist(tx):
    return one.distribution(tx, FOCUS, one.currency_column(tx, FOCUS))


@query(""", p as (select account, payment_format, count(*) as n from tx group by 1, 2),
j as (select account, '{' || string_agg('"' || payment_format || '":' || n, ',' order by payment_format) || '}' as formats from p group by 1)
select account, count(*) as tx_count, cast(sum(amount_paid) as double) as total_paid, round(cast(sum(amount_paid) as double) / count(amount_paid), 6) as mean_paid,
  cast(max(amount_paid) as double) as max_paid, any_value(formats) as formats from tx join j using (account) group by account""")
def outbound_summary(tx):
    return one.outbound_summary(tx).withColumn("formats", F.to_json("formats"))


@query(" select is_laundering, count(*) as n, round(count(*) * 100.0::double / sum(count(*)) over (), 2) as pct from tx group by 1")
def label_distribution(tx):
    return one.label_share(tx, "is_laundering")


_FEATURES = """, t as (
  select *, cast(from_bank = to_bank as int) as same_bank,
    case when amount_received > 0 then round(cast(amount_paid as double) / cast(amount_received as double), 6) end as amount_ratio,
    cast(contains(lower(payment_format), 'reinvest') as int) as is_reinvestment,
    cast(isodow(ts) - 1 as int) as weekday_of_transaction, cast(hour(ts) as int) as hour_of_transaction from tx)"""
_FORMATS = ("1-urgent", "2-high", "3-medium", "4-not specified", "5-low", "reinvestment")
_CURRENCIES = ("africa", "america", "asia", "europe", "middle east")


@query(_FEATURES + " select * from t")
def tx_features(tx):
    return features.tx_features(tx)


@query(""" select *, cast(hour(ts) as int) as hour, cast(abs(amount_paid - amount_received) as double) as amount_diff, cast(account = account_1 as int) as same_account,
  cast(from_bank = to_bank as int) as same_bank from tx""")
def tx_model_features(tx):
    return features.model_features(tx)


@query()
def tx_one_hot(tx):
    return features.one_hot(features.one_hot(features.tx_features(tx), "payment_format", "PF"), "payment_currency", "PC")


@query(""", top as (select payment_format from tx group by 1 order by count(*) desc, 1 limit 3)
select * replace (case when payment_format in (select payment_format from top) then payment_format else 'Other' end as payment_format) from tx""")
def rare_formats(tx):
    return features.collapse_rare(tx, "payment_format", 3)


_ENTROPY = """
, {w}_v as (select {a} as account, list_sort(list(cast({m} as double))) as v from tx group by 1),
{w}_q as (select account, v, len(v) as n, least(10, len(list_distinct(v))) as q from {w}_v),
{w}_e as (
  select account, i, case when t < 0.5 then lo + (hi - lo) * t else hi - (hi - lo) * (1.0::double - t) end as edge from (
    select account, i, h - floor(h) as t, v[cast(floor(h) as bigint) + 1] as lo, v[least(cast(floor(h) as bigint) + 1, n - 1) + 1] as hi from (
      select *, (case when i = q then 1.0::double else (i * (1.0::double / q)) * 100 / 100 end) * (n - 1) as h from (select *, unnest(range(0, q + 1)) as i from {w}_q)))
),
{w}_b as (select account, edge, row_number() over (partition by account order by edge) as j, lag(edge) over (partition by account order by edge) as below from (select distinct account, edge from {w}_e)),
{w}_k as (
  select b.account, b.j, count(*) as k, any_value(q.n) as n from {w}_b b join {w}_q q using (account), unnest(q.v) as u(x)
  where b.j > 1 and x <= edge and (x > below or b.j = 2) group by 1, 2
),
{w}_h as (select account, 0.0::double - sum(cast(k as double) / n * log2(cast(k as double) / n)) as h from {w}_k where n > 1 group by 1)"""
_ONE_WAY = """
, {w}_c as (select {a} as account, {o} as other, count(*) as c from tx group by 1, 2),
{w}_m as (select account, count(other) as partners, round(cast(sum(c * c) as double) / (cast(sum(c) as double) * cast(sum(c) as double)), 6) as hhi from {w}_c group by 1),
{w}_t as (select {a} as account, count(*) as n, cast(sum({m}) as double) as s, cast(max({m}) as double) as m from tx group by 1)"""
_ACCOUNTS = (
    _ENTROPY.format(w="o", a="account", m="amount_paid")
    + _ENTROPY.format(w="r", a="account_1", m="amount_received")
    + _ONE_WAY.format(w="o", a="account", o="account_1", m="amount_paid")
    + _ONE_WAY.format(w="r", a="account_1", o="account", m="amount_received")
    + """
, o as (select t.*, round(coalesce(h, 0), 6) as h, partners, hhi from o_t t left join o_h using (account) join o_m using (account)),
r as (select t.*, round(coalesce(h, 0), 6) as h, partners, hhi from r_t t left join r_h using (account) join r_m using (account)),
acc as (
  select coalesce(o.account, r.account) as account, o.n as total_out_tx, o.s as total_out_amt, o.m as max_out_amt, o.h as entropy_out_amt, r.n as total_in_tx, r.s as total_in_amt,
    r.m as max_in_amt, r.h as entropy_in_amt, round(coalesce(o.s, 0) - coalesce(r.s, 0), 6) as net_flow_amt, coalesce(o.partners, 0) as unique_receivers,
    coalesce(r.partners, 0) as unique_senders, coalesce(o.hhi, 0) as hhi_out, coalesce(r.hhi, 0) as hhi_in
  from o full join r on o.account = r.account
)"""
)


@query(_ACCOUNTS + " select * from acc")
def account_features(tx):
    return features.account_features(tx)


@query(_ACCOUNTS + " select account, entropy_out_amt, entropy_in_amt from acc")
def account_entropy(tx):
    return features.account_features(tx).select("account", "entropy_out_amt", "entropy_in_amt")


@query(_ACCOUNTS + " select account, unique_receivers, unique_senders, hhi_out, hhi_in from acc")
def uniques_hhi(tx):
    return features.account_features(tx).select("account", "unique_receivers", "unique_senders", "hhi_out", "hhi_in")


def _renamed(alias: str, end: str) -> str:
    return ", ".join(f"{alias}.{c} as {c}_{end}" for c in ("account", *features.ACCOUNT_FEATURES))


@query(_FEATURES + _ACCOUNTS + f" select t.*, {_renamed('s', 's')}, {_renamed('g', 'r')} from t left join acc s on t.account = s.account left join acc g on t.account_1 = g.account")
def tx_with_context(tx):
    return features.attach_context(features.tx_features(tx), features.account_features(tx))


def _hot(column: str, prefix: str, values: tuple[str, ...]) -> str:
    return ", ".join(f"cast(lower(trim({column})) = '{v}' as int) as \"{prefix}_{v}\"" for v in values)


ORACLES["tx_one_hot"] = SQL + _FEATURES + f" select * exclude (payment_format, payment_currency), {_hot('payment_format', 'PF', _FORMATS)}, {_hot('payment_currency', 'PC', _CURRENCIES)} from t"
