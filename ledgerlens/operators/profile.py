"""Profiles of a table: roles, missing values, outliers, hints, summaries, correlations, and reports on single columns."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.functions.numeric import as_double, kurtosis, quantile, share, skewness
from ledgerlens.functions.quantiles import exact_quantiles
from ledgerlens.functions.ranks import ranked_columns
from ledgerlens.operators.prep import numeric_columns

#: Fixed value: the words that make a column's name that of an id.
_ID_NAME = re.compile(r"(?:^|[_\s])(?:id|uuid|guid|iban|account|acct|customer|client|transaction|tx)(?:$|[_\s])", re.I)
#: Share of different values from which a column that isn't a number, time or truth value is taken for an id.
ID_SHARE = 0.98


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def per_column(df: DataFrame, columns: list[str], facts) -> DataFrame:
    """facts(c) gives the aggregates of a column, with equal names; one pass over df makes a row for each column."""
    if not columns:
        raise ValueError("no columns")
    packed = {c: F.struct(F.lit(c).alias("column"), *facts(c)).alias(c) for c in columns}
    row = df.agg(*packed.values())
    return row.select(F.explode(F.array(*[F.col(f"`{c}`") for c in columns])).alias("r")).select("r.*")


def roles(df: DataFrame) -> DataFrame:
    """(column, role, is_constant, is_id_like): id-like columns are categorical, and of their given values nearly all are different, or they are named like ids."""
    kinds = dict(df.dtypes)

    def role(c: str) -> str:
        kind = kinds[c]
        if kind == "boolean":
            return "bool"
        if kind.startswith(("timestamp", "date")):
            return "datetime"
        return "numeric" if c in numeric_columns(df) else "categorical"

    found = per_column(df, df.columns, lambda c: [F.count_distinct(column(c)).alias("n_unique"), F.count(column(c)).alias("n"), F.lit(role(c)).alias("role"), F.lit(bool(_ID_NAME.search(c))).alias("named")])
    almost = F.col("n_unique") >= F.lit(ID_SHARE) * F.col("n")
    return found.select(
        "column",
        "role",
        (F.col("n_unique") <= 1).alias("is_constant"),
        ((F.col("role") == "categorical") & (almost | F.col("named")) & (F.col("n") > 0)).alias("is_id_like"),
    )


def missingness(df: DataFrame) -> DataFrame:
    """(column, dtype, missing_count, missing_ratio, n_unique_nonnull), most missing first."""
    kinds = dict(df.dtypes)
    found = per_column(
        df,
        df.columns,
        lambda c: [
            F.lit(kinds[c]).alias("dtype"),
            F.count_if(F.col(c).isNull()).alias("missing_count"),
            share(F.count_if(F.col(c).isNull()), F.count("*")).alias("missing_ratio"),
            F.count_distinct(F.col(c)).alias("n_unique_nonnull"),
        ],
    )
    return found.orderBy(F.desc("missing_ratio"), F.desc("missing_count"), "column")


def _finite(c: str) -> Column:
    """A column's numbers; infinities and NaN count as missing."""
    x = as_double(column(c))
    return F.when(F.abs(x) < float("inf"), x)


def _outliers(df: DataFrame, columns: list[str], method: str, least: int, rule) -> DataFrame:
    """rule(c) gives low, high, centre and scale of a column, each a number or None, and the test of an outlier or None."""
    empty = F.lit(None).cast("double")

    def facts(c):
        *bounds, out = rule(c)
        return [
            F.lit(method).alias("method"),
            F.count(column(c)).alias("nonnull"),
            (F.count_if(out) if out is not None else F.lit(0).cast("long")).alias("outlier_count"),
            *[(empty if v is None else F.round(F.lit(float(v)), 6)).alias(n) for n, v in zip(("bound_lo", "bound_hi", "mad_center", "mad_scale"), bounds, strict=True)],
            F.min(as_double(column(c))).alias("min"),
            F.max(as_double(column(c))).alias("max"),
        ]

    found = per_column(df, columns, facts).where(F.col("nonnull") >= least)
    ratio = share(F.col("outlier_count"), F.col("nonnull")).alias("outlier_ratio")
    return found.select(*found.columns[:4], ratio, *found.columns[4:]).orderBy(F.desc("outlier_ratio"), "column")


def outliers_iqr(df: DataFrame, columns: list[str] | None = None, k: float = 1.5, least: int = 30) -> DataFrame:
    """(column, method, nonnull, outlier_count, outlier_ratio, bound_lo, bound_hi, mad_center, mad_scale, min, max) by quartile fences; without spread the bounds are the quartiles and nothing is out."""
    columns = columns or numeric_columns(df)
    quartiles = exact_quantiles(df, {c: _finite(c) for c in columns}, [0.25, 0.75])

    def rule(c):
        a, b = quartiles[c]
        if a is None or a == b:
            return a, b, None, None, None
        low, high = a - k * (b - a), b + k * (b - a)
        return low, high, None, None, (as_double(column(c)) < low) | (as_double(column(c)) > high)

    return _outliers(df, columns, f"IQR(k={k})", least, rule)


def outliers_mad(df: DataFrame, columns: list[str] | None = None, limit: float = 3.5, least: int = 30) -> DataFrame:
    """The same columns: outliers have 0.6745 * |x - median| / MAD above the limit; without spread nothing is out."""
    columns = columns or numeric_columns(df)
    medians = {c: q[0] for c, q in exact_quantiles(df, {c: _finite(c) for c in columns}, [0.5]).items()}
    spread = exact_quantiles(df, {c: F.abs(_finite(c) - F.lit(m)) for c, m in medians.items() if m is not None}, [0.5])

    def rule(c):
        m, d = medians[c], spread.get(c, [None])[0]
        return None, None, m, d, F.abs(F.lit(0.6745) * (as_double(column(c)) - F.lit(m)) / F.lit(d)) > limit if d else None

    return _outliers(df, columns, f"MAD(z>{limit})", least, rule)


#: From so far apart, p99 to p01, a column should be scaled; from so much skew, by quartiles or logs.
WIDE, SKEWED = 1000, 1.0


def scaling_hints(df: DataFrame, columns: list[str] | None = None, least: int = 10) -> DataFrame:
    """(column, suggest_scale, suggest_robust_scaler, suggest_log1p, skew, p01, p99, rationale) of numeric columns with so many values at least."""
    columns = columns or numeric_columns(df)
    ends = exact_quantiles(df, {c: _finite(c) for c in columns}, [0.01, 0.99])

    def facts(c):
        x = _finite(c)
        low, high = (F.lit(v).cast("double") for v in ends[c])
        return [F.count(x).alias("n"), skewness(x).alias("skew"), low.alias("p01"), high.alias("p99"), F.min(x).alias("least")]

    found = per_column(df, columns, facts).where(F.col("n") >= least)
    ratio = F.abs("p99") / F.greatest(F.abs("p01"), F.lit(1e-12))
    wide, skewed = ratio >= WIDE, F.coalesce(F.abs("skew") >= SKEWED, F.lit(False))
    log = skewed & (F.col("least") >= 0)
    said = F.concat_ws(
        ";",
        F.when(wide, F.format_string("wide_scale(p99/p01≈%.1f)", ratio)),
        F.when(skewed, F.format_string("skew≈%.2f", "skew")),
        F.when(log, "nonnegative+skew→log1p_candidate"),
    )
    return found.select(
        "column", (wide | skewed).alias("suggest_scale"), skewed.alias("suggest_robust_scaler"), log.alias("suggest_log1p"),
        *[F.round(c, 6).alias(c) for c in ("skew", "p01", "p99")], said.alias("rationale"),
    )


#: Up to so many different values one-hot columns will do; from so many on they won't.
FEW_VALUES, MANY_VALUES = 20, 200
#: The names of the hints.
HINTS = ("avoid_onehot_idlike", "one_hot_ok", "high_cardinality", "moderate_cardinality")
NOTES = ("nearly all values differ, or the name is that of an id: drop or hash", "few values", "very many values: target, hash or frequency encoding", "one-hot makes many sparse columns")


def encoding_hints(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n_unique_nonnull, id_like, encoding_hint, note) of categorical and boolean columns with any value."""
    kinds = roles(df.select(*map(column, columns)) if columns else df)
    wanted = columns or [c for c, kind in df.dtypes if c not in numeric_columns(df) and not kind.startswith(("timestamp", "date"))]
    if not wanted:
        return df.sparkSession.createDataFrame([], "column string, n_unique_nonnull long, id_like boolean, encoding_hint string, note string")
    found = per_column(df, wanted, lambda c: [F.count_distinct(column(c)).alias("n_unique_nonnull"), F.count(column(c)).alias("n")]).where(F.col("n") > 0)
    found = found.join(F.broadcast(kinds.select("column", F.col("is_id_like").alias("id_like"))), "column")  # a row per column
    n = F.col("n_unique_nonnull")
    choose = lambda names: F.when(F.col("id_like"), names[0]).when(n <= FEW_VALUES, names[1]).when(n >= MANY_VALUES, names[2]).otherwise(names[3])
    return found.select("column", "n_unique_nonnull", "id_like", choose(HINTS).alias("encoding_hint"), choose(NOTES).alias("note"))


PERCENTS = (1, 5, 50, 95, 99)


def numeric_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n, mean, std, min, p01..p99, max, skew, kurtosis)."""
    columns = columns or numeric_columns(df)
    cuts = exact_quantiles(df, {c: as_double(column(c)) for c in columns}, [p / 100 for p in PERCENTS])

    def facts(c):
        x = as_double(column(c))
        return [
            F.count(x).alias("n"),
            F.round(F.avg(x), 6).alias("mean"),
            F.round(F.stddev_samp(x), 6).alias("std"),
            F.min(x).alias("min"),
            *[F.round(q, 6).alias(f"p{p:02d}") for p, q in zip(PERCENTS, (F.lit(q).cast("double") for q in cuts[c]), strict=True)],
            F.max(x).alias("max"),
            F.round(skewness(x), 6).alias("skew"),
            F.round(kurtosis(x), 6).alias("kurtosis"),
        ]

    return per_column(df, columns, facts)


def value_counts(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """(value, rank, count, pct): the k most frequent values, ties by value; pct is of the non-null rows."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("_total"))
    top = counts.orderBy(F.desc("count"), "value").limit(k)
    rank = F.row_number().over(W.orderBy(F.desc("count"), "value"))  # over k rows
    return top.crossJoin(F.broadcast(total)).select("value", rank.alias("rank"), "count", F.round(F.col("count") * 100.0 / F.col("_total"), 6).alias("pct"))


def top_values(df: DataFrame, columns: list[str], k: int = 15) -> DataFrame:
    """(column, top): the most frequent values of each column as a JSON object, most frequent first."""
    out = None
    for c in columns:
        top = value_counts(df, c, k)
        pairs = F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "count"))), lambda r: F.struct(r["value"], r["count"]))
        row = top.agg(F.to_json(F.map_from_entries(pairs)).alias("top")).select(F.lit(c).alias("column"), "top")
        out = row if out is None else out.unionByName(row)
    return out


def category_entropy(df: DataFrame, column: str) -> DataFrame:
    """One row: the Shannon entropy of a column's values, in bits."""
    counts = df.select(F.col(column).alias("v")).where("v is not null").groupBy("v").agg(F.count("*").cast("double").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    return counts.crossJoin(F.broadcast(total)).agg(F.round(-F.sum(p * F.log2(p + 1e-12)), 6).alias("entropy_bits"))


def _varying(df: DataFrame, columns: list[str]) -> list[str]:
    row = df.agg(*[F.struct(F.min(as_double(c)), F.max(as_double(c))).alias(c) for c in columns]).first()
    return [c for c in columns if row[c][0] is not None and row[c][0] != row[c][1]]


def average_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """df's columns as average ranks, each taken over the column's different values."""
    out = df.select(*[as_double(c).alias(c) for c in columns])
    every = ranked_columns(df, columns)
    for c in columns:
        ranks = every.where(F.col("column") == c).select(F.col("value").alias("_v"), (F.col("before") + (F.col("n") + 1) / 2).alias("_rank"))
        out = out.join(ranks, F.col(c) == F.col("_v"), "left").select(*[F.col("_rank").alias(c) if k == c else F.col(k) for k in columns])
    return out


def left_out(columns: list[str], most: int | None) -> list[str]:
    """The columns that a limit of so many leaves out; none without a limit. What uses a limit says what it left out."""
    return list(columns)[most:] if most is not None else []


def correlations(df: DataFrame, columns: list[str] | None = None, method: str = "pearson", most: int | None = None) -> DataFrame:
    """(a, b, r) for every pair of columns, or of the first `most`, from one pass; pairs with a constant column have no r. left_out names the others."""
    columns = list(columns or numeric_columns(df))[:most]
    varying = _varying(df, columns)
    data = average_ranks(df, varying) if method == "spearman" else df
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    live = {(a, b) for a, b in pairs if a in varying and b in varying}
    row = data.agg(*[F.corr(as_double(a), as_double(b)).alias(f"{a}|{b}") for a, b in sorted(live)] or [F.lit(0).alias("none")])
    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.round(F.col(f"`{a}|{b}`"), 6) if (a, b) in live else F.lit(None).cast("double")).alias("r"))
        for a, b in pairs
    ]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def high_correlations(df: DataFrame, columns: list[str] | None = None, limit: float = 0.85, most: int | None = None) -> DataFrame:
    return correlations(df, columns, most=most).where(F.abs("r") >= limit).orderBy(F.desc(F.abs("r")), "a", "b")


def vif(df: DataFrame, columns: list[str], fill_median: bool = False, most: int | None = None) -> list[tuple[str, float | None]]:
    """Variance inflation of each of the columns, or of the first `most`, without intercept, from the matrix of cross products; None where it can't be inverted."""
    columns = columns[:most]
    x = df.select(*[as_double(c).alias(c) for c in columns])
    if fill_median:
        m = exact_quantiles(x, {c: F.col(c) for c in columns}, [0.5])
        x = x.select(*[F.coalesce(c, F.lit(m[c][0] or 0.0)).alias(c) for c in columns])
    x = x.dropna()
    sums = x.agg(F.count("*").alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]).first()
    if len(columns) < 2 or sums["n"] < 50:
        return []
    gram = np.array([[sums[f"{min(i, j)}_{max(i, j)}"] for j in range(len(columns))] for i in range(len(columns))])
    try:
        inverse = np.linalg.inv(gram)
    except np.linalg.LinAlgError:
        return [(c, None) for c in columns]
    return [(c, float(gram[i, i] * inverse[i, i])) for i, c in enumerate(columns)]


def univariate_numeric(df: DataFrame, column: str, factor: float = 1.5, z: float = 3.0) -> DataFrame:
    """(metric, value) of a numeric column."""
    x = as_double(column)
    percents = (1, 5, 25, 50, 75, 95, 99)
    found = exact_quantiles(df, {column: x}, [p / 100 for p in percents])[column]
    cuts = {p: F.lit(v).cast("double") for p, v in zip(percents, found, strict=True)}
    first = df.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s")).first()
    q, m, s = [v or 0.0 for v in found[2:5]], first["m"] or 0.0, first["s"] or 0.0
    mad = exact_quantiles(df, {column: F.abs(x - F.lit(q[1]))}, [0.5])[column][0]
    width = q[2] - q[0]
    outside = F.count_if((x < q[0] - factor * width) | (x > q[2] + factor * width)) if width > 0 else F.lit(0)
    far = F.count_if(F.abs(x - F.lit(m)) / F.lit(s) > z) if s > 0 else F.lit(0)
    named = {
        "count": F.count(x),
        "missing": F.count_if(x.isNull()),
        "unique": F.count_distinct(x),
        "min": F.min(x),
        **{f"q{p:02d}": cuts[p] for p in (1, 5, 25)},
        "median": cuts[50],
        **{f"q{p:02d}": cuts[p] for p in (75, 95, 99)},
        "max": F.max(x),
        "mean": F.avg(x),
        "std": F.stddev_samp(x),
        "mad": F.lit(mad),
        "iqr": cuts[75] - cuts[25],
        "skew": skewness(x),
        "kurtosis": kurtosis(x),
        "zeros": F.count_if(x == 0),
        "positive": F.count_if(x > 0),
        "negative": F.count_if(x < 0),
        "iqr_outliers": outside,
        "z_outliers": far,
    }
    row = df.agg(*[F.round(v.cast("double"), 4).alias(k) for k, v in named.items()])
    cells = [F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in named]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def univariate_datetime(df: DataFrame, column: str, top: int = 12) -> DataFrame:
    """(metric, key, value): range and span in days, weekdays and the most frequent months with their counts."""
    t = F.col(column)
    span = F.timestamp_diff("SECOND", F.min(t), F.max(t)) / 86400
    facts = df.agg(F.count(t).alias("count"), F.round(span, 6).alias("span_days"), F.date_format(F.min(t), "yyyy-MM-dd HH:mm:ss").alias("min"), F.date_format(F.max(t), "yyyy-MM-dd HH:mm:ss").alias("max"))
    head = facts.select(
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("metric"), (F.col(k) if k in ("min", "max") else F.lit("")).alias("key"), (F.lit(None) if k in ("min", "max") else F.col(k)).cast("double").alias("value")) for k in ("count", "span_days", "min", "max")])
        ).alias("c")
    ).select("c.*")
    valid = df.where(t.isNotNull())
    days = valid.groupBy(F.date_format(t, "E").alias("key")).agg(F.count("*").cast("double").alias("value"))
    months = valid.groupBy(F.date_format(t, "yyyy-MM").alias("key")).agg(F.count("*").cast("double").alias("value")).orderBy(F.desc("value"), "key").limit(top)
    return head.unionByName(days.select(F.lit("weekday").alias("metric"), "key", "value")).unionByName(months.select(F.lit("month").alias("metric"), "key", "value"))


def univariate_boolean(df: DataFrame, column: str) -> DataFrame:
    """(metric, value): true and false counts and percentages."""
    c = F.col(column).cast("boolean")
    named = {"true": F.count_if(c), "false": F.count_if(~c), "true_pct": share(F.count_if(c), F.count(c), 8) * 100}
    row = df.agg(*[F.round(v.cast("double"), 6).alias(k) for k, v in named.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in named])).alias("c")).select("c.*")


def text_lengths(df: DataFrame, column: str) -> DataFrame:
    """(metric, value): lengths of a text column's values."""
    n = F.length(column)
    named = {"min": F.min(n), "q25": quantile(n, 0.25), "median": quantile(n, 0.5), "mean": F.avg(n), "q75": quantile(n, 0.75), "q95": quantile(n, 0.95), "max": F.max(n)}
    row = df.agg(*[F.round(v.cast("double"), 4).alias(k) for k, v in named.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in named])).alias("c")).select("c.*")


def logical_type(df: DataFrame, column: str) -> str:
    kind = dict(df.dtypes)[column]
    if kind == "boolean":
        return "boolean"
    if column in numeric_columns(df):
        return "numeric"
    if kind.startswith(("timestamp", "date")):
        return "datetime"
    row = df.agg(F.count_distinct(F.col(column)).alias("u"), F.count(column).alias("n")).first()
    return "text" if row["n"] and row["u"] / row["n"] > 0.5 else "categorical"


#: Metrics of each section of a report; count_valid stands with the others of its kind.
SECTIONS = {
    "Overview": "column dtype logical_type rows_total missing_count missing_pct unique_count unique_pct unique_count_approx".split(),
    "Numeric": "min q01 q05 q25 median q75 q95 q99 max mean std mad iqr skew kurtosis_fisher zeros_count positive_count negative_count outliers_iqr_count outliers_zscore_count".split(),
    "Datetime": "min_datetime max_datetime span_days weekday_top month_top".split(),
    "Boolean": "true_count false_count true_pct false_pct".split(),
    "Top Values / Text": "top_value shannon_entropy_bits text_len_min text_len_q25 text_len_median text_len_mean text_len_q75 text_len_q95 text_len_max".split(),
}
_NUMERIC_NAMES = {
    "count": "count_valid", "kurtosis": "kurtosis_fisher", "zeros": "zeros_count", "positive": "positive_count", "negative": "negative_count", "iqr_outliers": "outliers_iqr_count",
    "z_outliers": "outliers_zscore_count",
}


def _plain(x: Column) -> Column:
    """A number as text: thousands in groups, at most six digits behind the point and no trailing zeros."""
    text = F.regexp_replace(F.format_number(x.cast("double"), 6), r"\.?0+$", "")
    return F.when(text == "-0", "0").otherwise(text)


def univariate_report(df: DataFrame, column_name: str, top: int = 20, approx: bool = False, factor: float = 1.5, z: float = 3.0, write_path: str | None = None) -> DataFrame:
    """(section, metric, value, rank, key, count, pct) of one column, by section, metric and rank: an overview and what fits its logical type.

    approx estimates the number of different values instead of counting them. write_path takes the report as a CSV file as well. A column's bytes in memory mean nothing
    here and aren't reported.
    """
    c, spark = column(column_name), df.sparkSession
    kind = logical_type(df, column_name)
    different = F.approx_count_distinct(c) if approx else F.count_distinct(c)
    over = df.agg(F.count("*").alias("n"), F.count(c).alias("given"), different.alias("unlike")).first()
    n, given, unlike = over["n"], over["given"], over["unlike"]
    facts = {"rows_total": n, "missing_count": n - given, "missing_pct": (n - given) * 100.0 / n if n else None, "unique_count": unlike, "unique_pct": unlike * 100.0 / given if given else None}
    texts = {"column": column_name, "dtype": dict(df.dtypes)[column_name], "logical_type": kind, "unique_count_approx": str(approx)}
    head = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in facts.items()], "metric string, x double").select("metric", _plain(F.col("x")).alias("value"))
    head = head.union(spark.createDataFrame([*texts.items()], "metric string, value string"))
    empty = [F.lit(None).cast(t).alias(k) for k, t in (("rank", "int"), ("key", "string"), ("count", "long"), ("pct", "double"))]
    single = lambda rows, names=None: rows.select(
        (F.col("metric") if names is None else names).alias("metric"), _plain(F.col("value")).alias("value"), *empty
    )
    parts = [head.select("metric", "value", *empty)]
    valid = df.where(c.isNotNull())

    def ranked(values: Column, metric: str, most: int) -> DataFrame:
        found = value_counts(valid.select(values.alias("v")), "v", most)
        return found.select(F.lit(metric).alias("metric"), F.lit(None).cast("string").alias("value"), "rank", F.col("value").alias("key"), "count", "pct")

    counted = spark.createDataFrame([("count_valid", float(given))], "metric string, value double")
    if kind == "numeric":
        rows = univariate_numeric(df, column_name, factor, z).where(~F.col("metric").isin("missing", "unique"))
        names = F.coalesce(F.create_map(*[F.lit(v) for pair in _NUMERIC_NAMES.items() for v in pair])[F.col("metric")], F.col("metric"))
        parts.append(single(rows if given else counted, names if given else None))
    elif kind == "datetime":
        parts.append(single(counted))
        shown = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss")
        span = F.round(F.timestamp_diff("SECOND", F.min(c), F.max(c)) / 86400, 6)
        ends = valid.agg(shown(F.min(c)).alias("min_datetime"), shown(F.max(c)).alias("max_datetime"), _plain(span).alias("span_days"))
        parts.append(ends.unpivot([], ["min_datetime", "max_datetime", "span_days"], "metric", "value").where("value is not null").select("metric", "value", *empty))
        parts += [ranked(F.date_format(c, "E"), "weekday_top", min(7, top)), ranked(F.date_format(c, "yyyy-MM"), "month_top", min(12, top))]
    elif kind == "boolean":
        rows = valid.agg(F.count_if(c).alias("t"), F.count("*").alias("n")).first()
        held = {"count_valid": rows["n"], "true_count": rows["t"], "false_count": rows["n"] - rows["t"]}
        if rows["n"]:
            held |= {"true_pct": rows["t"] * 100.0 / rows["n"], "false_pct": (rows["n"] - rows["t"]) * 100.0 / rows["n"]}
        parts.append(single(spark.createDataFrame([(k, float(v)) for k, v in held.items()], "metric string, value double")))
    else:
        parts.append(ranked(c.cast("string"), "top_value", top))
        parts.append(single(category_entropy(valid, column_name).select(F.lit("shannon_entropy_bits").alias("metric"), F.col("entropy_bits").alias("value"))))
        if kind == "text":
            parts.append(single(text_lengths(valid, column_name).withColumn("metric", F.concat(F.lit("text_len_"), "metric"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    section = F.lit("Other")
    for name, metrics in SECTIONS.items():
        section = F.when(F.col("metric").isin(metrics), name).otherwise(section)
    section = F.when(F.col("metric") == "count_valid", kind.capitalize()).otherwise(section)
    report = out.select(section.alias("section"), *out.columns).orderBy("section", "metric", "rank")
    if write_path:
        report.coalesce(1).write.mode("overwrite").option("header", True).csv(write_path)
    return report


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, low, high, n): equal widths, the last bin closed on the right."""
    x = as_double(column)
    row = df.agg(F.min(x).alias("a"), F.max(x).alias("b")).first()
    if row["a"] is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    a, b = float(row["a"]), float(row["b"])
    width = (b - a) / bins or 1.0
    at = F.least(F.floor((x - a) / width), F.lit(bins - 1)).cast("int")
    return df.where(x.isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n")).select(
        "bin", F.round(F.lit(a) + F.col("bin") * width, 6).alias("low"), F.round(F.lit(a) + (F.col("bin") + 1) * width, 6).alias("high"), "n"
    )
