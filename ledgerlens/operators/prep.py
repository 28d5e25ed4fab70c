"""From features to a model matrix: logs, imputation, constant columns, scaling.

Everything data-dependent (medians, quartiles, constants) is found in passes that return a few numbers each; the matrix itself is one
projection. Quantiles are exact.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.numeric import as_double, signed_log
from ledgerlens.functions.quantiles import exact_quantiles
from ledgerlens.functions.storage import small_methods, stored

NUMERIC = ("int", "bigint", "smallint", "tinyint", "double", "float", "decimal")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, kind in df.dtypes if kind.startswith(NUMERIC)]


@dataclass
class MatrixConfig:
    """The defaults keep the label out, derive the time features, take signed logs of net flow and scale; `legacy` is the older behaviour."""

    exclude: tuple[str, ...] = ("account", "account_1", "from_bank", "to_bank", "is_laundering")
    missing_flags: tuple[str, ...] = ("entropy_out_amt", "entropy_in_amt", "hhi_out", "hhi_in", "unique_receivers", "unique_senders")
    logs: tuple[str, ...] = ("amount_paid", "amount_received", "total_out_amt", "total_in_amt", "max_out_amt", "max_in_amt")
    signed_logs: tuple[str, ...] = ("net_flow_amt",)
    zero_if_named: tuple[str, ...] = ("entropy", "hhi", "unique_")
    always_keep: tuple[str, ...] = ("weekday_of_transaction", "hour_of_transaction")
    drop_constant: bool = True
    scale: bool = True
    time_from: str | None = "ts"
    keep: tuple[str, ...] = field(default=())

    @classmethod
    def legacy(cls) -> MatrixConfig:
        base = cls()
        return cls(
            exclude=tuple(c for c in base.exclude if c != "is_laundering"),
            logs=(*base.logs, "net_flow_amt"),
            signed_logs=(),
            zero_if_named=("entropy", "hhi"),
            drop_constant=False,
            time_from=None,
        )


def pre_model(df: DataFrame, config: MatrixConfig | None = None) -> DataFrame:
    """The numeric matrix of df, with the columns config.keep in front as they are."""
    cfg = config or MatrixConfig()
    if cfg.time_from in df.columns:
        ts = F.col(cfg.time_from)
        for c, value in (("weekday_of_transaction", F.weekday(ts)), ("hour_of_transaction", F.hour(ts))):
            if c not in df.columns:
                df = df.withColumn(c, value)
    names = [c for c in numeric_columns(df) if c not in cfg.exclude and c not in cfg.keep]
    x: dict[str, Column] = {}
    for c in names:
        value = as_double(c)
        if c in cfg.missing_flags:
            x[f"{c}_missing"] = (value.isNull() | F.isnan(value)).cast("double")
        value = F.when(F.abs(value) < float("inf"), value)
        if c in cfg.logs:
            value = F.log1p(F.when(value < 0, 0.0).otherwise(value))
        elif c in cfg.signed_logs:
            value = signed_log(F.coalesce(value, F.lit(0.0)))
        x[c] = value
    if not x:
        return df.select(*cfg.keep)
    raw = stored(df.select(*[F.col(c) for c in cfg.keep], *[v.alias(k) for k, v in x.items()]), "matrix")  # looked at for gaps, constants and quartiles
    zero = {k for k in x if any(z in k for z in cfg.zero_if_named)}
    with small_methods(df.sparkSession):
        facts = raw.agg(*[F.struct(F.count(k), F.count("*"), F.min(k), F.max(k)).alias(k) for k in x]).first()
    gaps = {k for k in x if facts[k][0] < facts[k][1]}
    medians = exact_quantiles(raw, {k: F.col(k) for k in x if k not in zero and k in gaps}, [0.5], ready=True)
    fill = {k: float(medians[k][0] or 0.0) if k in medians else 0.0 for k in x}
    filled = raw.select(*cfg.keep, *[F.coalesce(k, F.lit(fill[k])).alias(k) if k in gaps else F.col(k) for k in x])
    kept = list(x)
    if cfg.drop_constant:
        values = {k: {v for v in (*facts[k][2:], fill[k] if k in gaps else None) if v is not None} for k in x}
        kept = [k for k in x if len(values[k]) > 1 or k in cfg.always_keep]
    out = filled.select(*cfg.keep, *kept)
    return robust_scale(out, kept, ready=True) if cfg.scale else out


def robust_scale(df: DataFrame, columns: list[str], ready: bool = False) -> DataFrame:
    """(x - median) / (q75 - q25), by exact quantiles; no spread counts as 1. ready as in exact_quantiles."""
    facts = exact_quantiles(df, {c: as_double(c) for c in columns}, [0.25, 0.5, 0.75], ready)
    out = []
    for c in df.columns:
        if c in columns and facts[c][0] is not None:
            a, m, b = facts[c]
            out.append(((as_double(c) - F.lit(m)) / F.lit((b - a) or 1.0)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population sigma; no spread counts as 1."""
    facts = df.agg(*[F.avg(as_double(c)).alias(f"m_{c}") for c in columns], *[F.stddev_pop(as_double(c)).alias(f"s_{c}") for c in columns]).first()
    out = []
    for c in df.columns:
        if c in columns and facts[f"m_{c}"] is not None:
            out.append(((as_double(c) - F.lit(facts[f"m_{c}"])) / F.lit(facts[f"s_{c}"] or 1.0)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def drop_constant_then_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    """Without the columns that hold one value (null counts as one), nulls of the others by their median."""
    facts = df.agg(*[F.struct(F.min(as_double(c)), F.max(as_double(c)), F.count(c), F.count("*")).alias(c) for c in columns]).first()
    medians = exact_quantiles(df, {c: as_double(c) for c in columns if facts[c][2] < facts[c][3]}, [0.5])
    out = []
    for c in df.columns:
        if c not in columns:
            out.append(F.col(c))
            continue
        low, high, n, total = facts[c]
        if n and (low != high or n < total):
            out.append(F.coalesce(as_double(c), F.lit(float(medians[c][0]) if c in medians else 0.0)).alias(c))
    return df.select(*out)


def check_numeric(df: DataFrame, columns: list[str]) -> None:
    """Raises on features that aren't numbers."""
    bad = [c for c in columns if c not in numeric_columns(df)]
    if bad:
        raise ValueError(f"not numeric: {bad}")
