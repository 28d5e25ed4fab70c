"""Whole runs: the profiling steps, the feature build, the detector ensemble."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.storage import stored
from ledgerlens.operators import evaluate, features, models, prep, profile
from ledgerlens.sinks.writers import StepResult


@dataclass
class ProfileConfig:
    only: tuple[str, ...] | None = None
    exclude: tuple[str, ...] = ()
    warn_missing: float = 0.30
    top: int = 15
    outlier_rule: str = "iqr"
    correlation_limit: float = 0.85
    most_columns: int | None = 60
    with_vif: bool = False
    most_vif_columns: int | None = 25


def _missingness(df: DataFrame, cfg: ProfileConfig) -> StepResult:
    table = profile.missingness(df)
    much = [r["column"] for r in table.where(F.col("missing_ratio") >= cfg.warn_missing).collect()]
    return StepResult({"missing_by_column": table}, warnings=[f"{c}: much is missing" for c in much])


def _outliers(df: DataFrame, cfg: ProfileConfig) -> StepResult:
    table = profile.outliers_mad(df) if cfg.outlier_rule == "mad" else profile.outliers_iqr(df)
    return StepResult({"outlier_summary_numeric": table})


def _hints(df: DataFrame, cfg: ProfileConfig) -> StepResult:
    return StepResult({"scaling": profile.scaling_hints(df), "encoding": profile.encoding_hints(df)})


def _distributions(df: DataFrame, cfg: ProfileConfig) -> StepResult:
    texts = [c for c, kind in df.dtypes if kind == "string"]
    return StepResult({"numeric_summary": profile.numeric_summary(df), "categorical_top_values": profile.top_values(df, texts, cfg.top)})


def _collinearity(df: DataFrame, cfg: ProfileConfig) -> StepResult:
    columns = prep.numeric_columns(df)
    pairs = stored(profile.correlations(df, columns, most=cfg.most_columns), "correlations")
    high = pairs.where(F.abs("r") >= cfg.correlation_limit).orderBy(F.desc(F.abs("r")), "a", "b")
    found = StepResult({"corr_matrix": pairs, "high_corr_pairs": high})
    without = profile.left_out(columns, cfg.most_columns)
    if without:
        found.warnings.append(f"correlations leave out {len(without)} columns beyond the first {cfg.most_columns}: {', '.join(without)}")
    if cfg.with_vif:
        found.metrics = {f"vif_{c}": v for c, v in profile.vif(df, columns, most=cfg.most_vif_columns) if v is not None}
        without = profile.left_out(columns, cfg.most_vif_columns)
        if without:
            found.warnings.append(f"VIF leaves out {len(without)} columns beyond the first {cfg.most_vif_columns}: {', '.join(without)}")
    return found


STEPS: dict[str, Callable[[DataFrame, ProfileConfig], StepResult]] = {
    "missingness": _missingness,
    "outliers": _outliers,
    "scaling_encoding": _hints,
    "distributions": _distributions,
    "multicollinearity": _collinearity,
}


def run_profile(df: DataFrame, config: ProfileConfig | None = None) -> dict[str, StepResult]:
    """The chosen steps' results, their tables computed and stored; a step that fails, when it is planned or when it runs, leaves a warning and doesn't stop the others."""
    cfg = config or ProfileConfig()
    out = {}
    for name, step in STEPS.items():
        if (cfg.only is not None and name not in cfg.only) or name in cfg.exclude:
            continue
        found = StepResult()
        try:
            found = step(df, cfg)
            found.tables = {k: stored(t, f"profile-{name}") for k, t in found.tables.items()}
        except Exception as error:  # noqa: BLE001  any step may fail by itself
            found = StepResult(metrics=found.metrics, warnings=[*found.warnings, f"failed: {error}"[:500]])
        out[name] = found
    return out


def build_features(tx: DataFrame) -> dict[str, DataFrame]:
    """Transaction features, account features, transactions in context, and both model matrices."""
    tx = stored(tx, "tx")  # a join, as a rule, that categories, accounts and context all read
    t = features.one_hot(features.one_hot(features.tx_features(features.basic_casts(tx)), "payment_format", "PF"), "payment_currency", "PC")
    accounts = stored(features.clean_numeric(features.account_features(tx)), "accounts")
    context = features.clean_numeric(features.attach_context(t, accounts))  # the matrix reads it once, and stores what it looks at again
    return {
        "tx_features": t,
        "account_features": accounts,
        "tx_with_context": context,
        "tx_matrix": prep.pre_model(context, prep.MatrixConfig(keep=("is_laundering",))),
        "account_matrix": prep.pre_model(accounts, prep.MatrixConfig(keep=("account",))),
    }


def _scored_points(df: DataFrame, columns: list[str], contamination: float, k: int, label: str | None = None) -> DataFrame:
    """The different points of df as doubles, the rows that each stands for in _n and of these those with label 1 in _labelled, with scores, flags, votes and consensus.

    Detectors look at nothing but a row's values, so equal rows have equal scores; what is written grows with the different points and not with the rows.
    """
    bad = F.count_if(F.col(label) == 1) if label else F.lit(None).cast("long")
    points = df.groupBy(*[F.col(c).cast("double").alias(c) for c in columns]).agg(F.count("*").alias("_n"), bad.alias("_labelled"))
    points = stored(points, "ensemble")  # the detectors read it several times
    out = models.isolation_forest(points, columns, weight="_n")
    out = stored(models.lof_scores(out, columns, k, weight="_n"), "local")  # copod counts and ranks it
    out = stored(models.copod_scores(out, columns, "copod_score", "_n"), "scores")  # each limit reads a score, and the result all of them
    for d in models.DETECTORS:
        out = models.flagged(out, f"{d}_score", f"{d}_is_outlier", contamination, "_n")
    return models.votes(out, [f"{d}_is_outlier" for d in models.DETECTORS])


def run_ensemble(matrix: DataFrame, columns: list[str], contamination: float = 0.005, k: int = 20) -> DataFrame:
    """matrix with the scores and flags of three detectors, their votes and the consensus."""
    prep.check_numeric(matrix, columns)
    df = stored(features.clean_numeric(matrix), "matrix")  # read for its points, and for the result
    points = _scored_points(df, columns, contamination, k)
    found = points.select(*[F.col(c).alias(f"_at_{i}") for i, c in enumerate(columns)], *[c for c in points.columns if c not in (*columns, "_n", "_labelled")])
    same = [F.col(c).cast("double") == F.col(f"_at_{i}") for i, c in enumerate(columns)]
    return df.join(found, same, "left").drop(*[f"_at_{i}" for i in range(len(columns))])


def points_report(matrix: DataFrame, columns: list[str], label: str | None = "is_laundering", contamination: float = 0.005, k: int = 20) -> DataFrame:
    """The report of the ensemble's run over matrix, from its different points: no row is written."""
    prep.check_numeric(matrix, columns)
    label = label if label in matrix.columns else None
    df = features.clean_numeric(matrix.select(*dict.fromkeys([*columns, *([label] if label else [])])))
    return ensemble_report(_scored_points(df, columns, contamination, k, label), "_labelled" if label else None, "_n")


def ensemble_report(scored: DataFrame, label: str | None = "is_laundering", weight: str | None = None) -> DataFrame:
    """The six flag groups and all rows against the label. weight names the column that says for how many rows a row stands."""
    groups = {d: F.col(f"{d}_is_outlier") == 1 for d in models.DETECTORS}
    groups |= {f"votes_{n}": F.col("anomaly_votes") == n for n in (2, 3)} | {"consensus": F.col("consensus_anomaly") == 1}
    return evaluate.agg_report(scored, groups, label, weight)
