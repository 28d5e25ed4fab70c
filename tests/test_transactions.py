"""The transaction operators on small literal tables, and against pandas and numpy."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.entropy import binned_entropy
from ledgerlens.functions.neighbours import neighbours
from ledgerlens.functions.ranks import ranked_values
from ledgerlens.operators import account, convert, evaluate, features, graph, models, prep, profile, typology
from ledgerlens.plans.runs import ProfileConfig, ensemble_report, run_ensemble, run_profile
from ledgerlens.sinks import writers
from ledgerlens.sources import csv

SCHEMA = (
    "ts timestamp_ntz, from_bank string, account string, to_bank string, account_1 string, amount_received decimal(18,2), receiving_currency string, amount_paid decimal(18,2), "
    "payment_currency string, payment_format string, is_laundering int"
)


def at(day, hour=0, minute=0):
    return dt.datetime(2022, 9, day, hour, minute)


def row(ts, src, dst, paid=10, got=10, bank="1", to="2", label=0, fmt="Cheque"):
    from decimal import Decimal

    money = lambda x: None if x is None else Decimal(str(x))
    return (ts, bank, src, to, dst, money(got), "EUR", money(paid), "USD", fmt, label)


@pytest.fixture(scope="module")
def tx(spark):
    rows = [
        row(at(1, 1), "A", "B", 5, 4), row(at(1, 1, 30), "A", "C", 7, 7), row(at(1, 12), "A", "D"), row(at(2), "B", "A", 3, 2, label=1), row(at(2, 5), "C", "C", 1, 1, fmt="Reinvestment"),
        row(at(3), "D", "E"), row(at(3), "E", "F"), row(at(3), "D", "E"), row(at(4), None, "F", None, 0), row(None, "F", "A", 2, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_fan_out_groups(tx):
    got = {(r["account"], r["bucket"]): (r["unique_recipients"], r["total_amount"]) for r in typology.fan_out_groups(tx, "1D").collect()}
    assert got[("A", at(1))] == (3, 21.0)
    assert got[("D", at(3))] == (1, 20.0)
    assert None not in {k[0] for k in got}


def test_buckets_of_ten_hours_start_at_the_first_midnight(spark):
    rows = spark.createDataFrame([row(at(1, 5), "A", "B"), row(at(1, 10), "A", "B"), row(at(2, 7), "A", "B")], SCHEMA)
    starts = sorted(r["bucket"] for r in typology.fan_out_groups(rows, "10H").collect())
    assert starts == [at(1), at(1, 10), at(2, 6)]


def test_zscore_without_spread_flags_nothing(spark):
    rows = spark.createDataFrame([row(at(1), "A", "B"), row(at(2), "C", "D")], SCHEMA)
    for r in typology.fan_out_zscore(rows, "1D").collect():
        assert r["z_score"] is None and r["is_outlier"] is False
    assert typology.fan_out_zscore(rows.limit(0), "1D").count() == 0


def test_scatter_and_gather(tx):
    assert {r["account"] for r in typology.scatter_accounts(tx, 95).collect()} == {"A"}
    chosen = typology.scatter_gather(tx, 95)
    gather = {r["account_1"] for r in typology.gather_accounts(tx, 95).collect()}
    pdf = tx.toPandas()
    assert chosen.count() == int(((pdf.account == "A") | pdf.account_1.isin(gather)).sum())
    assert typology.gather_scatter(tx.limit(0), 95).count() == 0


def test_graphs_keep_or_drop_loops(tx):
    assert ("C", "C", 1) in {tuple(r) for r in graph.account_edges(tx).collect()}
    assert ("C", "C") not in {(r["source"], r["target"]) for r in graph.directed_edges(tx).collect()}
    assert sum(r["weight"] for r in graph.account_edges(tx).collect()) == tx.where("account is not null").count()


def test_bank_pairs_are_ordered_as_numbers(spark):
    rows = spark.createDataFrame([row(at(1), "A", "B", bank="10", to="9"), row(at(1), "A", "B", bank="9", to="10")], SCHEMA)
    assert [tuple(r) for r in graph.bank_edges(rows).collect()] == [("9", "10", 2)]


def test_ego_networks(tx):
    one = {r["id"] for r in graph.ego_nodes(tx, "A", 1).collect()}
    assert one == {"B", "C", "D", "F"}
    assert {r["id"] for r in graph.ego_nodes(tx, "A", 2).collect()} == one | {"E"}
    assert {(r["source"], r["target"]) for r in graph.ego_edges(tx, "D", 1, alters=False).collect()} == {("A", "D"), ("D", "E")}
    assert graph.ego_edges(tx, "nobody", 2).count() == 0
    with pytest.raises(ValueError):
        graph.ego_nodes(tx, "A", 0)
    with pytest.raises(KeyError):
        graph.busiest(tx, "nothing")


def test_deep_dive_counts_a_transfer_to_itself_twice(tx):
    r = account.stats(tx, "C").first()
    assert (r["total_tx"], r["inbound_tx"], r["outbound_tx"], r["unique_counterparties"]) == (3, 2, 1, 2)
    days = {r["date"]: (r["inbound"], r["outbound"]) for r in account.daily(tx, "A").collect()}
    assert days[dt.date(2022, 9, 1)] == (0.0, 22.0) and days[dt.date(2022, 9, 2)] == (2.0, 0.0)
    assert sum(r["n"] for r in account.distribution(tx, "A", "payment_format").collect()) == 5


def test_features_of_accounts(tx):
    got = {r["account"]: r for r in features.account_features(tx).collect()}
    assert got["A"]["total_out_tx"] == 3 and got["A"]["unique_receivers"] == 3
    assert got["A"]["hhi_out"] == pytest.approx(1 / 3, abs=1e-6)
    assert got["D"]["hhi_out"] == 1.0 and got["C"]["entropy_out_amt"] == 0.0
    assert got["E"]["net_flow_amt"] == -10.0


def slow_entropy(values):
    x = pd.Series(values)
    if len(x) < 2:
        return 0.0
    bins = pd.qcut(x, min(10, x.nunique()), duplicates="drop")
    p = bins.value_counts(normalize=True)
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum()) + 0.0


def test_binned_entropy_is_that_of_quantile_bins(spark):
    rng = random.Random(1)
    groups = [[round(rng.choice([rng.random(), rng.randint(1, 4)]), 2) for _ in range(rng.randint(1, 40))] for _ in range(300)] + [[1.0] * 5, [2.0], list(map(float, range(11)))]
    df = spark.createDataFrame([(i, float(v)) for i, g in enumerate(groups) for v in g], "i int, v double")
    found = binned_entropy(df, "i", "v", "h").collect()
    assert len(found) == len(groups)
    for r in found:
        assert r["h"] == pytest.approx(slow_entropy(groups[r["i"]]), abs=1e-9), groups[r["i"]]


def test_moments_and_outliers_as_in_pandas(spark):
    rng = np.random.default_rng(3)
    x = pd.DataFrame({"a": rng.lognormal(size=200), "b": rng.normal(size=200), "c": 1.0})
    df = spark.createDataFrame(x)
    got = {r["column"]: r for r in profile.numeric_summary(df).collect()}
    for c in ("a", "b"):
        assert got[c]["skew"] == pytest.approx(x[c].skew(), abs=1e-5)
        assert got[c]["kurtosis"] == pytest.approx(x[c].kurt(), abs=1e-4)
        assert got[c]["p95"] == pytest.approx(x[c].quantile(0.95), abs=1e-5)
    assert (got["c"]["skew"], got["c"]["kurtosis"]) == (0.0, 0.0)
    pairs = {(r["a"], r["b"]): r["r"] for r in profile.correlations(df).collect()}
    assert pairs["a", "b"] == pytest.approx(x.a.corr(x.b), abs=1e-5) and pairs["a", "c"] is None
    ranks = profile.correlations(df, ["a", "b"], "spearman").first()["r"]
    assert ranks == pytest.approx(x.a.rank().corr(x.b.rank()), abs=1e-5)
    out = {r["column"]: r["outlier_count"] for r in profile.outliers_iqr(df).collect()}
    q1, q3 = x.a.quantile([0.25, 0.75])
    assert out["a"] == int(((x.a < q1 - 1.5 * (q3 - q1)) | (x.a > q3 + 1.5 * (q3 - q1))).sum()) and out["c"] == 0
    found = dict(profile.vif(df, ["a", "b"]))
    gram = x[["a", "b"]].to_numpy().T @ x[["a", "b"]].to_numpy()
    assert found["a"] == pytest.approx(gram[0, 0] * np.linalg.inv(gram)[0, 0])


def test_ranked_values_need_no_global_window(spark):
    rng = random.Random(2)
    values = [rng.randint(0, 300) for _ in range(2000)]
    for r in ranked_values(spark.createDataFrame([(v,) for v in values], "v int"), "v").collect():
        assert r["n"] == values.count(r["value"]) and r["before"] == sum(v < r["value"] for v in values)


def test_neighbours_against_all_pairs(spark, monkeypatch):
    from ledgerlens.functions import neighbours as module

    monkeypatch.setattr(module, "CELL", 40)
    rng = np.random.default_rng(5)
    x = np.round(np.vstack([rng.normal(size=(300, 2)), np.zeros((30, 2)), rng.normal(5, 0.1, size=(60, 2))]), 3)
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]))
    for r in neighbours(df, ["a", "b"], 4).collect():
        unlike = np.unique(x, axis=0)
        d = np.sort(np.sqrt(((unlike - np.array(r["key"])) ** 2).sum(axis=1)))[:4]
        assert [p["d"] for p in r["near"]] == pytest.approx(d.tolist())


def test_dbscan_against_all_pairs(spark):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(0, 0.2, size=(60, 2)), rng.normal(4, 0.2, size=(60, 2)), rng.uniform(-3, 8, size=(25, 2))])
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(x)), "a": x[:, 0], "b": x[:, 1]}))
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= 0.5
    core = near.sum(axis=1) >= 5
    got = {r["i"]: r["cluster"] for r in models.dbscan(df, ["a", "b"], 0.5, 5).collect()}
    for i in range(len(x)):
        assert (got[i] == -1) == (not (near[i] & core).any())
        for j in np.flatnonzero(near[i] & core):
            if core[i]:
                assert got[i] == got[j]
    assert len({c for c in got.values() if c >= 0}) >= 2


def test_conversion(spark):
    df = spark.createDataFrame([("1.5",), ("2",), ("x",), (None,)], "v string")
    same, report = convert.convert_column(df, "v", "int")
    assert not report.success and report.n_failed == 3 and same.columns == df.columns and same.schema == df.schema
    cut, report = convert.convert_column(df.dropna(), "v", "int")
    assert [r["v"] for r in cut.collect()] == [1, 2, None] and report.failed_values == [("x", 1)]
    yes, report = convert.convert_column(spark.createDataFrame([("Yes",), ("no",), ("2",)], "v string"), "v", "bool")
    assert [r["v"] for r in yes.collect()] == [True, False, None] and report.n_failed == 1
    with pytest.raises(KeyError):
        convert.convert_column(df, "w", "int")
    with pytest.raises(ValueError):
        convert.convert_column(df, "v", "complex")


def test_csv_reading_and_inspection(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(
        "Timestamp;From Bank;Account;To Bank;Account;Amount;Flag\n2022-09-01 00:20:00;010;8000​E;10; ８０ ;1,5;1\n2022/09/01 00:21;3208;B;1;C;x;0\nnot a time;1;D;2;E;2;1\n2022-09-03;1\nlong;1;D;2;E;2;1;;\n2022-09-02;5;F;6;G;3;0\n", encoding="utf-8"
    )
    df = csv.read_csv(spark, str(path))
    assert df.columns == ["Timestamp", "From Bank", "Account", "To Bank", "Account.1", "Amount", "Flag"]
    rows = df.collect()
    assert len(rows) == 5 and rows[3]["Account"] is None and rows[3]["From Bank"] == 1.0
    assert rows[0]["Account"] == "8000E" and rows[0]["Account.1"] == "80" and rows[0]["From Bank"] == 10.0
    assert [r["Amount"] for r in rows] == [1.5, None, 2.0, None, 3.0]
    assert rows[0]["Timestamp"] == "2022-09-01 00:20:00" and rows[2]["Timestamp"] is None
    assert csv.wide_lines(spark, str(path)) == 1
    info = csv.inspect_csv(spark, str(path))
    assert (info["delimiter"], info["num_columns"], info["malformed_rows"]) == (";", 7, 2)
    assert info["columns_info"]["Flag"]["inferred_dtype"] == "bool"
    with pytest.raises(ValueError):
        csv.inspect_csv(spark, str(path), strict=True)
    assert csv.head_lines(spark, str(path), 2).count() == 2
    assert csv.read_csv(spark, str(path), nrows=1).count() == 1


def test_column_profiles(spark):
    df = spark.createDataFrame([("1", "0", "a", "2022-01-01", ""), ("2.5", "1", "b", "2022/1/2", "na"), ("-3", "1", "c", "x", None)], "f string, b string, s string, d string, e string")
    got = {r["column"]: (r["inferred_dtype"], r["missing_count"]) for r in csv.column_profile(df, df.columns).collect()}
    assert got == {"f": ("float", 0), "b": ("bool", 0), "s": ("string", 0), "d": ("string", 0), "e": ("string", 3)}


def test_matrix_imputes_logs_and_drops(spark):
    df = spark.createDataFrame([("a", 1.0, None, -5.0, 7.0), ("b", 3.0, 2.0, 5.0, 7.0), ("c", None, 4.0, 0.0, 7.0)], "account string, amount_paid double, entropy_out_amt double, net_flow_amt double, same double")
    got = {r["account"]: r for r in prep.pre_model(df, prep.MatrixConfig(keep=("account",), scale=False)).collect()}
    assert "same" not in got["a"]
    assert got["c"]["amount_paid"] == pytest.approx((math.log(2) + math.log(4)) / 2)
    assert got["a"]["entropy_out_amt"] == 0.0 and got["a"]["entropy_out_amt_missing"] == 1.0
    assert got["a"]["net_flow_amt"] == pytest.approx(-math.log(6))
    legacy = prep.pre_model(df, prep.MatrixConfig.legacy())
    assert "same" in legacy.columns
    assert prep.pre_model(df.select("account"), prep.MatrixConfig()).columns == []
    with pytest.raises(ValueError):
        prep.check_numeric(df, ["account"])


def test_evaluation_guards(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (0, 0)], "is_laundering int, hit int")
    r = evaluate.confusion(df, "hit").first()
    assert (r["tp"], r["fn"], r["precision"], r["recall"], r["f1"], r["corr"]) == (0, 1, 0.0, 0.0, 0.0, None)
    report = {r["grp"]: r for r in evaluate.agg_report(df, {"hit": F.col("hit") == 1}).collect()}
    assert report["hit"]["laundering_share_among_flagged"] == 0.0
    assert evaluate.agg_report(df.drop("is_laundering"), {"hit": F.col("hit") == 1}).first()["n_laundering"] is None


def test_ensemble_votes(spark):
    rng = np.random.default_rng(1)
    x = pd.DataFrame({"a": np.append(rng.normal(size=400), [12.0, -11.0]), "b": np.append(rng.normal(size=400), [9.0, 10.0]), "is_laundering": [0] * 400 + [1, 1]})
    scored = run_ensemble(spark.createDataFrame(x), ["a", "b"])
    rows = scored.orderBy(F.desc("anomaly_votes")).limit(2).collect()
    assert all(r["anomaly_votes"] >= 2 and r["is_laundering"] == 1 for r in rows)
    report = {r["grp"]: r for r in ensemble_report(scored).collect()}
    assert report["all_rows"]["n_flagged"] == 402 and set(report) >= {"iforest", "lof", "copod", "consensus"}


def test_profile_run_and_sinks(spark, tx, tmp_path):
    results = run_profile(tx, ProfileConfig(exclude=("multicollinearity",)))
    assert set(results) == {"missingness", "outliers", "scaling_encoding", "distributions"}
    writers.write_step("missingness", results["missingness"], str(tmp_path))
    writers.write_summary(spark, results, str(tmp_path))
    assert (tmp_path / "missingness/missing_by_column").exists() and spark.read.text(f"{tmp_path}/summary").count() == 1
    writers.write_graph(graph.account_nodes(tx), graph.account_edges(tx), f"{tmp_path}/graph")
    assert spark.read.option("header", True).csv(f"{tmp_path}/graph/edges").columns == ["Source", "Target", "Weight"]
    said = {r["feature_name"]: r["description"] for r in writers.data_dictionary(spark, {"account": ["hhi_out", "net_flow_amt"], "tx": ["PF_cheque"]}).collect()}
    assert said["PF_cheque"] == "payment format, one-hot"


def test_streams_agree_with_batches(spark, tx, tmp_path):
    from ledgerlens.streaming.typology_stream import fan_out_stream

    rows = tx.where("ts is not null and account is not null")
    rows.write.parquet(f"{tmp_path}/in")
    stream = fan_out_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("fan_out").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    got = {(r["account"], r["bucket"]): r["unique_recipients"] for r in spark.table("fan_out").collect()}
    assert got == {(r["account"], r["bucket"]): r["unique_recipients"] for r in typology.fan_out_groups(rows, "1D").collect()}


def test_exact_quantiles_as_in_numpy(spark, monkeypatch):
    from ledgerlens.functions import quantiles

    monkeypatch.setattr(quantiles, "ACCURACY", 50)  # brackets that hold many values
    rng = np.random.default_rng(11)
    x = pd.DataFrame({"a": rng.normal(size=3000), "b": rng.integers(0, 4, 3000) * 1.0, "c": 7.0, "d": np.nan})
    x.loc[::7, "a"] = np.nan
    df = spark.createDataFrame(x).repartition(5)
    ps = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = quantiles.exact_quantiles(df, {c: F.col(c) for c in x}, ps)
    for c in "abc":
        assert got[c] == pytest.approx(x[c].quantile(ps).tolist()), c
    assert got["d"] == [None] * len(ps)
    assert quantiles.exact_quantiles(df.limit(0), {"a": F.col("a")}, [0.5]) == {"a": [None]}
    assert quantiles.exact_quantiles(spark.createDataFrame([(3.0,)], "b double"), {"b": F.col("b")}, [0.3])["b"] == [3.0]


def test_csv_values_with_breaks_delimiters_and_dotted_names(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text('a;b;c.d\nA;1;x\nB;2,5\n"E\nE";5;"q;""r"\nF;6;;\nG;7;\n', encoding="utf-8")
    rows = csv.read_csv(spark, str(path), account_columns=("a",)).collect()
    assert sorted(tuple(r) for r in rows if r["c.d"] is not None) == [("A", 1.0, "x"), ("E\nE", 5.0, 'q;"r'), ("G", 7.0, "")]
    assert [tuple(r) for r in rows if r["c.d"] is None] == [("B", 2.5, None)] and csv.wide_lines(spark, str(path)) == 1
    latin = tmp_path / "latin.csv"
    latin.write_bytes("a;é\n1;ü\n".encode("latin-1"))
    assert csv.read_csv(spark, str(latin), encoding="iso-8859-1").columns == ["a", "é"]
    theirs, stats = csv.read_account(spark, str(path), " A ", "a", "b", "c.d")
    assert theirs.count() == 1 and stats.first()["total_rows"] == 4


def test_times_of_the_type_lattice(spark):
    given = {"z": "2022-01-01T00:00:00Z", "offset": "2022-01-01 00:00+02:00", "plain": "2022-01-01", "slash": "2022/01/01", "dot": "01.02.2022", "e": "1e6", "f": "1f"}
    df = spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} string" for k in given))
    got = {r["column"]: r["inferred_dtype"] for r in csv.column_profile(df, df.columns).collect()}
    assert got == {"z": "datetime", "offset": "datetime", "plain": "datetime", "slash": "string", "dot": "string", "e": "float", "f": "string"}


def test_a_step_that_fails_when_it_runs_stops_no_other(spark, tx):
    broken = tx.withColumn("payment_format", F.when(F.col("account") == "A", F.raise_error(F.lit("broken"))).otherwise(F.col("payment_format")))
    results = run_profile(broken, ProfileConfig(only=("scaling_encoding", "outliers")))
    assert "broken" in results["scaling_encoding"].warnings[0] and not results["scaling_encoding"].tables
    assert results["outliers"].tables and not results["outliers"].warnings


def test_columns_beyond_a_limit_are_named(spark):
    df = spark.createDataFrame([(float(k), float(-k), k * k * 1.0) for k in range(60)], "a double, b double, c double")
    found = run_profile(df, ProfileConfig(only=("multicollinearity",), most_columns=2, most_vif_columns=2, with_vif=True))["multicollinearity"]
    assert len(found.warnings) == 2 and all(w.endswith(": c") for w in found.warnings)
    assert profile.correlations(df).count() == 3


def test_workbook_and_folder(spark, tx, tmp_path):
    import zipfile

    folder = writers.run_folder(spark, str(tmp_path), "run 1")
    sheets = dict(zip(writers.SHEETS, (account.stats(tx, "A"), account.daily(tx, "A"), account.distribution(tx, "A", "payment_format"), account.distribution(tx, "A", "payment_currency")), strict=True))
    file = writers.write_account_report(spark, "A", sheets, folder)
    with zipfile.ZipFile(file) as z:
        assert sum(n.startswith("xl/worksheets/") for n in z.namelist()) == 4
        assert [n for n in writers.SHEETS if f'name="{n}"' in z.read("xl/workbook.xml").decode()] == list(writers.SHEETS)
    writers.write_readme(spark, {"account_features": sheets["Stats"]}, folder, "2022-09-01")
    assert "account_features" in open(f"{folder}/README.txt").read()
    with pytest.raises(ValueError):
        writers.write_account_report(spark, "A", {"Stats": sheets["Stats"]}, folder)


def test_reports_by_logical_type(spark, tx, tmp_path):
    flags = spark.createDataFrame([(True, None, 1.5), (False, None, -2.0), (True, None, 1234.5), (None, None, None)], "f boolean, n string, x double")
    got = {r["metric"]: r["value"] for r in profile.univariate_report(flags, "f").collect()}
    assert (got["true_count"], got["false_pct"], got["logical_type"], got["rows_total"]) == ("2", "33.333333", "boolean", "4")
    numeric = {r["metric"]: (r["section"], r["value"]) for r in profile.univariate_report(flags, "x", write_path=f"{tmp_path}/x").collect()}
    assert numeric["max"] == ("Numeric", "1,234.5") and numeric["count_valid"] == ("Numeric", "3") and numeric["outliers_zscore_count"][1] == "0"
    assert spark.read.option("header", True).csv(f"{tmp_path}/x").columns == ["section", "metric", "value", "rank", "key", "count", "pct"]
    assert profile.univariate_report(flags, "n").where("metric = 'top_value'").count() == 0
    assert profile.univariate_report(flags.limit(0), "x").where("metric = 'rows_total'").first()["value"] == "0"


def test_the_entry_module():
    import __spark_entry__

    named, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert len(named) > 80 and set(sql) <= set(named)


def test_quantiles_are_exact_whatever_the_brackets(spark, monkeypatch):
    from ledgerlens.functions import quantiles

    monkeypatch.setattr(quantiles, "SKETCHED", 200)
    monkeypatch.setattr(quantiles, "FEW", 3)
    rng = np.random.default_rng(13)
    x = pd.DataFrame({"a": rng.normal(size=4000), "b": rng.integers(0, 2, 4000) * 1.0, "c": np.where(rng.random(4000) < 0.3, np.nan, rng.integers(0, 9, 4000))})
    df, ps = spark.createDataFrame(x).repartition(3).cache(), [0.0, 0.25, 0.5, 0.75, 1.0]
    real = quantiles._brackets

    def off(found, counts, ps, sampled):
        ends = real(found, counts, ps, sampled)
        return {c: [90.0] * len(e) if c == "_0" else e for c, e in ends.items()} if sampled else ends

    for brackets in (real, off):
        monkeypatch.setattr(quantiles, "_brackets", brackets)
        got = quantiles.exact_quantiles(df, {c: F.col(c) for c in x}, ps, ready=True)
        for c in x:
            assert got[c] == pytest.approx(x[c].quantile(ps).tolist()), c


def test_one_row_a_batch_for_a_bracket_of_one_value():
    from ledgerlens.functions import quantiles

    batch = pa.RecordBatch.from_pydict({"x": [0.0] * 5000 + [1.0] * 3000})
    rows = [r for b in quantiles._counted([(0, 0.0, 0.0), (0, 1.0, 1.0)])([batch]) for r in b.to_pylist()]
    assert sorted((r["k"], r["v"] is None, r["n"]) for r in rows) == [(0, False, 5000), (0, True, 0), (1, False, 3000), (1, True, 5000)]


def test_entropy_looks_at_no_row_with_a_lambda(spark):
    from ledgerlens.functions.entropy import binned_entropy

    rows = spark.createDataFrame([("a", float(i % 7)) for i in range(50)], "k string, v double")
    plan = binned_entropy(rows, "k", "v", "h")._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan


def test_rounding_is_half_away_from_zero(spark):
    from ledgerlens.functions.numeric import rounded

    values = [0.125, -0.125, 2.5, -2.675, 1e300, -1e20, float("inf"), 0.0, None, 1234567.891]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(rounded(F.col("x"), 2)).collect()]
    assert got == [0.13, -0.13, 2.5, -2.68, 1e300, -1e20, float("inf"), 0.0, None, 1234567.89]


def test_paths_of_flat_trees_are_those_of_the_trees():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 3)), 1)
    tree = models._grow(x, 8, rng)

    def walk(node, row, depth=0):
        return walk(node[2 if row[node[0]] < node[1] else 3], row, depth + 1) if isinstance(node, list) else depth + models._mean_path(node)

    assert models._paths(models._flat(tree), x).tolist() == [walk(tree, row) for row in x]
    assert models._paths(models._flat(5), x).tolist() == [models._mean_path(5)] * 300


def test_neighbours_cross_cells_and_ties_go_by_the_points(spark, monkeypatch):
    from ledgerlens.functions import neighbours as module

    monkeypatch.setattr(module, "CELL", 3)
    monkeypatch.setattr(module, "LEAF", 4)
    grid = [(float(a), float(b)) for a in range(12) for b in range(12)]
    rows = spark.createDataFrame(grid + grid[:40], "a double, b double")
    unlike = np.array(grid)
    for r in neighbours(rows, ["a", "b"], 6).collect():
        d = np.sqrt(((unlike - np.array(r["key"])) ** 2).sum(axis=1))
        best = sorted((float(x), tuple(p)) for x, p in zip(d, unlike.tolist()))[:6]
        assert [(p["d"], tuple(p["key"])) for p in r["near"]] == best
        assert r["n"] == 1 + (grid.index(tuple(r["key"])) < 40) and r["near"][0]["id"] == r["id"]


def test_the_ensemble_ranks_and_scores_stored_rows(spark):
    rows = pd.DataFrame({"a": np.arange(60.0) % 7, "b": np.arange(60.0) % 11})
    read = []
    real = models.copod_scores

    def seen(df, columns, *more):
        read.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, columns, *more)

    models.copod_scores = seen
    try:
        run_ensemble(spark.createDataFrame(rows), ["a", "b"])
    finally:
        models.copod_scores = real
    assert "Join" not in read[0] and "ArrowEvalPython" not in read[0]


def test_outlier_factors_over_cells_are_those_of_all_rows(spark, monkeypatch):
    from ledgerlens.functions import neighbours as module

    monkeypatch.setattr(module, "CELL", 3)
    monkeypatch.setattr(module, "LEAF", 4)
    k = 3
    times = {(float(a), float(b)): 1 + 3 * (a == 5) * (b % 4 == 0) + (a + b) % 2 for a in range(12) for b in range(12)} | {(300.0, -40.0): 1, (11.5, 11.25): 2, (0.0, 400.0): 5}
    rows = spark.createDataFrame([(*p, n) for p, n in times.items()], "a double, b double, n int")
    keys = sorted(times)
    near, last = {}, {}
    for p in keys:
        d = sorted((math.sqrt((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2), q) for q in keys)
        near[p] = [x for x in d for _ in range(times[x[1]])][1 : k + 1]  # without the row itself
        last[p] = near[p][-1][0]
    dense = {p: 1 / (sum(max(d, last[q]) for d, q in near[p]) / k + 1e-10) for p in keys}
    want = {p: sum(dense[q] for _, q in near[p]) / k / dense[p] for p in keys}
    got = {tuple(r["key"]): r["factor"] for r in module.local_outliers(rows, ["a", "b"], k, "n").collect()}
    assert got == pytest.approx(want)
    copies = spark.createDataFrame([p for p, n in times.items() for _ in range(n)], "a double, b double")
    assert {tuple(r["key"]): r["factor"] for r in module.local_outliers(copies, ["a", "b"], k).collect()} == pytest.approx(want)
    alone = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert [r["factor"] for r in module.local_outliers(alone, ["a", "b"], k).collect()] == [None]
    assert module.local_outliers(alone.limit(0), ["a", "b"], k).count() == 0


def test_points_score_like_their_rows(spark):
    from ledgerlens.operators import features
    from ledgerlens.plans.runs import points_report

    rng = np.random.default_rng(4)
    x = pd.DataFrame({"a": np.round(rng.gamma(2, 30, 250), 2), "b": np.round(rng.normal(size=250), 1)}).loc[np.repeat(np.arange(250), rng.integers(1, 25, 250))].reset_index(drop=True)
    x["is_laundering"], x["id"] = rng.integers(0, 2, len(x)), np.arange(len(x))
    x.loc[3, "a"] = np.nan
    df = spark.createDataFrame(x)
    want = models.copod_scores(models.lof_scores(models.isolation_forest(features.clean_numeric(df), ["a", "b"]), ["a", "b"], 20), ["a", "b"])
    for d in models.DETECTORS:
        want = models.flagged(want, f"{d}_score", f"{d}_is_outlier", 0.005)
    want = models.votes(want, [f"{d}_is_outlier" for d in models.DETECTORS])
    got = run_ensemble(df, ["a", "b"])
    assert got.columns == want.columns
    pairs = zip(*(t.orderBy("id").collect() for t in (got, want)), strict=True)
    assert all(list(a) == pytest.approx(list(b), rel=1e-12) for a, b in pairs)
    assert sorted(points_report(df, ["a", "b"]).collect()) == sorted(ensemble_report(want).collect())
    assert sorted(map(str, points_report(df.drop("is_laundering"), ["a", "b"]).collect())) == sorted(map(str, ensemble_report(want.drop("is_laundering")).collect()))
    assert {r["n_flagged"] for r in points_report(df.limit(0), ["a", "b"]).collect()} == {0}


def test_narrow_transactions_shuffle_no_row_for_its_holders(spark, monkeypatch):
    from ledgerlens.sources import transactions as module

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda **k: module.transactions(spark, "/root/testdata/sf0.001", **k).select("amount_paid")._jdf.queryExecution().executedPlan().toString()
        assert plan().count("SortMergeJoin") == 3 and plan(wide=False).count("SortMergeJoin") == 1
        rows = [sorted(module.transactions(spark, "/root/testdata/sf0.001", wide=w).collect()) for w in (True, False)]
        assert rows[0] == rows[1]
        monkeypatch.setattr(module, "BROADCAST_BYTES", 64)
        assert plan(wide=False).count("SortMergeJoin") == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_quantiles_of_rows_that_stand_for_many(spark, monkeypatch):
    from ledgerlens.functions import quantiles

    rng = np.random.default_rng(5)
    v, n = np.round(rng.normal(size=500), 2), rng.integers(0, 40, 500)
    n[7] = 3000
    rows = spark.createDataFrame(pd.DataFrame({"v": v, "n": n})).union(spark.createDataFrame([(None, 9), (float("nan"), 9)], "v double, n long"))
    want = np.quantile(np.repeat(v, n), [0.0, 0.3, 0.995, 1.0]).tolist()
    monkeypatch.setattr(quantiles, "BATCH", 1000)
    for sketched in (1 << 20, 2000):
        monkeypatch.setattr(quantiles, "SKETCHED", sketched)
        assert quantiles.exact_quantiles(rows, {"v": F.col("v")}, [0.0, 0.3, 0.995, 1.0], weight=F.col("n"))["v"] == pytest.approx(want)


def test_the_ensemble_report_writes_points_and_neither_rows_nor_neighbours(spark, monkeypatch, tmp_path):
    from ledgerlens.plans import profiling

    view = profiling.transactions
    monkeypatch.setattr(profiling, "transactions", lambda *a, **k: view(*a, **k).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(3)))))
    monkeypatch.setattr("ledgerlens.functions.storage.shared_folder", lambda spark: str(tmp_path))
    report = {r["grp"]: r["n_flagged"] for r in profiling.QUERIES["ensemble_report_full"](spark, "/root/testdata/sf0.001").collect()}
    tx = view(spark, "/root/testdata/sf0.001")
    unlike = tx.select("amount_paid", "amount_received").distinct().count()
    assert report["all_rows"] == 3 * tx.count() >= 3 * unlike
    for path in (tmp_path / "ledgerlens").iterdir():
        table = spark.read.parquet(str(path))
        assert table.count() <= 2 * unlike and "struct" not in " ".join(kind for _, kind in table.dtypes), path.name  # ranks have both columns' values
