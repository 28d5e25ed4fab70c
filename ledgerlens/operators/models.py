"""Unsupervised detectors over numeric columns, and their vote."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.functions.neighbours import core_links, dense_points, least_label, local_outliers, neighbours
from ledgerlens.functions.numeric import as_double, skewness
from ledgerlens.functions.quantiles import exact_quantiles
from ledgerlens.functions.ranks import ranked_columns
from ledgerlens.functions.storage import stored

DETECTORS = ("iforest", "lof", "copod")


def flagged(scores: DataFrame, score: str, flag: str, contamination: float, weight: str | None = None) -> DataFrame:
    """scores with flag 1 above the percentile that leaves the contamination's share. With a weight, which names the column that says for how many rows a row stands, scores is a stored table."""
    limit = exact_quantiles(scores, {score: F.col(score)}, [1 - contamination], weight is not None, None if weight is None else F.col(weight))[score][0]
    return scores.withColumn(flag, (F.col(score) > F.lit(limit)).cast("int"))


def _third_moments(df: DataFrame, columns: list[str], weight: str) -> dict[str, float | None]:
    """Of each column the sum of the cubes of what lies off the mean, null for fewer than three rows."""
    there = {c: F.when(as_double(c).isNotNull(), F.col(weight)) for c in columns}
    sums = df.agg(*[F.struct(F.sum(n).alias("n"), F.sum(n * as_double(c)).alias("s")).alias(c) for c, n in there.items()]).first()
    few = {c: (sums[c]["n"] or 0) < 3 for c in columns}
    off = {c: as_double(c) - F.lit(None if few[c] else sums[c]["s"] / sums[c]["n"]).cast("double") for c in columns}
    return df.agg(*[F.sum(there[c] * d * d * d).alias(c) for c, d in off.items()]).first().asDict()


def copod_scores(df: DataFrame, columns: list[str], score: str = "copod_score", weight: str | None = None) -> DataFrame:
    """Copula-based outlier score: per column the negative logs of both tails' empirical probabilities; a column counts with the tail
    that its skewness names, or with the mean of both if that is more; columns add up. Each column is ranked over its different values.
    weight names the column that says for how many rows a row stands."""
    ranks = ranked_columns(df, columns, weight)
    if weight is None:
        n, signs = df.count(), df.agg(*[F.signum(skewness(c)).alias(c) for c in columns]).first()
    else:
        n, signs = df.agg(F.sum(weight)).first()[0] or 0, _third_moments(df, columns, weight)
    out, parts = df, []
    for c in columns:
        side = ranks.where(F.col("column") == c).select(
            F.col("value").alias("_v"),
            (-F.log((F.col("before") + F.col("n")) / F.lit(float(n)))).alias(f"_l_{c}"),
            (-F.log((F.lit(float(n)) - F.col("before")) / F.lit(float(n)))).alias(f"_r_{c}"),
        )
        out = out.join(side, as_double(c) == F.col("_v"), "left").drop("_v")
        left, right, sign = F.col(f"_l_{c}"), F.col(f"_r_{c}"), signs[c] or 0.0
        tail = left if sign < 0 else right if sign > 0 else left + right
        parts.append(F.greatest(tail, (left + right) / 2))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return out.select(*df.columns, F.round(total, 6).alias(score))


def _expanded(near: Column, k: int) -> Column:
    """Distances of the k nearest rows of a point, copies of a point counted as rows."""
    return F.slice(F.flatten(F.transform(near, lambda p: F.array_repeat(p["d"], F.least(p["n"], F.lit(k)).cast("int")))), 1, k)


def _keyed(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumn("_key", F.array(*[F.col(c).cast("double") for c in columns]))


def knn_scores(df: DataFrame, columns: list[str], k: int = 3, score: str = "knn_score") -> DataFrame:
    """Mean distance to the k nearest rows, the row itself being one."""
    near = neighbours(df, columns, k).select(F.col("key").alias("_k"), _expanded(F.col("near"), k).alias("_d"))
    mean = F.aggregate("_d", F.lit(0.0), lambda s, d: s + d) / F.size("_d")
    keyed = _keyed(df, columns)
    return keyed.join(near, keyed["_key"] == near["_k"], "left").select(*df.columns, F.round(mean, 6).alias(score))


def lof_scores(df: DataFrame, columns: list[str], k: int = 20, score: str = "lof_score", weight: str | None = None) -> DataFrame:
    """Local outlier factor over the k nearest other rows. weight names the column that says for how many rows a row stands."""
    factors = local_outliers(df, columns, k, weight).select(F.col("key").alias("_k"), F.round("factor", 6).alias(score))
    keyed = _keyed(df, columns)
    return keyed.join(factors, keyed["_key"] == factors["_k"], "left").select(*df.columns, score)


def dbscan(df: DataFrame, columns: list[str], eps: float, least: int) -> DataFrame:
    """df with cluster: -1 for noise, else the rank of the cluster by its smallest core point.

    Core points have `least` rows within eps, themselves included; clusters are the components of core points; a border point belongs to the smallest cluster that reaches it.
    Points are sent to the cells that a ball of eps reaches; neighbours are counted, and links thinned to stars, within cells, so no pairs of points are written.
    """
    marked, cells = dense_points(df, columns, eps, least)
    marked = stored(marked, "points")
    roots = _components(stored(core_links(marked, cells, eps), "links"))
    core = marked.where("core").join(roots, F.col("key") == F.col("vertex"), "left").select("key", F.coalesce("root", "key").alias("root"))
    clusters = stored(core.select("root").distinct(), "clusters")
    ranks = _placed_in_order(clusters, "root")
    labels = stored(core.join(ranks, "root").select("key", F.col("place").alias("label")), "labels")
    found = labels.unionByName(least_label(marked, labels, cells, eps)).select(F.col("key").alias("_k"), "label")
    keyed = _keyed(df, columns)
    return keyed.join(found, F.col("_key") == F.col("_k"), "left").select(*df.columns, F.coalesce("label", F.lit(-1)).cast("int").alias("cluster"))


def _placed_in_order(df: DataFrame, column: str) -> DataFrame:
    """df with place, the number of rows before each in the column's order: running numbers in sorted ranges, and the ranges' sizes, a number each, added up."""
    ranged = stored(df.repartitionByRange(column).sortWithinPartitions(column).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = {r["_range"]: r["n"] for r in ranged.groupBy("_range").agg(F.count("*").alias("n")).collect()}
    first, total = {}, 0
    for k in sorted(sizes):
        first[k], total = total, total + sizes[k]
    bases = df.sparkSession.createDataFrame([*first.items()] or [(-1, 0)], "_range int, _base long")
    own = F.row_number().over(W.partitionBy("_range").orderBy(column)) - 1
    return ranged.join(F.broadcast(bases), "_range").select(*df.columns, (F.col("_base") + own).alias("place"))


def _components(links: DataFrame, most: int = 60) -> DataFrame:
    """(vertex, root) of every vertex in links (u, v); root is the smallest of its component. Large and small stars in turn, each round a table of the shared folder."""
    a, b = F.col("u"), F.col("v")
    edges = stored(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    for _ in range(most):
        around = edges.select("u", "v").union(edges.select("v", "u"))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = stored(around.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "edges")
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        edges = stored(moved.where("u != v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
        before = now
    raise RuntimeError("no components")


def kmeans_scores(df: DataFrame, columns: list[str], k: int = 3, seed: int = 42, score: str = "kmeans_score") -> DataFrame:
    """Distance to the nearest of k centres, and the centre's number in cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=columns, outputCol="_features", handleInvalid="error").transform(df)
    model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster").fit(vectors)
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])  # k by d numbers
    point = F.array(*[F.col(c).cast("double") for c in columns])
    apart = F.aggregate(F.zip_with(point, F.get(centres, F.col("cluster")), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return model.transform(vectors).select(*df.columns, "cluster", F.round(F.sqrt(apart), 6).alias(score))


def _grow(x: np.ndarray, depth: int, rng) -> list:
    """[column, cut, low, high], or the number of rows of a leaf."""
    if depth == 0 or len(x) <= 1:
        return len(x)
    live = np.flatnonzero(x.max(axis=0) > x.min(axis=0))
    if not len(live):
        return len(x)
    c = int(rng.choice(live))
    cut = float(rng.uniform(x[:, c].min(), x[:, c].max()))
    low = x[:, c] < cut
    return [c, cut, _grow(x[low], depth - 1, rng), _grow(x[~low], depth - 1, rng)]


def _mean_path(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _flat(tree) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """A tree's nodes as columns, cuts, children (low and high side by side; a leaf is its own child), path lengths of leaves, and its depth."""
    column, cut, child, length = [], [], [], []
    waiting, deepest = [(tree, 0, -1)], 0
    while waiting:
        node, depth, place = waiting.pop()
        me = len(column)
        if place >= 0:
            child[place] = me
        deepest = max(deepest, depth)
        inner = isinstance(node, list)
        column.append(node[0] if inner else 0)
        cut.append(node[1] if inner else 0.0)
        child += [me, me]
        length.append(0.0 if inner else depth + _mean_path(node))
        if inner:
            waiting += [(node[3], depth + 1, 2 * me + 1), (node[2], depth + 1, 2 * me)]
    return np.array(column), np.array(cut), np.array(child), np.array(length), deepest


def _paths(flat, x: np.ndarray) -> np.ndarray:
    """Each row's path length. All rows go down together, a level at a time."""
    column, cut, child, length, deepest = flat
    values, rows, at = x.reshape(-1), np.arange(len(x)) * x.shape[1], np.zeros(len(x), np.int64)
    for _ in range(deepest):
        at = child[2 * at + ~(values[rows + column[at]] < cut[at])]
    return length[at]


def isolation_forest(df: DataFrame, columns: list[str], trees: int = 100, sample: int = 256, seed: int = 42, score: str = "iforest_score", weight: str | None = None) -> DataFrame:
    """Isolation forest: trees on a sample of at most trees * sample rows, those whose values hash lowest; every row is scored. weight names the column that says for how many rows a row stands."""
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]
    times = [] if weight is None else [F.col(weight).alias("_n")]
    drawn = df.select(*values, *times).orderBy(F.xxhash64(*columns), *columns).limit(trees * sample).toPandas().to_numpy()
    if times:
        n = drawn[:, -1].astype(np.int64)
        drawn = np.repeat(drawn[:, :-1], np.clip(trees * sample - (np.cumsum(n) - n), 0, n), axis=0)
    rng = np.random.default_rng(seed)
    size = min(sample, len(drawn))
    forest = [_grow(drawn[rng.choice(len(drawn), size, replace=False)], int(np.ceil(np.log2(max(size, 2)))), rng) for _ in range(trees)] if size else []
    kept = df.sparkSession.sparkContext.broadcast([_flat(tree) for tree in forest])
    unit = _mean_path(max(size, 2))

    @F.pandas_udf("double")
    def scored(x: pd.DataFrame) -> pd.Series:
        m, total = np.ascontiguousarray(x.to_numpy(dtype=float)), np.zeros(len(x))
        for tree in kept.value:
            total += _paths(tree, m)
        return pd.Series(np.power(2.0, -total / max(len(kept.value), 1) / unit))

    return df.withColumn(score, scored(F.struct(*values)))


def top_flags(df: DataFrame, score: str, flag: str, k: int = 3) -> DataFrame:
    """flag 1 for the k rows with the highest score; ties go by the other columns, in order."""
    top = df.orderBy(F.desc(score), *[c for c in df.columns if c != score]).limit(k).select(F.struct(*df.columns).alias("_row")).distinct()
    held = df.withColumn("_all", F.struct(*df.columns))
    return held.join(F.broadcast(top), F.col("_all") == F.col("_row"), "left").select(*df.columns, F.col("_row").isNotNull().cast("int").alias(flag))  # k rows


def votes(df: DataFrame, flags: list[str], least: int = 2) -> DataFrame:
    total = sum((F.coalesce(F.col(f), F.lit(0)) for f in flags[1:]), F.coalesce(F.col(flags[0]), F.lit(0)))
    return df.withColumn("anomaly_votes", total).withColumn("consensus_anomaly", (F.col("anomaly_votes") >= least).cast("int"))


def vote_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("anomaly_votes").agg(F.count("*").alias("n"))


def detector_summary(df: DataFrame, flags: list[str]) -> DataFrame:
    """(algorithm, n_flagged, share)."""
    row = df.agg(*[F.sum(f).alias(f) for f in flags], F.count("*").alias("_n"))
    cells = [F.struct(F.lit(f.removesuffix("_is_outlier")).alias("algorithm"), F.col(f).alias("n_flagged"), F.round(F.col(f) / F.col("_n"), 6).alias("share")) for f in flags]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def top_consensus(df: DataFrame, scores: list[str], n: int | None = None) -> DataFrame:
    """Consensus rows by votes and mean score, highest first."""
    mean = sum((F.col(s) for s in scores[1:]), F.col(scores[0])) / len(scores)
    out = df.where(F.col("consensus_anomaly") == 1).withColumn("avg_score", F.round(mean, 6)).orderBy(F.desc("anomaly_votes"), F.desc("avg_score"), *df.columns)
    return out.limit(n) if n else out


cloudpickle.register_pickle_by_value(sys.modules[__name__])
