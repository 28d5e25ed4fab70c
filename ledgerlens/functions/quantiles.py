"""Exact quantiles of whole columns, without holding a column's values anywhere.

A sketch of bounded size, of a sample if there are many rows, gives a bracket around every quantile. A second pass over all rows counts what lies below each bracket and the values within
by value; running counts over those say which values stand at the quantile's place. A quantile that doesn't stand in its bracket, which the counts tell, is looked for once more with a bracket from
a sketch of all rows. What comes to the driver is two numbers a quantile.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.functions.storage import small_methods, stored

#: The sketch's places are right to one in so many rows; brackets reach twice as far on either side.
ACCURACY = 10_000
#: Rows, about, that a sketch for brackets sees if there are more than twice as many. Which they are decides about the work and not about the result.
SKETCHED = 1 << 20
#: Values of one bracket in a batch, beyond which equal ones are put together at once.
FEW = 200
#: Rows at once where a row stands for many.
BATCH = 1 << 16


def _drawn(part: float):
    """Rows as often as the last column says, or a sample of that part of those, without the last column."""

    def run(batches):
        rng = np.random.default_rng([7, TaskContext.get().partitionId()])
        for batch in batches:
            times = batch.columns[-1].to_numpy(zero_copy_only=False)
            ends = np.cumsum(rng.binomial(times, part) if part < 1 else times)
            rows = batch.select(batch.schema.names[:-1])
            for i in range(0, int(ends[-1]) if len(ends) else 0, BATCH):
                yield rows.take(pa.array(np.searchsorted(ends, np.arange(i, min(i + BATCH, int(ends[-1]))), side="right")))

    return run


def _brackets(x: DataFrame, counts: dict[str, int], ps: list[float], sampled: bool) -> dict[str, list[float]]:
    """Of each column a lower and an upper end for each quantile."""
    part = min(1.0, SKETCHED / max(counts.values()))
    sampled = sampled and part < 0.5

    def ends(n: int) -> Column:
        seen = max(n * part if sampled else n, 1)
        reach = lambda p: 2 / ACCURACY + 2 / seen + (6 * math.sqrt(p * (1 - p) / seen) + 10 / seen if sampled else 0)
        return F.array(*[F.lit(min(max(p + s * reach(p), 0.0), 1.0)) for p in ps for s in (-1, 1)])

    if "_n" in x.columns:  # a row stands for so many
        some = x.select(*counts, "_n").mapInArrow(_drawn(part if sampled else 1.0), ", ".join(f"`{c}` double" for c in counts))
    else:
        some = x.sample(part, seed=7) if sampled else x
    found = some.agg(*[F.percentile_approx(c, ends(n), ACCURACY).alias(c) for c, n in counts.items()]).first()
    return {c: found[c] if found[c] is not None else [-math.inf, math.inf] * len(ps) for c in counts}


def _counted(asked: list[tuple[int, float, float]], weighted: bool = False):
    """Of each bracket (column, low, high) the rows below, under a null value, and the values within. weighted: the last column says for how many rows a row stands."""

    def run(batches):
        below = np.zeros(len(asked), np.int64)
        for batch in batches:
            values = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            places, found, times = [], [], []
            weight = values[-1] if weighted else None
            for k, (column, low, high) in enumerate(asked):
                v = values[column]
                below[k] += weight[v < low].sum() if weighted else np.count_nonzero(v < low)
                if weighted:
                    at = (v >= low) & (v <= high)
                    held, where = np.unique(v[at], return_inverse=True)
                    n = np.zeros(len(held), np.int64)
                    np.add.at(n, where, weight[at])
                elif low == high:
                    held, n = np.array([low]), np.array([np.count_nonzero(v == low)])
                else:
                    held = v[(v >= low) & (v <= high)]
                    held, n = np.unique(held, return_counts=True) if len(held) > FEW else (held, np.ones(len(held), np.int64))
                places.append(np.full(len(held), k, np.int32))
                found.append(held)
                times.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (places, found, times)], names=["k", "v", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(asked), dtype=np.int32)), pa.nulls(len(asked), pa.float64()), pa.array(below)], names=["k", "v", "n"])

    return run


def _at_places(x: DataFrame, asked: list[tuple[int, float, float]], places: list[tuple[int, int]], weighted: bool = False) -> list[tuple[float | None, float | None]]:
    """The values at both places, counted from 0, of each bracket; None for one that isn't in it."""
    held = x.mapInArrow(_counted(asked, weighted), "k int, v double, n long").where("n > 0").groupBy("k", "v").agg(F.sum("n").alias("n"))
    of = lambda side: F.get(F.array(*[F.lit(p[side]).cast("long") for p in places]), F.col("k"))
    upto = F.sum("n").over(W.partitionBy("k").orderBy(F.asc_nulls_first("v")).rowsBetween(W.unboundedPreceding, 0))
    here = lambda at: (at >= F.col("upto") - F.col("n")) & (at < F.col("upto"))
    placed = held.withColumn("upto", upto).where("v is not null").select("k", "v", here(of(0)).alias("first"), here(of(1)).alias("last"))
    found: dict[tuple[int, str], float] = {}
    for r in placed.where("first or last").collect():  # two rows a quantile at most
        found |= {(r["k"], end): r["v"] for end in ("first", "last") if r[end]}
    return [(found.get((k, "first")), found.get((k, "last"))) for k in range(len(asked))]


def exact_quantiles(df: DataFrame, columns: dict[str, Column], ps: list[float], ready: bool = False, weight: Column | None = None) -> dict[str, list[float | None]]:
    """Each column's quantiles, with linear interpolation; nulls and NaN are left out, and a column without values has None. ready says that df is a stored table, or little work on one; weight, for how many rows a row stands."""
    if not columns:
        return {}
    names = {f"_{i}": c for i, c in enumerate(columns)}
    rows = [] if weight is None else [F.coalesce(weight.cast("long"), F.lit(0).cast("long")).alias("_n")]
    x = df.select(*[F.nanvl(c.cast("double"), F.lit(None).cast("double")).alias(n) for n, c in zip(names, columns.values(), strict=True)], *rows)
    x = x if ready else stored(x, "quantiles")
    with small_methods(df.sparkSession):
        counted = x.agg(*[(F.sum(F.when(F.col(n).isNotNull(), F.col("_n"))) if rows else F.count(n)).alias(n) for n in names]).first()
    counts = {n: counted[n] for n in names if counted[n]}
    out: dict[str, list[float | None]] = {c: [None] * len(ps) for c in columns}
    open_ = [(n, i) for n in counts for i in range(len(ps))]
    for sampled in (True, False):
        if not open_:
            break
        own = {n: counts[n] for n in dict.fromkeys(n for n, _ in open_)}
        ends = _brackets(x, own, ps, sampled)
        at = {n: k for k, n in enumerate(own)}
        asked = [(at[n], ends[n][2 * i], ends[n][2 * i + 1]) for n, i in open_]
        middle = [(counts[n] - 1) * ps[i] for n, i in open_]
        found = _at_places(x.select(*own, *["_n"] * bool(rows)), asked, [(math.floor(h), math.ceil(h)) for h in middle], bool(rows))
        for (n, i), h, (low, high) in zip(open_, middle, found, strict=True):
            if low is not None and high is not None:
                out[names[n]][i] = low if low == high else (math.ceil(h) - h) * low + (h - math.floor(h)) * high
        open_ = [(n, i) for n, i in open_ if out[names[n]][i] is None]
    if open_:
        raise RuntimeError(f"no quantiles of {sorted({names[n] for n, _ in open_})}")
    return out


cloudpickle.register_pickle_by_value(sys.modules[__name__])
