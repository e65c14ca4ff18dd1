"""Grouped aggregates: counts, quantile summaries, shares, pivots, fits.

Every aggregate here is a Catalyst hash/object aggregate with partial
(map-side) aggregation, so a hot group is combined before the shuffle.
Exact quantiles of unbounded groups use :func:`distribution`; ``quantile`` is
Spark's ``percentile``, whose buffer is a value -> count map, for frames and
groups whose distinct values are known to be few.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_count(df: DataFrame, *keys, name: str = "n") -> DataFrame:
    """``count(k1, k2, ...)``: NULL keys form their own group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def quantile(col, p: float) -> Column:
    """``quantile_cont(col, p)``: exact, linearly interpolated."""
    return F.percentile(F.col(col) if isinstance(col, str) else col, F.lit(p))


def distribution(df: DataFrame, keys: Sequence[str], value: str,
                 probs: dict[str, float], prefix: str = "") -> DataFrame:
    """n (rows with a value), mean, median and named quantiles of ``value``
    per group (of the whole table without ``keys``); quantiles are exact and
    interpolated (``quantile_cont``).

    Always the histogram refinement of :mod:`panelkit.operators.quantiles`,
    which never holds a group or a value list in one task.
    """
    from panelkit.operators.quantiles import exact_quantiles
    keys = list(keys)
    base = df.where(F.col(value).isNotNull())
    allq = {f"median{prefix}": 0.5, **probs}
    moments = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                      F.avg(value).alias(f"mean{prefix}"))
    q = exact_quantiles(base, keys, value, allq)
    if not keys:                                    # one row each
        moments, q, keys = moments.withColumn("_all", F.lit(0)), q.withColumn("_all", F.lit(0)), ["_all"]
    m, qq = moments.alias("_m"), q.alias("_q")
    cond = [F.col(f"_m.{k}").eqNullSafe(F.col(f"_q.{k}")) for k in keys]
    return m.join(qq, cond, "left").select(
        *[F.col(f"_m.{k}").alias(k) for k in keys if k != "_all"], "n", f"mean{prefix}",
        *[F.col(f"_q.`{c}`").alias(c) for c in allq])


def share_within(df: DataFrame, count_col: str, within: Sequence[str],
                 name: str = "share") -> DataFrame:
    """``n / sum(n)`` inside each ``within`` group (position = "fill").
    Runs on an already-aggregated frame, so the window is small."""
    total = F.sum(count_col).over(Window.partitionBy(*within))
    return df.withColumn(name, F.col(count_col) / total)


def pivot_wider(df: DataFrame, keys: Sequence[str], names_from: str, values_from: str,
                values: Sequence[str]) -> DataFrame:
    """``pivot_wider``; the output columns are listed explicitly so Spark does
    not run an extra job to discover them."""
    return df.groupBy(*keys).pivot(names_from, list(values)).agg(F.first(values_from))


def having_between(df: DataFrame, key: str, lo: int, hi: int, name: str = "n") -> DataFrame:
    """``GROUP BY key HAVING count(*) BETWEEN lo AND hi``."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
            .where(F.col(name).between(lo, hi)))


def loglog_fit(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares line of log10(y) on log10(x) per group (slope,
    intercept, n), from positive pairs only."""
    pos = df.where((F.col(x) > 0) & (F.col(y) > 0))
    lx, ly = F.log10(x), F.log10(y)
    return pos.groupBy(*keys).agg(
        F.regr_slope(ly, lx).alias("slope"),
        F.regr_intercept(ly, lx).alias("intercept"),
        F.count(F.lit(1)).alias("n"))


def collapse(df: DataFrame, keys: Sequence, aggs: dict[str, Column]) -> DataFrame:
    """``group_by(keys) |> summarise(...)`` with named aggregates."""
    return df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
