"""Quantiles and distinct counts from stored, mergeable summaries.

The exact forms (:mod:`panelkit.operators.quantiles`, ``count(distinct)``) read
the facts again for every question.  Here the facts are read once, into a state
table with one small summary per cell (a month and a group, say), and any later
question about a union of cells merges summaries: KLL sketches for ranks,
HyperLogLog sketches for distinct counts.  Both are Spark built-ins with
map-side partial aggregation, so a hot cell is one summary per map task.

Errors are properties of the summaries and do not grow with merging: see
:func:`rank_error` and :func:`count_error`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUANTILE_K = 400           # KLL size: values kept in the top level
DISTINCT_LOG2 = 14         # HyperLogLog size: 2**14 registers


def rank_error(k: int = QUANTILE_K) -> float:
    """Bound on the difference between the asked and the true normalised rank,
    at 99 % confidence, of a KLL sketch of size k (its published fit)."""
    return 2.296 / k ** 0.9021


def count_error(log2: int = DISTINCT_LOG2) -> float:
    """Relative error of a HyperLogLog count at three standard deviations."""
    return 3 * 1.04 / 2 ** (log2 / 2)


def quantile_state(df: DataFrame, cells: Sequence, value: str, k: int = QUANTILE_K) -> DataFrame:
    """One row per cell: the cells, n (rows with a value), and a sketch of the
    values.  NULL and NaN values are left out; cells of only such have n = 0
    and a NULL sketch."""
    x = F.col(value).cast("double")
    x = F.when(~F.isnan(x), x)
    return df.groupBy(*cells).agg(F.count(x).alias("n"), F.kll_sketch_agg_double(x, k).alias("sketch")) \
        .withColumn("sketch", F.when(F.col("n") > 0, F.col("sketch")))


def merge_quantiles(state: DataFrame, keys: Sequence, probs: Mapping[str, float], k: int = QUANTILE_K) -> DataFrame:
    """Approximate quantiles of the union of cells per key, from the state
    alone: keys, n, one column per entry of ``probs``.  Without keys all cells
    are one group; a key without values gives NULLs."""
    held = state.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("_s"))
    q = [F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("_s", F.lit(float(p)))).alias(name)
         for name, p in probs.items()]
    return held.select(*[c for c in held.columns if c not in ("n", "_s")], "n", *q)


def distinct_state(df: DataFrame, cells: Sequence, value: str, log2: int = DISTINCT_LOG2) -> DataFrame:
    """One row per cell: the cells and a sketch of the distinct values; NULL
    is no value."""
    return df.groupBy(*cells).agg(F.hll_sketch_agg(F.col(value), log2).alias("sketch"))


def merge_distinct(state: DataFrame, keys: Sequence, name: str = "n_distinct") -> DataFrame:
    """Approximate distinct count of the union of cells per key, from the
    state alone."""
    return state.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(name))


def true_rank(values: DataFrame, keys: Sequence[str], value: str, estimates: DataFrame,
              probs: Sequence[str]) -> DataFrame:
    """For each estimated quantile the smallest and largest normalised rank
    that it has among the true values (ties give an interval): keys, prob,
    estimate, rank_lo, rank_hi.  One pass; the estimates, a row per key, are
    joined on the keys and Spark broadcasts them when they are small."""
    long = estimates.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(p).alias("prob"), F.col(p).alias("estimate")) for p in probs])).alias("_e")) \
        .select(*keys, "_e.prob", "_e.estimate")
    x, e = F.col(f"`{value}`").cast("double"), F.col("estimate")
    facts = values.where(x.isNotNull() & ~F.isnan(x)).select(*keys, value)
    return facts.join(long, list(keys)).groupBy(*keys, "prob", "estimate").agg(
        (F.count_if(x < e) / F.count(F.lit(1))).alias("rank_lo"), (F.count_if(x <= e) / F.count(F.lit(1))).alias("rank_hi"))


def within(lo: Column, hi: Column, p: Column, bound: float) -> Column:
    """Whether the interval of ranks comes within ``bound`` of p."""
    return (lo <= p + F.lit(bound)) & (hi >= p - F.lit(bound))
