"""Exact interpolated quantiles for arbitrarily large groups.

``quantile_cont(x, p)`` needs the values at ranks ``floor(p*(n-1))`` and
the next one.  Spark's exact ``percentile`` aggregate keeps a value -> count
map per group, so one group with a billion distinct values would have to fit
in one task.  Here the rank is found by histogram refinement instead, with
nothing but counting aggregates:

1. per group: ``n``, ``min``, ``max``;
2. each target rank starts with the candidate value range ``[min, max]``;
   one pass counts the candidate rows in ``buckets`` equal-width value
   buckets, with the two end values in buckets of their own (plus each
   bucket's own min/max); a running sum over the buckets locates the bucket
   holding the target rank, and that bucket's ``[min, max]`` becomes the new
   candidate range;
3. passes repeat until every range is a single value, which is the answer.
   A pass shrinks a range by a factor of ``buckets``, and by two distinct
   values at least, so widely spread values cost more passes, not memory.

The bucket index is a monotone function of the value, so the candidate set
is always exactly the rows whose value lies in the candidate range, and
ties need no special case.  Every aggregation has map-side partial
aggregation and at most ``buckets`` + 2 rows per (group, range), so a hot
group is spread over all tasks.  The result equals ``percentile`` / DuckDB's
``quantile_cont``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit.session import cut_lineage


def _cond_join(left: DataFrame, right: DataFrame, keys: Sequence[str], extra) -> DataFrame:
    lf, rt = left.alias("_l"), right.alias("_r")
    cond = [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in keys] + [extra]
    return lf.join(rt, cond, "inner")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    probs: Mapping[str, float], buckets: int = 65536) -> DataFrame:
    """One row per group with one column per entry of ``probs`` (linear
    interpolation between closest ranks; NULL values ignored).  Groups
    whose values are all NULL are absent.  Without ``keys`` the whole table
    is one group."""
    keys = list(keys)
    if not keys:
        one = exact_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, probs, buckets)
        return one.drop("_all")
    base = df.select(*keys, F.col(value).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    stats = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"),
                                    F.max("_x").alias("_hi"))
    plist = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(p)).alias("p"))
                      for k, p in probs.items()])
    t = stats.select(*keys, "_n", "_lo", "_hi", F.explode(plist).alias("_q"))
    pos = F.col("_q.p") * (F.col("_n") - 1)
    t = t.select(*keys, "_lo", "_hi", F.col("_q.name").alias("_name"),
                 F.floor(pos).cast("long").alias("_a"),
                 (pos - F.floor(pos)).alias("_frac"), (F.col("_n") - 1).alias("_last"))
    # two target ranks per (group, quantile): a and min(a + 1, n - 1)
    targets = t.select(*keys, "_name", "_frac", "_lo", "_hi",
                       F.explode(F.array(
                           F.struct(F.lit(0).alias("w"), F.col("_a").alias("r")),
                           F.struct(F.lit(1).alias("w"), F.least(F.col("_a") + 1, F.col("_last"))
                                    .alias("r")))).alias("_t"))
    targets = targets.select(*keys, "_name", "_frac", F.col("_t.w").alias("_which"),
                             F.col("_t.r").alias("_rank"), "_lo", "_hi",
                             F.lit(0).cast("long").alias("_base"))
    # The target table is small (groups x quantiles x 2); it is checkpointed
    # into the shared checkpoint folder after every round so that each round
    # plans against a finished table instead of re-deriving all earlier ones.
    targets = cut_lineage(targets)

    while targets.where(F.col("_lo") < F.col("_hi")).limit(1).count():
        open_ = targets.where(F.col("_lo") < F.col("_hi"))
        ranges = open_.select(*keys, "_lo", "_hi").distinct()
        rows = _cond_join(base, ranges, keys,
                          (F.col("_l._x") >= F.col("_r._lo")) & (F.col("_l._x") <= F.col("_r._hi")))
        # Halves first: the width of the widest range would overflow.
        span = F.col("_r._hi") / 2 - F.col("_r._lo") / 2
        share = F.try_divide(F.col("_l._x") / 2 - F.col("_r._lo") / 2, span)
        inner = F.floor(F.coalesce(F.nanvl(share, F.lit(0.0)), F.lit(0.0)) * buckets).cast("long")
        bucket = F.when(F.col("_l._x") == F.col("_r._lo"), F.lit(-1).cast("long")) \
            .when(F.col("_l._x") == F.col("_r._hi"), F.lit(buckets).cast("long")) \
            .otherwise(F.greatest(F.lit(0), F.least(inner, F.lit(buckets - 1))))
        rows = rows.select(*[F.col(f"_r.{k}").alias(k) for k in keys],
                           F.col("_r._lo").alias("_lo"), F.col("_r._hi").alias("_hi"),
                           bucket.alias("_b"), F.col("_l._x").alias("_x"))
        hist = rows.groupBy(*keys, "_lo", "_hi", "_b").agg(
            F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_bmin"), F.max("_x").alias("_bmax"))
        before = F.coalesce(F.sum("_c").over(
            Window.partitionBy(*keys, "_lo", "_hi").orderBy("_b")
            .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        hist = hist.withColumn("_before", before)
        local = F.col("_l._rank") - F.col("_l._base")
        hit = _cond_join(open_, hist, keys,
                         (F.col("_l._lo") == F.col("_r._lo")) & (F.col("_l._hi") == F.col("_r._hi"))
                         & (local >= F.col("_r._before"))
                         & (local < F.col("_r._before") + F.col("_r._c")))
        narrowed = hit.select(*[F.col(f"_l.{k}").alias(k) for k in keys],
                              F.col("_l._name").alias("_name"), F.col("_l._frac").alias("_frac"),
                              F.col("_l._which").alias("_which"), F.col("_l._rank").alias("_rank"),
                              F.col("_r._bmin").alias("_lo"), F.col("_r._bmax").alias("_hi"),
                              (F.col("_l._base") + F.col("_r._before")).alias("_base"))
        targets = cut_lineage(targets.where(F.col("_lo") == F.col("_hi")).unionByName(narrowed))

    vals_ab = targets.select(*keys, "_name", "_frac", "_which", F.col("_lo").alias("_v"))
    pair = vals_ab.groupBy(*keys, "_name").agg(
        F.max(F.when(F.col("_which") == 0, F.col("_v"))).alias("_va"),
        F.max(F.when(F.col("_which") == 1, F.col("_v"))).alias("_vb"),
        F.max("_frac").alias("_frac"))
    q = F.col("_va") + (F.col("_vb") - F.col("_va")) * F.col("_frac")
    return pair.groupBy(*keys).pivot("_name", list(probs)).agg(F.first(q))
