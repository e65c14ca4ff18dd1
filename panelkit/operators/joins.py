"""Join operators for spine-linked panels.

All joins are equi-joins handed to Catalyst: AQE picks broadcast,
shuffled-hash or sort-merge from runtime sizes (broadcast only when the
measured side is under ``spark.sql.autoBroadcastJoinThreshold``), and
splits skewed partitions of sort-merge joins.  NULL keys never match
(SQL ``=``), so an anti join keeps NULL-key rows and a full join emits
them unmatched on both sides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions.expr import hash_key, month_start


def outer_join(left: DataFrame, right: DataFrame, on: Sequence[str] | str,
               how: str = "left") -> DataFrame:
    """Left or full outer equi-join on named keys with NULL-key rows kept
    out of the shuffle.

    A row with a NULL key part can never match, but an outer join must still
    emit it, and Spark hashes all such rows to one partition: a key column
    that is NULL for a third of the rows would put that third in one task
    (and AQE cannot split skew in a full outer join).  Those rows are routed
    around the join and added back with the other side's columns NULL.
    """
    if how not in ("left", "full"):
        raise ValueError(f"outer_join supports how='left' or 'full', not {how!r}")
    keys = [on] if isinstance(on, str) else list(on)
    has_null = None
    for k in keys:
        c = F.col(k).isNull()
        has_null = c if has_null is None else (has_null | c)
    out = left.where(~has_null).join(
        right.where(~has_null) if how == "full" else right, keys, how)
    out = out.unionByName(left.where(has_null), allowMissingColumns=True)
    if how == "full":
        out = out.unionByName(right.where(has_null), allowMissingColumns=True)
    return out


def join_flag(left: DataFrame, right: DataFrame, on, flag: str, probe: str) -> DataFrame:
    """``left_join`` + ``mutate(flag = !is.na(probe))``."""
    return outer_join(left, right, on, "left").withColumn(flag, F.col(probe).isNotNull())


def coverage(left: DataFrame, right: DataFrame, key: str,
             left_flag: str, right_flag: str) -> DataFrame:
    """Full outer join of two key sets with presence flags, then the 2x2
    coverage count.  Duplicate keys multiply exactly as in SQL; NULL keys
    appear unmatched on their own side."""
    lft = left.select(key, F.lit(True).alias(left_flag))
    rgt = right.select(key, F.lit(True).alias(right_flag))
    return (outer_join(lft, rgt, key, "full")
            .select(F.coalesce(left_flag, F.lit(False)).alias(left_flag),
                    F.coalesce(right_flag, F.lit(False)).alias(right_flag))
            .groupBy(left_flag, right_flag).agg(F.count(F.lit(1)).alias("n")))


def join_renamed(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                 how: str = "inner") -> DataFrame:
    """``by = c(left_key = right_key)``: keep the left key only."""
    return left.join(right, left[left_key] == right[right_key], how).drop(right[right_key])


def crosswalk(src_spine: DataFrame, dst_spine: DataFrame, src_name: str,
              dst_name: str, spine_key: str = "spine_id",
              id_col: str = "synthetic_aeuid") -> DataFrame:
    """Agency A id -> agency B id through the shared spine key."""
    a = src_spine.select(F.col(id_col).alias(src_name), spine_key)
    b = dst_spine.select(F.col(id_col).alias(dst_name), spine_key)
    return a.join(b, spine_key, "inner").select(src_name, dst_name)


def _epoch_day(c: Column) -> Column:
    return F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date"))


def interval_join(events: DataFrame, anchors: DataFrame, keys: Sequence[str] | str,
                  event_time: str, anchor_time: str, days: int,
                  bin_days: int = 32) -> DataFrame:
    """Equi-join on ``keys`` with ``anchor <= t < anchor + days``, in the
    times' own type: days after a timestamp end at the same time of day.

    Range join by binning: events carry the ``bin_days``-wide time bin they
    fall in; each anchor is replicated to the (at most
    ``days / bin_days + 2``) bins its interval touches.  The join runs on
    ``(keys, bin)`` with the exact range as a residual, so candidate pairs
    are limited to one bin of one person (a person with many rows is spread
    over many join keys), and every matching pair is produced exactly once,
    in the event's bin.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    et, at = F.col(event_time), F.col(anchor_time)
    ev = events.withColumn("_bin", F.floor(_epoch_day(et) / bin_days))
    lo = F.floor(_epoch_day(at) / bin_days)
    # A timestamp's interval may end within the day ``days`` later.
    dates = anchors.schema[anchor_time].dataType.typeName() == "date"
    hi = F.floor((_epoch_day(at) + (days - 1 if dates else days)) / bin_days)
    an = anchors.withColumn("_bin", F.explode(F.sequence(lo, hi)))
    e, a = ev.alias("e"), an.alias("a")
    cond = [F.col(f"e.{k}") == F.col(f"a.{k}") for k in keys]
    cond.append(F.col("e._bin") == F.col("a._bin"))
    cond.append(F.col(f"e.{event_time}") >= F.col(f"a.{anchor_time}"))
    start = F.col(f"a.{anchor_time}")
    end = F.date_add(start, days) if dates else start + F.make_dt_interval(F.lit(days))
    cond.append(F.col(f"e.{event_time}") < end)
    cols = [F.col(f"e.{k}") for k in keys]
    cols += [F.col(f"e.{c}") for c in events.columns if c not in keys]
    cols += [F.col(f"a.{c}") for c in anchors.columns if c not in keys]
    return e.join(a, cond, "inner").select(*cols)


def shifted_self_join(df: DataFrame, key: str, time_col: str, value_col: str,
                      days: int, prev_name: str) -> DataFrame:
    """Fixed-offset lag as an equi-join: the right side's time is moved
    forward by ``days`` and matched on (key, time).  Only exact-offset
    predecessors match; duplicates on (key, time) multiply."""
    prev = df.select(key, F.date_add(F.col(time_col), days).alias(time_col),
                     F.col(value_col).alias(prev_name))
    return df.join(prev, [key, time_col], "inner")


def month_grain_join(left: DataFrame, right: DataFrame, key: str,
                     left_time: str, right_time: str) -> DataFrame:
    """Round both sides to calendar month, then equi-join on (key, month)."""
    lm = left.withColumn("month", month_start(left_time))
    rm = right.withColumn("month", month_start(right_time))
    return lm.join(rm, [key, "month"], "inner")


def hash_key_join(left: DataFrame, right: DataFrame, key: str,
                  how: str = "inner") -> DataFrame:
    """Join on a 64-bit hash of a string key, guarded by the original key.

    The integer equality drives partitioning and hashing; the string
    equality removes hash collisions so the result equals the plain join.
    """
    lh = left.withColumn("_khash", hash_key(key))
    rh = right.withColumnRenamed(key, "_rkey").withColumn("_khash", hash_key("_rkey"))
    cond = (lh["_khash"] == rh["_khash"]) & (lh[key] == rh["_rkey"])
    return lh.join(rh, cond, how).drop("_khash", "_rkey")


def stored_key_join(left: DataFrame, right: DataFrame, hash_col: str, key: str,
                    how: str = "inner") -> DataFrame:
    """Join two tables that store the integer surrogate ``hash_col`` of
    ``key``: equality on the integer, guarded by the id; nothing is hashed."""
    r = right.withColumnsRenamed({hash_col: "_rhash", key: "_rkey"})
    cond = (F.col(hash_col) == F.col("_rhash")) & (F.col(key) == F.col("_rkey"))
    return left.join(r, cond, how).drop("_rhash", "_rkey")


def star_join(dim: DataFrame, bridge: DataFrame, fact: DataFrame,
              dim_key: str, fact_key: str) -> DataFrame:
    """dimension -(dim_key)- bridge -(fact_key)- fact, the canonical
    three-table person/spine/claims join."""
    return dim.join(bridge, dim_key, "inner").join(fact, fact_key, "inner")


def star_rollup(dim: DataFrame, bridge: DataFrame, fact: DataFrame, dim_key: str,
                fact_key: str, group_by: Sequence, sums: dict[str, str],
                count_name: str = "n", fact_group: Sequence[str] = ()) -> DataFrame:
    """Three-table star join followed by sums and a row count per group,
    with the fact table aggregated per join key *before* the join.

    Sums and counts decompose: per (person[, fact_group]) subtotals from a
    map-side-combined aggregation, joined to the person's attributes and
    summed again.  The fact side that reaches the join shuffle is one row
    per person instead of one per claim, and a person holding a third of
    all claims is one row there -- no skewed join partition at all.
    ``group_by`` may reference columns of ``dim``/``bridge`` and
    ``fact_group`` columns.
    """
    sub = fact.groupBy(fact_key, *fact_group).agg(
        *[F.sum(c).alias(n) for n, c in sums.items()], F.count(F.lit(1)).alias(count_name))
    j = dim.join(bridge, dim_key, "inner").join(sub, fact_key, "inner")
    return j.groupBy(*group_by).agg(*[F.sum(n).alias(n) for n in sums],
                                    F.sum(count_name).cast("long").alias(count_name))


def in_table(df: DataFrame, keys: DataFrame, on, negate: bool = False) -> DataFrame:
    """``filter(x %in% table$key)`` rewritten as a semi (or anti) join so the
    key set never reaches the driver.  For the anti join, rows with a NULL
    key (always kept: they match nothing) bypass the shuffle, as in
    :func:`outer_join`."""
    if not negate:
        return df.join(keys, on, "left_semi")
    cols = [on] if isinstance(on, str) else list(on)
    has_null = None
    for k in cols:
        c = F.col(k).isNull()
        has_null = c if has_null is None else (has_null | c)
    return df.where(~has_null).join(keys, cols, "left_anti").unionByName(df.where(has_null))


def range_cond(col: Column, lo, hi) -> Column:
    """Half-open ``lo <= col < hi``."""
    return (col >= lo) & (col < hi)
