"""Frames and panels by calendar time instead of row count.

A row frame of three rows spans more than three months when months are
missing.  Here a frame is a distance in whole periods (months, weeks, days):
:func:`calendar_framed` evaluates a RANGE frame over the period number, and
:func:`densify` inserts the missing periods so that row frames and calendar
frames agree.

Long histories are split by time without numbering rows first: the period
number is cut into blocks at least as long as the frame reaches, and a row is
copied into each block whose frames can reach it.  A block evaluates its
frames alone and keeps its own rows, so one person's history spreads over as
many tasks as it has blocks, after a single shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.operators.windows import Chunk, _cols, lead_value

UNITS = ("month", "week", "day", "number")


def period_number(period, unit: str = "month") -> Column:
    """Whole periods since the start of 1970, as a long; NULL stays NULL.
    Weeks start on Thursday, as 1970-01-01 did; ``number`` takes an integer
    column (a year, say) as it is."""
    p = F.col(period) if isinstance(period, str) else period
    if unit == "number":
        return p.cast("long")
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}, not {unit!r}")
    d = p.cast("date")
    if unit == "month":
        return ((F.year(d) - 1970) * 12 + F.month(d) - 1).cast("long")
    days = F.datediff(d, F.lit("1970-01-01").cast("date"))
    return days.cast("long") if unit == "day" else F.floor(days / 7).cast("long")


def later(period, periods, unit: str = "month") -> Column:
    """``period`` moved by a number of whole periods, in its own type."""
    p = F.col(period) if isinstance(period, str) else period
    n = periods if isinstance(periods, Column) else F.lit(periods)
    if unit == "number":
        return p + n
    n = n.cast("int")
    return F.add_months(p, n) if unit == "month" else F.date_add(p, n * 7 if unit == "week" else n)


def calendar_framed(df: DataFrame, key, period: str, start: int, end: int, aggs: Mapping[str, Column],
                    unit: str = "month", block: int | None = None) -> DataFrame:
    """Add aggregates over the rows whose period lies ``start`` to ``end``
    periods away (negative: earlier), e.g. ``(-3, -1)`` for the previous three
    months, however many rows those have.

    All rows of one period are peers.  Rows without a period form a frame of
    their own, as RANGE frames do in SQL, and a NULL key is a key.  With
    ``block`` (periods per block, widened to the frame's reach) a key's history
    is split over tasks; the result is the same.
    """
    if start > end:
        raise ValueError("the frame ends before it starts")
    keys = _cols(key)
    rows = df.withColumn("_num", period_number(period, unit))
    if block is None:
        w = Window.partitionBy(*keys).orderBy("_num").rangeBetween(start, end)
        return rows.select("*", *[a.over(w).alias(name) for name, a in aggs.items()]).drop("_num")
    block = max(block, end - start + 1, abs(start), abs(end))
    at = lambda n: F.floor((F.col("_num") + n) / block).cast("long")
    # Frames that reach this row belong to rows -end to -start periods away;
    # its own block is listed too, also where no frame reaches back to it.
    own = at(0)
    reach = F.array_union(F.array(own), F.sequence(at(-end), at(-start)))
    rows = rows.withColumn("_own", own).withColumn(
        "_block", F.explode(F.when(F.col("_num").isNull(), F.array(F.lit(None).cast("long"))).otherwise(reach)))
    w = Window.partitionBy(*keys, "_block").orderBy("_num").rangeBetween(start, end)
    out = rows.select("*", *[a.over(w).alias(name) for name, a in aggs.items()])
    return out.where(F.col("_own").eqNullSafe(F.col("_block"))).drop("_num", "_own", "_block")


def densify(df: DataFrame, key, period: str, fill: Mapping[str, object], unit: str = "month",
            flag: str | None = None, chunk: Chunk = None) -> DataFrame:
    """Insert the periods that are missing between a key's first and last.

    Inserted rows carry the key, their period, ``fill`` for the columns it
    names (a value or a Column) and NULL in the others; ``flag`` names a
    boolean column that is true for them.  Each row inserts what lies between
    it and the next one (``lead``), so there is one shuffle and no join, and
    ``chunk`` splits long histories as in :func:`panelkit.operators.windows.lead_value`.
    Rows of the same period are kept, and only the last of them is followed
    by insertions.  Rows with a NULL period are kept as they are.
    """
    keys = _cols(key)
    rows = lead_value(df.withColumn("_num", period_number(period, unit)), keys, [period], "_num", "_next", chunk)
    gap = F.greatest(F.coalesce(F.col("_next") - F.col("_num"), F.lit(1)), F.lit(1))
    rows = rows.withColumn("_step", F.explode(F.sequence(F.lit(0), (gap - 1).cast("int"))))
    given = F.col("_step") == 0
    cols = []
    for c in df.columns:
        if c in keys:
            cols.append(F.col(f"`{c}`"))
        elif c == period:
            cols.append(F.when(given, F.col(f"`{c}`")).otherwise(later(f"`{c}`", F.col("_step"), unit)).alias(c))
        else:
            v = fill.get(c)
            v = v if isinstance(v, Column) else F.lit(v)
            cols.append(F.when(given, F.col(f"`{c}`")).otherwise(v.cast(df.schema[c].dataType)).alias(c))
    return rows.select(*cols, *([(~given).alias(flag)] if flag else []))


def calendar_shock_flags(periods: DataFrame, key, period: str, measure: str, lookback: int = 3,
                         factor: float = 2.0, missing_as_zero: bool = False, unit: str = "month",
                         block: int | None = None) -> DataFrame:
    """Periods where ``measure >= factor * mean`` of the ``lookback`` calendar
    periods before, and that mean is positive.

    The mean is over the periods present, or with ``missing_as_zero`` over all
    of them since the key's first period (a period without a row counts as 0),
    which needs no inserted rows: the sum is divided by the number of periods.
    """
    aggs = {"trailing_avg": F.avg(measure)}
    if missing_as_zero:
        aggs = {"trailing_avg": F.sum(measure)}
    out = calendar_framed(periods, key, period, -lookback, -1, aggs, unit, block)
    if missing_as_zero:
        out = _elapsed(out, key, period, lookback, unit)
        out = out.withColumn("trailing_avg", F.coalesce("trailing_avg", F.lit(0.0)) / F.col("_elapsed")).drop("_elapsed")
    return out.where((F.col("trailing_avg") > 0) & (F.col(measure) >= F.lit(factor) * F.col("trailing_avg")))


def _elapsed(df: DataFrame, key, period: str, lookback: int, unit: str) -> DataFrame:
    """Periods since the key's first one, at most ``lookback``; NULL for the
    first.  The first period comes from a map-side combined minimum, so a long
    history is not gathered for it."""
    keys = _cols(key)
    num = period_number(period, unit)
    first = df.groupBy(F.struct(*keys).alias("_key")).agg(F.min(num).alias("_first"))
    # Structs with NULL fields are equal, so a NULL key finds its minimum.
    out = df.withColumn("_key", F.struct(*keys)).join(first, "_key")
    return out.withColumn("_elapsed", F.nullif(F.least(num - F.col("_first"), F.lit(lookback).cast("long")), F.lit(0))) \
        .drop("_key", "_first")


def pivot_periods(df: DataFrame, keys: Sequence[str], period: str, value: str, agg: str = "sum",
                  limit: int = 2000) -> DataFrame:
    """``pivot_wider`` over periods found in the data: one column per period.

    The distinct periods are listed first, and more than ``limit`` of them
    raise: a table that wide is a mistake, not a result to cut short.
    """
    found = [r[0] for r in df.select(period).where(F.col(period).isNotNull()).distinct()
             .orderBy(period).limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"{period} has more than {limit} values")
    return df.groupBy(*keys).pivot(period, found).agg(getattr(F, agg)(value))
