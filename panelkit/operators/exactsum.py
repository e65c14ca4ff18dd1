"""Sums of doubles that do not depend on the order of addition.

Adding doubles rounds after every step, so a sum changes in its last bits with
the number of partitions.  Here every value is split, without error, into
integer digits of a fixed-point number that is wide enough for all doubles; the
digits are summed as integers, and the total is rounded to a double once.  The
result is the double nearest to the true sum, on any cluster.

A double is m * 2**e with 53-bit m.  Bit positions are counted from 2**-1074,
the smallest double, and cut into limbs of ``BITS``.  Scaling a value by a power
of two is exact, so it becomes an integer of at most 75 bits above its limb's
lower end, whose digits are floors and differences of doubles, exact as well.
Digits are summed per (key, limb): a few rows per key, combined map-side, and
free of overflow up to 2**42 rows.  Per key the sums are then carried into
digits of one sign and written as a hexadecimal number, whose conversion to a
double rounds to nearest.

All steps are built-in expressions.  NULL is left out; a sum that meets NaN, or
both infinities, is NaN; one with an infinity is that infinity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 20                  # of a limb: five hexadecimal digits
DIGITS = 4                 # limbs that one value can touch
LOWEST = 1074              # -exponent of the smallest double
_BASE = float(1 << BITS)


def _limb(x: Column) -> Column:
    """Limb at or below the last bit of x (finite, not zero).  The logarithm
    may round across an integer, so one bit is kept in reserve."""
    top = F.floor(F.log2(F.abs(x))).cast("int") - 2
    return F.greatest(F.lit(0), F.floor((top - 52 + LOWEST) / BITS).cast("int"))


def _digits(x: Column, limb: Column) -> list[Column]:
    """Digits of x from its limb on, all of x's sign.  Powers of two with
    integer exponents are exact, and half the scaling at a time stays in
    range; the digits are those of |x|, as a negative rest would need more
    bits than a double has."""
    half = F.pow(F.lit(2.0), (LOWEST - limb * BITS) / 2)
    rest, sign = F.abs(x) * half * half, F.when(x < 0, -1).otherwise(1)
    out = []
    for k in range(DIGITS - 1, 0, -1):
        unit = _BASE ** k
        digit = F.floor(rest / F.lit(unit)).cast("double")
        out.append(digit.cast("long") * sign)
        rest = rest - digit * F.lit(unit)
    return [rest.cast("long") * sign, *reversed(out)]


def _carried(values: Column) -> Column:
    """(digits, carry) of an array of sums, lowest first: every digit in
    [0, 2**BITS), what is left over in the carry."""
    return F.aggregate(
        values, F.struct(F.array().cast("array<long>").alias("d"), F.lit(0).cast("long").alias("carry")),
        lambda acc, v: F.struct(
            F.concat(acc["d"], F.array((v + acc["carry"]).bitwiseAND((1 << BITS) - 1))).alias("d"),
            F.shiftright(v + acc["carry"], BITS).alias("carry")))


def _number(lo: Column, digits: Column) -> Column:
    """The double nearest to sum(digits[k] * 2**(BITS * (lo + k) - LOWEST))."""
    text = F.array_join(F.transform(F.reverse(digits), lambda d: F.lpad(F.hex(d), BITS // 4, "0")), "")
    # A hexadecimal number needs a digit other than zero in front to be short.
    text = F.ltrim(text, F.lit("0"))
    return F.when(text == "", F.lit(0.0)).otherwise(
        F.concat(F.lit("0x"), text, F.lit("p"), (lo * BITS - LOWEST).cast("string")).cast("double"))


def exact_sums(df: DataFrame, keys: Sequence[str], values: Sequence[str], mean: Sequence[str] = ()) -> DataFrame:
    """Correctly rounded sums per key, one column per value column under its
    own name, and ``mean_<name>`` (the rounded sum over the count) for those in
    ``mean``.

    A key whose values are all NULL gets NULL, an empty table without keys one
    row of NULLs, a NULL key its own row.  A sum beyond the largest double is
    an infinity.  The input is read once; a hot key is combined map-side into
    at most 108 rows per column and task.
    """
    keys = list(keys)
    names = list(values)
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("which"), F.col(f"`{v}`").cast("double").alias("x"))
                                for k, v in enumerate(names)]))
    rows = df.select(F.struct(*[F.col(f"`{k}`") for k in keys], F.lit(0).alias("_")).alias("_key"), pairs.alias("_v")) \
        .select("_key", "_v.which", "_v.x")
    x = F.col("x")
    # -1: nothing to add (NULL, zero, NaN, infinity), only to be counted.
    plain = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))) & (x != 0)
    rows = rows.withColumn("limb", F.when(plain, _limb(F.when(plain, x).otherwise(F.lit(1.0)))).otherwise(F.lit(-1)))
    safe = F.when(plain, x).otherwise(F.lit(0.0))
    digits = _digits(safe, F.greatest(F.col("limb"), F.lit(0)))
    per = rows.groupBy("_key", "which", "limb").agg(
        *[F.sum(d).alias(f"d{k}") for k, d in enumerate(digits)], F.count(x).alias("n"),
        F.count_if(F.isnan(x)).alias("nan"), F.count_if(x == F.lit(float("inf"))).alias("up"),
        F.count_if(x == F.lit(float("-inf"))).alias("down"))
    # A limb's sums, laid over the limbs they belong to.
    spread = per.select("_key", "which", "n", "nan", "up", "down", F.posexplode(F.array(
        *[F.col(f"d{k}") for k in range(DIGITS)])).alias("k", "v"), "limb")
    first = F.col("k") == 0
    over = spread.groupBy("_key", "which", F.greatest(F.col("limb") + F.col("k"), F.lit(0)).alias("limb")).agg(
        F.sum("v").alias("v"), *[F.sum(F.when(first, F.col(c)).otherwise(0)).alias(c) for c in ("n", "nan", "up", "down")])
    total = over.groupBy("_key", "which").agg(
        F.map_from_entries(F.collect_list(F.struct("limb", "v"))).alias("at"), F.min("limb").alias("lo"),
        F.max("limb").alias("hi"), *[F.sum(c).alias(c) for c in ("n", "nan", "up", "down")])
    # Three limbs more than the sums touch take the last carries.
    dense = F.transform(F.sequence(F.col("lo"), F.col("hi") + 3), lambda i: F.coalesce(F.col("at")[i], F.lit(0).cast("long")))
    total = total.withColumn("_dense", dense).withColumn("_c", _carried(F.col("_dense")))
    total = total.withColumn("_neg", F.col("_c.carry") < 0) \
        .withColumn("_d", F.when(F.col("_neg"), _carried(F.transform("_dense", lambda v: -v))["d"]).otherwise(F.col("_c.d")))
    number = _number(F.col("lo"), F.col("_d"))
    number = F.when(F.col("_neg"), -number).otherwise(number)
    number = F.when(F.col("n") == 0, F.lit(None).cast("double")) \
        .when((F.col("nan") > 0) | ((F.col("up") > 0) & (F.col("down") > 0)), F.lit(float("nan"))) \
        .when(F.col("up") > 0, F.lit(float("inf"))).when(F.col("down") > 0, F.lit(float("-inf"))).otherwise(number)
    out = total.select("_key", "which", number.alias("s"), "n")
    cells = []
    for k, v in enumerate(names):
        s = F.max(F.when(F.col("which") == k, F.col("s")))
        cells.append(s.alias(v))
        if v in mean:
            cells.append((s / F.nullif(F.max(F.when(F.col("which") == k, F.col("n"))), F.lit(0))).alias(f"mean_{v}"))
    if not keys:
        return out.agg(*cells)
    wide = out.groupBy("_key").agg(*cells)
    return wide.select(*[F.col(f"_key.`{k}`").alias(k) for k in keys], *[c for c in wide.columns if c != "_key"])
