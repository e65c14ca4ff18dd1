"""Scalar column helpers with the reference's numeric and date semantics.

All are built-in Catalyst expressions, so they stay inside whole-stage
codegen.  The integer helpers exist because engines disagree on
``as.integer``/``CAST`` (truncate vs round-half-even) and on negative
integer division; these spell the intent out.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def floor_int(x) -> Column:
    """``as.integer(floor(x))``: largest integer <= x."""
    return F.floor(_c(x)).cast("int")


def trunc_int(x) -> Column:
    """Truncate toward zero (R ``trunc``/``as.integer`` on doubles)."""
    x = _c(x)
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("int")


def round_half_even_int(x) -> Column:
    """Round half to even, as an integer (what a rounding CAST does)."""
    return F.bround(_c(x), 0).cast("int")


def floor_div(a, b) -> Column:
    """R ``%/%`` on whole numbers: floor division, exact for every 64-bit
    value and correct for negative operands; division by 0 gives NULL."""
    a, b = _c(a).cast("long"), F.nullif(_c(b).cast("long"), F.lit(0).cast("long"))
    q = F.call_function("div", a, b)
    return F.when((a % b != 0) & ((a < 0) != (b < 0)), q - 1).otherwise(q)


def floor_mod(a, b) -> Column:
    """R ``%%`` on whole numbers: the result has the sign of the divisor;
    modulo 0 gives NULL."""
    a, b = _c(a).cast("long"), F.nullif(_c(b).cast("long"), F.lit(0).cast("long"))
    m = a % b
    return F.when((m != 0) & ((m < 0) != (b < 0)), m + b).otherwise(m)


def bucket_floor(x, width: int) -> Column:
    """``floor(x / width) * width`` as int (age decades, 5-year bands)."""
    return (F.floor(_c(x) / F.lit(width)) * F.lit(width)).cast("int")


def case_when(branches: Sequence[tuple[Column, object]], default=None) -> Column:
    """``case_when(cond ~ value, ..., TRUE ~ default)``; first match wins."""
    out = None
    for cond, value in branches:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    if default is not None:
        out = out.otherwise(default if isinstance(default, Column) else F.lit(default))
    return out


def brackets(x, cuts: Sequence[tuple[float, str]], top_label: str) -> Column:
    """Ordered half-open brackets: ``x < cut -> label``, else ``top_label``."""
    x = _c(x)
    return case_when([(x < F.lit(c), label) for c, label in cuts], top_label)


def recode(x, mapping: Mapping[str, str], keep_unmatched: bool = True) -> Column:
    """dplyr ``recode``: map listed values, keep (or NULL) the rest."""
    x = _c(x)
    out = case_when([(x == F.lit(k), v) for k, v in mapping.items()],
                    x if keep_unmatched else F.lit(None).cast("string"))
    return out


def order_position(x, levels: Sequence[str]) -> Column:
    """``match(x, levels)``: 1-based position, NULL when absent."""
    pos = F.array_position(F.array(*[F.lit(v) for v in levels]), _c(x))
    return F.when(pos > 0, pos.cast("int"))


def month_start(d) -> Column:
    """``floor_date(d, "month")`` as a DATE (no timestamp/time-zone drift)."""
    return F.trunc(_c(d).cast("date"), "MM")


def plus_days(d, n: int) -> Column:
    return F.date_add(_c(d).cast("date"), n)


def days_between(end, start) -> Column:
    """``difftime(end, start, units = "days")`` as an integer day count."""
    return F.datediff(_c(end).cast("date"), _c(start).cast("date"))


def first_match_replace(x, pattern: str, replacement: str) -> Column:
    """R ``sub``: replace only the first regex match.

    ``regexp_replace`` replaces all matches, so the pattern is wrapped to
    consume the whole string.  The text before the first match and the text
    after it (newlines included) are groups of their own, which moves the
    numbers of the pattern's groups up by one.  The replacement names groups
    as ``$1`` or ``\1``.
    """
    def up(m: re.Match, mark: str) -> str:
        return m[0] if m[1] is None else f"{mark}{int(m[1]) + 1}"
    own = re.sub(r"\\\\|\\([1-9])", lambda m: up(m, "\\"), pattern)
    new = re.sub(r"\\\\|[\\$]([1-9])", lambda m: up(m, "$"), replacement)
    return F.regexp_replace(_c(x), f"^(?<pre>(?s:.*?))(?:{own})(?<rest>(?s:.*))$", "${pre}" + new + "${rest}")


def hash_key(x) -> Column:
    """64-bit integer surrogate for a string id (not collision-free: always
    join on the original id as well)."""
    return F.xxhash64(_c(x))


def hash_bucket(x, n: int) -> Column:
    """Non-negative bucket id in [0, n) from the 64-bit hash."""
    return F.pmod(F.xxhash64(_c(x)), F.lit(n)).cast("int")
