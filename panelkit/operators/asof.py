"""As-of join: for each left row, the latest right row of the same key
strictly before it in time.

Spark has no as-of join operator.  It is composed from one union and one
ordered scan: left and right rows are tagged and stacked; right rows carry
their payload, left rows NULL; for each left row the payload is the last
non-NULL value strictly before it.  At equal timestamps the right row is
ordered *after* the left one, so it does not match ("strictly before").
One shuffle on the key (or on key + time chunk for hot keys), no pairwise
comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.operators.windows import carry_last_before


def asof_last_before(left: DataFrame, right: DataFrame, key: str, left_time: str,
                     right_time: str, left_tiebreak: str, right_tiebreak: str,
                     payload: list[str], chunk_days: int | str | None = None) -> DataFrame:
    """Left rows with the ``payload`` columns of the latest right row whose
    time is strictly before the left row's (NULL when none).  ``chunk_days``
    splits long per-key histories into time chunks: an int width, "auto"
    (measured, see :func:`panelkit.operators.windows.auto_chunk`) or None."""
    lcols = left.columns
    # Left rows with a NULL key or time match nothing; they skip the shuffle
    # (all of them would otherwise share one window partition) and are added
    # back.  Right rows with a NULL key or time are before nothing.
    has_both = F.col(key).isNotNull() & F.col(left_time).isNotNull()
    unkeyed = left.where(~has_both)
    left = left.where(has_both)
    right = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull())
    packed = F.struct(*[F.col(c) for c in payload])
    l_side = left.select(
        F.col(key).alias("_k"), F.col(left_time).alias("_t"), F.lit(0).alias("_side"),
        F.col(left_tiebreak).cast("long").alias("_tb"),
        F.struct(*[F.col(c) for c in lcols]).alias("_left"),
        F.lit(None).cast(right.select(packed.alias("p")).schema["p"].dataType).alias("_right"))
    r_side = right.select(
        F.col(key).alias("_k"), F.col(right_time).alias("_t"), F.lit(1).alias("_side"),
        F.col(right_tiebreak).cast("long").alias("_tb"),
        F.lit(None).cast(l_side.schema["_left"].dataType).alias("_left"),
        packed.alias("_right"))
    both = l_side.unionByName(r_side)
    chunk: Column | str | None = None
    if chunk_days == "auto":
        chunk = "auto"
    elif chunk_days:
        from panelkit.operators.windows import time_chunk
        chunk = time_chunk("_t", chunk_days)
    carried = carry_last_before(both, "_k", ["_t", "_side", "_tb"], "_right", "_match", chunk)
    matched = (carried.where(F.col("_side") == 0)
               .select("_left.*", *[F.col(f"_match.{c}").alias(c) for c in payload]))
    return matched.unionByName(unkeyed, allowMissingColumns=True)
