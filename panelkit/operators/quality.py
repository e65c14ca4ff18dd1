"""Key-integrity checks (what a PRIMARY KEY would enforce at ingest, run
as a data-quality job instead)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_profile(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: total rows, rows with a NULL key part, distinct non-NULL keys
    and non-NULL keys that occur more than once.  A per-key count (with
    map-side combine) followed by a global roll-up of those counts."""
    any_null = None
    for k in keys:
        cond = F.col(k).isNull()
        any_null = cond if any_null is None else (any_null | cond)
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    ok = ~any_null
    return per_key.agg(
        F.coalesce(F.sum("_c"), F.lit(0)).cast("long").alias("rows"),
        F.coalesce(F.sum(F.when(any_null, F.col("_c"))), F.lit(0)).cast("long").alias("null_keys"),
        F.count(F.when(ok, 1)).alias("distinct_keys"),
        F.count(F.when(ok & (F.col("_c") > 1), 1)).alias("duplicated_keys"))


def duplicated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their multiplicity."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))
