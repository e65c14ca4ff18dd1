"""Hash buckets of people.

In Spark the ``Exchange hashpartitioning(person)`` under a window already is
the "process one tenth of the people at a time" step, so the default for
every per-person operator is a single plan.  ``bucketed_apply`` keeps the
explicit form for small clusters that want to bound one stage's sort: the
same function runs on each bucket and the results are stacked lazily.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.functions.expr import hash_bucket


def with_bucket(df: DataFrame, key: str, n: int, name: str = "bucket") -> DataFrame:
    """``CAST(hash(key) % n AS INTEGER)`` with a non-negative remainder."""
    return df.withColumn(name, hash_bucket(key, n))


def bucketed_apply(df: DataFrame, key: str, n: int,
                   fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``map(0:(n-1), fn on bucket b) |> reduce(union_all)``.

    Correct for any ``fn`` that only relates rows of the same ``key``
    (every key lives in exactly one bucket).
    """
    b = with_bucket(df, key, n, "_bucket")
    parts = [fn(b.where(F.col("_bucket") == i).drop("_bucket")) for i in range(n)]
    return reduce(lambda x, y: x.unionByName(y), parts)
