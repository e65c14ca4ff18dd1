"""Ordering with the reference's NULL placement (NULLS LAST both ways)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions.expr import order_position


def _key(c, desc: bool) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.desc_nulls_last() if desc else col.asc_nulls_last()


def arrange(df: DataFrame, *cols, desc: Sequence[str] = ()) -> DataFrame:
    """``arrange(a, desc(b))``: global sort, NULLs last."""
    return df.orderBy(*[_key(c, isinstance(c, str) and c in desc) for c in cols])


def top_k(df: DataFrame, k: int, by: Sequence[str], desc: bool = True,
          tiebreak: Sequence[str] = ()) -> DataFrame:
    """``arrange(desc(by)) |> head(k)``: planned as TakeOrderedAndProject
    (per-partition top-k, then merge of k rows per partition)."""
    keys = [_key(c, desc) for c in by] + [_key(c, False) for c in tiebreak]
    return df.orderBy(*keys).limit(k)


def arrange_levels(df: DataFrame, col: str, levels: Sequence[str], *then) -> DataFrame:
    """``arrange(match(col, levels))``: custom level order, unknown last."""
    return df.orderBy(order_position(col, levels).asc_nulls_last(),
                      *[_key(c, False) for c in then])
