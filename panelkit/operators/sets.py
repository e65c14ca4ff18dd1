"""Row-set operators: n-ary union, labelled bind, key-wise difference."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    """``reduce(union_all)``: by name, duplicates kept, no shuffle."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def bind_rows(labelled: dict[str, DataFrame], label_col: str = "group") -> DataFrame:
    """``bind_rows`` of labelled frames, filling missing columns with NULL."""
    frames = [df.withColumn(label_col, F.lit(label)) for label, df in labelled.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def difference(df: DataFrame, other: DataFrame, on) -> DataFrame:
    """Rows of ``df`` whose key is absent from ``other`` (``anti_join``)."""
    return df.join(other, on, "left_anti")
