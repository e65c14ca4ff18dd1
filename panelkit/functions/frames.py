"""DataFrame-level column transforms (``rename_with``, ``across``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalise_columns(df: DataFrame) -> DataFrame:
    """``rename_with(tolower)``: lower-case every column name."""
    return df.toDF(*[c.lower() for c in df.columns])


def round_doubles(df: DataFrame, digits: int = 2) -> DataFrame:
    """``mutate(across(where(is.double), round))`` over the schema."""
    return df.select(*[
        F.round(F.col(f.name), digits).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields
    ])
