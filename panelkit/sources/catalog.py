"""Named relations: views over parquet, materialised tables, housekeeping.

A view is a name for a lazy scan (zero copy; each query reads only the
columns and row groups it needs).  A table is a one-off materialisation
written as parquet to the shared folder and registered in the catalog.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession


def register_view(spark: SparkSession, name: str, paths, where: str | Column | None = None,
                  extra: Mapping[str, Column] | None = None) -> DataFrame:
    """``CREATE OR REPLACE VIEW name AS SELECT * [, extra] FROM read_parquet(paths)
    [WHERE ...]``.  The filter becomes a pushed parquet filter in every
    query on the view."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.parquet(*paths)
    for col, expr in (extra or {}).items():
        df = df.withColumn(col, expr)
    if where is not None:
        df = df.where(where)
    df.createOrReplaceTempView(name)
    return spark.table(name)


def materialise(df: DataFrame, name: str, path: str, mode: str = "overwrite") -> DataFrame:
    """``CREATE OR REPLACE TABLE name AS ...`` / ``compute(temporary=FALSE)``:
    write parquet at ``path`` and register the table."""
    (df.write.mode(mode).format("parquet").option("compression", "zstd")
     .option("path", path).saveAsTable(name))
    return df.sparkSession.table(name)


def drop_table(spark: SparkSession, name: str) -> None:
    """``DROP TABLE IF EXISTS``; also drops a temp view of that name."""
    spark.catalog.dropTempView(name)
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def table_names(spark: SparkSession) -> list[str]:
    """``dbListTables``: catalog metadata (names only, never rows)."""
    return sorted(t.name for t in spark.catalog.listTables())


def existing_sources(spark: SparkSession, globs: Mapping[str, str]) -> dict[str, str]:
    """Keep only the sources whose glob matches at least one file (Hadoop
    ``globStatus`` on the driver: file-system metadata, no data)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = {}
    for name, pattern in globs.items():
        p = jvm.org.apache.hadoop.fs.Path(pattern)
        hits = p.getFileSystem(conf).globStatus(p)
        if hits is not None and len(hits) > 0:
            out[name] = pattern
    return out
