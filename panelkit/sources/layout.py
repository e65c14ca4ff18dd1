"""Writers that control the on-disk layout of parquet tables.

The knobs the reference tunes, as Spark writer options:

* compression codec (``zstd``),
* rows per row group (``parquet.block.row.count.limit``) -- the unit of
  min/max skipping,
* rows per file (``maxRecordsPerFile``),
* Hive partition folders (``partitionBy``) for partition pruning,
* clustering by key (range partition + sort within partition, never one
  global sort into one file) for tight footer statistics,
* bucketed tables (``bucketBy``) so joins and windows on the bucket key
  read pre-partitioned data without an exchange.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_ROW_GROUP_ROWS = 250_000
DEFAULT_FILE_ROWS = 5_000_000


def _writer(df: DataFrame, compression: str, row_group_rows: int | None,
            max_rows_per_file: int | None, mode: str, bloom: Mapping[str, int] | None = None):
    w = df.write.mode(mode).option("compression", compression)
    for column, distinct in (bloom or {}).items():
        w = w.option(f"parquet.bloom.filter.enabled#{column}", "true") \
            .option(f"parquet.bloom.filter.expected.ndv#{column}", distinct)
    if row_group_rows:
        w = w.option("parquet.block.row.count.limit", row_group_rows)
    if max_rows_per_file:
        w = w.option("maxRecordsPerFile", max_rows_per_file)
    return w


def write_parquet(df: DataFrame, path: str, compression: str = "zstd",
                  row_group_rows: int | None = DEFAULT_ROW_GROUP_ROWS,
                  max_rows_per_file: int | None = DEFAULT_FILE_ROWS,
                  partition_by: Sequence[str] = (), mode: str = "overwrite",
                  folder_files: int = 8, bloom: Mapping[str, int] | None = None) -> str:
    """``COPY ... TO dir (FORMAT PARQUET, COMPRESSION zstd, ROW_GROUP_SIZE,
    ROW_GROUPS_PER_FILE)``.  The job commit protocol replaces the
    write-to-tmp-then-move step: a failed job leaves no partial output.
    With ``partition_by`` the rows are first dealt by partition value and a
    salt of ``folder_files``, so a folder gets at most that many writers
    (not one per task) and a hot value is still spread.  ``bloom`` names
    columns to write Bloom filters for, with the distinct values expected in
    a row group: a lookup on a column that the table is not clustered by then
    skips the row groups that cannot hold the value."""
    if partition_by:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(folder_files))
        df = df.repartition(*[F.col(c) for c in partition_by], salt)
    w = _writer(df, compression, row_group_rows, max_rows_per_file, mode, bloom)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_clustered(df: DataFrame, path: str, keys: Sequence[str],
                    num_partitions: int | None = None, **kw) -> str:
    """Sorted materialisation for point lookups: range-partition on the key
    with a hash of the row as tie-break (sampled boundaries; range
    partitioning alone cannot split one hot key over files) and sort inside
    each partition.  Every file then covers a narrow key range and row-group
    min/max statistics let a lookup skip almost everything."""
    n = num_partitions or df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    clustered = (df.withColumn("_tie", F.xxhash64(*df.columns))
                 .repartitionByRange(int(n), *[F.col(k) for k in keys], F.col("_tie"))
                 .sortWithinPartitions(*keys).drop("_tie"))
    return write_parquet(clustered, path, **kw)


def append_sorted(df: DataFrame, path: str, sort_cols: Sequence[str], batch: str | int, **kw) -> str:
    """``INSERT INTO t SELECT ... ORDER BY`` per batch: each batch is sorted
    within its files, which go to the batch's own folder; other batches are
    not rewritten, and a retried batch replaces itself."""
    write_parquet(df.sortWithinPartitions(*sort_cols), f"{path}/batch={batch}", **kw)
    return path


def save_bucketed_table(df: DataFrame, name: str, path: str, key: str, n: int,
                        sort: bool = True, compression: str = "zstd",
                        sort_cols: Sequence[str] | None = None) -> str:
    """Persistent table bucketed (and sorted) on ``key`` into ``n`` buckets,
    stored at ``path`` in the shared folder.  Joins/aggregations/windows on
    ``key`` between tables with the same bucketing need no exchange.  Rows
    are dealt to the buckets before the write: one file per bucket."""
    w = (df.repartition(n, F.col(key)).write.mode("overwrite").format("parquet").option("compression", compression)
         .option("path", path).bucketBy(n, key))
    if sort:
        cols = list(sort_cols or [key])
        w = w.sortBy(cols[0], *cols[1:])
    w.saveAsTable(name)
    return name
