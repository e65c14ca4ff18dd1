"""Idempotent replacement of single partitions of a stored table.

A yearly conversion is run again when its input was corrected or a run broke
off.  Here each run replaces exactly the partitions it is given (dynamic
partition overwrite) and notes which input files they came from; a run whose
inputs are already noted does nothing.  Other partitions' files are not
touched, not even rewritten with the same rows.

The order makes a broken run harmless: the write is committed first and noted
afterwards.  A run that breaks before the commit leaves the old partition, one
that breaks between commit and note leaves the new partition without a note,
and the next run replaces it with the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.sources import layout
from panelkit.sources.drift import list_files

NOTES = "target string, partition string, inputs array<string>, noted timestamp"


def input_files(spark: SparkSession, paths: str | Sequence[str], suffix: str = ".csv") -> list[str]:
    """``path|length|modified`` of every input file: a changed file is a
    different input even under the same name."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for f in list_files(spark, paths, suffix):
        p = jvm.org.apache.hadoop.fs.Path(f)
        status = p.getFileSystem(conf).getFileStatus(p)
        out.append(f"{f}|{status.getLen()}|{status.getModificationTime()}")
    return out


def replace_partitions(df: DataFrame, path: str, partition: str, values: Sequence, folder_files: int = 8,
                       row_group_rows: int | None = layout.DEFAULT_ROW_GROUP_ROWS,
                       max_rows_per_file: int | None = layout.DEFAULT_FILE_ROWS, compression: str = "zstd") -> None:
    """Replace the partitions ``values`` of the table at ``path`` by the rows
    of ``df``; a value without rows ends up without a folder.

    Rows of any other value raise before anything is written, as they would
    replace a partition that was not meant.  Rows are dealt to at most
    ``folder_files`` files per value, so a hot value is spread.
    """
    spark, values = df.sparkSession, list(values)
    if None in values:
        raise ValueError("the NULL partition cannot be named for replacement")
    # One row more than there are values to replace shows any that is not one.
    held = {r[0] for r in df.select(partition).distinct().limit(len(values) + 1).collect()}
    if held - set(values):
        raise ValueError(f"rows of {partition} = {sorted(map(str, held - set(values)))} are not to be replaced, only {values}")
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(folder_files))
    writer = df.repartition(F.col(partition), salt).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .option("compression", compression)
    if row_group_rows:
        writer = writer.option("parquet.block.row.count.limit", row_group_rows)
    if max_rows_per_file:
        writer = writer.option("maxRecordsPerFile", max_rows_per_file)
    writer.partitionBy(partition).parquet(path)
    for value in values:
        if value not in held:
            _drop_folder(spark, f"{path}/{partition}={value}")


def _drop_folder(spark: SparkSession, folder: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def noted_inputs(spark: SparkSession, notes: str, target: str) -> dict[str, list[str]]:
    """The latest noted inputs per partition of a target."""
    if not _exists(spark, notes):
        return {}
    latest = spark.read.schema(NOTES).parquet(notes).where(F.col("target") == target) \
        .groupBy("partition").agg(F.max_by("inputs", "noted").alias("inputs"))
    return {r.partition: sorted(r.inputs) for r in latest.collect()}


def convert_partition(spark: SparkSession, path: str, notes: str, partition: str, value, inputs: str | Sequence[str],
                      read: Callable[[SparkSession, list[str]], DataFrame], suffix: str = ".csv") -> bool:
    """Convert one partition's input files into the table at ``path``, unless
    the notes say that these very files are in it already.

    ``read(spark, files)`` gives the rows; they must all belong to ``value``.
    Returns whether anything was written.  Without input files the partition
    is emptied (and noted as such).
    """
    files = input_files(spark, inputs, suffix)
    if noted_inputs(spark, notes, path).get(str(value)) == sorted(files):
        return False
    if files:
        replace_partitions(read(spark, [f.rsplit("|", 2)[0] for f in files]), path, partition, [value])
    else:
        _drop_folder(spark, f"{path}/{partition}={value}")
    row = spark.createDataFrame([(path, str(value), files)], "target string, partition string, inputs array<string>")
    row.withColumn("noted", F.current_timestamp()).coalesce(1).write.mode("append").parquet(notes)
    return True
