"""Tables that stay clustered while batches are appended.

A batch sorted by the key overlaps every earlier batch's key ranges, so after
ten yearly appends a point lookup opens ten files.  Here each append notes the
key range of its files, taken from their footers, and :func:`recluster` rewrites
just the files that pile up: wherever more than ``depth`` ranges overlap, the
smallest of them are merged into files with ranges of their own.

The live files of a table are a listing, itself a small parquet table written
after the data, one version per change.  A run that breaks leaves files that no
listing names, and the table as it was; readers see one version.  One writer at
a time.  The driver handles paths, ranges and sizes; rows move in Spark jobs.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.sources import layout
from panelkit.sources.drift import FOOTER_THREADS, list_files

RUN = "cluster_run"        # folder of one sorted run; not a column of the table


def file_ranges(spark: SparkSession, files: Sequence[str], key: str) -> list[tuple]:
    """(file, lo, hi, rows, bytes) of every file, from footers alone.  A file
    without rows or without a key value has NULL ends; one whose footer lacks
    statistics raises, as its range is unknown."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def one(file: str) -> tuple:
        path = jvm.org.apache.hadoop.fs.Path(file)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(
            jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, conf))
        try:
            lo = hi = None
            rows = 0
            for block in reader.getFooter().getBlocks():
                rows += block.getRowCount()
                column = next(c for c in block.getColumns() if c.getPath().toDotString().lower() == key.lower())
                stats = column.getStatistics()
                if stats.hasNonNullValue():
                    a, b = (x.toStringUsingUTF8() if hasattr(x, "toStringUsingUTF8") else x
                            for x in (stats.genericGetMin(), stats.genericGetMax()))
                    lo, hi = a if lo is None else min(lo, a), b if hi is None else max(hi, b)
                elif not (stats.isNumNullsSet() and stats.getNumNulls() == block.getRowCount()):
                    raise ValueError(f"{file} has no statistics of {key}")
            size = path.getFileSystem(conf).getFileStatus(path).getLen()
            return file, lo, hi, rows, size
        finally:
            reader.close()

    with ThreadPoolExecutor(FOOTER_THREADS) as pool:
        return list(pool.map(one, files))


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/listing")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    found = [s.getPath() for s in fs.listStatus(p)]
    return sorted(int(f.getName()[2:]) for f in found
                  if f.getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS")))


def live_files(spark: SparkSession, path: str, version: int | None = None) -> list[tuple]:
    """(file, lo, hi, rows, bytes) of the table's files, with the ends in the
    key's own type."""
    versions = _versions(spark, path)
    if not versions:
        return []
    listing = spark.read.parquet(f"{path}/listing/v={versions[-1] if version is None else version:09d}")
    return [tuple(r) for r in listing.select("file", "lo", "hi", "rows", "bytes").collect()]


def _note(spark: SparkSession, path: str, files: list[tuple], kind: str) -> None:
    versions = _versions(spark, path)
    schema = f"file string, lo {kind}, hi {kind}, rows long, bytes long"
    target = f"{path}/listing/v={(versions[-1] if versions else 0) + 1:09d}"
    spark.createDataFrame(files, schema).coalesce(1).write.mode("overwrite").parquet(target)


def _kind(df: DataFrame, key: str) -> str:
    kind = df.schema[key].dataType.simpleString()
    if kind not in ("string", "int", "bigint", "smallint", "tinyint", "double", "float"):
        raise TypeError(f"{key} of type {kind} has no range in a listing")
    return kind


def _write_runs(parts: Sequence[DataFrame], path: str, key: str, file_rows: int, **kw) -> list[tuple]:
    """Each part as sorted files with ranges of their own, all in one job;
    returns the files' ranges.

    Rows of one key stay together, so a lookup finds them in one file, except
    for keys of more rows than a file has: those are spread by a hash, or one
    task would get them all.  ``file_rows`` is what a file holds on average; a
    hard limit would cut through a key's rows.
    """
    df = reduce(lambda a, b: a.unionByName(b), [p.withColumn(RUN, F.lit(k)) for k, p in enumerate(parts)])
    spark, folder = df.sparkSession, f"{path}/data/{uuid.uuid4().hex}"
    counts = df.groupBy(F.col(key).alias("_hot")).count()
    rows, most = counts.agg(F.sum("count"), F.max("count")).first()
    if not rows:
        return []
    salt = F.lit(0)
    if most > file_rows:
        hot = counts.where(F.col("count") > file_rows)               # at most rows / file_rows keys
        df = df.join(hot, F.col(key).eqNullSafe(F.col("_hot")), "left")
        salt = F.when(F.col("count").isNotNull(), F.xxhash64(*parts[0].columns)).otherwise(0)
    df = df.withColumn("_tie", salt).select(*parts[0].columns, RUN, "_tie") \
        .repartitionByRange(-(-rows // file_rows), RUN, key, "_tie").sortWithinPartitions(RUN, key).drop("_tie")
    # A folder per part: no file holds rows of two of them.
    w = layout._writer(df, kw.pop("compression", "zstd"), kw.pop("row_group_rows", layout.DEFAULT_ROW_GROUP_ROWS), None,
                       "overwrite", kw.pop("bloom", None))
    w.partitionBy(RUN).parquet(folder)
    return [f for f in file_ranges(spark, list_files(spark, folder), key) if f[3]]


def append_clustered(df: DataFrame, path: str, key: str, file_rows: int = layout.DEFAULT_FILE_ROWS,
                     depth: int | None = 2, **kw) -> None:
    """Append a batch, sorted by the key; with ``depth`` the files are then
    reclustered to it, as one new version of the table.  An empty batch
    changes nothing.  ``kw``: compression, row_group_rows, bloom."""
    spark, kind = df.sparkSession, _kind(df, key)
    new = _write_runs([df], path, key, file_rows, **dict(kw))
    if not new:
        return
    files = live_files(spark, path) + new
    if depth is not None:
        files = _thinned(spark, path, files, key, depth, file_rows, kw)
    _note(spark, path, files, kind)


def to_merge(files: Sequence[tuple], depth: int) -> list[list[str]]:
    """Groups of files to rewrite so that at most ``depth`` ranges overlap.

    Wherever more do, all but the ``depth - 1`` largest of them are taken.  A
    group is a chain of taken files whose ranges overlap, so its rewritten
    files lie over each point once: a point of d > depth ranges keeps depth - 1
    and gets one.  Files without a key value are never opened by a lookup and
    stay as they are.
    """
    held = [f for f in files if f[1] is not None]
    taken: set[str] = set()
    # The depth changes only at ends, and is largest at some file's low end.
    for point in sorted({f[1] for f in held}):
        over = sorted((f for f in held if f[1] <= point <= f[2]), key=lambda f: (f[4], f[0]))
        if len(over) > depth:
            taken |= {f[0] for f in over[:len(over) - depth + 1]}
    groups: list[list[str]] = []
    reach = None
    for f in sorted((f for f in held if f[0] in taken), key=lambda f: (f[1], f[2])):
        if reach is None or f[1] > reach:
            groups.append([])
            reach = f[2]
        groups[-1].append(f[0])
        reach = max(reach, f[2])
    return groups


def _thinned(spark: SparkSession, path: str, files: list[tuple], key: str, depth: int, file_rows: int, kw) -> list[tuple]:
    """The files after merging what piles up beyond ``depth``."""
    while groups := to_merge(files, depth):
        gone = {f for g in groups for f in g}
        new = _write_runs([spark.read.parquet(*g) for g in groups], path, key, file_rows, **dict(kw))
        before, files = max_depth(files), [f for f in files if f[0] not in gone] + new
        if max_depth(files) >= before:         # keys of several files each: no fewer runs to be had
            break
    return files


def recluster(spark: SparkSession, path: str, key: str, depth: int = 2,
              file_rows: int = layout.DEFAULT_FILE_ROWS, **kw) -> int:
    """Rewrite the files that pile up beyond ``depth``; returns how many were
    replaced.  The other files stay untouched, and so do the replaced ones
    until :func:`vacuum`, for readers of earlier listings.

    Keys of more rows than a file holds need several files in any layout; for
    them the depth counts runs, not files.
    """
    old = live_files(spark, path)
    new = _thinned(spark, path, old, key, depth, file_rows, kw)
    gone = {f[0] for f in old} - {f[0] for f in new}
    if gone:
        _note(spark, path, new, _kind(spark.read.parquet(old[0][0]), key))
    return len(gone)


def max_depth(files) -> int:
    held = [f for f in files if f[1] is not None]
    return max((sum(f[1] <= point <= f[2] for f in held) for point in {f[1] for f in held}), default=0)


def read_clustered(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table's rows, as of its latest listing or an earlier one."""
    files = live_files(spark, path, version)
    if not files:
        raise FileNotFoundError(f"no table at {path}")
    return spark.read.parquet(*[f[0] for f in files])


def lookup(spark: SparkSession, path: str, key: str, value) -> tuple[DataFrame, int]:
    """The rows of one key value, and how many files can hold it.  Only those
    are opened, and the filter skips row groups inside them."""
    files = live_files(spark, path)
    if not files:
        raise FileNotFoundError(f"no table at {path}")
    over = [f[0] for f in files if f[1] is not None and f[1] <= value <= f[2]]
    df = spark.read.parquet(*(over or [files[0][0]])).where(F.col(key) == F.lit(value))
    return df, len(over)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete data files that none of the last ``keep`` listings names, and
    the older listings; returns the number of files."""
    versions = _versions(spark, path)
    named = {f[0] for v in versions[-keep:] for f in live_files(spark, path, v)}
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    dead = [f for f in list_files(spark, f"{path}/data") if f not in named]
    for f in dead:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f), False)
    for v in versions[:-keep]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/listing/v={v:09d}"), True)
    return len(dead)
