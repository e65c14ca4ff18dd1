"""File-level jobs: directory profiles, filename routing, run logs."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def profile_files(spark: SparkSession, root: str, pattern: str = "*",
                  top: int | None = None) -> DataFrame:
    """Files and GB per dataset (the folder holding each file), largest
    first.  Uses the ``binaryFile`` source for its ``path``/``length``
    metadata columns; ``content`` is not selected, so no file is read."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", "true").load(root)
             .select("path", "length"))
    # Dataset = the top-level entry under root (a file or a folder of parts).
    base = root.rstrip("/").rsplit("/", 1)[-1]
    dataset = F.regexp_extract("path", "/" + re.escape(base) + "/([^/]+)", 1)
    out = (files.groupBy(dataset.alias("dataset"))
           .agg(F.count(F.lit(1)).alias("n_files"),
                F.sum("length").alias("total_bytes"))
           .withColumn("total_gb", F.col("total_bytes") / F.lit(1024 ** 3))
           .orderBy(F.col("total_bytes").desc(), F.col("dataset")))
    return out.limit(top) if top else out


def route_csv(spark: SparkSession, root: str, routes: Mapping[str, tuple[str, T.StructType]],
              tag_pattern: str = r"(\d{4})") -> dict[str, DataFrame]:
    """Filename -> target-table routing.

    ``routes`` maps a target to ``(text, schema)``: a file belongs to the
    first target whose text is in its path below ``root``, in either case.
    Targets without a file are left out, and files of no target are skipped.
    Only paths are listed on the driver; each target is one CSV scan.  The
    per-file tag (e.g. year) comes from ``_metadata.file_path``.
    """
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top, found = fs.makeQualified(top).toString(), {}
    listing = fs.listFiles(jvm.org.apache.hadoop.fs.Path(root), True)
    while listing.hasNext():
        path = listing.next().getPath().toString()
        below = path[len(top):].lower()
        if not below.endswith(".csv"):
            continue
        target = next((t for t, (text, _) in routes.items() if text.lower() in below), None)
        if target is not None:
            found.setdefault(target, []).append(path)
    return {t: spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(found[t])
            .withColumn("file_tag", F.regexp_extract(F.col("_metadata.file_path"), tag_pattern, 1))
            for t, (_, schema) in routes.items() if t in found}


def append_log(rows: DataFrame, path: str) -> None:
    """``log_result``: append run rows to a parquet log (schema may grow)."""
    rows.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Read the whole log, merging schemas that drifted between appends."""
    return spark.read.option("mergeSchema", True).parquet(path)
