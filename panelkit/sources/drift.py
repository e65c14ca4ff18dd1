"""Reading files whose columns drifted in type.

``mergeSchema`` fills columns that some files lack, but stops when a column
is an integer in one file and a string in another.  Here the files are grouped
by schema, the groups' schemas are widened to one type per column, and every
group is scanned with its own schema and cast.

Schemas come from the files' footers, read a few at a time; files with the same
schema text form a group, and Spark is asked for one file's schema per group.
Only paths and schemas reach the driver, and no data is read for it.

Types widen as a stacking reader's do: boolean to integer types, integers to
the longer one, integers and decimals to a decimal that holds both, any number
with a double to double, date to timestamp, and everything else that differs
to string.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOOTER_THREADS = 16
_INTEGERS = [T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType]
_DIGITS = {T.BooleanType: 1, T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}
# Float keeps 24 bits exactly, so only the types up to 16 bits stay with it.
_FLOAT_SAFE = (T.BooleanType, T.ByteType, T.ShortType, T.FloatType)


def list_files(spark: SparkSession, paths: str | Sequence[str], suffix: str = ".parquet") -> list[str]:
    """Data files under the given folders, files or globs, in path order
    (file-system metadata; names that start with ``_`` or ``.`` are not data)."""
    jvm, out = spark.sparkContext._jvm, []
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for given in [paths] if isinstance(paths, str) else paths:
        p = jvm.org.apache.hadoop.fs.Path(given)
        fs = p.getFileSystem(conf)
        for status in fs.globStatus(p) or []:
            if status.isFile():
                out.append(status.getPath().toString())
                continue
            top = status.getPath().toString()
            found = fs.listFiles(status.getPath(), True)
            while found.hasNext():
                path = found.next().getPath().toString()
                parts = path[len(top):].strip("/").split("/")
                if path.endswith(suffix) and not any(x.startswith(("_", ".")) for x in parts):
                    out.append(path)
    return sorted(set(out))


def widest(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that both are read as."""
    if a == b:
        return a
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return b if isinstance(a, T.NullType) else a
    kinds = {type(a), type(b)}
    integers = [t for t in _INTEGERS if t in kinds]
    if kinds <= set(_INTEGERS):
        return integers[-1]()
    if kinds <= {*_INTEGERS, T.DecimalType}:
        scale = max(t.scale if isinstance(t, T.DecimalType) else 0 for t in (a, b))
        whole = max(t.precision - t.scale if isinstance(t, T.DecimalType) else _DIGITS[type(t)] for t in (a, b))
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.DoubleType()
    if kinds <= set(_FLOAT_SAFE):
        return T.FloatType()
    if kinds <= {*_INTEGERS, T.DecimalType, T.FloatType, T.DoubleType}:
        return T.DoubleType()
    if kinds <= {T.DateType, T.TimestampType, T.TimestampNTZType}:
        return T.TimestampNTZType() if T.TimestampType not in kinds else T.TimestampType()
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return widen([a, b])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(widest(a.elementType, b.elementType), True)
    if isinstance(a, T.MapType) and isinstance(b, T.MapType) and a.keyType == b.keyType:
        return T.MapType(a.keyType, widest(a.valueType, b.valueType), True)
    if any(isinstance(t, (T.StructType, T.ArrayType, T.MapType, T.BinaryType)) for t in (a, b)):
        raise TypeError(f"{a.simpleString()} and {b.simpleString()} have no common type")
    return T.StringType()


def widen(schemas: Sequence[T.StructType]) -> T.StructType:
    """One schema for all: columns by name (in any case) in order of
    appearance, each of the widest type, all nullable."""
    fields: dict[str, T.StructField] = {}
    for schema in schemas:
        for f in schema.fields:
            have = fields.get(f.name.lower())
            kind = f.dataType if have is None else widest(have.dataType, f.dataType)
            fields[f.name.lower()] = T.StructField(have.name if have else f.name, kind, True)
    return T.StructType(list(fields.values()))


def schema_groups(spark: SparkSession, files: Sequence[str]) -> list[tuple[T.StructType, list[str]]]:
    """The files by schema, in order of appearance, with each group's schema."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def text(file: str) -> str:
        path = jvm.org.apache.hadoop.fs.Path(file)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(
            jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, conf))
        try:
            return reader.getFooter().getFileMetaData().getSchema().toString()
        finally:
            reader.close()

    by_text: dict[str, list[str]] = {}
    with ThreadPoolExecutor(FOOTER_THREADS) as pool:
        for file, found in zip(files, pool.map(text, files)):
            by_text.setdefault(found, []).append(file)
    # Texts may differ where Spark's schemas do not (required or optional).
    groups: dict[str, tuple[T.StructType, list[str]]] = {}
    for members in by_text.values():
        schema = spark.read.option("recursiveFileLookup", True).parquet(members[0]).schema
        groups.setdefault(schema.json(), (schema, []))[1].extend(members)
    return list(groups.values())


def _as(col: Column, have: T.DataType, want: T.DataType) -> Column:
    """``col`` of type ``have`` as ``want``: a widening, so it cannot fail."""
    if have == want:
        return col
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        inner = {f.name.lower(): f for f in have.fields}
        return F.when(col.isNotNull(), F.struct(*[
            (_as(col.getField(inner[f.name.lower()].name), inner[f.name.lower()].dataType, f.dataType)
             if f.name.lower() in inner else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields]))
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType):
        return F.transform(col, lambda x: _as(x, have.elementType, want.elementType))
    if isinstance(have, T.BooleanType) and not isinstance(want, T.StringType):
        return col.cast("int").cast(want)
    return col.cast(want)


def _unescaped(x: Column) -> Column:
    """Percent escapes resolved, a plus sign kept.  Folder names are escaped
    once by the writer, and the path's URI once more."""
    return F.url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))


def read_drifted(spark: SparkSession, paths: str | Sequence[str], partition_columns: Sequence[str] = (),
                 file_column: str | None = None) -> DataFrame:
    """All files under ``paths`` as one table, columns by name, each of the
    widest type found; a column that a file lacks is NULL there.

    ``partition_columns`` are read from ``name=value`` folders as strings and
    ``file_column`` holds each row's path.  One scan per distinct schema, with
    column pruning; filters on columns that keep their type reach the files.
    A table without files raises, as it has no schema.
    """
    files = list_files(spark, paths)
    if not files:
        raise FileNotFoundError(f"no data files under {paths}")
    groups = schema_groups(spark, files)
    target = widen([schema for schema, _ in groups])
    parts = []
    for schema, members in groups:
        names = {f.name.lower(): f for f in schema.fields}
        path = F.col("_metadata.file_path")
        cols = [_as(F.col(f"`{names[f.name.lower()].name}`"), names[f.name.lower()].dataType, f.dataType).alias(f.name)
                if f.name.lower() in names else F.lit(None).cast(f.dataType).alias(f.name) for f in target.fields]
        cols += [F.nullif(_unescaped(_unescaped(F.regexp_extract(path, f"/{c}=([^/]*)/", 1))),
                          F.lit("__HIVE_DEFAULT_PARTITION__")).alias(c) for c in partition_columns]
        if file_column:
            cols.append(path.alias(file_column))
        scan = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*members)
        parts.append(scan.select(*cols))
    return reduce(lambda a, b: a.unionByName(b), parts)


def drift_report(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Column by column, the types found, the number of files of each, and the
    type that they are read as."""
    groups = schema_groups(spark, list_files(spark, paths))
    target = {f.name.lower(): f.dataType.simpleString() for f in widen([s for s, _ in groups]).fields}
    found: dict[tuple[str, str], int] = {}
    for schema, members in groups:
        for f in schema.fields:
            k = (f.name.lower(), f.dataType.simpleString())
            found[k] = found.get(k, 0) + len(members)
    rows = [(c, t, n, target[c]) for (c, t), n in sorted(found.items())]
    return spark.createDataFrame(rows, "column string, type string, files long, read_as string")
