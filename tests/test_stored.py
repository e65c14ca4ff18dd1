"""Type drift, partition replacement, summaries, exact sums, Bloom filters."""

import datetime as dt
import glob
import math
import os
import random
from decimal import Decimal
from fractions import Fraction

import duckdb
import pytest
from paths import SF_SMALL
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit import fixtures as fx
from panelkit.operators import sketches as S
from panelkit.operators.exactsum import exact_sums
from panelkit.plans import registry
from panelkit.session import scratch_path
from panelkit.sources import drift, layout, readers, replace

registry.load_all()


# ----------------------------------------------------------------- type drift

def write(spark, root, name, schema, rows):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/{name}")


def test_drift_equals_union_by_name(spark):
    """Int, long and string versions of a column, and missing ones, as DuckDB
    stacks them."""
    root = scratch_path(spark, "drift")
    write(spark, root, "a", "k long, code int, v double", [(1, 10, 1.5), (2, None, None)])
    write(spark, root, "b", "k long, code long, w string", [(3, 1 << 40, "x")])
    write(spark, root, "c", "k int, code string, v int", [(4, "007", 3), (5, "a b", -1)])
    write(spark, root, "d", "k long, v double", [(6, 0.25)])
    got = sorted(map(tuple, drift.read_drifted(spark, root).select("k", "code", "v", "w").collect()))
    want = duckdb.sql(f"SELECT k, code, v, w FROM read_parquet('{root}/*/*.parquet', union_by_name=true) ORDER BY k").fetchall()
    assert got == want == [(1, "10", 1.5, None), (2, None, None, None), (3, str(1 << 40), None, "x"), (4, "007", 3.0, None),
                           (5, "a b", -1.0, None), (6, None, 0.25, None)]


def test_drift_types(spark):
    t = lambda s: T._parse_datatype_string(f"x {s}").fields[0].dataType
    cases = {("int", "bigint"): "bigint", ("boolean", "int"): "int", ("int", "double"): "double", ("float", "int"): "double",
             ("float", "smallint"): "float", ("decimal(9,2)", "int"): "decimal(12,2)", ("decimal(9,2)", "decimal(5,4)"): "decimal(11,4)",
             ("decimal(38,2)", "bigint"): "decimal(38,2)", ("decimal(38,10)", "decimal(38,0)"): "double",
             ("decimal(9,2)", "double"): "double", ("date", "timestamp"): "timestamp", ("date", "timestamp_ntz"): "timestamp_ntz",
             ("date", "int"): "string", ("boolean", "string"): "string", ("void", "date"): "date",
             ("array<int>", "array<string>"): "array<string>", ("struct<a: int>", "struct<a: double, b: int>"): "struct<a: double, b: int>"}
    for (a, b), want in cases.items():
        for x, y in ((a, b), (b, a)):
            assert drift.widest(t(x), t(y)).simpleString().replace(" ", "") == want.replace(" ", ""), (x, y)
    for a, b in (("array<int>", "int"), ("binary", "string"), ("struct<a: int>", "string")):
        with pytest.raises(TypeError):
            drift.widest(t(a), t(b))


def test_drift_values_nested_names_and_folders(spark):
    root = scratch_path(spark, "drift")
    write(spark, root, "year=2001", "Id long, flag boolean, s struct<a: int>, l array<int>, d date, m decimal(6,2)",
          [(1, True, (1,), [1, None], dt.date(2001, 2, 3), Decimal("1.50")), (2, None, None, None, None, None)])
    write(spark, root, "year=a%20b", "ID long, flag int, s struct<a: double, b: string>, l array<double>, d timestamp_ntz, m int",
          [(3, 5, (0.5, "z"), [2.5], dt.datetime(2002, 1, 1, 5), 7)])
    os.makedirs(f"{root}/_temporary/x")
    open(f"{root}/_temporary/x/part.parquet", "w").close()
    df = drift.read_drifted(spark, root, partition_columns=["year"], file_column="file")
    rows = {r.Id: r for r in df.collect()}
    assert df.columns == ["Id", "flag", "s", "l", "d", "m", "year", "file"]
    assert (rows[1].flag, rows[1].s.a, rows[1].s.b, rows[1].l, rows[1].m) == (1, 1.0, None, [1.0, None], Decimal("1.50"))
    assert rows[1].d == dt.datetime(2001, 2, 3) and rows[2].s is None and rows[3].s.b == "z" and rows[3].m == Decimal("7.00")
    assert (rows[1].year, rows[3].year) == ("2001", "a b") and rows[3].file.endswith(".parquet")
    report = {(r.column, r.type): (r.files, r.read_as) for r in drift.drift_report(spark, root).collect()}
    assert report["flag", "boolean"] == (1, "int") and report["m", "int"] == (1, "decimal(12,2)")
    with pytest.raises(FileNotFoundError):
        drift.read_drifted(spark, f"{root}/nowhere")


def test_drift_groups_follow_vintages(spark, monkeypatch):
    """Many files of few vintages take few scans, and only asked columns are read."""
    root = scratch_path(spark, "drift")
    for k in range(12):
        kind = "int" if k < 5 else "string" if k < 9 else "bigint"
        spark.range(3).select("id", F.col("id").cast(kind).alias("x"), F.lit(k).alias("k")).coalesce(1).write.parquet(f"{root}/f{k:02}")
    files = drift.list_files(spark, root)
    groups = drift.schema_groups(spark, files)
    assert len(files) == 12 and sorted(len(m) for _, m in groups) == [3, 4, 5]
    df = drift.read_drifted(spark, root).where("k = 6").select("x")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,6)" in plan and "id" not in plan.split("ReadSchema")[1].split(">")[0]
    assert [r.x for r in df.collect()] == ["0", "1", "2"]


# ------------------------------------------------------- replaced partitions

def names(path):
    return {os.path.relpath(f, path): os.path.getmtime(f) for f in glob.glob(f"{path}/*/*.parquet")}


def test_replace_touches_one_partition(spark):
    root = scratch_path(spark, "replace")
    table, notes, src = f"{root}/t", f"{root}/notes", f"{root}/csv"
    df = spark.range(300).select("id", (F.col("id") % 3).cast("int").alias("y"))
    df.withColumn("file_year", F.col("y")).write.option("header", True).partitionBy("file_year").csv(src)
    read = lambda s, files: readers.read_csv(s, files, "id long, y int")
    for y in range(3):
        assert replace.convert_partition(spark, table, notes, "y", y, f"{src}/file_year={y}", read)
    before = names(table)
    rows = sorted(map(tuple, spark.read.parquet(table).collect()))
    assert rows == [(k, k % 3) for k in range(300)]
    # Again from the same files: nothing happens.
    assert not replace.convert_partition(spark, table, notes, "y", 1, f"{src}/file_year=1", read)
    assert names(table) == before
    # From another file: only that year's files change.
    df.where("y = 1 AND id < 100").write.mode("overwrite").option("header", True).csv(f"{root}/new")
    assert replace.convert_partition(spark, table, notes, "y", 1, f"{root}/new", read)
    after = names(table)
    assert {f: t for f, t in after.items() if "y=1/" not in f} == {f: t for f, t in before.items() if "y=1/" not in f}
    assert not {f for f in after if "y=1/" in f} & {f for f in before if "y=1/" in f}
    assert spark.read.parquet(table).where("y = 1").count() == 33


def test_replace_after_a_broken_run(spark, monkeypatch):
    root = scratch_path(spark, "replace")
    table, notes, src = f"{root}/t", f"{root}/notes", f"{root}/csv"
    spark.range(50).select("id", F.lit(1).alias("y")).write.option("header", True).csv(src)
    read = lambda s, files: readers.read_csv(s, files, "id long, y int")
    replace.replace_partitions(spark.range(7).select("id", F.lit(2).alias("y")), table, "y", [2])
    other = names(table)

    def broken(s, files):
        return read(s, files).withColumn("id", F.when(F.col("id") == 49, F.raise_error(F.lit("broken"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="broken"):
        replace.convert_partition(spark, table, notes, "y", 1, src, broken)
    assert names(table) == other and replace.noted_inputs(spark, notes, table) == {}
    # Broken between the commit and the note: the next run writes the same rows.
    with monkeypatch.context() as m:
        m.setattr(replace, "NOTES", "broken")
        m.setattr(replace, "noted_inputs", lambda *a: {})
        m.setattr(F, "current_timestamp", lambda: (_ for _ in ()).throw(RuntimeError("gone")))
        with pytest.raises(RuntimeError):
            replace.convert_partition(spark, table, notes, "y", 1, src, read)
    assert spark.read.parquet(table).where("y = 1").count() == 50 and replace.noted_inputs(spark, notes, table) == {}
    assert replace.convert_partition(spark, table, notes, "y", 1, src, read)
    assert not replace.convert_partition(spark, table, notes, "y", 1, src, read)
    assert spark.read.parquet(table).count() == 57 and other.items() <= names(table).items()


def test_replace_refuses_other_partitions_and_empties(spark):
    root = scratch_path(spark, "replace")
    df = spark.range(10).select("id", (F.col("id") % 2).cast("int").alias("y"))
    replace.replace_partitions(df, root, "y", [0, 1])
    before = names(root)
    with pytest.raises(ValueError, match="not to be replaced"):
        replace.replace_partitions(df, root, "y", [0])
    with pytest.raises(ValueError, match="NULL"):
        replace.replace_partitions(df, root, "y", [None])
    assert names(root) == before
    replace.replace_partitions(df.where("false"), root, "y", [0])
    assert sorted(r.id for r in spark.read.parquet(root).collect()) == [1, 3, 5, 7, 9]


# ------------------------------------------------------------ stored summaries

def test_quantile_state_merges(spark):
    rng = random.Random(6)
    rows = [(k % 7, f"g{k % 3}", rng.lognormvariate(0, 2)) for k in range(30_000)] + [(9, "g9", None), (9, "g9", float("nan"))]
    df = spark.createDataFrame(rows, "m int, g string, x double").repartition(6)
    state = S.quantile_state(df, ["m", "g"], "x")
    probs = {"a": 0.01, "b": 0.5, "c": 0.999}
    for keys in ([], ["g"], ["m"]):
        est = S.merge_quantiles(state, keys, probs)
        for r in est.collect():
            mine = sorted(x for m, g, x in rows if x is not None and not math.isnan(x)
                          and all({"g": g, "m": m}[k] == r[k] for k in keys))
            assert r.n == len(mine)
            if not mine:
                assert r.a is None and r.b is None
                continue
            for name, p in probs.items():
                rank = sum(x <= r[name] for x in mine) / len(mine)
                assert abs(rank - p) <= S.rank_error() + 1 / len(mine)


def test_state_answers_without_the_facts(spark):
    """The second question is a plan over the state table alone."""
    path = scratch_path(spark, "state")
    S.distinct_state(fx.stp(spark, SF_SMALL), [F.year("week_ending").alias("y")], "synthetic_aeuid").write.parquet(path)
    out = S.merge_distinct(spark.read.parquet(path), [])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "sketch" in plan
    true = fx.stp(spark, SF_SMALL).select("synthetic_aeuid").distinct().count()
    assert abs(out.first()[0] - true) <= max(1, S.count_error() * true)


# ------------------------------------------------------------------ exact sums

def exactly(xs):
    """The double nearest to the true sum."""
    try:
        return float(sum(map(Fraction, xs)))
    except OverflowError:
        return math.inf


def bits(x):
    return None if x is None else "nan" if math.isnan(x) else x.hex()


def test_exact_sums_equal_fsum(spark):
    rng = random.Random(8)
    groups = {
        "money": [round(rng.uniform(-1e6, 1e6), 2) for _ in range(4000)],
        "wide": [rng.uniform(-1, 1) * 2.0 ** rng.randrange(-1000, 1000) for _ in range(600)],
        "cancel": [1e16, 1.0, -1e16, 1e-30, 2.0 ** 60, -(2.0 ** 60)], "tiny": [5e-324] * 9 + [-5e-324], "zero": [0.0, -0.0],
        "halves": [1.0, 2.0 ** -53], "tie": [1.0, 2.0 ** -53, 2.0 ** -110], "down": [-1.0, -(2.0 ** -53), -(2.0 ** -110)],
        "largest": [1.7976931348623157e308, 1e292], "back": [1.7976931348623157e308, 1.7976931348623157e308, -1.7976931348623157e308],
        "gone": [x for k in range(200) for x in (math.pi * 2.0 ** k, -math.pi * 2.0 ** k)], "powers": [2.0 ** k for k in range(-1074, 1023)],
    }
    special = {"nan": [1.0, float("nan")], "inf": [1.0, float("inf")], "ninf": [float("-inf"), 3.0],
               "both": [float("inf"), float("-inf")], "over": [1.7976931348623157e308] * 2, "none": [None, None], None: [1.5, None, 2.25]}
    rows = [(g, x) for d in (groups, special) for g, xs in d.items() for x in xs]
    rng.shuffle(rows)
    want = {g: bits(exactly(xs)) for g, xs in groups.items()}
    want |= {"nan": "nan", "inf": "inf", "ninf": "-inf", "both": "nan", "over": "inf",
             "none": None, None: bits(3.75), "zero": bits(0.0)}
    df = spark.createDataFrame(rows, "g string, x double")
    for n in (1, 8, 200):
        got = {r.g: bits(r.x) for r in exact_sums(df.repartition(n), ["g"], ["x"]).collect()}
        assert got == want, n


def test_exact_sums_shapes(spark):
    df = spark.createDataFrame([(1, 0.1, 2.0), (1, 0.2, None), (2, None, None)], "k int, a double, b double")
    got = sorted(map(tuple, exact_sums(df, ["k"], ["a", "b"], mean=["a"]).collect()))
    assert got == [(1, math.fsum([0.1, 0.2]), math.fsum([0.1, 0.2]) / 2, 2.0), (2, None, None, None)]
    assert tuple(exact_sums(df, [], ["a"]).first()) == (math.fsum([0.1, 0.2]),)
    assert tuple(exact_sums(df.where("false"), [], ["a"]).first()) == (None,)
    assert exact_sums(df.where("false"), ["k"], ["a"]).count() == 0
    clash = df.withColumnsRenamed({"a": "limb", "b": "which"})
    assert sorted(map(tuple, exact_sums(clash, ["k"], ["limb", "which"]).collect())) == [(1, math.fsum([0.1, 0.2]), 2.0), (2, None, None)]


# ------------------------------------------- lookups and pruning by stored files

def scanned_rows(df):
    """Rows that the executed plan's file scan gave."""
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            node = node.executedPlan()
        if "QueryStage" in node.nodeName():
            node = node.plan()
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().get("numOutputRows").get().value()
        kids = node.children()
        todo += [kids.apply(k) for k in range(kids.size())]
    return total


def test_bloom_filters_skip_row_groups(spark):
    # Ids of which a row group holds too many for a dictionary.
    df = spark.range(300_000).select("id", F.md5(F.col("id").cast("string")).alias("person"))
    plain, bloom = scratch_path(spark, "plain"), scratch_path(spark, "bloom")
    layout.write_clustered(df, plain, ["id"], num_partitions=1, row_group_rows=50_000)
    layout.write_clustered(df, bloom, ["id"], num_partitions=1, row_group_rows=50_000, bloom={"person": 50_000})
    person = df.where("id = 123456").first().person
    got = [readers.read_parquet(spark, p).where(F.col("person") == person) for p in (plain, bloom)]
    assert [r.id for r in got[0].collect()] == [r.id for r in got[1].collect()] == [123456]
    rows = [scanned_rows(df) for df in got]
    assert rows == [300_000, 50_000]


def test_years_prune_folders_while_running(spark):
    df = registry.QUERIES["join_pruned_years"](spark, SF_SMALL)
    assert "dynamicpruning" in df._jdf.queryExecution().executedPlan().toString().lower()
    chosen = {r.yr for r in df.collect()}
    by_year = fx.mbs(spark, SF_SMALL).groupBy(F.year("dos").alias("yr")).count().collect()
    read = scanned_rows(df) - 7
    assert abs(read - sum(r["count"] for r in by_year if r.yr in chosen)) <= 7 < sum(r["count"] for r in by_year) - read
