"""Clustering that survives appends, key checks by batch, late stream rows."""

import datetime as dt
import glob
import os
import random
import re

import pytest
from paths import SF_SMALL
from pyspark.sql import functions as F

from panelkit import fixtures as fx
from panelkit.operators import keycheck
from panelkit.operators.windows import change_points
from panelkit.session import scratch_path
from panelkit.sources import clustered, layout
from panelkit.streaming.late import OrderedChangePoints


# ------------------------------------------------------------------ clustering

def test_to_merge_leaves_the_depth():
    rng = random.Random(5)
    for _ in range(300):
        files = []
        for k in range(rng.randrange(1, 30)):
            lo = rng.randrange(100)
            files.append((f"f{k}", lo, lo + rng.randrange(40), 10, rng.randrange(1, 50)))
        files.append(("empty", None, None, 5, 5))
        for depth in (1, 2, 3):
            groups = clustered.to_merge(files, depth)
            gone = {f for g in groups for f in g}
            by = {f[0]: f for f in files}
            left = [f for f in files if f[0] not in gone]
            for g in groups:                       # a group becomes one run over its reach
                left.append((g[0], min(by[f][1] for f in g), max(by[f][2] for f in g), 0, 0))
            assert clustered.max_depth(left) <= depth
            assert bool(groups) == (clustered.max_depth(files) > depth)
            assert "empty" not in gone


def test_ten_appends(spark):
    path = scratch_path(spark, "clustered")
    rng = random.Random(1)
    rows = [(rng.choice(["", "é", "z"]) + str(rng.randrange(300)), k) for k in range(4000)] + [(None, -1), (None, -2)]
    df = spark.createDataFrame(rows, "k string, v long")
    for b in range(10):
        clustered.append_clustered(df.where(F.pmod("v", F.lit(10)) == b), path, "k", file_rows=400, row_group_rows=50)
    clustered.append_clustered(df.where("false"), path, "k")
    out = clustered.read_clustered(spark, path)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(rows, key=str)
    live = clustered.live_files(spark, path)
    assert len(live) > 5 and clustered.max_depth(live) <= 2 and sum(f[3] for f in live) == len(rows)
    for k in ["12", "é7", "z299", "nobody"]:
        found, files = clustered.lookup(spark, path, "k", k)
        assert sorted(r.v for r in found.collect()) == sorted(v for x, v in rows if x == k)
        assert files <= 2 and len(found.inputFiles()) <= 2
    # Earlier listings can be read until they are cleaned up.
    assert clustered.read_clustered(spark, path, 1).count() == sum(v % 10 == 0 for _, v in rows)
    before = len(clustered.list_files(spark, f"{path}/data"))
    assert clustered.vacuum(spark, path) == before - len(live)
    assert clustered.read_clustered(spark, path).count() == len(rows)


def test_only_overlapping_files_are_rewritten(spark):
    path = scratch_path(spark, "clustered")
    base = spark.range(10_000).select(F.col("id").alias("k"))
    clustered.append_clustered(base, path, "k", file_rows=1000)
    first = {f[0] for f in clustered.live_files(spark, path)}
    for _ in range(4):
        clustered.append_clustered(base.where("k BETWEEN 2100 AND 2300"), path, "k", file_rows=1000)
    live = clustered.live_files(spark, path)
    # The ten files of the base are larger than the pile of small ones.
    assert first <= {f[0] for f in live} and clustered.max_depth(live) == 2
    assert clustered.read_clustered(spark, path).count() == 10_000 + 4 * 201


def test_hot_key_is_spread(spark):
    path = scratch_path(spark, "clustered")
    df = spark.range(3000).select(F.when(F.col("id") < 1500, 7).otherwise(F.col("id")).alias("k"), "id")
    for _ in range(3):
        clustered.append_clustered(df, path, "k", file_rows=200)
    live = clustered.live_files(spark, path)
    assert max(f[3] for f in live) <= 600 and sum(f[3] for f in live) == 9000
    assert clustered.lookup(spark, path, "k", 7)[0].count() == 4500
    assert clustered.lookup(spark, path, "k", 2500)[1] <= 2


def test_broken_append_leaves_the_table(spark, monkeypatch):
    path = scratch_path(spark, "clustered")
    df = spark.range(100).select(F.col("id").alias("k"))
    clustered.append_clustered(df, path, "k")
    with monkeypatch.context() as m:
        m.setattr(clustered, "_note", lambda *a: (_ for _ in ()).throw(RuntimeError("gone")))
        with pytest.raises(RuntimeError):
            clustered.append_clustered(df, path, "k")
    assert clustered.read_clustered(spark, path).count() == 100
    clustered.append_clustered(df, path, "k")
    assert clustered.read_clustered(spark, path).count() == 200 and clustered.vacuum(spark, path) >= 1
    with pytest.raises(FileNotFoundError):
        clustered.read_clustered(spark, f"{path}/nothing")
    with pytest.raises(TypeError):
        clustered.append_clustered(df.select(F.array("k").alias("k")), path, "k")


def test_ranges_come_from_footers(spark):
    path = scratch_path(spark, "ranges")
    layout.write_parquet(fx.stp(spark, SF_SMALL), path, row_group_rows=100)
    got = clustered.file_ranges(spark, clustered.list_files(spark, path), "synthetic_aeuid")
    for file, lo, hi, rows, size in got:
        want = spark.read.parquet(file).agg(F.min("synthetic_aeuid"), F.max("synthetic_aeuid"), F.count("*")).first()
        assert (lo, hi, rows) == tuple(want) and size == os.path.getsize(file.removeprefix("file:"))


# ------------------------------------------------------------------ key checks

def test_batches_against_sets(spark):
    rng = random.Random(2)
    store = keycheck.KeyStore(spark, scratch_path(spark, "keys"), "k", 3000)
    seen: set = set()
    for batch in range(3):
        keys = [f"k{rng.randrange(6000)}" for _ in range(900)] + [None] * (batch % 2)
        df = spark.createDataFrame([(k, 1) for k in keys], "k string, n int").repartition(3)
        got = {tuple(r) for r in store.check(df, batch).collect()}
        want = {(k, "twice") for k in set(keys) if k and keys.count(k) > 1}
        want |= {(k, "stored") for k in set(keys) if k in seen} | ({(None, "missing")} if None in keys else set())
        assert got == want
        store.admit(df, batch)
        store.admit(df, batch)                       # again after a broken run
        seen |= {k for k in keys if k}
    stored = spark.read.parquet(f"{store.root}/keys")
    assert {r.k for r in stored.select("k").collect()} == seen


def test_filter_leaves_few_candidates_and_no_gap(spark):
    keys = spark.range(20_000).select(F.col("id").alias("k"))
    bits = keycheck.filter_bits(20_000)
    state = keycheck.membership(keys, "k", bits)
    assert state.agg(F.sum(F.bitmap_count("bits"))).first()[0] <= 20_000 * keycheck.PROBES
    inside = keycheck.candidates(keys.where("k % 7 = 0"), "k", state, bits).count()
    assert inside == len(range(0, 20_000, 7))
    absent = spark.range(20_000, 60_000).select(F.col("id").alias("k"))
    assert keycheck.candidates(absent, "k", state, bits).count() < 40_000 / 100


def test_only_hit_folders_are_read(spark):
    store = keycheck.KeyStore(spark, scratch_path(spark, "keys"), "k", 1000)
    store.admit(spark.range(1000).select(F.col("id").alias("k")), 0)
    found = store.check(spark.createDataFrame([(5,), (999_999_999,)], "k long"), 1)
    assert [tuple(r) for r in found.collect()] == [(5, "stored")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    asked = re.search(r"range#\d+ (?:IN \(([\d,]+)\)|= (\d+))", plan.split("/keys]")[1])
    assert len((asked[1] or asked[2]).split(",")) <= 2


# ------------------------------------------------------------ late stream rows

ROWS = "person string, day date, rec long, v string"


def feed(spark, drops, lateness, chunk=None):
    root = scratch_path(spark, "late")
    schema = spark.createDataFrame([], ROWS).schema
    job = OrderedChangePoints(spark, schema, "person", "day", "rec", "v", "prev", lateness, f"{root}/out",
                              f"{root}/state", chunk=chunk)
    for drop in drops:
        spark.createDataFrame(drop, ROWS).coalesce(1).write.mode("append").parquet(f"{root}/in")
        job.run(spark.readStream.schema(schema).parquet(f"{root}/in"), f"{root}/chk")
    job.finish(job.last_batch())
    return job, spark.read.parquet(f"{root}/out")


def test_late_rows_find_their_place(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abcd"), dt.date(2000, 1, 1) + dt.timedelta(days=rng.randrange(200)), k,
             rng.choice(["x", "y", "z", None])) for k in range(400)]
    drops: list = [[] for _ in range(4)]
    for r in rows:
        day = (r[1] - dt.date(2000, 1, 1)).days + rng.randrange(31)
        drops[min(3, day // 57)].append(r)
    df = spark.createDataFrame(rows, ROWS).where("v IS NOT NULL")
    want = {tuple(r) for r in change_points(df, "person", ["day", "rec"], "v", "prev").collect()}
    _, out = feed(spark, drops, 31, "auto")
    assert out.where("late").count() == 0
    got = [tuple(r)[:5] for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_later_than_allowed_is_flagged(spark):
    d = lambda k: dt.date(2000, 1, 1) + dt.timedelta(days=k)
    drops = [[("a", d(10), 1, "x"), ("a", d(20), 2, "y"), (None, d(1), 9, "n")],
             [("a", d(40), 3, "z")],                                 # closes day 35
             [("a", d(15), 4, "w"), ("a", d(36), 5, "y"), ("a", None, 6, "q")], []]
    job, out = feed(spark, drops, 5)
    rows = {r.rec: r for r in out.collect()}
    assert rows[4].late and rows[4].prev is None
    assert (rows[2].prev, rows[3].prev, rows[3].late) == ("x", "y", False) and set(rows) == {2, 3, 4}
    # Finishing again ends the same.
    before = sorted(map(tuple, out.collect()))
    job.finish(job.last_batch() - 1)
    assert sorted(map(tuple, spark.read.parquet(job.out).collect())) == before


def test_replayed_batch_ends_the_same(spark):
    d = lambda k: dt.date(2000, 1, 1) + dt.timedelta(days=k)
    job, _ = feed(spark, [[("a", d(k), k, "xy"[k % 2]) for k in range(30)]], 3)
    again = spark.createDataFrame([("a", d(k), k, "xy"[k % 2]) for k in range(30)], ROWS)
    before = sorted(map(tuple, spark.read.parquet(job.out).collect()))
    job.process(again, 0)
    job.finish(0)
    assert sorted(map(tuple, spark.read.parquet(job.out).collect())) == before and len(before) == 29
    assert glob.glob(f"{job.state.removeprefix('file:')}/last/batch_id=1")
