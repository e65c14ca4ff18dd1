"""Unit tests for library pieces not covered by registered queries:
stream state handling, measured chunk choice, catalog housekeeping,
filename routing, hash-key joins, key profiles."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paths import SF_SMALL
from panelkit.operators import joins as J
from panelkit.operators.quality import key_profile
from panelkit.operators.windows import auto_chunk, change_points
from panelkit.session import scratch_path, shared_root
from panelkit.sources import catalog, files, layout
from panelkit.streaming.switches import _detector

D = dt.date


class _State:
    def __init__(self):
        self.value = None

    @property
    def exists(self):
        return self.value is not None

    @property
    def get(self):
        return self.value

    def update(self, v):
        self.value = v


def _batch(rows):
    return pd.DataFrame(rows, columns=["p", "t", "tb", "v"])


def test_stream_detector_carries_state_and_drops_late_rows():
    fn = _detector("p", "t", "tb", "v", "prev", ["p", "t", "tb", "v", "prev", "late"])
    st = _State()
    out1 = pd.concat(fn("x", iter([_batch([("x", D(2021, 1, 3), 3, "B"),
                                           ("x", D(2021, 1, 1), 1, "A"),
                                           ("x", D(2021, 1, 2), 2, "A")])]), st))
    assert list(out1["t"]) == [D(2021, 1, 3)] and list(out1["prev"]) == ["A"]
    assert st.get == (D(2021, 1, 3), 3, "B")
    late_and_new = [_batch([("x", D(2021, 1, 2), 9, "C"),      # late: dropped
                            ("x", D(2021, 1, 4), 4, None),     # NULL: ignored
                            ("x", D(2021, 1, 5), 5, "A")])]
    out2 = pd.concat(list(fn("x", iter(late_and_new), st)))
    assert list(out2["late"]) == [True, False]
    assert list(out2["v"]) == ["C", "A"] and list(out2["prev"]) == [None, "B"]
    assert st.get == (D(2021, 1, 5), 5, "A")


def test_stream_detector_calls_python_per_bucket(spark, monkeypatch):
    """More people than buckets are a group per bucket and not per person, and
    switches and late rows stay those of the table form."""
    from panelkit.streaming import switches as S
    monkeypatch.setattr(S, "BUCKETS", 3)
    rows = [(None if p == 7 else f"p{p}", D(2021, 1, 1) + dt.timedelta(days=(p + 3 * k) % 20), 100 * p + k, "XYZ"[(p + k // 2) % 3] if k != 4 else None)
            for p in range(40) for k in range(9)]
    df = spark.createDataFrame(rows, "p string, t date, tb long, v string")
    root, found = scratch_path(spark, "buckets"), []
    for part in (df.where("t >= '2021-01-08' AND p != 'p3'"), df.where("t < '2021-01-08' OR p = 'p3' OR p IS NULL")):
        part.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{root}/in")
        q = (S.stream_change_points(stream, "p", "t", "tb", "v", "prev").writeStream.format("parquet")
             .option("path", f"{root}/out").option("checkpointLocation", f"{root}/chk").trigger(availableNow=True).start())
        q.awaitTermination()
        found.append(sum(o.numRowsTotal for o in q.lastProgress.stateOperators))
        S.run_change_points_tables(stream, "p", "t", "tb", "v", "prev", f"{root}/out2", f"{root}/state", f"{root}/chk2")
    assert found[-1] == 3                               # state rows: one a bucket
    known = F.col("p").isNotNull()                      # the table form joins by key, without null

    def got(path):
        return sorted((r.p, r.tb, str(r.prev), r.late) for r in spark.read.parquet(path).where(known).collect())
    assert got(f"{root}/out") == got(f"{root}/out2") and {r[3] for r in got(f"{root}/out")} == {True, False}
    alone = [r for r in rows if r[0] is None and r[3]]
    alone.sort(key=lambda r: (r[1], r[2]))
    assert spark.read.parquet(f"{root}/out").where(~known).count() == sum(a[3] != b[3] for a, b in zip(alone, alone[1:]))


def test_auto_chunk_only_for_hot_keys(spark):
    rows = [("hot", D(2020, 1, 1) + dt.timedelta(days=i), i, "AB"[(i // 3) % 2]) for i in range(40)]
    rows += [("cold", D(2020, 1, 1), 100, "A"), ("cold", D(2020, 2, 1), 101, "B")]
    df = spark.createDataFrame(rows, "p string, t date, tb long, v string")
    assert auto_chunk(df, "p", "t", max_rows=1000) is None
    ch = auto_chunk(df, "p", "t", max_rows=7)
    assert ch is not None
    plain = {(r["tb"], r["prev"]) for r in change_points(df, "p", ["t", "tb"], "v", "prev").collect()}
    split = {(r["tb"], r["prev"]) for r in
             change_points(df, "p", ["t", "tb"], "v", "prev", chunk=ch).collect()}
    assert plain == split and len(plain) > 5


def test_catalog_housekeeping(spark):
    df = spark.range(10).withColumn("k", F.col("id") % 3)
    name = "pk_unit_table"
    catalog.drop_table(spark, name)
    t = catalog.materialise(df, name, scratch_path(spark, name))
    assert t.count() == 10 and name in catalog.table_names(spark)
    catalog.drop_table(spark, name)
    assert name not in catalog.table_names(spark)
    v = catalog.register_view(spark, "pk_unit_view", _write(spark, df), where=F.col("k") == 1)
    assert v.count() == 3


def _write(spark, df):
    path = scratch_path(spark, "unit")
    layout.write_parquet(df, path)
    return path


def test_existing_sources_and_routing(spark):
    root = scratch_path(spark, "routing")
    spark.range(6).withColumn("shard", F.concat(F.lit("ctx-"), F.lit(2001) + F.col("id") % 2)) \
        .write.option("header", True).partitionBy("shard").csv(root)
    present = catalog.existing_sources(spark, {"ctx": f"{root}/shard=ctx*/*.csv",
                                               "other": f"{root}/shard=zzz*/*.csv"})
    assert list(present) == ["ctx"]
    schema = T.StructType([T.StructField("id", T.LongType())])
    routed = files.route_csv(spark, root, {"ctx": ("CTX", schema), "none": ("zzz", schema)},
                             tag_pattern=r"-(\d{4})/")
    tags = {r["file_tag"]: r["n"] for r in routed["ctx"].groupBy("file_tag")
            .agg(F.count(F.lit(1)).alias("n")).collect()}
    assert tags == {"2001": 3, "2002": 3}


def test_hash_key_join_equals_plain_join(spark):
    a = spark.createDataFrame([(f"id{i % 17}", i) for i in range(60)], "k string, a long")
    b = spark.createDataFrame([(f"id{i}", i * 10) for i in range(12)] + [(None, 0)],
                              "k string, b long")
    got = sorted(tuple(r) for r in J.hash_key_join(a, b, "k").select("k", "a", "b").collect())
    ref = sorted(tuple(r) for r in a.join(b, "k").select("k", "a", "b").collect())
    assert got == ref


def test_key_profile_counts(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "k int")
    r = key_profile(df, ["k"]).first()
    assert (r["rows"], r["null_keys"], r["distinct_keys"], r["duplicated_keys"]) == (5, 2, 2, 1)


def test_shared_root_is_the_session_checkpoint_dir(spark):
    root = shared_root(spark)
    assert root and scratch_path(spark, "x").startswith(root)


def test_stream_implementations_agree_on_out_of_order_drops(spark):
    from panelkit.streaming.switches import run_change_points_tables, stream_change_points
    rows = [("a", D(2021, 1, d), d, v) for d, v in [(1, "X"), (2, "X"), (3, "Y"), (8, "Z"), (9, "Z")]]
    rows += [("b", D(2021, 1, d), 10 + d, v) for d, v in [(2, "P"), (6, "Q")]]
    df = spark.createDataFrame(rows, "p string, t date, tb long, v string")
    late_first = [df.where(F.col("t") >= D(2021, 1, 5)), df.where(F.col("t") < D(2021, 1, 5))]
    results = []
    for impl in ("state", "tables"):
        root = scratch_path(spark, f"ooo-{impl}")
        for part in late_first:
            part.write.mode("append").parquet(f"{root}/in")
            stream = spark.readStream.schema(df.schema).parquet(f"{root}/in")
            if impl == "state":
                q = (stream_change_points(stream, "p", "t", "tb", "v", "prev").writeStream
                     .format("parquet").option("path", f"{root}/out")
                     .option("checkpointLocation", f"{root}/chk").trigger(availableNow=True).start())
                q.awaitTermination()
            else:
                run_change_points_tables(stream, "p", "t", "tb", "v", "prev", f"{root}/out",
                                         f"{root}/state", f"{root}/chk")
        out = spark.read.parquet(f"{root}/out")
        results.append(sorted((r["p"], r["tb"], r["prev"], r["late"]) for r in out.collect()))
    # drop 1 (days >= 5): a: Z after nothing -> no switch, b: Q alone -> none;
    # drop 2 (days < 5): a's and b's rows are all late (before the stored day)
    assert results[0] == results[1]
    assert [r for r in results[0] if r[3]] == [("a", 1, None, True), ("a", 2, None, True),
                                                ("a", 3, None, True), ("b", 12, None, True)]
    assert [r for r in results[0] if not r[3]] == []


def test_auto_chunk_option_on_every_ordered_operator(spark, monkeypatch):
    from panelkit.operators import windows as W
    from panelkit.operators.asof import asof_last_before
    rows = [("hot", D(2020, 1, 1) + dt.timedelta(days=i // 2), i, "ABC"[(i // 4) % 3], float(i % 7))
            for i in range(60)]
    rows += [("cold", D(2020, 3, 1), 100, "A", 1.0), ("cold", D(2020, 3, 9), 101, "B", 2.0)]
    df = spark.createDataFrame(rows, "p string, t date, tb long, v string, x double")
    order = ["t", "tb"]

    def runs():
        return [
            sorted(tuple(r) for r in W.lag_value(df, "p", order, "v", "o", chunk=c)
                   .select("tb", "o").collect()),
            sorted(tuple(r) for r in W.lead_value(df, "p", order, "v", "o", chunk=c)
                   .select("tb", "o").collect()),
            sorted(tuple(r) for r in W.row_index(df, "p", order, "i", chunk=c)
                   .select("tb", "i").collect()),
            sorted(tuple(r) for r in W.rank_values(df, "p", ["t"], "r", "d", chunk=c)
                   .select("tb", "r", "d").collect()),
            sorted(tuple(r) for r in W.framed(df, "p", order, -3, -1, {"m": F.avg("x")}, chunk=c)
                   .select("tb", "m").collect()),
        ]

    c = None
    plain = runs()
    monkeypatch.setattr(W, "MAX_ROWS_PER_KEY_TASK", 8)
    assert W._resolve(df, ["p"], order, "auto") is not None
    c = "auto"
    assert runs() == plain
    left = df.select(F.col("tb").alias("lid"), "p", F.col("t").cast("timestamp_ntz").alias("lt"))
    right = df.select(F.col("tb").alias("rid"), "p",
                      (F.col("t").cast("timestamp_ntz") - F.expr("INTERVAL 1 HOUR")).alias("rt"))
    a = asof_last_before(left, right, "p", "lt", "rt", "lid", "rid", ["rid"], chunk_days="auto")
    b = asof_last_before(left, right, "p", "lt", "rt", "lid", "rid", ["rid"])
    assert sorted(tuple(r) for r in a.select("lid", "rid").collect()) == \
        sorted(tuple(r) for r in b.select("lid", "rid").collect())


def test_readers_fill_by_name_and_inference(spark):
    from panelkit.sources import readers
    a = spark.createDataFrame([(1, "x")], "id long, a string")
    b = spark.createDataFrame([(2, 3.5)], "id long, b double")
    st = readers.stack_by_name([a, b])
    assert sorted(st.columns) == ["a", "b", "id"]
    assert sorted((r["id"], r["a"], r["b"]) for r in st.collect()) == [(1, "x", None), (2, None, 3.5)]
    path = scratch_path(spark, "infer")
    spark.createDataFrame([(10, "2020-01-02", 1.5)], "k int, d string, v double") \
        .write.option("header", True).csv(path)
    inferred = readers.infer_csv(spark, f"{path}/*.csv")
    types = dict(inferred.dtypes)
    assert types["k"] == "int" and types["v"] == "double"
    bad = scratch_path(spark, "corrupt")
    spark.createDataFrame([("1",), ("oops",)], "k string").write.option("header", True).csv(bad)
    kept = readers.read_csv(spark, f"{bad}/*.csv", "k int", keep_corrupt=True).collect()
    assert {(r["k"], r[readers.CORRUPT]) for r in kept} == {(None, "oops"), (1, None)}


def test_profile_files_top_datasets(spark):
    from panelkit.sources.files import profile_files
    root = scratch_path(spark, "profile")
    spark.range(1000).write.parquet(f"{root}/big")
    spark.range(10).coalesce(1).write.parquet(f"{root}/small")
    top = profile_files(spark, root, "*.parquet", top=1).collect()
    assert [r["dataset"] for r in top] == ["big"]
    every = {r["dataset"]: r["n_files"] for r in profile_files(spark, root, "*.parquet", top=None).collect()}
    assert set(every) == {"big", "small"} and every["small"] == 1


def test_profile_files_equals_file_sizes(spark):
    """Counts and bytes per dataset against the file system's own."""
    import os
    from panelkit.plans import registry
    want = {}
    for name in os.listdir(SF_SMALL):
        path = os.path.join(SF_SMALL, name)
        files = [path] if os.path.isfile(path) else [os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs]
        files = [f for f in files if f.endswith(".parquet")]
        if files:
            want[name] = (len(files), sum(map(os.path.getsize, files)))
    rows = registry.QUERIES["profile_sources"](spark, SF_SMALL).collect()
    assert {r.dataset: (r.n_files, r.total_bytes) for r in rows} == want
    assert [r.total_bytes for r in rows] == sorted((b for _, b in want.values()), reverse=True)


def test_plain_csv_equals_the_parser(spark):
    import pytest
    from panelkit import fixtures as fx
    from panelkit.plans.storage import ITR_SCHEMA, MBS_SCHEMA, ITR_INC_SCHEMA
    from panelkit.sources import readers
    for view, schema in (("mbs", MBS_SCHEMA), ("itr", ITR_SCHEMA), ("itr_inc", ITR_INC_SCHEMA)):
        path = scratch_path(spark, "plain-csv")
        fx.view(spark, SF_SMALL, view).repartition(3).write.option("header", True).csv(path)
        a, b = (f(spark, f"{path}/*.csv", schema) for f in (readers.read_csv, readers.read_plain_csv))
        assert a.schema == b.schema
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0 and b.count() == fx.view(spark, SF_SMALL, view).count()
    for text, fails in (("k,v\n1,x\n,\n2,\n", False), ('k,v\n1,"x"\n', True), ("k,v\n1,x,y\n", True), ("k,v\n1\n", True),
                        ("k,v\noops,x\n", True), ("v,k\n1,x\n", True)):
        path = scratch_path(spark, "plain-csv")
        spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.text(path)
        df = readers.read_plain_csv(spark, path, "k int, v string")
        if fails:
            with pytest.raises(Exception):
                df.collect()
        else:
            assert [tuple(r) for r in df.collect()] == [(1, "x"), (None, None), (2, None)]


def test_csv_fails_on_malformed_rows_unless_kept(spark):
    import pytest
    from panelkit.sources import readers
    bad = scratch_path(spark, "malformed")
    spark.createDataFrame([("1",), ("oops",)], "k string").write.option("header", True).csv(bad)
    with pytest.raises(Exception, match="oops|MALFORMED"):
        readers.read_csv(spark, f"{bad}/*.csv", "k int").collect()


def test_rollup_is_complete_for_any_file_count(spark):
    """1, 8 or 40 landing files give the same days; late rows are counted."""
    from panelkit.streaming.rollup import read_rollup, run_rollup
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_id", "ts", "user_id", "value")
    total, results, late = ev.count(), [], []
    for files in (1, 8, 40):
        root = scratch_path(spark, "rollup-files")
        ev.repartition(files, "event_id").write.parquet(f"{root}/in")
        stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 4).parquet(f"{root}/in")
        run_rollup(stream, f"{root}/out", f"{root}/chk", "user_id", "ts", "value")
        rows = read_rollup(spark, f"{root}/out", "user_id").collect()
        assert sum(r.n for r in rows) == total
        results.append(sorted((r.user_id, r.day, r.n, round(r.total, 2)) for r in rows))
        late.append(sum(r.n_late for r in rows))
    assert results[0] == results[1] == results[2]
    assert late[0] == 0 and late[2] > 0


def test_rollup_tasks_grow_with_the_rows(spark, monkeypatch):
    """The number of tasks follows the rows of a batch and of what is stored,
    not only the session's setting, which stays as it is."""
    import glob
    from panelkit.streaming import rollup
    monkeypatch.setattr(rollup, "TASK_ROWS", 100)
    df = spark.range(4000).selectExpr("id AS k", "timestamp'2024-01-01' + make_interval(0, 0, 0, id % 9) AS ts", "1.5D AS v")
    root, usual = scratch_path(spark, "rollup-tasks"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for part in (df.where("k < 3000"), df.where("k >= 3000")):
            part.write.mode("append").parquet(f"{root}/in")
            rollup.run_rollup(spark.readStream.schema(df.schema).parquet(f"{root}/in"), f"{root}/out", f"{root}/chk", "k", "ts", "v")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(glob.glob(f"{root.removeprefix('file:')}/out/part/batch_id=0/*.parquet")) == 30
    assert spark.conf.get("spark.sql.shuffle.partitions") == usual and int(usual) < 30
    days = rollup.read_rollup(spark, f"{root}/out", "k")
    plan = rollup.monthly_from_daily(days, "k", ["total"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and ", 40), REPARTITION_BY_NUM" in plan
    assert days.count() == 4000 and days.agg(F.sum("total")).first()[0] == 6000


def test_lost_state_version_raises(spark):
    import pytest
    from panelkit.streaming import switches as S
    root = scratch_path(spark, "lost-state")
    src = spark.createDataFrame([(1, 1, 1, "A"), (1, 2, 2, "B")], "p int, d int, tb long, v string") \
        .selectExpr("p", "date_add(DATE'2020-01-01', d) AS t", "tb", "v")

    def drop(where):
        src.where(where).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(src.schema).parquet(f"{root}/in")
        S.run_change_points_tables(stream, "p", "t", "tb", "v", "prev", f"{root}/out", f"{root}/state", f"{root}/chk")
    drop("tb = 1")
    S._forget(spark, f"{root}/state/batch_id=0")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|batch_id=0"):
        drop("tb = 2")


def test_ordered_queries_come_back_in_order(spark):
    """The rows' own order, not the sorted comparison, for the ordered verbs."""
    from panelkit.operators.sort import arrange, arrange_levels, top_k
    df = spark.createDataFrame([(2, "b"), (None, "a"), (1, "c"), (1, "b"), (3, None)], "x int, g string") \
        .repartition(4)
    last = 10**9

    def k(v):
        return last if v is None else v
    got = [r.x for r in arrange(df, "x", "g").collect()]
    assert got == sorted(got, key=k) and got[-1] is None
    desc = [r.x for r in arrange(df, "x", desc=["x"]).collect()]
    assert desc == [3, 2, 1, 1, None]
    lv = [r.g for r in arrange_levels(df, "g", ["c", "b"]).collect()]
    assert lv[:3] == ["c", "b", "b"] and set(lv[3:]) == {"a", None}
    assert [r.x for r in top_k(df, 2, ["x"], tiebreak=["g"]).collect()] == [3, 2]
    from panelkit.plans import registry
    registry.load_all()
    t3 = [(r.age_decade, r.core_gender) for r in registry.QUERIES["t3_three_way"](spark, SF_SMALL).collect()]
    assert t3 == sorted(t3)


def test_hot_key_is_split_over_files_and_folders_are_bounded(spark):
    import os
    path = scratch_path(spark, "hot-clustered")
    hot = spark.range(20000, numPartitions=12).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS k", "id AS v")
    layout.write_clustered(hot, path, ["k"], num_partitions=8)
    per = spark.read.parquet(path).where("k = -1").groupBy(F.input_file_name()).count().count()
    assert per >= 2
    parts = scratch_path(spark, "folders")
    layout.write_parquet(hot.withColumn("yr", F.col("v") % 3), parts, partition_by=["yr"], folder_files=4)
    for y in range(3):
        assert len([f for f in os.listdir(f"{parts}/yr={y}") if f.endswith(".parquet")]) <= 4


def test_cluster_sessions_need_a_shared_folder():
    from unittest import mock

    import pytest
    from panelkit import session
    fake = mock.MagicMock()
    fake.conf.get.return_value = None
    fake.sparkContext.getConf.return_value.get.return_value = None
    fake.sparkContext.applicationId = "none-such"
    for master in ("local-cluster[3,2,1024]", "spark://host:7077", "yarn"):
        fake.sparkContext.master = master
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.shared_root(fake)
    session.configure(fake)        # needs no folder
