"""Storage and catalog queries: CSV ingest, parquet layout variants,
views, tables, appends, routing, logs and directory profiles.

Each query writes what it needs under a fresh folder of the shared
checkpoint directory (never a machine-local temp folder) and then reads it
back, so the answer is computed from the written files.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit import fixtures as fx
from panelkit.functions.expr import hash_bucket
from panelkit.operators.aggregates import group_count
from panelkit.operators.windows import last_per_key
from panelkit.plans.panel import _STP_SQL, employer_switches, stp_filtered, wk_panel, _PANEL_SQL
from panelkit.plans.registry import query
from panelkit.session import scratch_path
from panelkit.sources import catalog, files, layout, readers

ITR_SCHEMA = T.StructType([
    T.StructField("rec_id", T.LongType()),
    T.StructField("synthetic_aeuid", T.StringType()),
    T.StructField("incm_yr", T.IntegerType()),
    T.StructField("ocptn_grp_cd", T.IntegerType()),
])
ITR_INC_SCHEMA = T.StructType([
    T.StructField("rec_id", T.LongType()),
    T.StructField("synthetic_aeuid", T.StringType()),
    T.StructField("incm_yr", T.IntegerType()),
    T.StructField("ti_or_lss_amt", T.DoubleType()),
])
MBS_SCHEMA = T.StructType([
    T.StructField("synthetic_aeuid", T.StringType()),
    T.StructField("dos", T.DateType()),
    T.StructField("numserv", T.DoubleType()),
    T.StructField("feecharged", T.DoubleType()),
    T.StructField("btos", T.StringType()),
])


def _write_csv(df, path):
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


@query("csv_roundtrip", views=("itr",), sql="SELECT * FROM itr")
def csv_roundtrip(spark, sf):
    """CSV written from the tax-return view and read back with a declared
    schema (ids stay typed, NULLs survive)."""
    path = _write_csv(fx.itr(spark, sf), scratch_path(spark, "itr-csv"))
    return readers.read_csv(spark, f"{path}/*.csv", ITR_SCHEMA)


@query("ingest_csv_parquet", views=("mbs",), headline=True, sql="SELECT * FROM mbs")
def ingest_csv_parquet(spark, sf):
    """CSV shards without quoting -> zstd parquet with 250k-row row groups and
    5M-row files, read back."""
    src = _write_csv(fx.mbs(spark, sf), scratch_path(spark, "mbs-csv"))
    dst = scratch_path(spark, "mbs-parquet")
    layout.write_parquet(readers.read_plain_csv(spark, f"{src}/*.csv", MBS_SCHEMA), dst)
    return readers.read_parquet(spark, dst)


@query("scan_parquet", views=(), sql="""
SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY 1""")
def scan_parquet(spark, sf):
    """Parquet scan by glob with column pruning (two of eleven columns)."""
    li = readers.read_parquet(spark, f"{sf.rstrip('/')}/line*.parquet")
    return li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"),
                                          F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("scan_merge_schema", views=("itr",), sql="""
SELECT rec_id, synthetic_aeuid, incm_yr,
       CASE WHEN incm_yr % 2 = 0 THEN NULL ELSE ocptn_grp_cd END AS ocptn_grp_cd FROM itr""")
def scan_merge_schema(spark, sf):
    """Files whose schemas drifted (the even years lack the occupation
    column) read as one table; the missing column is NULL."""
    root = scratch_path(spark, "itr-drift")
    itr = fx.itr(spark, sf)
    odd = (F.col("incm_yr") % 2) != 0
    itr.where(odd).write.parquet(f"{root}/part=a")
    itr.where(~odd).drop("ocptn_grp_cd").write.parquet(f"{root}/part=b")
    return readers.read_parquet(spark, root, merge_schema=True).drop("part")


@query("layout_year_partition", views=("itr",), headline=True, sql="""
SELECT CAST(floor(ocptn_grp_cd / 1000.0) AS INTEGER) AS occ_major, count(*) AS n
FROM itr WHERE incm_yr = 1998 GROUP BY 1""")
def layout_year_partition(spark, sf):
    """Hive-partitioned by income year; a year filter reads one folder
    (partition pruning, visible as PartitionFilters in the plan)."""
    path = scratch_path(spark, "itr-by-year")
    layout.write_parquet(fx.itr(spark, sf), path, partition_by=["incm_yr"])
    t = readers.read_parquet(spark, path).where(F.col("incm_yr") == 1998)
    return group_count(t.select(F.floor(F.col("ocptn_grp_cd") / 1000).cast("int")
                                .alias("occ_major")), "occ_major")


@query("layout_sorted_point", views=("mbs",), headline=True, sql="""
SELECT count(*) AS n, round(sum(numserv), 2) AS services FROM mbs WHERE synthetic_aeuid = 'D100'""")
def layout_sorted_point(spark, sf):
    """Claims clustered by person id (range partition + sort); a one-person
    lookup then skips all but one file / row group by min/max statistics."""
    path = scratch_path(spark, "mbs-sorted")
    layout.write_clustered(fx.mbs(spark, sf), path, ["synthetic_aeuid"],
                           row_group_rows=10_000)
    t = readers.read_parquet(spark, path)
    return t.where(F.col("synthetic_aeuid") == "D100").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("numserv"), 2).alias("services"))


@query("catalog_view", views=("demo", "dhda_spine", "mbs"), sql="""
SELECT d.core_gender, count(*) AS claims, round(sum(m.numserv), 2) AS services
FROM demo d JOIN dhda_spine s ON d.spine_id = s.spine_id
JOIN mbs m ON s.synthetic_aeuid = m.synthetic_aeuid GROUP BY 1""")
def catalog_view(spark, sf):
    """Views over the parquet files, queried by name with SQL."""
    root = sf.rstrip("/")
    for name in ("customer", "orders", "lineitem"):
        catalog.register_view(spark, f"pk_{name}", f"{root}/{name}.parquet")
    # the panel views, as SQL views over the registered parquet views
    for name in ("demo", "dhda_spine", "mbs"):
        body = re.sub(r"\b(customer|orders|lineitem)\b", r"pk_\1", fx.VIEW_SQL[name])
        spark.sql(f"CREATE OR REPLACE TEMP VIEW pk_{name} AS "
                  + body.replace("AS VARCHAR", "AS STRING"))
    # claims are summed per person before the join (see star_rollup)
    return spark.sql("""
        SELECT d.core_gender, CAST(sum(m.c) AS BIGINT) AS claims, round(sum(m.s), 2) AS services
        FROM pk_demo d JOIN pk_dhda_spine s ON d.spine_id = s.spine_id
        JOIN (SELECT synthetic_aeuid, count(*) AS c, sum(numserv) AS s
              FROM pk_mbs GROUP BY synthetic_aeuid) m ON s.synthetic_aeuid = m.synthetic_aeuid
        GROUP BY d.core_gender""")


@query("catalog_view_filtered", views=("stp",), sql="""
SELECT CAST(year(week_ending) AS INTEGER) AS yr, count(*) AS n FROM stp
WHERE abn_hash_trunc IS NOT NULL GROUP BY 1""")
def catalog_view_filtered(spark, sf):
    """A view whose definition carries a row filter and a derived bucket
    column; queries on it see only the filtered rows."""
    stp = fx.stp(spark, sf)
    path = scratch_path(spark, "stp")
    layout.write_parquet(stp, path)
    v = catalog.register_view(spark, "pk_stp", path, where=F.col("abn_hash_trunc").isNotNull(),
                              extra={"bucket": hash_bucket("synthetic_aeuid", 10)})
    return group_count(v.select(F.year("week_ending").cast("int").alias("yr")), "yr")


@query("catalog_table", views=("demo",), sql="""
SELECT core_gender, count(*) AS n FROM demo GROUP BY 1""")
def catalog_table(spark, sf):
    """``CREATE OR REPLACE TABLE`` then query the table by name."""
    name = "pk_demo_table"
    catalog.drop_table(spark, name)
    t = catalog.materialise(fx.demo(spark, sf), name, scratch_path(spark, name))
    return group_count(t, "core_gender")


@query("append_sorted_batches", views=("stp",), sql="SELECT * FROM stp")
def append_sorted_batches(spark, sf):
    """Create from the first batch, then append later batches, each sorted
    by (person, date) within its files."""
    path = scratch_path(spark, "stp-batches")
    stp = fx.stp(spark, sf)
    cut = F.lit("1998-01-01").cast("date")
    for batch, part in enumerate((stp.where(F.col("week_ending") < cut), stp.where(F.col("week_ending") >= cut))):
        layout.append_sorted(part, path, ["synthetic_aeuid", "week_ending"], batch)
    return readers.read_parquet(spark, path).drop("batch")


# The text that marks each target's files.
ROUTES = {"itr_context": ("context", ITR_SCHEMA), "itr_ded": ("ded-exp-off", ITR_INC_SCHEMA),
          "itr_inc": ("inc-loss", ITR_INC_SCHEMA), "itr_whld": ("whld-debt", ITR_INC_SCHEMA)}


@query("route_by_filename", views=("itr", "itr_inc"), sql="""
SELECT 'itr_context' AS target, CAST(incm_yr AS VARCHAR) AS file_tag, count(*) AS n FROM itr GROUP BY 1, 2
UNION ALL SELECT 'itr_inc', CAST(incm_yr AS VARCHAR), count(*) FROM itr_inc GROUP BY 1, 2
UNION ALL SELECT 'itr_ded', CAST(incm_yr AS VARCHAR), count(*) FROM itr_inc WHERE ti_or_lss_amt < 0 GROUP BY 1, 2
UNION ALL SELECT 'itr_whld', CAST(incm_yr AS VARCHAR), count(*) FROM itr_inc WHERE ti_or_lss_amt IS NULL GROUP BY 1, 2""")
def route_by_filename(spark, sf):
    """CSV shards routed to four target tables by file name, in either case;
    files of no target are skipped; the year tag comes from the path."""
    root = scratch_path(spark, "itr-shards")
    ctx, inc = fx.itr(spark, sf), fx.itr_inc(spark, sf)
    amount = F.col("ti_or_lss_amt")
    for kind, df in (("Itr-CONTEXT", ctx), ("itr-inc-loss", inc), ("itr-Ded-Exp-Off", inc.where(amount < 0)),
                     ("itr-whld-debt", inc.where(amount.isNull())), ("ato-spine", inc)):
        df.withColumn("shard", F.concat(F.lit(f"{kind}-"), F.col("incm_yr"))) \
            .write.mode("append").option("header", True).partitionBy("shard").csv(root)
    routed = files.route_csv(spark, root, ROUTES, tag_pattern=r"-(\d{4})/")
    parts = [group_count(df.select(F.lit(t).alias("target"), "file_tag"), "target", "file_tag")
             for t, df in routed.items()]
    return reduce(lambda x, y: x.unionByName(y), parts)


@query("infer_csv_scan", views=("itr_inc",), sql="SELECT * FROM itr_inc")
def infer_csv_scan(spark, sf):
    """CSV read back with the schema inferred from every row."""
    path = _write_csv(fx.itr_inc(spark, sf), scratch_path(spark, "itr-inc-csv"))
    return readers.infer_csv(spark, f"{path}/*.csv").select(
        F.col("rec_id").cast("long").alias("rec_id"), "synthetic_aeuid", "incm_yr", "ti_or_lss_amt")


@query("csv_to_answer", views=("demo", "dhda_spine", "mbs"), sql="""
SELECT d.core_gender, count(*) AS claims, round(sum(m.numserv), 2) AS services, round(sum(m.feecharged), 2) AS fees
FROM demo d JOIN dhda_spine s ON d.spine_id = s.spine_id
JOIN mbs m ON s.synthetic_aeuid = m.synthetic_aeuid GROUP BY 1 ORDER BY 1""")
def csv_to_answer(spark, sf):
    """The whole path: CSV shards -> parquet -> catalog views -> SQL answer.
    The answer reads only the ingested files."""
    root = scratch_path(spark, "csv-to-answer")
    schemas = {"demo": fx.demo(spark, sf).schema, "dhda_spine": fx.dhda_spine(spark, sf).schema, "mbs": MBS_SCHEMA}
    names = {}
    for name, schema in schemas.items():
        src = _write_csv(fx.view(spark, sf, name), f"{root}/csv/{name}")
        layout.write_parquet(readers.read_csv(spark, f"{src}/*.csv", schema), f"{root}/parquet/{name}")
        names[name] = f"pk_ingested_{name}"
        catalog.register_view(spark, names[name], f"{root}/parquet/{name}")
    return spark.sql(f"""
        SELECT d.core_gender, CAST(sum(m.c) AS BIGINT) AS claims, round(sum(m.s), 2) AS services,
               round(sum(m.f), 2) AS fees
        FROM {names["demo"]} d JOIN {names["dhda_spine"]} s ON d.spine_id = s.spine_id
        JOIN (SELECT synthetic_aeuid, count(*) AS c, sum(numserv) AS s, sum(feecharged) AS f
              FROM {names["mbs"]} GROUP BY synthetic_aeuid) m ON s.synthetic_aeuid = m.synthetic_aeuid
        GROUP BY d.core_gender ORDER BY d.core_gender""")


@query("layout_compare", views=("mbs",), sql="""
SELECT layout, count(*) AS n, round(sum(numserv), 2) AS services FROM mbs,
  (VALUES ('flat'), ('by_year'), ('clustered'), ('small_groups')) AS v(layout)
WHERE year(dos) = 1997 GROUP BY 1""")
def layout_compare(spark, sf):
    """One year's total from the same claims in four layouts; all agree.
    The claims are joined once, for the flat layout; the others lay out anew
    what it holds."""
    root = scratch_path(spark, "layouts")
    layout.write_parquet(fx.mbs(spark, sf).withColumn("yr", F.year("dos")), f"{root}/flat")
    m = readers.read_parquet(spark, f"{root}/flat")
    layout.write_parquet(m, f"{root}/by_year", partition_by=["yr"])
    layout.write_clustered(m, f"{root}/clustered", ["yr", "synthetic_aeuid"])
    layout.write_parquet(m, f"{root}/small_groups", row_group_rows=10_000)
    parts = [readers.read_parquet(spark, f"{root}/{name}").where(F.col("yr") == 1997).agg(
        F.lit(name).alias("layout"), F.count(F.lit(1)).alias("n"), F.round(F.sum("numserv"), 2).alias("services"))
        for name in ("flat", "by_year", "clustered", "small_groups")]
    return reduce(lambda x, y: x.unionByName(y), parts)


@query("log_append", views=("itr",), sql="""
SELECT 't1_' || CAST(incm_yr AS VARCHAR) AS task, count(*) AS n_result,
       CASE WHEN incm_yr >= 1998 THEN 'none' END AS error FROM itr GROUP BY incm_yr""")
def log_append(spark, sf):
    """Run rows appended to a parquet log in two batches whose schemas
    differ (the second adds ``error``); read back merged, latest per task."""
    path = scratch_path(spark, "runlog")
    per_year = fx.itr(spark, sf).groupBy("incm_yr").agg(F.count(F.lit(1)).alias("n_result"))
    rows = per_year.select(F.concat(F.lit("t1_"), F.col("incm_yr")).alias("task"), "n_result",
                           F.col("incm_yr").alias("run"))
    files.append_log(rows.where(F.col("run") < 1998), path)
    files.append_log(rows.where(F.col("run") >= 1998).withColumn("error", F.lit("none")), path)
    log = files.read_log(spark, path)
    return last_per_key(log, ["task"], ["run"]).select("task", "n_result", "error")


@query("profile_sources", views=(), sql=None)
def profile_sources(spark, sf):
    """Files and bytes per dataset folder under the data root (file
    metadata only; contents are not read)."""
    return files.profile_files(spark, sf, "*.parquet", top=None)


@query("panel_temp", views=("demo", "ato_spine", "itr"), sql="WITH " + _PANEL_SQL + """
SELECT incm_yr, count(*) AS n, count(DISTINCT spine_id) AS people FROM wk_panel GROUP BY 1""")
def panel_temp(spark, sf):
    """Temporary materialisation reused by later queries (``compute()``):
    written once to the shared folder, registered as a temp view, queried by
    name.  Nothing stays pinned in executor memory."""
    path = scratch_path(spark, "wk-panel")
    wk_panel(spark, sf).write.parquet(path)
    catalog.register_view(spark, "pk_wk_panel", path)
    return spark.sql("SELECT incm_yr, count(*) AS n, count(DISTINCT spine_id) AS people "
                     "FROM pk_wk_panel GROUP BY incm_yr")


@query("stage_table", views=("stp",), sql="WITH " + _STP_SQL + """
SELECT count(*) AS n_switches, count(DISTINCT synthetic_aeuid) AS n_switchers FROM stp_switches""")
def stage_table(spark, sf):
    """A pipeline stage written as a persistent table in the shared folder
    (cuts lineage; later stages read the files)."""
    name = "pk_stp_switches"
    catalog.drop_table(spark, name)
    t = catalog.materialise(employer_switches(stp_filtered(spark, sf)), name,
                            scratch_path(spark, name))
    return t.agg(F.count(F.lit(1)).alias("n_switches"),
                 F.count_distinct("synthetic_aeuid").alias("n_switchers"))


@query("bucketed_table_join", views=("stp", "ato_spine"), sql="""
SELECT CAST(year(s.week_ending) AS INTEGER) AS yr, count(*) AS n
FROM stp s JOIN ato_spine a ON s.synthetic_aeuid = a.synthetic_aeuid GROUP BY 1""")
def bucketed_table_join(spark, sf):
    """Two tables bucketed by person into the same number of buckets: the
    join reads co-partitioned buckets with no exchange on either side."""
    n = 8
    a = layout.save_bucketed_table(fx.stp(spark, sf), "pk_stp_bucketed",
                                   scratch_path(spark, "stp-bucketed"), "synthetic_aeuid", n)
    b = layout.save_bucketed_table(fx.ato_spine(spark, sf), "pk_ato_bucketed",
                                   scratch_path(spark, "ato-bucketed"), "synthetic_aeuid", n)
    j = spark.table(a).join(spark.table(b), "synthetic_aeuid")
    return group_count(j.select(F.year("week_ending").cast("int").alias("yr")), "yr")
