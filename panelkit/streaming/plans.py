"""Registered stream queries.

Each query lands the source rows in the shared folder in two time-ordered
drops (as files would arrive), runs the stream over the first drop, then
again over the second with the same checkpoint, and returns what the sink
holds.  The second run must pick up only the new files and carry state
across the restart for the answer to equal the batch result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit import fixtures as fx
from panelkit.plans.panel import _MONTHLY_SQL, _STP_SQL, stp_filtered
from panelkit.plans.registry import query
from panelkit.plans.storage import MBS_SCHEMA
from panelkit.session import scratch_path
from panelkit.streaming.ingest import ingest_new_files
from panelkit.streaming.late import OrderedChangePoints
from panelkit.streaming.rollup import monthly_from_daily, read_rollup, run_rollup
from panelkit.streaming.switches import run_change_points_tables, stream_change_points


def _two_drops(df, time_col, cut, write):
    c = F.lit(cut).cast(df.schema[time_col].dataType)
    yield lambda: write(df.where(F.col(time_col) < c))
    yield lambda: write(df.where(F.col(time_col) >= c))


@query("stream_ingest_files", views=("mbs",), sql="SELECT * FROM mbs")
def stream_ingest_files(spark, sf):
    """Incremental CSV -> parquet: two drops of shards, two restarts."""
    root = scratch_path(spark, "stream-ingest")
    landing, out, chk = f"{root}/landing", f"{root}/parquet", f"{root}/_checkpoint"

    def write(part):
        part.write.mode("append").option("header", True).csv(landing)

    for drop in _two_drops(fx.mbs(spark, sf), "dos", "1998-01-01", write):
        drop()
        ingest_new_files(spark, landing, MBS_SCHEMA, out, chk)
    return spark.read.parquet(out)


@query("stream_switches", views=("stp",), sql="WITH " + _STP_SQL + """
SELECT synthetic_aeuid, week_ending, new_employer, prev_employer, gross_pay, rec_id FROM stp_switches""")
def stream_switches(spark, sf):
    """Employer switches from a payroll stream with per-person state,
    across two drops and a restart."""
    root = scratch_path(spark, "stream-switches")
    landing, out, chk = f"{root}/landing", f"{root}/switches", f"{root}/_checkpoint"
    src = stp_filtered(spark, sf).select(
        "synthetic_aeuid", "week_ending", "rec_id", "abn_hash_trunc",
        F.col("pmt_sumry_totl_grs_pmt_amt").alias("gross_pay"))
    schema = src.schema

    def write(part):
        part.write.mode("append").parquet(landing)

    for drop in _two_drops(src, "week_ending", "1998-01-01", write):
        drop()
        # One micro-batch per drop: the files of one drop are hash slices,
        # not time slices, so splitting a drop across micro-batches would
        # make some of its rows late.  (A feed whose files arrive in time
        # order bounds batches with maxFilesPerTrigger instead.)
        stream = spark.readStream.schema(schema).parquet(landing)
        sw = stream_change_points(stream, "synthetic_aeuid", "week_ending", "rec_id",
                                  "abn_hash_trunc", "prev_employer")
        q = (sw.writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", chk).trigger(availableNow=True).start())
        q.awaitTermination()
    res = spark.read.parquet(out).where(~F.col("late"))
    return res.select("synthetic_aeuid", "week_ending",
                      F.col("abn_hash_trunc").alias("new_employer"), "prev_employer",
                      "gross_pay", "rec_id")


_LATE_SQL = """
WITH stp_f AS (SELECT * FROM stp WHERE abn_hash_trunc IS NOT NULL),
a AS (SELECT * FROM stp_f WHERE week_ending >= DATE '1998-01-01'),
b AS (SELECT * FROM stp_f WHERE week_ending < DATE '1998-01-01'),
sa AS (SELECT count(*) AS n FROM (
         SELECT abn_hash_trunc, lag(abn_hash_trunc) OVER (PARTITION BY synthetic_aeuid
                                                          ORDER BY week_ending, rec_id) AS p FROM a)
       WHERE p IS NOT NULL AND abn_hash_trunc <> p),
sb AS (SELECT count(*) AS n FROM (
         SELECT abn_hash_trunc, lag(abn_hash_trunc) OVER (PARTITION BY synthetic_aeuid
                                                          ORDER BY week_ending, rec_id) AS p
         FROM b WHERE synthetic_aeuid NOT IN (SELECT synthetic_aeuid FROM a))
       WHERE p IS NOT NULL AND abn_hash_trunc <> p),
lt AS (SELECT count(*) AS n FROM b WHERE synthetic_aeuid IN (SELECT synthetic_aeuid FROM a))
SELECT true AS late, n FROM lt
UNION ALL SELECT false AS late, (SELECT n FROM sa) + (SELECT n FROM sb) AS n"""


@query("stream_late_rows", views=("stp",), sql=_LATE_SQL)
def stream_late_rows(spark, sf):
    """The late-data contract of the stateful detector: the later payroll
    drop arrives first, then the earlier one.  Rows of people already in
    state are late (counted, not applied); people first seen in the late
    drop start fresh.  Output: switches and late rows, counted."""
    root = scratch_path(spark, "stream-late")
    landing, out, chk = f"{root}/landing", f"{root}/switches", f"{root}/_checkpoint"
    src = stp_filtered(spark, sf).select(
        "synthetic_aeuid", "week_ending", "rec_id", "abn_hash_trunc",
        F.col("pmt_sumry_totl_grs_pmt_amt").alias("gross_pay"))
    cut = F.lit("1998-01-01").cast("date")
    for part in (src.where(F.col("week_ending") >= cut), src.where(F.col("week_ending") < cut)):
        part.write.mode("append").parquet(landing)
        stream = spark.readStream.schema(src.schema).parquet(landing)
        sw = stream_change_points(stream, "synthetic_aeuid", "week_ending", "rec_id",
                                  "abn_hash_trunc", "prev_employer")
        q = (sw.writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", chk).trigger(availableNow=True).start())
        q.awaitTermination()
    counts = spark.read.parquet(out).agg(
        F.count(F.when(F.col("late"), 1)).alias("n_late"),
        F.count(F.when(~F.col("late"), 1)).alias("n_switch"))
    # both rows always present, even when a count is zero
    pairs = F.array(F.struct(F.lit(True).alias("late"), F.col("n_late").alias("n")),
                    F.struct(F.lit(False).alias("late"), F.col("n_switch").alias("n")))
    return counts.select(F.explode(pairs).alias("r")).select("r.late", "r.n")


@query("stream_switches_tables", views=("stp",), sql="WITH " + _STP_SQL + """
SELECT synthetic_aeuid, week_ending, new_employer, prev_employer, gross_pay, rec_id FROM stp_switches""")
def stream_switches_tables(spark, sf):
    """The switch stream with its per-person state kept as a versioned
    table and every step a DataFrame operation (no per-person Python)."""
    root = scratch_path(spark, "stream-switches-tables")
    landing, out = f"{root}/landing", f"{root}/switches"
    src = stp_filtered(spark, sf).select(
        "synthetic_aeuid", "week_ending", "rec_id", "abn_hash_trunc",
        F.col("pmt_sumry_totl_grs_pmt_amt").alias("gross_pay"))

    def write(part):
        part.write.mode("append").parquet(landing)

    for drop in _two_drops(src, "week_ending", "1998-01-01", write):
        drop()
        stream = spark.readStream.schema(src.schema).parquet(landing)
        run_change_points_tables(stream, "synthetic_aeuid", "week_ending", "rec_id",
                                 "abn_hash_trunc", "prev_employer", out, f"{root}/state",
                                 f"{root}/_checkpoint")
    res = spark.read.parquet(out).where(~F.col("late"))
    return res.select("synthetic_aeuid", "week_ending",
                      F.col("abn_hash_trunc").alias("new_employer"), "prev_employer",
                      "gross_pay", "rec_id")


@query("stream_daily_rollup", views=(), sql="""
SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 2) AS total
FROM events GROUP BY 1, 2""")
def stream_daily_rollup(spark, sf):
    """Per user and day: events and value over an event stream, two drops and
    a restart; the result does not depend on how many files a drop has."""
    root = scratch_path(spark, "stream-rollup")
    landing, out, chk = f"{root}/landing", f"{root}/rollup", f"{root}/_checkpoint"
    ev = fx.table(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    schema = ev.schema

    def write(part):
        part.write.mode("append").parquet(landing)

    for drop in _two_drops(ev, "ts", "2024-01-15 00:00:00", write):
        drop()
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(landing)
        run_rollup(stream, out, chk, "user_id", "ts", "value")
    r = read_rollup(spark, out, "user_id")
    return r.select("user_id", "day", "n", F.round("total", 2).alias("total"))


@query("stream_person_month", views=("mbs",), sql="WITH " + _MONTHLY_SQL + """
SELECT synthetic_aeuid, month, round(services, 2) AS services, round(fees, 2) AS fees, claims
FROM mbs_monthly""")
def stream_person_month(spark, sf):
    """The person-month collapse in event time: claims stream into days per
    person (two drops, one restart), and the days are rolled up to calendar
    months in batch."""
    root = scratch_path(spark, "stream-person-month")
    landing, out, chk = f"{root}/landing", f"{root}/daily", f"{root}/_checkpoint"
    claims = fx.mbs(spark, sf)

    def write(part):
        part.write.mode("append").parquet(landing)

    for drop in _two_drops(claims, "dos", "1998-01-01", write):
        drop()
        stream = spark.readStream.schema(claims.schema).parquet(landing)
        run_rollup(stream, out, chk, "synthetic_aeuid", "dos",
                   {"services": "numserv", "fees": "feecharged"}, lateness="31 days")
    m = monthly_from_daily(read_rollup(spark, out, "synthetic_aeuid"), "synthetic_aeuid",
                           ["services", "fees"])
    return m.select("synthetic_aeuid", "month", F.round("services", 2).alias("services"),
                    F.round("fees", 2).alias("fees"), F.col("n").alias("claims"))


@query("stream_switches_late", views=("stp",), sql="WITH " + _STP_SQL + """
SELECT synthetic_aeuid, week_ending, new_employer, prev_employer, gross_pay, rec_id FROM stp_switches""")
def stream_switches_late(spark, sf):
    """Payroll rows that arrive up to 60 days late, in four drops and as many
    restarts: late rows are put in their place, and the switches equal the
    batch job's."""
    root = scratch_path(spark, "stream-late-ordered")
    landing, out = f"{root}/landing", f"{root}/switches"
    src = stp_filtered(spark, sf).select(
        "synthetic_aeuid", "week_ending", "rec_id", "abn_hash_trunc",
        F.col("pmt_sumry_totl_grs_pmt_amt").alias("gross_pay"))
    # A row arrives some days after its week, by a hash of its record id.
    arrived = F.date_add("week_ending", F.pmod(F.xxhash64("rec_id"), F.lit(61)).cast("int"))
    job = OrderedChangePoints(spark, src.schema, "synthetic_aeuid", "week_ending", "rec_id", "abn_hash_trunc",
                              "prev_employer", 60, out, f"{root}/state")
    edges = ["0001-01-01", "1996-08-01", "1998-03-15", "1999-11-20", "9999-12-31"]
    for lo, hi in zip(edges, edges[1:]):
        src.where((arrived >= F.lit(lo).cast("date")) & (arrived < F.lit(hi).cast("date"))) \
            .write.mode("append").parquet(landing)
        job.run(spark.readStream.schema(src.schema).parquet(landing), f"{root}/_checkpoint")
    job.finish(job.last_batch())
    res = spark.read.parquet(out).where(~F.col("late"))
    return res.select("synthetic_aeuid", "week_ending", F.col("abn_hash_trunc").alias("new_employer"),
                      "prev_employer", "gross_pay", "rec_id")
