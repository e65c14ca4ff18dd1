"""Queries over stored state: files whose types drifted, partitions replaced
in place, summaries that answer later questions, Bloom-filtered lookups and
partitions pruned at run time, and sums that no partitioning changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from panelkit import fixtures as fx
from panelkit.operators import keycheck
from panelkit.operators import sketches as S
from panelkit.operators.exactsum import exact_sums
from panelkit.plans.panel import stp_filtered
from panelkit.plans.registry import query
from panelkit.plans.storage import ITR_INC_SCHEMA
from panelkit.session import scratch_path
from panelkit.sources import clustered, drift, layout, readers, replace

# ----------------------------------------------------------------- type drift

# Fixed vintages of the drifted files: the last year of each, and how the
# occupation code and the income are stored.
VINTAGES = [(1996, "int", "double"), (1998, "bigint", "bigint"), (1999, "string", "decimal(12,2)"), (9999, None, "double")]


def _drifted(spark, sf) -> str:
    """Tax returns in files of four vintages, by year folder."""
    root, after = scratch_path(spark, "itr-vintages"), 0
    rows = fx.itr(spark, sf).join(fx.itr_inc(spark, sf).select("rec_id", F.floor("ti_or_lss_amt").alias("income")), "rec_id")
    for last, code, income in VINTAGES:
        part = rows.where((F.col("incm_yr") > after) & (F.col("incm_yr") <= last)) \
            .withColumn("income", F.col("income").cast(income)).withColumn("year", F.col("incm_yr"))
        part = part.drop("ocptn_grp_cd") if code is None else part.withColumn("ocptn_grp_cd", F.col("ocptn_grp_cd").cast(code))
        # Each vintage names its columns in its own case.
        part = part.withColumnRenamed("synthetic_aeuid", "SYNTHETIC_AEUID" if code == "bigint" else "synthetic_aeuid")
        part.write.mode("append").partitionBy("year").parquet(root)
        after = last
    return root


@query("scan_type_drift", views=("itr", "itr_inc"), sql="""
SELECT rec_id, synthetic_aeuid, incm_yr,
       CASE WHEN incm_yr <= 1999 THEN CAST(ocptn_grp_cd AS VARCHAR) END AS ocptn_grp_cd,
       CAST(floor(ti_or_lss_amt) AS DOUBLE) AS income, CAST(incm_yr AS VARCHAR) AS folder_year
FROM itr JOIN (SELECT rec_id, ti_or_lss_amt FROM itr_inc) USING (rec_id)""")
def scan_type_drift(spark, sf):
    """Files of four vintages read as one table: the occupation code is an
    int, a long, a string, then absent; the income a double, a long and a
    decimal; one vintage has an upper-case name.  Year folders become text."""
    t = drift.read_drifted(spark, _drifted(spark, sf), partition_columns=["year"])
    return t.withColumnRenamed("year", "folder_year")


@query("type_drift_report", views=("itr",), sql="""
WITH y AS (SELECT DISTINCT incm_yr FROM itr),
v AS (SELECT CASE WHEN incm_yr <= 1996 THEN 1 WHEN incm_yr <= 1998 THEN 2 WHEN incm_yr <= 1999 THEN 3 ELSE 4 END AS v FROM y),
has AS (SELECT 'ocptn_grp_cd' AS "column", unnest(['int', 'bigint', 'string']) AS type, unnest([1, 2, 3]) AS v
        UNION ALL SELECT 'income', unnest(['double', 'bigint', 'decimal(12,2)', 'double']), unnest([1, 2, 3, 4]))
SELECT "column", type, count(*) > 0 AS found, CASE "column" WHEN 'income' THEN 'double' ELSE 'string' END AS read_as
FROM has JOIN v USING (v) GROUP BY 1, 2""")
def type_drift_report(spark, sf):
    """Which types the drifted columns have, and what they are read as."""
    r = drift.drift_report(spark, _drifted(spark, sf)).where(F.col("column").isin("ocptn_grp_cd", "income"))
    return r.select("column", "type", (F.col("files") > 0).alias("found"), "read_as")


# ------------------------------------------------------- replaced partitions

@query("replace_year", views=("itr_inc",), sql="""
SELECT rec_id, synthetic_aeuid, incm_yr,
       CASE WHEN incm_yr = 1997 THEN ti_or_lss_amt * 2 ELSE ti_or_lss_amt END AS ti_or_lss_amt FROM itr_inc""")
def replace_year(spark, sf):
    """Every year converted from its CSV files, then 1997 again from corrected
    files, and once more from the same: each run replaces its own year, and
    the last one does nothing."""
    root = scratch_path(spark, "itr-inc-years")
    inc, table, notes = fx.itr_inc(spark, sf), f"{root}/table", f"{root}/notes"
    _yearly_csv(inc, f"{root}/csv")
    years = [r[0] for r in inc.select("incm_yr").distinct().collect()]
    read = lambda s, files: readers.read_csv(s, files, ITR_INC_SCHEMA)
    for y in sorted(years):
        replace.convert_partition(spark, table, notes, "incm_yr", y, f"{root}/csv/file_year={y}", read)
    fixed = inc.where(F.col("incm_yr") == 1997).withColumn("ti_or_lss_amt", F.col("ti_or_lss_amt") * 2)
    _yearly_csv(fixed, f"{root}/corrected")
    for _ in range(2):
        replace.convert_partition(spark, table, notes, "incm_yr", 1997, f"{root}/corrected/file_year=1997", read)
    return readers.read_parquet(spark, table).select("rec_id", "synthetic_aeuid", "incm_yr", "ti_or_lss_amt")


def _yearly_csv(df, path: str) -> None:
    df.withColumn("file_year", F.col("incm_yr")).write.option("header", True).partitionBy("file_year").csv(path)


# ------------------------------------------------------------ stored summaries

# Fixed spans of years that the later questions ask about.
SPANS = [("1995-1996", 1995, 1996), ("1997-1999", 1997, 1999), ("1995-2001", 1995, 2001), ("2001", 2001, 2001)]
_SPAN_VALUES = ", ".join(f"('{n}', {a}, {b})" for n, a, b in SPANS)
_PROBS = {"p10": 0.10, "median": 0.5, "p90": 0.90, "p99": 0.99}


def _spans(years):
    """``years`` (with incm_yr) once per span that holds the year."""
    spans = F.array(*[F.struct(F.lit(n).alias("span"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, a, b in SPANS])
    held = F.filter(spans, lambda s: F.col("incm_yr").between(s["a"], s["b"]))
    return years.withColumn("span", F.explode(F.transform(held, lambda s: s["span"])))


@query("quantile_state_spans", views=("itr_inc",), sql=f"""
WITH s(span, a, b) AS (VALUES {_SPAN_VALUES}), p(prob) AS (VALUES ('p10'), ('median'), ('p90'), ('p99'))
SELECT span, prob, count(ti_or_lss_amt) AS n, true AS within_bound FROM s, p, itr_inc
WHERE incm_yr BETWEEN a AND b GROUP BY 1, 2 HAVING count(ti_or_lss_amt) > 0""")
def quantile_state_spans(spark, sf):
    """Income quantiles of spans of years from yearly summaries: the state is
    written once and merged per span; then the true ranks of the answers are
    counted and held against the summaries' error bound."""
    inc = fx.itr_inc(spark, sf)
    path = scratch_path(spark, "income-quantiles")
    S.quantile_state(inc, ["incm_yr"], "ti_or_lss_amt").write.parquet(path)
    answers = S.merge_quantiles(_spans(spark.read.parquet(path)), ["span"], _PROBS)
    return _held_against(_spans(inc.select("incm_yr", "ti_or_lss_amt")), answers, "span")


def _held_against(facts, answers, key: str):
    """The answers' true ranks against the bound of the summaries."""
    ranks = S.true_rank(facts, [key], "ti_or_lss_amt", answers, list(_PROBS))
    asked = reduce(lambda c, p: F.when(F.col("prob") == p, F.lit(_PROBS[p])).otherwise(c), _PROBS, F.lit(None))
    return ranks.join(answers.select(key, "n"), key).select(
        key, "prob", "n", S.within(F.col("rank_lo"), F.col("rank_hi"), asked, S.rank_error()).alias("within_bound"))


@query("quantile_state_regroup", views=("itr_inc",), sql="""
SELECT width, prob, count(ti_or_lss_amt) AS n, true AS within_bound
FROM (SELECT *, CAST(length(synthetic_aeuid) AS INTEGER) AS width FROM itr_inc),
     (VALUES ('p10'), ('median'), ('p90'), ('p99')) AS p(prob) GROUP BY 1, 2""")
def quantile_state_regroup(spark, sf):
    """A question the state was not made for: summaries per year and length of
    the person's id, merged over all years per length."""
    inc = fx.itr_inc(spark, sf).withColumn("width", F.length("synthetic_aeuid"))
    path = scratch_path(spark, "income-quantiles-width")
    S.quantile_state(inc, ["incm_yr", "width"], "ti_or_lss_amt").write.parquet(path)
    return _held_against(inc, S.merge_quantiles(spark.read.parquet(path), ["width"], _PROBS), "width")


@query("distinct_state_periods", views=("stp",), sql="""
WITH q AS (SELECT *, CAST(year(week_ending) AS INTEGER) AS yr FROM stp WHERE abn_hash_trunc IS NOT NULL)
SELECT 'year' AS kind, CAST(yr AS VARCHAR) AS period, count(DISTINCT synthetic_aeuid) AS people, true AS within_bound
FROM q GROUP BY ALL
UNION ALL SELECT 'employer', abn_hash_trunc, count(DISTINCT synthetic_aeuid), true FROM q GROUP BY ALL
UNION ALL SELECT 'all', 'all', count(DISTINCT synthetic_aeuid), true FROM q""")
def distinct_state_periods(spark, sf):
    """People per year, per employer and overall from one state table of
    summaries per month and employer; the exact counts are taken beside it to
    hold the estimates against their bound."""
    stp = stp_filtered(spark, sf)
    path = scratch_path(spark, "people-distinct")
    S.distinct_state(stp, [F.trunc("week_ending", "MM").alias("month"), "abn_hash_trunc"], "synthetic_aeuid").write.parquet(path)
    state = spark.read.parquet(path)
    by = {"year": (F.year("month"), F.year("week_ending")), "employer": (F.col("abn_hash_trunc"), F.col("abn_hash_trunc")),
          "all": (F.lit("all"), F.lit("all"))}
    parts = []
    for kind, (of_state, of_facts) in by.items():
        est = S.merge_distinct(state, [of_state.cast("string").alias("period")], "est")
        true = stp.groupBy(of_facts.cast("string").alias("period")).agg(F.count_distinct("synthetic_aeuid").alias("people"))
        parts.append(true.join(est, "period").select(F.lit(kind).alias("kind"), "period", "people", (
            F.abs(F.col("est") - F.col("people")) <= F.greatest(F.lit(1.0), F.col("people") * F.lit(S.count_error()))
        ).alias("within_bound")))
    return reduce(lambda a, b: a.unionByName(b), parts)


# ------------------------------------------------------------------ exact sums

@query("exact_fee_sums", views=("mbs",), sql="""
SELECT btos, CAST(year(dos) AS INTEGER) AS yr, fsum(feecharged) AS feecharged, fsum(numserv) AS numserv,
       fsum(feecharged) / count(feecharged) AS mean_feecharged FROM mbs GROUP BY 1, 2""")
def exact_fee_sums(spark, sf):
    """Fees and services per type and year, each the double nearest to the
    true sum, so nothing is rounded before comparing."""
    m = fx.mbs(spark, sf).select("btos", F.year("dos").cast("int").alias("yr"), "feecharged", "numserv")
    return exact_sums(m, ["btos", "yr"], ["feecharged", "numserv"], mean=["feecharged"])


@query("exact_income_sums", views=("itr_inc",), sql="""
SELECT incm_yr, fsum(ti_or_lss_amt) AS ti_or_lss_amt, fsum(ti_or_lss_amt) / count(ti_or_lss_amt) AS mean_ti_or_lss_amt
FROM itr_inc GROUP BY 1""")
def exact_income_sums(spark, sf):
    """Sums of both signs with NULLs, per income year."""
    return exact_sums(fx.itr_inc(spark, sf), ["incm_yr"], ["ti_or_lss_amt"], mean=["ti_or_lss_amt"])


# ------------------------------------------- lookups and pruning by stored files

@query("lookup_bloom", views=("itr",), sql="""
SELECT count(*) AS n, min(incm_yr) AS first_year, max(rec_id) AS last_rec FROM itr WHERE synthetic_aeuid = 'A100'""")
def lookup_bloom(spark, sf):
    """One person's returns in a table clustered by record: the person's id is
    not clustered, so row groups are skipped by the Bloom filters written for
    it."""
    path = scratch_path(spark, "itr-bloom")
    itr = fx.itr(spark, sf)
    layout.write_clustered(itr, path, ["rec_id"], row_group_rows=1000, bloom={"synthetic_aeuid": 1000})
    t = readers.read_parquet(spark, path).where(F.col("synthetic_aeuid") == "A100")
    return t.agg(F.count(F.lit(1)).alias("n"), F.min("incm_yr").alias("first_year"), F.max("rec_id").alias("last_rec"))


@query("join_pruned_years", views=("mbs", "itr_inc"), sql="""
WITH chosen AS (SELECT incm_yr AS yr FROM itr_inc GROUP BY 1
                HAVING sum(CASE WHEN ti_or_lss_amt < 0 THEN 1 ELSE 0 END) > 0.012 * count(*) AND incm_yr >= 1996)
SELECT m.yr, btos, count(*) AS claims, round(sum(numserv), 2) AS services
FROM (SELECT *, CAST(year(dos) AS INTEGER) AS yr FROM mbs) m JOIN chosen USING (yr) GROUP BY 1, 2""")
def join_pruned_years(spark, sf):
    """Claims of the years that a small table selects: the claims are stored
    by year, and the join's years prune the folders while it runs."""
    path, years = scratch_path(spark, "mbs-by-year"), scratch_path(spark, "year-table")
    layout.write_parquet(fx.mbs(spark, sf).withColumn("yr", F.year("dos")), path, partition_by=["yr"])
    loss = F.when(F.col("ti_or_lss_amt") < 0, 1).otherwise(0)
    fx.itr_inc(spark, sf).groupBy(F.col("incm_yr").alias("yr")).agg((F.sum(loss) / F.count(F.lit(1))).alias("loss_share")) \
        .write.parquet(years)
    chosen = spark.read.parquet(years).where((F.col("loss_share") > 0.012) & (F.col("yr") >= 1996)).select("yr")
    j = readers.read_parquet(spark, path).join(chosen, "yr")
    return j.groupBy("yr", "btos").agg(F.count(F.lit(1)).alias("claims"), F.round(F.sum("numserv"), 2).alias("services"))


# -------------------------------------------- clustering that survives appends

def _ten_batches(spark, sf, path: str):
    """Payroll appended in ten batches by pay date, each over all people."""
    stp = fx.stp(spark, sf)
    day = F.datediff("week_ending", F.lit("1995-01-01").cast("date"))
    tenth = F.least(F.greatest(F.floor(day / 256), F.lit(0)), F.lit(9))
    for k in range(10):
        clustered.append_clustered(stp.where(tenth == k), path, "synthetic_aeuid", file_rows=_batch_rows(stp))


def _batch_rows(stp) -> int:
    """Rows of a file, so that a batch has several."""
    return max(100, stp.count() // 20)


@query("append_reclustered", views=("stp",), sql="SELECT * FROM stp")
def append_reclustered(spark, sf):
    """Ten appended batches, reclustered as they come, hold the same rows."""
    path = scratch_path(spark, "stp-clustered")
    _ten_batches(spark, sf, path)
    return clustered.read_clustered(spark, path)


@query("lookup_reclustered", views=("stp",), sql="""
SELECT synthetic_aeuid, count(*) AS n, round(sum(pmt_sumry_totl_grs_pmt_amt), 2) AS pay, true AS two_files_at_most
FROM stp WHERE synthetic_aeuid IN ('A100', 'A17', 'A5', 'A64', 'A99') GROUP BY 1""")
def lookup_reclustered(spark, sf):
    """Five people looked up after ten appends: each lookup opens at most two
    files."""
    path = scratch_path(spark, "stp-clustered")
    _ten_batches(spark, sf, path)
    parts = []
    for person in ("A100", "A17", "A5", "A64", "A99"):
        rows, files = clustered.lookup(spark, path, "synthetic_aeuid", person)
        parts.append(rows.groupBy("synthetic_aeuid").agg(
            F.count(F.lit(1)).alias("n"), F.round(F.sum("pmt_sumry_totl_grs_pmt_amt"), 2).alias("pay"))
            .withColumn("two_files_at_most", F.lit(files <= 2)))
    return reduce(lambda a, b: a.unionByName(b), parts)


# ---------------------------------------------------- key integrity by batches

# Fixed first and last days of the batches; each repeats part of the one before.
KEY_BATCHES = [("1995-01-01", "1997-06-30"), ("1997-05-01", "1999-12-31"), ("1999-12-01", "2001-12-31")]
_BATCH_VALUES = ", ".join(f"({k}, DATE '{a}', DATE '{b}')" for k, (a, b) in enumerate(KEY_BATCHES))


@query("key_integrity_batches", views=("stp",), sql=f"""
WITH b(batch, lo, hi) AS (VALUES {_BATCH_VALUES}),
r AS (SELECT batch, CASE WHEN abn_hash_trunc IS NULL THEN NULL ELSE rec_id END AS rec_id, rec_id AS id
      FROM stp JOIN b ON week_ending BETWEEN lo AND hi),
seen AS (SELECT batch, rec_id, count(*) AS n FROM r GROUP BY 1, 2)
SELECT batch, 'stored' AS problem, count(*) AS n FROM seen s WHERE rec_id IS NOT NULL
  AND EXISTS (SELECT 1 FROM seen p WHERE p.rec_id = s.rec_id AND p.batch < s.batch) GROUP BY 1
UNION ALL SELECT batch, 'missing', 1 FROM seen WHERE rec_id IS NULL
UNION ALL SELECT batch, 'twice', count(*) FROM seen WHERE rec_id IS NOT NULL AND n > 1 GROUP BY 1""")
def key_integrity_batches(spark, sf):
    """Three batches of payroll that overlap in time, checked one by one
    against stored keys: the repeats are found without reading the batches
    before."""
    stp = fx.stp(spark, sf)
    store = keycheck.KeyStore(spark, scratch_path(spark, "stp-keys"), "rec_id", stp.count())
    parts = []
    for k, (lo, hi) in enumerate(KEY_BATCHES):
        rows = stp.where(F.col("week_ending").between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))) \
            .select(F.when(F.col("abn_hash_trunc").isNotNull(), F.col("rec_id")).alias("rec_id"))
        found = store.check(rows, k).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))
        parts.append(found.select(F.lit(k).alias("batch"), "problem", "n"))
        store.admit(rows, k)
    return reduce(lambda a, b: a.unionByName(b), parts)
