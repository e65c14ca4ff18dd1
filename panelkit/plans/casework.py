"""End-to-end case-study queries: income distribution, service use by sex
and age, and job switches after health shocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit import fixtures as fx
from panelkit.functions import brackets, month_start
from panelkit.operators import joins as J
from panelkit.operators.aggregates import distribution, group_count, share_within
from panelkit.operators.quantiles import exact_quantiles
from panelkit.operators.sets import bind_rows
from panelkit.plans.linkage import three_way_age_5yr
from panelkit.plans.panel import (
    _MONTHLY_SQL, _SHOCK_SQL, _STP_SQL, employer_switches, mbs_shocks, stp_filtered,
)
from panelkit.plans.registry import query
from panelkit.session import scratch_path

# ------------------------------------------------------------------ incomes

# Fixed bracket cut points and labels of the income distribution.
INCOME_BRACKETS = [
    (0, "loss"),
    (18200, "<$18.2k"),
    (45000, "$18.2–45k"),
    (120000, "$45–120k"),
    (180000, "$120–180k"),
]
TOP_BRACKET = "$180k+"

_BRACKET_SQL = """
CASE WHEN ti_or_lss_amt < 0 THEN 'loss' WHEN ti_or_lss_amt < 18200 THEN '<$18.2k'
     WHEN ti_or_lss_amt < 45000 THEN '$18.2–45k' WHEN ti_or_lss_amt < 120000 THEN '$45–120k'
     WHEN ti_or_lss_amt < 180000 THEN '$120–180k' ELSE '$180k+' END"""


@query("income_stats_by_year", views=("itr_inc",), headline=True, sql="""
SELECT incm_yr, count(*) AS n, round(avg(ti_or_lss_amt), 4) AS mean_ti,
       round(median(ti_or_lss_amt), 4) AS median_ti,
       round(quantile_cont(ti_or_lss_amt, 0.10), 4) AS p10_ti,
       round(quantile_cont(ti_or_lss_amt, 0.90), 4) AS p90_ti
FROM itr_inc WHERE ti_or_lss_amt IS NOT NULL GROUP BY 1 ORDER BY 1""")
def income_stats_by_year(spark, sf):
    """n, mean, median and P10/P90 (exact, interpolated) per income year."""
    inc = fx.itr_inc(spark, sf).where(F.col("ti_or_lss_amt").isNotNull())
    d = distribution(inc, ["incm_yr"], "ti_or_lss_amt", {"p10_ti": 0.10, "p90_ti": 0.90},
                     prefix="_ti")
    return d.select("incm_yr", "n", *[F.round(c, 4).alias(c) for c in
                                      ("mean_ti", "median_ti", "p10_ti", "p90_ti")]) \
        .orderBy("incm_yr")


@query("income_stats_refined", views=("itr_inc",), sql="""
SELECT incm_yr, count(*) AS n, round(avg(ti_or_lss_amt), 4) AS mean_ti,
       round(median(ti_or_lss_amt), 4) AS median_ti,
       round(quantile_cont(ti_or_lss_amt, 0.10), 4) AS p10_ti,
       round(quantile_cont(ti_or_lss_amt, 0.90), 4) AS p90_ti
FROM itr_inc WHERE ti_or_lss_amt IS NOT NULL GROUP BY 1""")
def income_stats_refined(spark, sf):
    """The same statistics with coarse histograms, so that every rank takes
    many refinement passes."""
    inc = fx.itr_inc(spark, sf).where(F.col("ti_or_lss_amt").isNotNull())
    moments = inc.groupBy("incm_yr").agg(F.count(F.lit(1)).alias("n"),
                                         F.round(F.avg("ti_or_lss_amt"), 4).alias("mean_ti"))
    q = exact_quantiles(inc, ["incm_yr"], "ti_or_lss_amt",
                        {"median_ti": 0.5, "p10_ti": 0.10, "p90_ti": 0.90}, buckets=64)
    return moments.join(q, "incm_yr").select("incm_yr", "n", "mean_ti", *[
        F.round(c, 4).alias(c) for c in ("median_ti", "p10_ti", "p90_ti")])


@query("income_stats_overall", views=("itr_inc",), sql="""
SELECT count(*) AS n, round(avg(ti_or_lss_amt), 4) AS mean_ti, round(median(ti_or_lss_amt), 4) AS median_ti,
       round(quantile_cont(ti_or_lss_amt, 0.10), 4) AS p10_ti, round(quantile_cont(ti_or_lss_amt, 0.90), 4) AS p90_ti
FROM itr_inc WHERE ti_or_lss_amt IS NOT NULL""")
def income_stats_overall(spark, sf):
    """The statistics of all years together: one ungrouped distribution."""
    d = distribution(fx.itr_inc(spark, sf), [], "ti_or_lss_amt", {"p10_ti": 0.10, "p90_ti": 0.90}, prefix="_ti")
    return d.select("n", *[F.round(c, 4).alias(c) for c in ("mean_ti", "median_ti", "p10_ti", "p90_ti")])


def _brackets(spark, sf) -> DataFrame:
    inc = fx.itr_inc(spark, sf).where(F.col("ti_or_lss_amt").isNotNull())
    b = inc.select("incm_yr", brackets("ti_or_lss_amt", INCOME_BRACKETS, TOP_BRACKET)
                   .alias("bracket"))
    return group_count(b, "incm_yr", "bracket")


@query("income_brackets", views=("itr_inc",), sql=f"""
SELECT incm_yr, {_BRACKET_SQL} AS bracket, count(*) AS n
FROM itr_inc WHERE ti_or_lss_amt IS NOT NULL GROUP BY 1, 2""")
def income_brackets(spark, sf):
    """Six ordered brackets (``case_when``), counted per year."""
    return _brackets(spark, sf)


@query("bracket_shares", views=("itr_inc",), sql=f"""
SELECT incm_yr, bracket, n, round(n / sum(n) OVER (PARTITION BY incm_yr), 6) AS share FROM (
  SELECT incm_yr, {_BRACKET_SQL} AS bracket, count(*) AS n
  FROM itr_inc WHERE ti_or_lss_amt IS NOT NULL GROUP BY 1, 2)""")
def bracket_shares(spark, sf):
    """Share of each bracket within its year (``position = "fill"``)."""
    s = share_within(_brackets(spark, sf), "n", ["incm_yr"])
    return s.withColumn("share", F.round("share", 6))


# ------------------------------------------------------------- service use

@query("fee_per_service", views=("demo", "dhda_spine", "mbs"), sql="""
SELECT d.core_gender, CAST(floor((2015 - d.year_of_birth) / 5.0) * 5 AS INTEGER) AS age_group,
       round(sum(m.feecharged) / nullif(sum(m.numserv), 0), 4) AS fee_per_service
FROM demo d JOIN dhda_spine s ON d.spine_id = s.spine_id
JOIN mbs m ON s.synthetic_aeuid = m.synthetic_aeuid
WHERE 2015 - d.year_of_birth >= 0 AND 2015 - d.year_of_birth < 100 AND d.core_gender IN ('M', 'F')
GROUP BY 1, 2""")
def fee_per_service(spark, sf):
    """Average fee per service by sex and 5-year age group (ratio of
    aggregates; a zero denominator gives NULL, not an error)."""
    r = three_way_age_5yr(spark, sf).where(F.col("core_gender").isin("M", "F"))
    ratio = F.try_divide(F.col("fee_charged"), F.col("services"))
    return r.select("core_gender", "age_group", F.round(ratio, 4).alias("fee_per_service"))


# -------------------------------------------------- switches x health shocks

_LINK_SQL = """,
cw AS (SELECT a.synthetic_aeuid AS ato_aeuid, d.synthetic_aeuid AS dhda_aeuid
       FROM ato_spine a JOIN dhda_spine d ON a.spine_id = d.spine_id),
linked AS (
  SELECT s.synthetic_aeuid, s.week_ending, s.rec_id, sh.shock_month, cw.dhda_aeuid
  FROM stp_switches s JOIN cw ON s.synthetic_aeuid = cw.ato_aeuid
  JOIN mbs_shocks sh ON sh.synthetic_aeuid = cw.dhda_aeuid
  WHERE s.week_ending >= sh.shock_month AND s.week_ending < sh.shock_month + INTERVAL 90 DAY)
"""
_CS4_VIEWS = ("stp", "mbs", "ato_spine", "dhda_spine")
_CS4_WITH = "WITH " + _STP_SQL + "," + _MONTHLY_SQL + _SHOCK_SQL + _LINK_SQL


def post_shock_links(spark, sf, switches: DataFrame | None = None) -> DataFrame:
    """Switches (ATO ids) -> crosswalk -> shocks (health ids) within
    ``[shock_month, shock_month + 90 days)``.  A switch near two shocks
    appears twice (one row per matching shock)."""
    sw = switches if switches is not None else employer_switches(stp_filtered(spark, sf))
    cw = J.crosswalk(fx.ato_spine(spark, sf), fx.dhda_spine(spark, sf), "ato_aeuid", "dhda_aeuid")
    s = J.join_renamed(sw.select("synthetic_aeuid", "week_ending", "rec_id"), cw,
                       "synthetic_aeuid", "ato_aeuid")
    shocks = mbs_shocks(spark, sf).select(F.col("synthetic_aeuid").alias("dhda_aeuid"),
                                          "shock_month")
    return J.interval_join(s, shocks, "dhda_aeuid", "week_ending", "shock_month", 90)


@query("interval_join_90d", views=_CS4_VIEWS, sql=_CS4_WITH + """
SELECT synthetic_aeuid, week_ending, rec_id, shock_month, dhda_aeuid FROM linked""")
def interval_join_90d(spark, sf):
    return post_shock_links(spark, sf).select("synthetic_aeuid", "week_ending", "rec_id",
                                              "shock_month", "dhda_aeuid")


def _post_shock(spark, sf, switches: DataFrame | None = None):
    links = post_shock_links(spark, sf, switches)
    return (links.groupBy(month_start("week_ending").alias("switch_month"))
            .agg(F.count(F.lit(1)).alias("switches_post_shock"),
                 F.count_distinct("synthetic_aeuid").alias("people")))


@query("post_shock_switches", views=_CS4_VIEWS, headline=True, sql=_CS4_WITH + """
SELECT CAST(date_trunc('month', week_ending) AS DATE) AS switch_month,
       count(*) AS switches_post_shock, count(DISTINCT synthetic_aeuid) AS people
FROM linked GROUP BY 1 ORDER BY 1""")
def post_shock_switches(spark, sf):
    """Employer switches within 90 days after a health shock, by month."""
    return _post_shock(spark, sf).orderBy("switch_month")


def _baseline(spark, sf, switches: DataFrame | None = None):
    sw = switches if switches is not None else employer_switches(stp_filtered(spark, sf))
    return (sw.groupBy(month_start("week_ending").alias("switch_month"))
            .agg(F.count(F.lit(1)).alias("switches"),
                 F.count_distinct("synthetic_aeuid").alias("people")))


@query("switch_rate_baseline", views=("stp",), sql="WITH " + _STP_SQL + """
SELECT CAST(date_trunc('month', week_ending) AS DATE) AS switch_month, count(*) AS switches,
       count(DISTINCT synthetic_aeuid) AS people FROM stp_switches GROUP BY 1 ORDER BY 1""")
def switch_rate_baseline(spark, sf):
    """All switches by month: the baseline rate."""
    return _baseline(spark, sf).orderBy("switch_month")


@query("switch_summary", views=("stp",), sql="WITH " + _STP_SQL + """
SELECT count(*) AS n_switches, count(DISTINCT synthetic_aeuid) AS n_switchers FROM stp_switches""")
def switch_summary(spark, sf):
    """Number of switches and of distinct switchers."""
    sw = employer_switches(stp_filtered(spark, sf))
    return sw.agg(F.count(F.lit(1)).alias("n_switches"),
                  F.count_distinct("synthetic_aeuid").alias("n_switchers"))


@query("baseline_vs_postshock", views=_CS4_VIEWS, sql=_CS4_WITH + """,
base AS (SELECT CAST(date_trunc('month', week_ending) AS DATE) AS month, count(*) AS n
         FROM stp_switches GROUP BY 1),
post AS (SELECT CAST(date_trunc('month', week_ending) AS DATE) AS month, count(*) AS n
         FROM linked GROUP BY 1)
SELECT month, n, 'All switchers' AS "group" FROM base
UNION ALL SELECT month, n, 'Post health-shock (3-month window)' AS "group" FROM post""")
def baseline_vs_postshock(spark, sf):
    """Both series stacked with a group label (``bind_rows``)."""
    # Written once to the shared folder, then read by both series.
    path = scratch_path(spark, "switches")
    employer_switches(stp_filtered(spark, sf)).write.parquet(path)
    sw = spark.read.parquet(path)
    base = _baseline(spark, sf, sw).select(F.col("switch_month").alias("month"),
                                       F.col("switches").alias("n"))
    post = _post_shock(spark, sf, sw).select(F.col("switch_month").alias("month"),
                                         F.col("switches_post_shock").alias("n"))
    return bind_rows({"All switchers": base, "Post health-shock (3-month window)": post})
