"""Calendar frames over person-months: the previous three months, not the
previous three rows, with and without the months that have no claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit import fixtures as fx
from panelkit.operators.calendar import calendar_framed, calendar_shock_flags, densify, pivot_periods
from panelkit.operators.windows import framed, shock_flags, time_chunk
from panelkit.plans.panel import CHUNK_DAYS, _MONTHLY_SQL, _ORDER, _PANEL_SQL, _PANEL_VIEWS, mbs_monthly, wk_panel
from panelkit.plans.registry import query

# The RANGE frames of the oracle, over month starts.
_PREVIOUS = """(PARTITION BY synthetic_aeuid ORDER BY month
    RANGE BETWEEN INTERVAL 3 MONTH PRECEDING AND INTERVAL 1 MONTH PRECEDING)"""

_TRAILING_SQL = "WITH " + _MONTHLY_SQL + f"""
SELECT synthetic_aeuid, month, round(avg(services) OVER {_PREVIOUS}, 4) AS trailing_avg,
       count(*) OVER {_PREVIOUS} AS months_seen
FROM mbs_monthly"""


def _trailing(spark, sf, block):
    f = calendar_framed(mbs_monthly(spark, sf), "synthetic_aeuid", "month", -3, -1,
                        {"t": F.avg("services"), "months_seen": F.count(F.lit(1))}, block=block)
    return f.select("synthetic_aeuid", "month", F.round("t", 4).alias("trailing_avg"), "months_seen")


@query("trailing_mean_calendar", views=("mbs",), sql=_TRAILING_SQL)
def trailing_mean_calendar(spark, sf):
    """Mean services of the previous three calendar months, and how many of
    them have claims."""
    return _trailing(spark, sf, None)


@query("trailing_mean_calendar_split", views=("mbs",), sql=_TRAILING_SQL)
def trailing_mean_calendar_split(spark, sf):
    """The same with every history split into blocks of six months, rows near
    a block's edge copied to the neighbour."""
    return _trailing(spark, sf, 6)


@query("framed_aggs_calendar", views=("mbs",), sql="WITH " + _MONTHLY_SQL + f"""
SELECT synthetic_aeuid, month, round(sum(services) OVER {_PREVIOUS}, 2) AS sum3,
       round(min(services) OVER {_PREVIOUS}, 2) AS min3, round(max(services) OVER {_PREVIOUS}, 2) AS max3
FROM mbs_monthly""")
def framed_aggs_calendar(spark, sf):
    """Sum, minimum and maximum of the previous three calendar months."""
    f = calendar_framed(mbs_monthly(spark, sf), "synthetic_aeuid", "month", -3, -1,
                        {"sum3": F.sum("services"), "min3": F.min("services"), "max3": F.max("services")}, block=24)
    return f.select("synthetic_aeuid", "month", *[F.round(c, 2).alias(c) for c in ("sum3", "min3", "max3")])


@query("framed_quantile_calendar", views=("mbs",), sql="WITH " + _MONTHLY_SQL + f"""
SELECT synthetic_aeuid, month, round(quantile_cont(services, 0.5) OVER {_PREVIOUS}, 4) AS median3,
       round(quantile_cont(services, 0.9) OVER {_PREVIOUS}, 4) AS p90_3
FROM mbs_monthly""")
def framed_quantile_calendar(spark, sf):
    """Median and 90th percentile of the previous three calendar months."""
    f = calendar_framed(mbs_monthly(spark, sf), "synthetic_aeuid", "month", -3, -1,
                        {"median3": F.percentile("services", F.lit(0.5)),
                         "p90_3": F.percentile("services", F.lit(0.9))}, block=24)
    return f.select("synthetic_aeuid", "month", *[F.round(c, 4).alias(c) for c in ("median3", "p90_3")])


@query("frame_following_calendar", views=("mbs",), sql="WITH " + _MONTHLY_SQL + """
SELECT synthetic_aeuid, month,
  round(avg(services) OVER (PARTITION BY synthetic_aeuid ORDER BY month
        RANGE BETWEEN INTERVAL 1 MONTH PRECEDING AND INTERVAL 1 MONTH FOLLOWING), 4) AS centred3,
  round(sum(services) OVER (PARTITION BY synthetic_aeuid ORDER BY month
        RANGE BETWEEN CURRENT ROW AND INTERVAL 2 MONTH FOLLOWING), 2) AS ahead3
FROM mbs_monthly""")
def frame_following_calendar(spark, sf):
    """Calendar frames that look ahead: one month either side, and this month
    with the next two."""
    m = mbs_monthly(spark, sf).select("synthetic_aeuid", "month", "services")
    f = calendar_framed(m, "synthetic_aeuid", "month", -1, 1, {"c": F.avg("services")}, block=12)
    f = calendar_framed(f, "synthetic_aeuid", "month", 0, 2, {"a": F.sum("services")}, block=12)
    return f.select("synthetic_aeuid", "month", F.round("c", 4).alias("centred3"), F.round("a", 2).alias("ahead3"))


_SHOCK_CAL_SQL = "WITH " + _MONTHLY_SQL + f"""
SELECT synthetic_aeuid, month AS shock_month, round(services, 2) AS services, round(t, 4) AS trailing_avg
FROM (SELECT *, avg(services) OVER {_PREVIOUS} AS t FROM mbs_monthly)
WHERE t > 0 AND services >= 2 * t"""


def _shocks(s):
    return s.select("synthetic_aeuid", F.col("month").alias("shock_month"), F.round("services", 2).alias("services"),
                    F.round("trailing_avg", 4).alias("trailing_avg"))


@query("shock_flags_calendar", views=("mbs",), sql=_SHOCK_CAL_SQL)
def shock_flags_calendar(spark, sf):
    """Months with at least twice the mean of the previous three calendar
    months."""
    return _shocks(calendar_shock_flags(mbs_monthly(spark, sf), "synthetic_aeuid", "month", "services"))


@query("shock_flags_calendar_split", views=("mbs",), sql=_SHOCK_CAL_SQL)
def shock_flags_calendar_split(spark, sf):
    """The same flags with histories split into yearly blocks."""
    return _shocks(calendar_shock_flags(mbs_monthly(spark, sf), "synthetic_aeuid", "month", "services", block=12))


# Every month between a person's first and last, claims or not.
_DENSE_SQL = "WITH " + _MONTHLY_SQL + """,
ends AS (SELECT synthetic_aeuid, min(month) AS a, max(month) AS b FROM mbs_monthly GROUP BY 1),
grid AS (SELECT synthetic_aeuid, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS month FROM ends),
dense AS (SELECT g.synthetic_aeuid, g.month, coalesce(m.services, 0.0) AS services,
                 coalesce(m.claims, 0) AS claims, m.claims IS NULL AS inserted
          FROM grid g LEFT JOIN mbs_monthly m ON g.synthetic_aeuid = m.synthetic_aeuid AND g.month = m.month)
"""


@query("densified_panel", views=("mbs",), sql=_DENSE_SQL + """
SELECT CAST(year(month) AS INTEGER) AS yr, inserted, count(*) AS months, round(sum(services), 2) AS services,
       CAST(sum(claims) AS BIGINT) AS claims FROM dense GROUP BY 1, 2""")
def densified_panel(spark, sf):
    """The person-month panel with its missing months as zeros, by year."""
    d = densify(mbs_monthly(spark, sf).drop("fees"), "synthetic_aeuid", "month", {"services": 0.0, "claims": 0},
                flag="inserted", chunk=time_chunk("month", CHUNK_DAYS))
    return d.groupBy(F.year("month").cast("int").alias("yr"), "inserted").agg(
        F.count(F.lit(1)).alias("months"), F.round(F.sum("services"), 2).alias("services"),
        F.sum("claims").alias("claims"))


@query("trailing_mean_dense", views=("mbs",), sql=_DENSE_SQL + """
SELECT synthetic_aeuid, month, inserted, round(avg(services) OVER (PARTITION BY synthetic_aeuid ORDER BY month
       ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 4) AS trailing_avg FROM dense""")
def trailing_mean_dense(spark, sf):
    """Row frames over the densified panel: three rows are three months."""
    d = densify(mbs_monthly(spark, sf).select("synthetic_aeuid", "month", "services"), "synthetic_aeuid", "month",
                {"services": 0.0}, flag="inserted")
    f = framed(d, "synthetic_aeuid", ["month"], -3, -1, {"t": F.avg("services")})
    return f.select("synthetic_aeuid", "month", "inserted", F.round("t", 4).alias("trailing_avg"))


_SHOCK_DENSE_SQL = _DENSE_SQL + """
SELECT synthetic_aeuid, month AS shock_month, round(services, 2) AS services, round(t, 4) AS trailing_avg
FROM (SELECT *, avg(services) OVER (PARTITION BY synthetic_aeuid ORDER BY month
                                    ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS t FROM dense)
WHERE t > 0 AND services >= 2 * t AND NOT inserted"""


@query("shock_flags_dense", views=("mbs",), sql=_SHOCK_DENSE_SQL)
def shock_flags_dense(spark, sf):
    """Shock flags against the mean of three months in which a month without
    claims counts as zero, on the panel with those months inserted."""
    d = densify(mbs_monthly(spark, sf).select("synthetic_aeuid", "month", "services"), "synthetic_aeuid", "month",
                {"services": 0.0}, flag="inserted")
    return _shocks(shock_flags(d, "synthetic_aeuid", "month", "services").where(~F.col("inserted")))


@query("shock_flags_missing_zero", views=("mbs",), sql=_SHOCK_DENSE_SQL)
def shock_flags_missing_zero(spark, sf):
    """The same flags without inserting rows: calendar sums over the number
    of months since the person's first claim."""
    return _shocks(calendar_shock_flags(mbs_monthly(spark, sf), "synthetic_aeuid", "month", "services",
                                        missing_as_zero=True, block=12))


@query("trailing_mean_years", views=_PANEL_VIEWS, sql="WITH " + _PANEL_SQL + """
SELECT spine_id, rec_id, incm_yr, round(avg(occ_major) OVER (PARTITION BY spine_id ORDER BY incm_yr
       RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS trailing_mean_occ FROM wk_panel""")
def trailing_mean_years(spark, sf):
    """The previous three income years of raw returns: all returns of a year
    are peers, and a year without one shortens the frame."""
    p = wk_panel(spark, sf).select("spine_id", "rec_id", "incm_yr", "occ_major")
    f = calendar_framed(p, "spine_id", "incm_yr", -3, -1, {"t": F.avg("occ_major")}, unit="number", block=4)
    return f.select("spine_id", "rec_id", "incm_yr", F.round("t", 6).alias("trailing_mean_occ"))


@query("pivot_found_years", views=("itr_inc",), sql="""
PIVOT (SELECT incm_yr, CASE WHEN ti_or_lss_amt < 0 THEN 'loss' WHEN ti_or_lss_amt IS NULL THEN 'none' ELSE 'gain' END
              AS result, rec_id FROM itr_inc) ON incm_yr USING count(rec_id) GROUP BY result""")
def pivot_found_years(spark, sf):
    """``pivot_wider`` with the column names found in the data."""
    amount = F.col("ti_or_lss_amt")
    result = F.when(amount < 0, "loss").when(amount.isNull(), "none").otherwise("gain")
    wide = pivot_periods(fx.itr_inc(spark, sf).select(result.alias("result"), "incm_yr", "rec_id"),
                         ["result"], "incm_yr", "rec_id", "count")
    years = [c for c in wide.columns if c != "result"]
    return wide.select("result", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in years])
