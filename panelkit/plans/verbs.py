"""Single-table verbs: filters, counts, scalar functions, ordering,
reshaping (the data-manipulation chapter and T1/T2)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit import fixtures as fx
from panelkit.functions import (
    bucket_floor, case_when, days_between, first_match_replace, floor_div, floor_int,
    floor_mod, normalise_columns, recode, round_doubles, round_half_even_int, trunc_int,
)
from panelkit.functions.expr import order_position
from panelkit.operators.aggregates import group_count, loglog_fit, pivot_wider
from panelkit.operators.sort import arrange, arrange_levels, top_k
from panelkit.operators.windows import first_per_key, last_per_key
from panelkit.plans.registry import query

T1_YEAR = 1998  # the fixture income year standing in for the reference's T1 year


@query("t1_filter_count", views=("itr",), headline=True, sql="""
SELECT count(*) AS n FROM itr WHERE incm_yr = 1998 AND ocptn_grp_cd IS NOT NULL""")
def t1_filter_count(spark, sf):
    """T1: one year, non-NULL occupation, count.  The year is a range on the
    source date, which the scan prunes by."""
    itr = fx.itr(spark, sf, year=T1_YEAR)
    return (itr.where((F.col("incm_yr") == T1_YEAR) & F.col("ocptn_grp_cd").isNotNull())
            .agg(F.count(F.lit(1)).alias("n")))


@query("filter_count_major", views=("itr",), sql="""
SELECT CAST(floor(ocptn_grp_cd / 1000.0) AS INTEGER) AS occ_major, count(*) AS n
FROM itr WHERE incm_yr = 1998 AND ocptn_grp_cd IS NOT NULL GROUP BY 1""")
def filter_count_major(spark, sf):
    itr = fx.itr(spark, sf)
    f = itr.where((F.col("incm_yr") == T1_YEAR) & F.col("ocptn_grp_cd").isNotNull())
    return group_count(f.select(floor_int(F.col("ocptn_grp_cd") / 1000).alias("occ_major")),
                       "occ_major").orderBy("occ_major")


@query("t2_group_count", views=("itr",), headline=True, sql="""
SELECT ocptn_grp_cd, count(*) AS n FROM itr GROUP BY 1""")
def t2_group_count(spark, sf):
    """T2: count per occupation code over all years; NULL is its own group."""
    return group_count(fx.itr(spark, sf), "ocptn_grp_cd")


@query("count_year_group", views=("itr",), headline=True, sql="""
SELECT incm_yr, CAST(floor(ocptn_grp_cd / 1000.0) AS INTEGER) AS occ_major, count(*) AS n
FROM itr WHERE ocptn_grp_cd IS NOT NULL GROUP BY 1, 2""")
def count_year_group(spark, sf):
    itr = fx.itr(spark, sf).where(F.col("ocptn_grp_cd").isNotNull())
    return group_count(itr.select("incm_yr", floor_int(F.col("ocptn_grp_cd") / 1000)
                                  .alias("occ_major")), "incm_yr", "occ_major")


_GENDER_SQL = ("CASE WHEN core_gender = 'M' THEN 'Male' WHEN core_gender = 'F' THEN 'Female' "
               "ELSE 'Other/unknown' END")


def _gender(col="core_gender"):
    g = F.col(col)
    return case_when([(g == "M", "Male"), (g == "F", "Female")], "Other/unknown")


@query("gender_label", views=("demo",), sql=f"""
SELECT CAST(floor(year_of_birth / 10.0) * 10 AS INTEGER) AS birth_decade,
       {_GENDER_SQL} AS gender, count(*) AS n
FROM demo WHERE year_of_birth IS NOT NULL GROUP BY 1, 2 ORDER BY 1, 2""")
def gender_label(spark, sf):
    """mutate + case_when + count + arrange (walk-through mutate/arrange)."""
    d = fx.demo(spark, sf).where(F.col("year_of_birth").isNotNull())
    out = group_count(d.select(bucket_floor("year_of_birth", 10).alias("birth_decade"),
                               _gender().alias("gender")), "birth_decade", "gender")
    return arrange(out, "birth_decade", "gender")


@query("decade_bucket", views=("mbs",), sql="""
SELECT CAST(floor(year(dos) / 10.0) * 10 AS INTEGER) AS decade,
       CAST(floor(numserv / 10.0) * 10 AS INTEGER) AS qty_band, count(*) AS n
FROM mbs GROUP BY 1, 2""")
def decade_bucket(spark, sf):
    """``as.integer(floor(x / k) * k)`` bucketing on int and double inputs."""
    m = fx.mbs(spark, sf)
    return group_count(m.select(bucket_floor(F.year("dos"), 10).alias("decade"),
                                bucket_floor("numserv", 10).alias("qty_band")),
                       "decade", "qty_band")


@query("cast_semantics", views=("itr_inc",), sql="""
SELECT CAST(floor(ti_or_lss_amt / 1000.0) AS INTEGER) AS k_floor,
       CAST(trunc(ti_or_lss_amt / 1000.0) AS INTEGER) AS k_trunc,
       CAST(round_even(ti_or_lss_amt / 1000.0, 0) AS INTEGER) AS k_round,
       count(*) AS n
FROM itr_inc WHERE ti_or_lss_amt IS NOT NULL GROUP BY 1, 2, 3""")
def cast_semantics(spark, sf):
    """floor vs truncate vs round-half-even of a signed amount, side by side
    (they differ for negative and for .5+ values)."""
    x = F.col("ti_or_lss_amt") / 1000
    inc = fx.itr_inc(spark, sf).where(F.col("ti_or_lss_amt").isNotNull())
    return group_count(inc.select(floor_int(x).alias("k_floor"), trunc_int(x).alias("k_trunc"),
                                  round_half_even_int(x).alias("k_round")),
                       "k_floor", "k_trunc", "k_round")


@query("floor_divmod", views=("itr_inc",), sql="""
WITH v AS (SELECT CAST(floor(ti_or_lss_amt) AS BIGINT) AS x FROM itr_inc WHERE ti_or_lss_amt IS NOT NULL)
SELECT CAST(floor(x / 7000.0) AS BIGINT) AS q, count(*) AS n,
       CAST(sum(x - floor(x / 7000.0) * 7000) AS BIGINT) AS r_sum
FROM v GROUP BY 1""")
def floor_divmod(spark, sf):
    """R ``%/%`` and ``%%`` on signed integers (floor semantics)."""
    v = (fx.itr_inc(spark, sf).where(F.col("ti_or_lss_amt").isNotNull())
         .select(F.floor("ti_or_lss_amt").cast("long").alias("x")))
    return (v.groupBy(floor_div("x", F.lit(7000)).alias("q"))
            .agg(F.count(F.lit(1)).alias("n"),
                 F.sum(floor_mod("x", F.lit(7000))).cast("long").alias("r_sum")))


@query("filter_range", views=("itr",), sql="""
SELECT incm_yr, count(*) AS n FROM itr WHERE ocptn_grp_cd >= 2000 AND ocptn_grp_cd < 3000 GROUP BY 1""")
def filter_range(spark, sf):
    """Half-open range on a code."""
    c = F.col("ocptn_grp_cd")
    return group_count(fx.itr(spark, sf).where((c >= 2000) & (c < 3000)), "incm_yr")


@query("filter_between", views=("demo",), sql="""
SELECT core_gender, count(*) AS n FROM demo WHERE year_of_birth BETWEEN 1975 AND 1984 GROUP BY 1""")
def filter_between(spark, sf):
    return group_count(fx.demo(spark, sf).where(F.col("year_of_birth").between(1975, 1984)),
                       "core_gender")


@query("filter_in_list", views=("demo", "itr"), sql="""
SELECT 'demo' AS src, count(*) AS n FROM demo WHERE core_gender IN ('M', 'F')
UNION ALL
SELECT 'itr' AS src, count(*) AS n FROM itr
WHERE CAST(floor(ocptn_grp_cd / 1000.0) AS INTEGER) IN (1, 2, 3, 4, 5, 6, 7, 8)""")
def filter_in_list(spark, sf):
    """``x %in% c("M", "F")`` and ``%in% 1:8``."""
    d = fx.demo(spark, sf).where(F.col("core_gender").isin("M", "F"))
    i = fx.itr(spark, sf).where(floor_int(F.col("ocptn_grp_cd") / 1000).isin(*range(1, 9)))
    return (d.agg(F.count(F.lit(1)).alias("n")).select(F.lit("demo").alias("src"), "n")
            .unionByName(i.agg(F.count(F.lit(1)).alias("n"))
                         .select(F.lit("itr").alias("src"), "n")))


@query("filter_date_range", views=("mbs", "dhda_spine"), sql="""
SELECT count(*) AS claims, round(sum(m.numserv), 2) AS services
FROM mbs m JOIN dhda_spine s ON m.synthetic_aeuid = s.synthetic_aeuid
WHERE m.dos >= DATE '1996-01-01' AND m.dos < DATE '1996-02-01'""")
def filter_date_range(spark, sf):
    """Date-literal half-open filter written before the join (pushed into
    the claim scan either way)."""
    m = fx.mbs(spark, sf).where((F.col("dos") >= F.lit("1996-01-01").cast("date"))
                                & (F.col("dos") < F.lit("1996-02-01").cast("date")))
    j = m.join(fx.dhda_spine(spark, sf), "synthetic_aeuid", "inner")
    return j.agg(F.count(F.lit(1)).alias("claims"),
                 F.round(F.sum("numserv"), 2).alias("services"))


@query("expr_escape", views=("demo",), sql="""
SELECT CAST(floor((2015 - year_of_birth) / 10.0) * 10 AS INTEGER) AS age_bucket, count(*) AS n
FROM demo GROUP BY 1""")
def expr_escape(spark, sf):
    """``mutate(x = sql("..."))``: one literal SQL expression in a pipeline."""
    d = fx.demo(spark, sf).withColumn(
        "age_bucket", F.expr("CAST(floor((2015 - year_of_birth) / 10) * 10 AS INT)"))
    return group_count(d, "age_bucket")


@query("sql_relation", views=("itr",), sql="""
SELECT incm_yr, count(*) AS n, count(ocptn_grp_cd) AS n_coded FROM itr GROUP BY incm_yr""")
def sql_relation(spark, sf):
    """``tbl(con, sql("SELECT ..."))``: a relation from SQL text over a view."""
    return spark.sql("SELECT incm_yr, count(*) AS n, count(ocptn_grp_cd) AS n_coded "
                     "FROM {itr} GROUP BY incm_yr", itr=fx.itr(spark, sf))


@query("distinct_rows", views=("itr",), sql="""
SELECT DISTINCT synthetic_aeuid, incm_yr FROM itr""")
def distinct_rows(spark, sf):
    return fx.itr(spark, sf).select("synthetic_aeuid", "incm_yr").distinct()


@query("dedupe_keep_first", views=("itr",), sql="""
SELECT rec_id, synthetic_aeuid, incm_yr, ocptn_grp_cd FROM itr
QUALIFY row_number() OVER (PARTITION BY synthetic_aeuid, incm_yr ORDER BY rec_id) = 1""")
def dedupe_keep_first(spark, sf):
    """``distinct(k, .keep_all = TRUE)`` with an explicit order: first row
    per key, all columns."""
    return first_per_key(fx.itr(spark, sf), ["synthetic_aeuid", "incm_yr"], ["rec_id"])


@query("round_doubles", views=("itr_inc",), sql="""
SELECT incm_yr, round(avg(ti_or_lss_amt), 2) AS mean_ti, round(min(ti_or_lss_amt), 2) AS min_ti,
       round(max(ti_or_lss_amt), 2) AS max_ti, count(*) AS n
FROM itr_inc GROUP BY 1""")
def round_doubles_q(spark, sf):
    """``mutate(across(where(is.double), round))`` over an aggregate."""
    agg = fx.itr_inc(spark, sf).groupBy("incm_yr").agg(
        F.avg("ti_or_lss_amt").alias("mean_ti"), F.min("ti_or_lss_amt").alias("min_ti"),
        F.max("ti_or_lss_amt").alias("max_ti"), F.count(F.lit(1)).alias("n"))
    return round_doubles(agg, 2)


@query("normalise_columns", views=("demo",), sql="""
SELECT core_gender, count(*) AS n, min(year_of_birth) AS year_of_birth FROM demo GROUP BY 1""")
def normalise_columns_q(spark, sf):
    """SCREAMING_CASE source columns -> ``rename_with(tolower)``."""
    raw = fx.demo(spark, sf).toDF("SPINE_ID", "YEAR_OF_BIRTH", "CORE_GENDER")
    d = normalise_columns(raw)
    return d.groupBy("core_gender").agg(F.count(F.lit(1)).alias("n"),
                                        F.min("year_of_birth").alias("year_of_birth"))


@query("string_fns", views=("stp",), sql="""
SELECT substring(abn_hash_trunc, 1, 1) AS code,
       regexp_replace(abn_hash_trunc, '-', ' ') AS label,
       contains(abn_hash_trunc, 'URGENT') AS urgent,
       concat_ws('_', 'emp', substring(abn_hash_trunc, 1, 1)) AS tag,
       count(*) AS n
FROM stp WHERE abn_hash_trunc IS NOT NULL GROUP BY 1, 2, 3, 4""")
def string_fns(spark, sf):
    """str_sub, sub (first match only), str_detect, paste."""
    s = fx.stp(spark, sf).where(F.col("abn_hash_trunc").isNotNull())
    a = F.col("abn_hash_trunc")
    code = F.substring(a, 1, 1)
    return group_count(s.select(code.alias("code"),
                                first_match_replace(a, "-", " ").alias("label"),
                                a.contains("URGENT").alias("urgent"),
                                F.concat_ws("_", F.lit("emp"), code).alias("tag")),
                       "code", "label", "urgent", "tag")


@query("string_first_match", views=("stp",), sql="""
SELECT regexp_replace(abn_hash_trunc, '(E|I|O)([A-Z])', '\\2\\1') AS swapped,
       regexp_replace(abn_hash_trunc, 'U|N|T', '.') AS masked, count(*) AS n
FROM stp WHERE abn_hash_trunc IS NOT NULL GROUP BY 1, 2""")
def string_first_match(spark, sf):
    """``sub`` with groups and with alternation: the first match only."""
    a = F.col("abn_hash_trunc")
    s = fx.stp(spark, sf).where(a.isNotNull())
    return group_count(s.select(first_match_replace(a, "(E|I|O)([A-Z])", "$2$1").alias("swapped"),
                                first_match_replace(a, "U|N|T", ".").alias("masked")), "swapped", "masked")


@query("date_parts", views=("stp",), sql="""
SELECT CAST(year(week_ending) AS INTEGER) AS yr, CAST(month(week_ending) AS INTEGER) AS mon,
       CAST(year(week_ending) || '-01-01' AS DATE) AS year_start,
       count(*) AS n, CAST(sum(day(week_ending)) AS BIGINT) AS day_sum
FROM stp GROUP BY 1, 2, 3""")
def date_parts(spark, sf):
    """year(), month(), day(), as.Date() from text."""
    s = fx.stp(spark, sf)
    yr = F.year("week_ending").cast("int")
    return (s.groupBy(yr.alias("yr"), F.month("week_ending").cast("int").alias("mon"),
                      F.to_date(F.concat(yr.cast("string"), F.lit("-01-01"))).alias("year_start"))
            .agg(F.count(F.lit(1)).alias("n"),
                 F.sum(F.dayofmonth("week_ending")).cast("long").alias("day_sum")))


@query("date_diff_days", views=("stp",), sql="""
SELECT synthetic_aeuid, CAST(max(week_ending) - min(week_ending) AS INTEGER) AS span_days,
       count(*) AS n FROM stp GROUP BY 1""")
def date_diff_days(spark, sf):
    """``difftime(last, first, units = "days")`` per person."""
    s = fx.stp(spark, sf).groupBy("synthetic_aeuid").agg(
        F.max("week_ending").alias("last"), F.min("week_ending").alias("first"),
        F.count(F.lit(1)).alias("n"))
    return s.select("synthetic_aeuid", days_between("last", "first").alias("span_days"), "n")


# Fixed label values of the service-type recode.
BTOS_LABELS = {"GP": "GP", "SP": "Specialist", "P": "Pathology", "O": "Other"}


@query("recode_labels", views=("mbs",), sql="""
SELECT CASE btos WHEN 'GP' THEN 'GP' WHEN 'SP' THEN 'Specialist' WHEN 'P' THEN 'Pathology'
                 WHEN 'O' THEN 'Other' ELSE btos END AS btos_label,
       CAST(CAST(year(dos) AS INTEGER) AS VARCHAR) AS year_label,
       round(sum(numserv), 2) AS services
FROM mbs GROUP BY 1, 2""")
def recode_labels(spark, sf):
    """``recode`` value map and ``as.character`` labels."""
    m = fx.mbs(spark, sf)
    return (m.groupBy(recode("btos", BTOS_LABELS).alias("btos_label"),
                      F.year("dos").cast("int").cast("string").alias("year_label"))
            .agg(F.round(F.sum("numserv"), 2).alias("services")))


@query("sort_multi", views=("demo",), sql="""
SELECT year_of_birth, core_gender, count(*) AS n FROM demo GROUP BY 1, 2
ORDER BY year_of_birth NULLS LAST, core_gender NULLS LAST""")
def sort_multi(spark, sf):
    return arrange(group_count(fx.demo(spark, sf), "year_of_birth", "core_gender"),
                   "year_of_birth", "core_gender")


@query("topk", views=("mbs",), sql="""
SELECT synthetic_aeuid, round(sum(numserv), 2) AS services FROM mbs GROUP BY 1
ORDER BY services DESC, synthetic_aeuid LIMIT 10""")
def topk(spark, sf):
    """The ten heaviest service users (ties broken by id)."""
    per = fx.mbs(spark, sf).groupBy("synthetic_aeuid").agg(
        F.round(F.sum("numserv"), 2).alias("services"))
    return top_k(per, 10, ["services"], tiebreak=["synthetic_aeuid"])


@query("custom_order", views=("mbs",), sql="""
SELECT btos, list_position(['GP', 'SP', 'P'], btos) AS level_pos, count(*) AS claims
FROM mbs GROUP BY 1 ORDER BY level_pos NULLS LAST""")
def custom_order(spark, sf):
    """``arrange(match(btos, levels))``."""
    levels = ["GP", "SP", "P"]
    per = group_count(fx.mbs(spark, sf), "btos", name="claims")
    return arrange_levels(per.withColumn("level_pos", order_position("btos", levels)),
                          "btos", levels)


@query("inline_values", views=("demo",), sql="""
WITH labels(core_gender, label) AS (VALUES ('M', 'Male'), ('F', 'Female'), ('X', 'Other/unknown'))
SELECT l.label, count(*) AS n FROM demo d JOIN labels l ON d.core_gender = l.core_gender GROUP BY 1""")
def inline_values(spark, sf):
    """A literal lookup table (``tribble``) joined to the people table.  The
    literal has three rows, so broadcasting it is size-safe by construction."""
    labels = spark.createDataFrame(
        [("M", "Male"), ("F", "Female"), ("X", "Other/unknown")],
        T.StructType([T.StructField("core_gender", T.StringType()),
                      T.StructField("label", T.StringType())]))
    j = fx.demo(spark, sf).join(F.broadcast(labels), "core_gender", "inner")
    return group_count(j, "label")


@query("pivot_metrics", views=("mbs",), sql="""
WITH s AS (SELECT CAST(year(dos) AS INTEGER) AS yr, btos, round(sum(numserv), 2) AS services
           FROM mbs GROUP BY 1, 2)
SELECT yr, max(services) FILTER (WHERE btos = 'GP') AS GP, max(services) FILTER (WHERE btos = 'SP') AS SP,
       max(services) FILTER (WHERE btos = 'P') AS P FROM s GROUP BY 1""")
def pivot_metrics(spark, sf):
    """``pivot_wider(names_from = btos, values_from = services)``."""
    long = fx.mbs(spark, sf).groupBy(F.year("dos").cast("int").alias("yr"), "btos").agg(
        F.round(F.sum("numserv"), 2).alias("services"))
    return pivot_wider(long, ["yr"], "btos", "services", ["GP", "SP", "P"])


@query("loglog_fit", views=("mbs",), sql="""
SELECT btos, round(regr_slope(log10(feecharged), log10(numserv)), 6) AS slope,
       round(regr_intercept(log10(feecharged), log10(numserv)), 6) AS intercept, count(*) AS n
FROM mbs WHERE numserv > 0 AND feecharged > 0 GROUP BY 1""")
def loglog_fit_q(spark, sf):
    """Log-log linear fit per group (the trend line of the size plots)."""
    fit = loglog_fit(fx.mbs(spark, sf), ["btos"], "numserv", "feecharged")
    return fit.select("btos", F.round("slope", 6).alias("slope"),
                      F.round("intercept", 6).alias("intercept"), "n")


@query("latest_per_key", views=("stp",), sql="""
SELECT synthetic_aeuid, week_ending, rec_id, abn_hash_trunc FROM stp
QUALIFY row_number() OVER (PARTITION BY synthetic_aeuid ORDER BY week_ending DESC, rec_id DESC) = 1""")
def latest_per_key(spark, sf):
    """Latest row per key (max time, then highest record id)."""
    s = fx.stp(spark, sf).select("synthetic_aeuid", "week_ending", "rec_id", "abn_hash_trunc")
    return last_per_key(s, ["synthetic_aeuid"], ["week_ending", "rec_id"])


@query("union_all_n", views=("itr", "itr_inc", "stp"), sql="""
SELECT incm_yr, source, n FROM (
  SELECT incm_yr, 'itr' AS source, count(*) AS n FROM itr GROUP BY 1
  UNION ALL SELECT incm_yr, 'itr_inc' AS source, count(*) AS n FROM itr_inc WHERE ti_or_lss_amt IS NOT NULL GROUP BY 1
  UNION ALL SELECT CAST(year(week_ending) AS INTEGER) AS incm_yr, 'stp' AS source, count(*) AS n
            FROM stp WHERE abn_hash_trunc IS NOT NULL GROUP BY 1)
UNION ALL
SELECT incm_yr, 'all' AS source, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT incm_yr, count(*) AS n FROM itr GROUP BY 1
  UNION ALL SELECT incm_yr, count(*) AS n FROM itr_inc WHERE ti_or_lss_amt IS NOT NULL GROUP BY 1
  UNION ALL SELECT CAST(year(week_ending) AS INTEGER) AS incm_yr, count(*) AS n
            FROM stp WHERE abn_hash_trunc IS NOT NULL GROUP BY 1) GROUP BY 1""")
def union_all_n(spark, sf):
    """Per-source yearly counts stacked with an n-ary ``union_all`` (no
    shuffle), plus their re-aggregation across sources."""
    from panelkit.operators.sets import union_all
    parts = [
        group_count(fx.itr(spark, sf), "incm_yr").withColumn("source", F.lit("itr")),
        group_count(fx.itr_inc(spark, sf).where(F.col("ti_or_lss_amt").isNotNull()), "incm_yr")
        .withColumn("source", F.lit("itr_inc")),
        group_count(fx.stp(spark, sf).where(F.col("abn_hash_trunc").isNotNull())
                    .select(F.year("week_ending").cast("int").alias("incm_yr")), "incm_yr")
        .withColumn("source", F.lit("stp")),
    ]
    stacked = union_all(parts)
    total = stacked.groupBy("incm_yr").agg(F.sum("n").cast("long").alias("n")) \
        .withColumn("source", F.lit("all"))
    return union_all([stacked.select("incm_yr", "source", "n"),
                      total.select("incm_yr", "source", "n")])
