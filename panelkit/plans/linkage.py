"""Linkage queries: the spine joins of the joins chapter and the T3/T-narrow
benchmarks, run over the panel views."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit import fixtures as fx
from panelkit.functions.expr import bucket_floor, floor_int, hash_key
from panelkit.operators import joins as J
from panelkit.operators.aggregates import group_count, having_between
from panelkit.operators.quality import key_profile
from panelkit.operators.sort import arrange
from panelkit.plans.registry import query
from panelkit.session import scratch_path
from panelkit.sources import layout

# Fixed parameters of the fixture mapping: the reference's "2014 -> 2015"
# transition years map to these fixture income years.
YEAR_FROM, YEAR_TO = 1997, 1998
REF_YEAR = 2015  # age reference year of the three-way joins


def _managers(spark, sf):
    """Managers (occupation 1000-1999) in YEAR_FROM, one row per person
    (lowest rec_id), and everyone's non-NULL occupation in YEAR_TO."""
    itr = fx.itr(spark, sf)
    first = _dedupe_itr(itr)
    mgrs = (first.where((F.col("incm_yr") == YEAR_FROM)
                        & J.range_cond(F.col("ocptn_grp_cd"), 1000, 2000))
            .select("synthetic_aeuid", F.col("ocptn_grp_cd").alias("occ_14")))
    y15 = (first.where((F.col("incm_yr") == YEAR_TO) & F.col("ocptn_grp_cd").isNotNull())
           .select("synthetic_aeuid", F.col("ocptn_grp_cd").alias("occ_15")))
    return mgrs, y15


def _dedupe_itr(itr):
    """One row per person-year (lowest rec_id): itr is not unique there."""
    from panelkit.operators.windows import first_per_key
    return first_per_key(itr, ["synthetic_aeuid", "incm_yr"], ["rec_id"])


_DEDUP_SQL = """
itr1 AS (SELECT * FROM itr QUALIFY row_number() OVER (PARTITION BY synthetic_aeuid, incm_yr ORDER BY rec_id) = 1),
mgrs AS (SELECT synthetic_aeuid, ocptn_grp_cd AS occ_14 FROM itr1
         WHERE incm_yr = 1997 AND ocptn_grp_cd >= 1000 AND ocptn_grp_cd < 2000),
y15 AS (SELECT synthetic_aeuid, ocptn_grp_cd AS occ_15 FROM itr1
        WHERE incm_yr = 1998 AND ocptn_grp_cd IS NOT NULL)
"""


@query("join_inner_transition", views=("itr",), sql="WITH " + _DEDUP_SQL + """
SELECT CAST(floor(occ_15 / 1000.0) AS INTEGER) AS occ_major_15,
       CAST(floor(occ_15 / 1000.0) AS INTEGER) = 1 AS still_mgr, count(*) AS n
FROM mgrs JOIN y15 USING (synthetic_aeuid) GROUP BY 1, 2""")
def join_inner_transition(spark, sf):
    mgrs, y15 = _managers(spark, sf)
    j = mgrs.join(y15, "synthetic_aeuid", "inner")
    major = floor_int(F.col("occ_15") / 1000)
    return group_count(j.select(major.alias("occ_major_15"),
                                (major == 1).alias("still_mgr")),
                       "occ_major_15", "still_mgr")


@query("join_left_flag", views=("itr",), sql="WITH " + _DEDUP_SQL + """
SELECT occ_15 IS NOT NULL AS filed_2015, count(*) AS n
FROM mgrs LEFT JOIN y15 USING (synthetic_aeuid) GROUP BY 1""")
def join_left_flag(spark, sf):
    mgrs, y15 = _managers(spark, sf)
    return group_count(J.join_flag(mgrs, y15, "synthetic_aeuid", "filed_2015", "occ_15"),
                       "filed_2015")


@query("join_semi", views=("itr",), sql="WITH " + _DEDUP_SQL + """
SELECT count(*) AS n FROM mgrs WHERE synthetic_aeuid IN (SELECT synthetic_aeuid FROM y15)""")
def join_semi(spark, sf):
    mgrs, y15 = _managers(spark, sf)
    return J.in_table(mgrs, y15.select("synthetic_aeuid"), "synthetic_aeuid") \
        .agg(F.count(F.lit(1)).alias("n"))


@query("join_anti", views=("itr",), sql="WITH " + _DEDUP_SQL + """
SELECT count(*) AS n FROM mgrs
WHERE NOT EXISTS (SELECT 1 FROM y15 WHERE y15.synthetic_aeuid = mgrs.synthetic_aeuid)""")
def join_anti(spark, sf):
    mgrs, y15 = _managers(spark, sf)
    return J.in_table(mgrs, y15.select("synthetic_aeuid"), "synthetic_aeuid", negate=True) \
        .agg(F.count(F.lit(1)).alias("n"))


@query("join_full_coverage", views=("ato_known", "dhda_known"), sql="""
SELECT coalesce(a.in_ato, false) AS in_ato, coalesce(d.in_dhda, false) AS in_dhda, count(*) AS n
FROM (SELECT spine_id, true AS in_ato FROM ato_known) a
FULL OUTER JOIN (SELECT spine_id, true AS in_dhda FROM dhda_known) d ON a.spine_id = d.spine_id
GROUP BY 1, 2""")
def join_full_coverage(spark, sf):
    return J.coverage(fx.ato_known(spark, sf), fx.dhda_known(spark, sf), "spine_id",
                      "in_ato", "in_dhda")


@query("join_composite", views=("itr", "itr_inc"), sql="""
WITH c AS (SELECT synthetic_aeuid, incm_yr, min(rec_id) AS rec_id FROM itr GROUP BY 1, 2),
     i AS (SELECT synthetic_aeuid, incm_yr, max(ti_or_lss_amt) AS ti FROM itr_inc GROUP BY 1, 2)
SELECT c.incm_yr, count(*) AS n, round(sum(i.ti), 2) AS ti_total
FROM c JOIN i ON c.synthetic_aeuid = i.synthetic_aeuid AND c.incm_yr = i.incm_yr
GROUP BY 1""")
def join_composite(spark, sf):
    """ITR context x ITR income on the shared (person, year) key."""
    c = fx.itr(spark, sf).groupBy("synthetic_aeuid", "incm_yr").agg(F.min("rec_id").alias("rec_id"))
    i = fx.itr_inc(spark, sf).groupBy("synthetic_aeuid", "incm_yr") \
        .agg(F.max("ti_or_lss_amt").alias("ti"))
    j = c.join(i, ["synthetic_aeuid", "incm_yr"], "inner")
    return j.groupBy("incm_yr").agg(F.count(F.lit(1)).alias("n"),
                                    F.round(F.sum("ti"), 2).alias("ti_total"))


def _people(spark, sf):
    """People aged 0-99 in the reference year, with their age."""
    d = fx.demo(spark, sf).select("spine_id", "year_of_birth", "core_gender")
    d = d.withColumn("age_2015", F.lit(REF_YEAR) - F.col("year_of_birth"))
    return d.where((F.col("age_2015") >= 0) & (F.col("age_2015") < 100))


def _claims_rollup(spark, sf, group_by, sums, fact_group=()):
    """people x health spine x claims, claims pre-aggregated per person."""
    m = fx.mbs(spark, sf).select("synthetic_aeuid", *sums.values(), *fact_group)
    return J.star_rollup(_people(spark, sf), fx.dhda_spine(spark, sf), m, "spine_id",
                         "synthetic_aeuid", group_by, sums, "claims", fact_group)


_STAR_SQL = """
FROM demo d JOIN dhda_spine s ON d.spine_id = s.spine_id
JOIN mbs m ON s.synthetic_aeuid = m.synthetic_aeuid
WHERE 2015 - d.year_of_birth >= 0 AND 2015 - d.year_of_birth < 100"""


@query("three_way_age_decade", views=("demo", "dhda_spine", "mbs"), headline=True, sql=f"""
SELECT CAST(floor((2015 - d.year_of_birth) / 10.0) * 10 AS INTEGER) AS age_decade, d.core_gender,
       round(sum(m.numserv), 2) AS services, round(sum(m.feecharged), 2) AS fees, count(*) AS claims
{_STAR_SQL} GROUP BY 1, 2""")
def three_way_age_decade(spark, sf):
    r = _claims_rollup(spark, sf, [bucket_floor("age_2015", 10).alias("age_decade"), "core_gender"],
                       {"services": "numserv", "fees": "feecharged"})
    return r.select("age_decade", "core_gender", F.round("services", 2).alias("services"),
                    F.round("fees", 2).alias("fees"), "claims")


@query("three_way_age_5yr", views=("demo", "dhda_spine", "mbs"), sql=f"""
SELECT d.core_gender, CAST(floor((2015 - d.year_of_birth) / 5.0) * 5 AS INTEGER) AS age_group,
       round(sum(m.numserv), 2) AS services, round(sum(m.feecharged), 2) AS fee_charged,
       count(*) AS claims
{_STAR_SQL} GROUP BY 1, 2""")
def three_way_age_5yr(spark, sf):
    r = _claims_rollup(spark, sf, ["core_gender", bucket_floor("age_2015", 5).alias("age_group")],
                       {"services": "numserv", "fee_charged": "feecharged"})
    return r.select("core_gender", "age_group", F.round("services", 2).alias("services"),
                    F.round("fee_charged", 2).alias("fee_charged"), "claims")


@query("three_way_by_type", views=("demo", "dhda_spine", "mbs"), sql=f"""
SELECT d.core_gender, CAST(floor((2015 - d.year_of_birth) / 10.0) * 10 AS INTEGER) AS age_group,
       m.btos, round(sum(m.numserv), 2) AS services, count(*) AS claims
{_STAR_SQL} GROUP BY 1, 2, 3""")
def three_way_by_type(spark, sf):
    age_group = (F.floor(F.col("age_2015") / 10) * 10).cast("int")  # %/% then * 10
    r = _claims_rollup(spark, sf, ["core_gender", age_group.alias("age_group"), "btos"],
                       {"services": "numserv"}, fact_group=["btos"])
    return r.select("core_gender", "age_group", "btos",
                    F.round("services", 2).alias("services"), "claims")


@query("t3_three_way", views=("demo", "dhda_spine", "mbs"), headline=True, sql="""
SELECT CAST(floor((2015 - d.year_of_birth) / 10.0) * 10 AS INTEGER) AS age_decade,
       d.core_gender AS core_gender, round(sum(m.numserv), 2) AS services, count(*) AS claims
FROM demo d JOIN dhda_spine s ON d.spine_id = s.spine_id
JOIN mbs m ON s.synthetic_aeuid = m.synthetic_aeuid GROUP BY 1, 2
ORDER BY 1 NULLS LAST, 2 NULLS LAST""")
def t3_three_way(spark, sf):
    """T3: the three-table join with no age filter, grouped by an expression
    (decade of age) and ordered; spine key renamed on both sides first."""
    d = fx.demo(spark, sf).withColumnRenamed("spine_id", "SPINE_ID")
    s = fx.dhda_spine(spark, sf).withColumnRenamed("spine_id", "SPINE_ID")
    m = fx.mbs(spark, sf).select("synthetic_aeuid", "numserv")
    decade = bucket_floor(F.lit(REF_YEAR) - F.col("year_of_birth"), 10)
    r = J.star_rollup(d, s, m, "SPINE_ID", "synthetic_aeuid",
                      [decade.alias("age_decade"), "core_gender"], {"services": "numserv"}, "claims")
    return arrange(r.select("age_decade", "core_gender", F.round("services", 2).alias("services"), "claims"),
                   "age_decade", "core_gender")


@query("narrow_three_way", views=("demo", "dhda_spine", "mbs"), headline=True, sql="""
SELECT count(*) AS claims, round(sum(m.numserv), 2) AS services
FROM demo d JOIN dhda_spine s ON d.spine_id = s.spine_id
JOIN mbs m ON s.synthetic_aeuid = m.synthetic_aeuid WHERE d.year_of_birth = 1970""")
def narrow_three_way(spark, sf):
    """Birth year = 1970 filter before the joins.  The people are stored once
    clustered by birth year, so the filter reaches the scan as a value; the
    runtime bloom filter carries the small key set to the claim scan."""
    people = stored_once(spark, "demo-by-year", fx.demo(spark, sf), lambda d, path: layout.write_clustered(
        d, path, ["year_of_birth", "spine_id"], row_group_rows=10_000))
    d = people.where(F.col("year_of_birth") == 1970).select("spine_id")
    m = fx.mbs(spark, sf).select("synthetic_aeuid", "numserv")
    j = J.star_join(d, fx.dhda_spine(spark, sf), m, "spine_id", "synthetic_aeuid")
    return j.agg(F.count(F.lit(1)).alias("claims"),
                 F.round(F.sum("numserv"), 2).alias("services"))


_STORED: dict[tuple, str] = {}


def stored_once(spark, name: str, df, write):
    """``df`` laid out by ``write(df, path)`` once per application and set of
    source files; later queries read the stored table.  New source files
    make a new one."""
    key = (spark.sparkContext.applicationId, name, *sorted(df.inputFiles()))
    if key not in _STORED:
        path = scratch_path(spark, name)
        write(df, path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def stored_by_hash(spark, name: str, df):
    """``df`` stored with the integer surrogate of its person id, clustered
    by it: queries read the stored key and never hash."""
    return stored_once(spark, name, df, lambda d, path: layout.write_clustered(
        d.withColumn("aeuid_hash", hash_key("synthetic_aeuid")), path, ["aeuid_hash"], row_group_rows=10_000))


@query("join_intkey", views=("demo", "dhda_spine", "mbs"), sql="""
SELECT count(*) AS claims, round(sum(m.numserv), 2) AS services
FROM demo d JOIN dhda_spine s ON d.spine_id = s.spine_id
JOIN mbs m ON s.synthetic_aeuid = m.synthetic_aeuid WHERE d.year_of_birth BETWEEN 1960 AND 1979""")
def join_intkey(spark, sf):
    """Narrow join of the stored tables on the stored 64-bit surrogate,
    guarded by the id itself."""
    d = fx.demo(spark, sf).where(F.col("year_of_birth").between(1960, 1979)).select("spine_id")
    s = stored_by_hash(spark, "spine-by-hash", fx.dhda_spine(spark, sf))
    m = stored_by_hash(spark, "mbs-by-hash", fx.mbs(spark, sf)).select(
        "synthetic_aeuid", "aeuid_hash", "numserv")
    j = J.stored_key_join(d.join(s, "spine_id"), m, "aeuid_hash", "synthetic_aeuid")
    return j.agg(F.count(F.lit(1)).alias("claims"),
                 F.round(F.sum("numserv"), 2).alias("services"))


@query("point_lookup_hash", views=("mbs",), sql="""
SELECT count(*) AS n, round(sum(numserv), 2) AS services FROM mbs WHERE synthetic_aeuid = 'D100'""")
def point_lookup_hash(spark, sf):
    """One person's claims by the stored surrogate: the id is hashed once,
    to a constant that min/max statistics prune by; the id guards it."""
    m = stored_by_hash(spark, "mbs-by-hash", fx.mbs(spark, sf))
    return m.where((F.col("aeuid_hash") == hash_key(F.lit("D100"))) & (F.col("synthetic_aeuid") == "D100")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("numserv"), 2).alias("services"))


@query("crosswalk_build", views=("ato_spine", "dhda_spine"), sql="""
SELECT a.synthetic_aeuid AS ato_aeuid, d.synthetic_aeuid AS dhda_aeuid
FROM ato_spine a JOIN dhda_spine d ON a.spine_id = d.spine_id""")
def crosswalk_build(spark, sf):
    return J.crosswalk(fx.ato_spine(spark, sf), fx.dhda_spine(spark, sf),
                       "ato_aeuid", "dhda_aeuid")


@query("crosswalk_link", views=("ato_spine", "dhda_spine", "itr_inc", "mbs"), sql="""
WITH cw AS (SELECT a.synthetic_aeuid AS ato_aeuid, d.synthetic_aeuid AS dhda_aeuid
            FROM ato_spine a JOIN dhda_spine d ON a.spine_id = d.spine_id),
inc AS (SELECT synthetic_aeuid, round(sum(ti_or_lss_amt), 2) AS income FROM itr_inc GROUP BY 1),
svc AS (SELECT synthetic_aeuid, round(sum(numserv), 2) AS services FROM mbs GROUP BY 1)
SELECT cw.ato_aeuid AS synthetic_aeuid, cw.dhda_aeuid, inc.income, svc.services
FROM inc JOIN cw ON inc.synthetic_aeuid = cw.ato_aeuid
JOIN svc ON svc.synthetic_aeuid = cw.dhda_aeuid""")
def crosswalk_link(spark, sf):
    """Per-person income (ATO ids) linked to per-person services (health
    ids) through the crosswalk, using renamed-key joins."""
    cw = J.crosswalk(fx.ato_spine(spark, sf), fx.dhda_spine(spark, sf), "ato_aeuid", "dhda_aeuid")
    inc = fx.itr_inc(spark, sf).groupBy("synthetic_aeuid") \
        .agg(F.round(F.sum("ti_or_lss_amt"), 2).alias("income"))
    svc = fx.mbs(spark, sf).groupBy("synthetic_aeuid") \
        .agg(F.round(F.sum("numserv"), 2).alias("services"))
    j = J.join_renamed(inc, cw, "synthetic_aeuid", "ato_aeuid")
    j = J.join_renamed(j, svc, "dhda_aeuid", "synthetic_aeuid")
    return j.select("synthetic_aeuid", "dhda_aeuid", "income", "services")


@query("point_lookup", views=("mbs",), headline=True, sql="""
SELECT count(*) AS n, round(sum(numserv), 2) AS services FROM mbs WHERE synthetic_aeuid = 'D100'""")
def point_lookup(spark, sf):
    """Everything for one person.  The id is the customer key with a prefix,
    so the lookup is stated on the key and reaches the scan as a value; the
    lookup by the id itself is ``layout_sorted_point``."""
    m = fx.mbs(spark, sf, person=100)
    return m.where(F.col("synthetic_aeuid") == "D100").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("numserv"), 2).alias("services"))


@query("having_pick_target", views=("mbs",), sql="""
SELECT synthetic_aeuid, n FROM (SELECT synthetic_aeuid, count(*) AS n FROM mbs GROUP BY 1)
WHERE n BETWEEN 25 AND 40 ORDER BY synthetic_aeuid LIMIT 1""")
def having_pick_target(spark, sf):
    """``GROUP BY id HAVING count(*) BETWEEN 25 AND 40 LIMIT 1`` made
    deterministic by ordering on the id before the limit."""
    return having_between(fx.mbs(spark, sf), "synthetic_aeuid", 25, 40) \
        .orderBy("synthetic_aeuid").limit(1)


@query("key_integrity", views=("dhda_spine",), sql="""
WITH k AS (SELECT spine_id, count(*) AS c FROM dhda_spine GROUP BY 1)
SELECT CAST(sum(c) AS BIGINT) AS rows, CAST(coalesce(sum(c) FILTER (WHERE spine_id IS NULL), 0) AS BIGINT) AS null_keys,
       count(*) FILTER (WHERE spine_id IS NOT NULL) AS distinct_keys,
       count(*) FILTER (WHERE spine_id IS NOT NULL AND c > 1) AS duplicated_keys FROM k""")
def key_integrity(spark, sf):
    return key_profile(fx.dhda_spine(spark, sf), ["spine_id"])


@query("hash_key_values", views=("dhda_spine",), sql=None)
def hash_key_values(spark, sf):
    """Integer surrogate column (values are Spark's xxhash64, which no other
    engine reproduces, so only the row count is comparable)."""
    return fx.dhda_spine(spark, sf).select("synthetic_aeuid",
                                           hash_key("synthetic_aeuid").alias("aeuid_hash"))


@query("hash_key_distinct", views=("dhda_spine",), sql="""
SELECT count(DISTINCT synthetic_aeuid) AS ids, count(DISTINCT synthetic_aeuid) AS hashes FROM dhda_spine""")
def hash_key_distinct(spark, sf):
    """The surrogate tells the ids apart: as many hashes as ids."""
    s = fx.dhda_spine(spark, sf)
    return s.agg(F.count_distinct("synthetic_aeuid").alias("ids"),
                 F.count_distinct(hash_key("synthetic_aeuid")).alias("hashes"))
