"""Panel views over the driver's test tables.

The administrative-panel tables the operators are written for (people,
agency spines, tax returns, claims, payroll) are derived here from the
TPC-H-style parquet in ``sf_dir``.  Each view is a plain projection of the
source tables, so every query built on top of them still scans, prunes and
shuffles the real files and grows with them.

``VIEW_SQL`` holds the same definitions as SQL text; the DuckDB oracle uses
them as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The base table's parquet scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _aeuid(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), key.cast("string"))


def demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per person: spine_id, year_of_birth, core_gender."""
    c = table(spark, sf_dir, "customer")
    seg = F.col("c_mktsegment")
    return c.select(
        F.col("c_custkey").alias("spine_id"),
        (F.lit(1915) + (F.col("c_custkey") * 7) % 100).cast("int").alias("year_of_birth"),
        F.when(seg.isin("AUTOMOBILE", "BUILDING"), "M")
         .when(seg.isin("FURNITURE", "HOUSEHOLD"), "F")
         .otherwise("X").alias("core_gender"),
    )


def ato_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ATO identifier -> spine_id (nullable spine_id)."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        F.when(k % 250 == 0, F.lit(None)).otherwise(k).alias("spine_id"),
        _aeuid("A", k).alias("synthetic_aeuid"),
    )


def dhda_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health identifier -> spine_id (nullable spine_id)."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        F.when(k % 250 == 1, F.lit(None)).otherwise(k).alias("spine_id"),
        _aeuid("D", k).alias("synthetic_aeuid"),
    )


def ato_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ATO spine with people missing, for the coverage matrix, which
    counts who is in one spine and not in the other."""
    return ato_spine(spark, sf_dir).where(F.substring("synthetic_aeuid", 2, 20).cast("long") % 40 != 7)


def dhda_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The health spine with people missing, for the coverage matrix."""
    return dhda_spine(spark, sf_dir).where(F.substring("synthetic_aeuid", 2, 20).cast("long") % 50 != 3)


def itr(spark: SparkSession, sf_dir: str, year: int | None = None) -> DataFrame:
    """Tax-return context: person x income year x occupation code; of one
    income year, when given, by a range on the source date."""
    o = table(spark, sf_dir, "orders")
    if year is not None:
        day = F.col("o_orderdate")
        o = o.where((day >= F.lit(f"{year}-01-01").cast(o.schema["o_orderdate"].dataType))
                    & (day < F.lit(f"{year + 1}-01-01").cast(o.schema["o_orderdate"].dataType)))
    k = F.col("o_orderkey")
    return o.select(
        k.alias("rec_id"),
        _aeuid("A", F.col("o_custkey")).alias("synthetic_aeuid"),
        F.year("o_orderdate").cast("int").alias("incm_yr"),
        F.when(k % 13 == 0, F.lit(None).cast("int"))
         .otherwise((F.lit(1000) + (k * 31) % 8000).cast("int")).alias("ocptn_grp_cd"),
    )


def itr_inc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax-return income: taxable income or loss (nullable, may be < 0)."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("rec_id"),
        _aeuid("A", F.col("o_custkey")).alias("synthetic_aeuid"),
        F.year("o_orderdate").cast("int").alias("incm_yr"),
        F.when(k % 17 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("o_totalprice") - 20000).alias("ti_or_lss_amt"),
    )


def mbs(spark: SparkSession, sf_dir: str, person: int | None = None) -> DataFrame:
    """Health claims: one row per claim line; of one person, when given, by a
    predicate on the source key."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_returnflag")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    if person is not None:
        o = o.where(F.col("o_custkey") == person)
    rf = F.col("l_returnflag")
    return li.join(o, li.l_orderkey == o.o_orderkey, "inner").select(
        _aeuid("D", F.col("o_custkey")).alias("synthetic_aeuid"),
        F.col("l_shipdate").cast("date").alias("dos"),
        F.col("l_quantity").alias("numserv"),
        F.col("l_extendedprice").alias("feecharged"),
        F.when(rf == "A", "GP").when(rf == "N", "SP").otherwise("P").alias("btos"),
    )


def stp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payroll events: person x pay date x employer (nullable)."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("rec_id"),
        _aeuid("A", F.col("o_custkey")).alias("synthetic_aeuid"),
        F.col("o_orderdate").cast("date").alias("week_ending"),
        F.when(k % 19 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("o_orderpriority")).alias("abn_hash_trunc"),
        F.col("o_totalprice").alias("pmt_sumry_totl_grs_pmt_amt"),
    )


VIEWS = {
    "demo": demo, "ato_spine": ato_spine, "dhda_spine": dhda_spine,
    "ato_known": ato_known, "dhda_known": dhda_known,
    "itr": itr, "itr_inc": itr_inc, "mbs": mbs, "stp": stp,
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return VIEWS[name](spark, sf_dir)


def register_all(spark: SparkSession, sf_dir: str) -> None:
    """Register every panel view (and the raw tables) as temp views."""
    for name in ("customer", "orders", "lineitem", "events", "nation", "region",
                 "supplier", "part"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    for name, fn in VIEWS.items():
        fn(spark, sf_dir).createOrReplaceTempView(name)


# Fixed view definitions shared with the oracle (plain SQL that DuckDB runs
# over the pre-registered base tables).
VIEW_SQL = {
    "demo": "SELECT c_custkey AS spine_id, CAST(1915 + (c_custkey*7)%100 AS INT) AS year_of_birth, "
            "CASE WHEN c_mktsegment IN ('AUTOMOBILE','BUILDING') THEN 'M' "
            "WHEN c_mktsegment IN ('FURNITURE','HOUSEHOLD') THEN 'F' ELSE 'X' END AS core_gender "
            "FROM customer",
    "ato_spine": "SELECT CASE WHEN c_custkey%250=0 THEN NULL ELSE c_custkey END AS spine_id, "
                 "concat('A', CAST(c_custkey AS VARCHAR)) AS synthetic_aeuid "
                 "FROM customer",
    "ato_known": "SELECT CASE WHEN c_custkey%250=0 THEN NULL ELSE c_custkey END AS spine_id, "
                 "concat('A', CAST(c_custkey AS VARCHAR)) AS synthetic_aeuid "
                 "FROM customer WHERE c_custkey%40<>7",
    "dhda_known": "SELECT CASE WHEN c_custkey%250=1 THEN NULL ELSE c_custkey END AS spine_id, "
                  "concat('D', CAST(c_custkey AS VARCHAR)) AS synthetic_aeuid "
                  "FROM customer WHERE c_custkey%50<>3",
    "dhda_spine": "SELECT CASE WHEN c_custkey%250=1 THEN NULL ELSE c_custkey END AS spine_id, "
                  "concat('D', CAST(c_custkey AS VARCHAR)) AS synthetic_aeuid "
                  "FROM customer",
    "itr": "SELECT o_orderkey AS rec_id, concat('A', CAST(o_custkey AS VARCHAR)) AS synthetic_aeuid, "
           "CAST(year(o_orderdate) AS INT) AS incm_yr, "
           "CASE WHEN o_orderkey%13=0 THEN NULL ELSE CAST(1000+(o_orderkey*31)%8000 AS INT) END "
           "AS ocptn_grp_cd FROM orders",
    "itr_inc": "SELECT o_orderkey AS rec_id, concat('A', CAST(o_custkey AS VARCHAR)) AS synthetic_aeuid, "
               "CAST(year(o_orderdate) AS INT) AS incm_yr, "
               "CASE WHEN o_orderkey%17=0 THEN NULL ELSE o_totalprice-20000 END AS ti_or_lss_amt "
               "FROM orders",
    "mbs": "SELECT concat('D', CAST(o.o_custkey AS VARCHAR)) AS synthetic_aeuid, "
           "CAST(l.l_shipdate AS DATE) AS dos, l.l_quantity AS numserv, "
           "l.l_extendedprice AS feecharged, "
           "CASE l.l_returnflag WHEN 'A' THEN 'GP' WHEN 'N' THEN 'SP' ELSE 'P' END AS btos "
           "FROM lineitem l JOIN orders o ON l.l_orderkey=o.o_orderkey",
    "stp": "SELECT o_orderkey AS rec_id, concat('A', CAST(o_custkey AS VARCHAR)) AS synthetic_aeuid, "
           "CAST(o_orderdate AS DATE) AS week_ending, "
           "CASE WHEN o_orderkey%19=0 THEN NULL ELSE o_orderpriority END AS abn_hash_trunc, "
           "o_totalprice AS pmt_sumry_totl_grs_pmt_amt FROM orders",
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the named view definitions as CTEs."""
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
