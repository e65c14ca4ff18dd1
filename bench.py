"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Warms the JVM once, then times each headline query ``REPEATS`` times
(plan construction plus a full execution into the ``noop`` sink: every row
is computed, nothing is collected) and reports the median; prints one JSON
line.  Layout comparisons (sorted vs unsorted point lookup, lag vs
fixed-offset self-join) are timed separately, with the layout written
once beforehand, as the reference's ratios are about the read side.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from panelkit import fixtures as fx  # noqa: E402
from panelkit.plans import registry  # noqa: E402
from panelkit.session import build_session, scratch_path  # noqa: E402
from panelkit.sources import layout  # noqa: E402


REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))
CSV_GB = float(os.environ.get("BENCH_CSV_GB", "2.1"))


def _run(df) -> float:
    t0 = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def _bytes(spark, path: str) -> int:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(p).getLength())


def _timed_write(fn) -> float:
    t0 = time.perf_counter()
    fn()
    return time.perf_counter() - t0


def _best(fn, n: int = 3) -> float:
    fn()
    return min(fn() for _ in range(n))


def layout_ratios(spark, sf_dir: str, times: dict) -> dict:
    """The read-side layout effects the reference measures, as ratios
    (seconds are not comparable across machines and data sizes)."""
    itr = fx.itr(spark, sf_dir)
    snappy = scratch_path(spark, "bench-itr-default")
    itr.write.parquet(snappy)                                   # Spark defaults
    zstd = scratch_path(spark, "bench-itr-zstd")
    layout.write_parquet(itr, zstd)                             # zstd, 250k groups
    small_rg = scratch_path(spark, "bench-itr-10k")
    layout.write_parquet(itr, small_rg, row_group_rows=10_000)
    by_year = scratch_path(spark, "bench-itr-year")
    layout.write_parquet(itr, by_year, partition_by=["incm_yr"])

    def year_count(path):
        return lambda: _run(spark.read.parquet(path).where(F.col("incm_yr") == 1998)
                            .agg(F.count(F.lit(1))))

    def group_by(path):
        return lambda: _run(spark.read.parquet(path).groupBy("ocptn_grp_cd").count())

    out = {
        "zstd_over_default_bytes": round(_bytes(spark, zstd) / _bytes(spark, snappy), 3),
        "year_filter_default_over_partitioned": round(
            _best(year_count(zstd)) / _best(year_count(by_year)), 2),
        "groupby_10k_over_250k_row_groups": round(
            _best(group_by(small_rg)) / _best(group_by(zstd)), 2),
        "lookup_unsorted_over_sorted": round(
            times["lookup_unsorted"] / max(times["lookup_sorted"], 1e-3), 2),
        "lag_over_self_join": round(
            times["switches_daily_lag"] / max(times["switches_self_join"], 1e-3), 2),
    }
    # CSV -> parquet conversion rate, on the claims repeated to BENCH_CSV_GB
    from panelkit.plans.storage import MBS_SCHEMA
    from panelkit.sources import readers
    one, landing = scratch_path(spark, "bench-csv-one"), scratch_path(spark, "bench-csv")
    mbs = fx.mbs(spark, sf_dir)
    mbs.write.option("header", True).csv(one)
    copies = max(1, round(CSV_GB * 1e9 / _bytes(spark, one)))
    (mbs.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("_copy")
     .write.option("header", True).csv(landing))
    gb = _bytes(spark, landing) / 1e9
    for name, read in (("csv", readers.read_csv), ("plain_csv", readers.read_plain_csv)):
        src = lambda: read(spark, f"{landing}/*.csv", MBS_SCHEMA)  # noqa: B023, E731
        out[f"{name}_parse_sec_per_gb"] = round(_run(src()) / gb, 2)
        out[f"{name}_to_parquet_sec_per_gb"] = round(_timed_write(
            lambda: layout.write_parquet(src(), scratch_path(spark, "bench-csv-out"))) / gb, 2)  # noqa: B023
    out["csv_input_gb"] = round(gb, 3)
    # stored integer surrogate vs string key on the narrow three-way join;
    # both sides read tables written the same way
    from panelkit.operators import joins as J
    from panelkit.plans.linkage import stored_by_hash
    d = fx.demo(spark, sf_dir).where(F.col("year_of_birth").between(1960, 1979)).select("spine_id")
    s = stored_by_hash(spark, "bench-spine", fx.dhda_spine(spark, sf_dir))
    m = stored_by_hash(spark, "bench-claims", mbs).select("synthetic_aeuid", "aeuid_hash", "numserv")
    string_key = lambda: _run(d.join(s.drop("aeuid_hash"), "spine_id")
                              .join(m.drop("aeuid_hash"), "synthetic_aeuid").agg(F.sum("numserv")))
    hash_key = lambda: _run(J.stored_key_join(d.join(s, "spine_id"), m, "aeuid_hash", "synthetic_aeuid")
                            .agg(F.sum("numserv")))
    out["string_over_hash_key_join"] = round(_best(string_key) / _best(hash_key), 2)
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(cpus)))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=parts,
                          app_name="panelkit-bench")
    registry.load_all()
    times: dict[str, float] = {}

    # warm-up (JIT, codegen caches): one scan, one join, one window shape
    for name in ("t2_group_count", "t3_three_way", "switches_lag"):
        _run(registry.QUERIES[name](spark, sf_dir))

    for name in registry.HEADLINE:
        fn = registry.QUERIES[name]
        runs = []
        for _ in range(REPEATS):
            t0 = time.perf_counter()
            df = fn(spark, sf_dir)          # layout/ingest queries write here
            build = time.perf_counter() - t0
            runs.append(build + _run(df))
        times[name] = round(statistics.median(runs), 3)

    # read-side layout ratios, layouts written once, untimed
    mbs = fx.mbs(spark, sf_dir)
    plain = scratch_path(spark, "bench-mbs-plain")
    layout.write_parquet(mbs, plain)
    clustered = scratch_path(spark, "bench-mbs-clustered")
    layout.write_clustered(mbs, clustered, ["synthetic_aeuid"], row_group_rows=10_000)

    def lookup(path):
        t = spark.read.parquet(path).where(F.col("synthetic_aeuid") == "D100")
        return t.agg(F.count(F.lit(1)).alias("n"), F.sum("numserv").alias("s"))

    _run(lookup(plain))
    times["lookup_unsorted"] = round(min(_run(lookup(plain)) for _ in range(3)), 3)
    times["lookup_sorted"] = round(min(_run(lookup(clustered)) for _ in range(3)), 3)
    for name in ("switches_self_join", "switches_daily_lag"):
        times[name] = round(statistics.median(
            _run(registry.QUERIES[name](spark, sf_dir)) for _ in range(REPEATS)), 3)

    ratios = layout_ratios(spark, sf_dir, times)

    total = round(sum(times[n] for n in registry.HEADLINE), 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": cpus, "ratios": ratios}))
    spark.stop()


if __name__ == "__main__":
    main()
