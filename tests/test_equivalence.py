"""Property tests: the scale-oriented forms of each operator equal the
straightforward form (chunk-split windows vs one window, binned range
join vs the plain condition join, as-of vs brute force, buckets vs none).
"""

import datetime as dt
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelkit.operators import joins as J
from panelkit.operators.asof import asof_last_before
from panelkit.operators.bucketed import bucketed_apply
from panelkit.operators.windows import (
    carry_last_before, change_points, first_per_key, lag_value, last_per_key, lead_value,
    row_index, time_chunk,
)

SETTINGS = settings(max_examples=12, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])
BASE = dt.date(2020, 1, 1)

rows_st = st.lists(
    st.tuples(st.sampled_from([0, 1, 2, 3, None]),    # person
              st.one_of(st.none(), st.integers(0, 400)),  # day offset
              st.sampled_from(["A", "B", "C", None])),  # value
    min_size=1, max_size=60)


def _frame(spark, rows):
    data = [(p, None if d is None else BASE + dt.timedelta(days=d), i, v) for i, (p, d, v) in enumerate(rows)]
    return spark.createDataFrame(data, "p int, t date, tb long, v string")


def _set(df, cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()),
                  key=lambda t: tuple((x is not None, str(type(x)), x) for x in t))


@SETTINGS
@given(rows=rows_st, days=st.sampled_from([1, 7, 30, 90]))
def test_chunked_lag_lead_equal_plain(spark, rows, days):
    df = _frame(spark, rows)
    order = ["t", "tb"]
    cols = ["p", "tb", "o"]
    for fn in (lag_value, lead_value):
        plain = fn(df, "p", order, "v", "o")
        chunked = fn(df, "p", order, "v", "o", chunk=time_chunk("t", days))
        assert _set(plain, cols) == _set(chunked, cols)


@SETTINGS
@given(rows=rows_st, days=st.sampled_from([1, 10, 45]))
def test_chunked_index_and_carry_equal_plain(spark, rows, days):
    df = _frame(spark, rows)
    order = ["t", "tb"]
    ch = time_chunk("t", days)
    assert _set(row_index(df, "p", order, "i"), ["tb", "i"]) == \
        _set(row_index(df, "p", order, "i", chunk=ch), ["tb", "i"])
    assert _set(carry_last_before(df, "p", order, "v", "c"), ["tb", "c"]) == \
        _set(carry_last_before(df, "p", order, "v", "c", chunk=ch), ["tb", "c"])


@SETTINGS
@given(rows=rows_st)
def test_first_last_per_key_equal_row_number(spark, rows):
    df = _frame(spark, rows)
    w = Window.partitionBy("p").orderBy(F.col("t").asc_nulls_last(), "tb")
    rn = df.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    assert _set(first_per_key(df, ["p"], ["t", "tb"]), df.columns) == _set(rn, df.columns)
    wd = Window.partitionBy("p").orderBy(F.col("t").desc_nulls_last(), F.desc("tb"))
    rn = df.withColumn("rn", F.row_number().over(wd)).where("rn = 1").drop("rn")
    assert _set(last_per_key(df, ["p"], ["t", "tb"]), df.columns) == _set(rn, df.columns)


@SETTINGS
@given(rows=rows_st, n=st.integers(1, 5))
def test_bucketed_apply_equals_unbucketed(spark, rows, n):
    df = _frame(spark, rows).withColumn("p", F.col("p").cast("string"))
    fn = lambda d: change_points(d, "p", ["t", "tb"], "v", "prev")
    assert _set(bucketed_apply(df, "p", n, fn), ["tb", "prev"]) == _set(fn(df), ["tb", "prev"])


@SETTINGS
@given(ev=st.lists(st.tuples(st.integers(0, 2), st.integers(0, 300)), min_size=1, max_size=40),
       an=st.lists(st.tuples(st.integers(0, 2), st.integers(0, 300)), min_size=1, max_size=10),
       days=st.sampled_from([1, 30, 90]), bin_days=st.sampled_from([1, 7, 32, 100]))
def test_binned_interval_join_equals_condition_join(spark, ev, an, days, bin_days):
    e = spark.createDataFrame([(p, BASE + dt.timedelta(days=d), i) for i, (p, d) in enumerate(ev)],
                              "p int, t date, eid long")
    a = spark.createDataFrame([(p, BASE + dt.timedelta(days=d), i) for i, (p, d) in enumerate(an)],
                              "p int, s date, aid long")
    got = J.interval_join(e, a, "p", "t", "s", days, bin_days=bin_days)
    ref = e.alias("e").join(a.alias("a"), (F.col("e.p") == F.col("a.p"))
                            & (F.col("t") >= F.col("s"))
                            & (F.col("t") < F.date_add(F.col("s"), days)))
    assert _set(got, ["eid", "aid"]) == _set(ref, ["eid", "aid"])


@SETTINGS
@given(lrows=st.lists(st.tuples(st.integers(0, 2), st.integers(0, 50)), min_size=1, max_size=20),
       rrows=st.lists(st.tuples(st.integers(0, 2), st.integers(0, 50)), min_size=0, max_size=20),
       chunk=st.sampled_from([None, 1, 3]))
def test_asof_equals_brute_force(spark, lrows, rrows, chunk):
    t0 = dt.datetime(2024, 1, 1)
    left = spark.createDataFrame(
        [(i, u, t0 + dt.timedelta(hours=h)) for i, (u, h) in enumerate(lrows)],
        "lid long, u int, t timestamp_ntz")
    # right times unique per user so "latest" is well defined
    seen, rr = set(), []
    for i, (u, h) in enumerate(rrows):
        if (u, h) not in seen:
            seen.add((u, h))
            rr.append((100 + i, u, t0 + dt.timedelta(hours=h), float(i)))
    right = spark.createDataFrame(rr, "rid long, u int, rt timestamp_ntz, v double")
    got = asof_last_before(left, right, "u", "t", "rt", "lid", "rid", ["rid", "v"],
                           chunk_days=chunk)
    cand = left.join(right, (left.u == right.u) & (right.rt < left.t), "left")
    best = cand.groupBy("lid").agg(F.max_by("rid", "rt").alias("rid"))
    assert _set(got, ["lid", "rid"]) == _set(best, ["lid", "rid"])


@SETTINGS
@given(vals=st.lists(st.tuples(st.sampled_from([None, 1, 2]),
                               st.one_of(st.none(), st.integers(-50, 50), st.floats(-1e6, 1e6),
                                         st.sampled_from([1e300, -1e300, 5e-324]))),
                     min_size=1, max_size=80),
       buckets=st.sampled_from([2, 16, 65536]))
def test_refined_quantiles_equal_percentile(spark, vals, buckets):
    from panelkit.operators.quantiles import exact_quantiles
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in vals],
                               "g int, x double")
    probs = {"p0": 0.0, "p10": 0.1, "med": 0.5, "p90": 0.9, "p100": 1.0}
    got = exact_quantiles(df, ["g"], "x", probs, buckets=buckets)
    ref = df.where(F.col("x").isNotNull()).groupBy("g").agg(
        *[F.percentile("x", F.lit(p)).alias(k) for k, p in probs.items()])
    def rows(d):
        return sorted((r["g"] if r["g"] is not None else -1, *[r[k] for k in probs]) for r in d.collect())
    assert [r[0] for r in rows(got)] == [r[0] for r in rows(ref)]
    for x, y in zip(rows(got), rows(ref)):
        assert all(math.isclose(p, q, rel_tol=1e-9, abs_tol=1e-6) for p, q in zip(x, y)), (x, y)


@SETTINGS
@given(rows=st.lists(st.tuples(st.integers(0, 2), st.integers(0, 200), st.integers(0, 9)),
                     min_size=1, max_size=60),
       frame=st.sampled_from([(-3, -1), (-1, 1), (0, 2), (-2, 0), (-4, 3)]),
       block=st.sampled_from([5, 7, 50]), days=st.sampled_from([1, 20]))
def test_split_frames_equal_plain(spark, rows, frame, block, days):
    from panelkit.operators.windows import framed
    data = [(p, BASE + dt.timedelta(days=d), i, float(v)) for i, (p, d, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "p int, t date, tb long, x double")
    aggs = {"s": F.sum("x"), "m": F.avg("x"), "mx": F.max("x"), "n": F.count("x")}
    plain = framed(df, "p", ["t", "tb"], *frame, aggs)
    split = framed(df, "p", ["t", "tb"], *frame, aggs, chunk=time_chunk("t", days),
                   block_rows=block)
    cols = ["tb", "s", "m", "mx", "n"]
    norm = lambda d: sorted(tuple(None if v is None else round(v, 9) if isinstance(v, float)
                                  else v for v in r) for r in d.select(*cols).collect())
    assert norm(plain) == norm(split)


@SETTINGS
@given(rows=rows_st, days=st.sampled_from([1, 15, 90]))
def test_chunked_ranks_equal_plain(spark, rows, days):
    from panelkit.operators.windows import rank_values
    df = _frame(spark, rows)
    cols = ["tb", "r", "d"]
    plain = rank_values(df, "p", ["t"], "r", "d")
    split = rank_values(df, "p", ["t"], "r", "d", chunk=time_chunk("t", days))
    assert _set(plain, cols) == _set(split, cols)


@SETTINGS
@given(hist=st.lists(st.tuples(st.integers(1, 12), st.lists(st.sampled_from("ABC"), min_size=1,
                                                             max_size=8)), min_size=1, max_size=4),
       step=st.sampled_from([1, 7]))
def test_lag_equals_fixed_offset_self_join_without_gaps(spark, hist, step):
    """On a gap-free grid with one row per (person, period) the row-order
    lag and the time-offset self-join find the same changes."""
    rows, tb = [], 0
    for p, (start, values) in enumerate(hist):
        for i, v in enumerate(values):
            rows.append((p, BASE + dt.timedelta(days=step * (start + i)), tb, v))
            tb += 1
    df = spark.createDataFrame(rows, "p int, t date, tb long, v string")
    by_lag = change_points(df, "p", ["t", "tb"], "v", "prev")
    by_join = J.shifted_self_join(df, "p", "t", "v", step, "prev").where(F.col("v") != F.col("prev"))
    assert _set(by_lag, ["p", "t", "prev", "v"]) == _set(by_join, ["p", "t", "prev", "v"])


@SETTINGS
@given(people=st.lists(st.tuples(st.integers(0, 5), st.sampled_from("MF")), min_size=1, max_size=8),
       bridge=st.lists(st.tuples(st.integers(0, 6), st.integers(0, 4)), min_size=1, max_size=10),
       fact=st.lists(st.tuples(st.integers(0, 5), st.one_of(st.none(), st.integers(-5, 9)),
                               st.sampled_from("ab")), min_size=0, max_size=30))
def test_star_rollup_equals_join_then_aggregate(spark, people, bridge, fact):
    """Pre-aggregating the fact side gives the same sums and counts as
    joining first, with duplicate bridge rows (which multiply) and NULLs."""
    d = spark.createDataFrame(people, "pid int, sex string")
    b = spark.createDataFrame(bridge, "pid int, fid int")
    f = spark.createDataFrame([(fid, None if v is None else float(v), t) for fid, v, t in fact],
                              "fid int, x double, t string")
    got = J.star_rollup(d, b, f, "pid", "fid", ["sex", "t"], {"s": "x"}, "n", fact_group=["t"])
    ref = (d.join(b, "pid").join(f, "fid").groupBy("sex", "t")
           .agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n")))
    assert _set(got, ["sex", "t", "s", "n"]) == _set(ref, ["sex", "t", "s", "n"])


def test_semi_plus_anti_is_left(spark):
    a = spark.range(0, 50).withColumn("k", F.col("id") % 7)
    b = spark.range(0, 10).withColumn("k", F.col("id") % 5).select("k")
    semi, anti = J.in_table(a, b, "k"), J.in_table(a, b, "k", negate=True)
    assert semi.count() + anti.count() == a.count()
    assert semi.join(anti, "id").count() == 0


@SETTINGS
@given(rows=rows_st, frame=st.sampled_from([(-3, -1), (-20, 5)]))
def test_auto_chunk_equals_plain(spark, rows, frame):
    """With the limit lowered to 4 rows, ``chunk="auto"`` splits and gives
    what one window per key gives, wide frames included."""
    from unittest import mock

    from panelkit.operators import windows as W
    df = _frame(spark, rows)
    order = ["t", "tb"]

    def all_of(chunk):
        return (_set(change_points(df, "p", order, "v", "prev", chunk=chunk), ["tb", "prev"]),
                _set(row_index(df, "p", order, "i", chunk=chunk), ["tb", "i"]),
                _set(W.rank_values(df, "p", ["t"], chunk=chunk), ["tb", "rank", "dense_rank"]),
                _set(W.framed(df, "p", order, *frame, {"c": F.count("v")}, chunk=chunk, block_rows=4), ["tb", "c"]))
    plain = all_of(None)
    with mock.patch.object(W, "MAX_ROWS_PER_KEY_TASK", 4):
        assert all_of("auto") == plain


def test_auto_chunk_sizes_by_the_largest_cell(spark):
    """A key whose rows crowd into one month is split by its own cells, not
    by the average of the largest key."""
    from panelkit.operators.windows import auto_chunk
    a = spark.range(1000).selectExpr("1 AS p", "date_add(DATE'2020-01-01', CAST(id AS INT)) AS t")
    b = spark.range(990).selectExpr("2 AS p", "date_add(DATE'2020-01-01', CAST(id % 30 AS INT)) AS t")
    df = a.unionByName(b)
    ch = auto_chunk(df, "p", "t", max_rows=100)
    assert df.groupBy("p", ch).count().agg(F.max("count")).first()[0] <= 100


def test_asof_null_times(spark):
    left = spark.createDataFrame([(1, 1, None), (2, 1, dt.datetime(2024, 1, 2)), (3, None, dt.datetime(2024, 1, 2))],
                                 "lid long, u int, t timestamp_ntz")
    right = spark.createDataFrame([(7, 1, dt.datetime(2024, 1, 1)), (8, 1, None)], "rid long, u int, rt timestamp_ntz")
    for chunk in (None, 7):
        got = asof_last_before(left, right, "u", "t", "rt", "lid", "rid", ["rid"], chunk_days=chunk)
        assert {r.lid: r.rid for r in got.collect()} == {1: None, 2: 7, 3: None}


def test_interval_join_on_timestamps(spark):
    e = spark.createDataFrame([(1, dt.datetime(2024, 1, 2, 6)), (1, dt.datetime(2024, 1, 2, 12))], "p int, t timestamp_ntz")
    a = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 12))], "p int, s timestamp_ntz")
    for bins in (1, 32):
        assert [r.t.hour for r in J.interval_join(e, a, "p", "t", "s", 1, bin_days=bins).collect()] == [6]


def test_distribution_without_keys(spark):
    from panelkit.operators.aggregates import distribution
    df = spark.range(101).select(F.col("id").cast("double").alias("x"))
    r = distribution(df, [], "x", {"p10": 0.1}).first()
    assert (r["n"], r["mean"], r["median"], r["p10"]) == (101, 50.0, 50.0, 10.0)
