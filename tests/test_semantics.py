"""Hand-made edge cases for the semantic rules (NULLs, integer casts,
frames, interval and as-of bounds, the reference's worked example)."""

import datetime as dt

from pyspark.sql import functions as F

from panelkit.functions import (
    first_match_replace, floor_div, floor_int, floor_mod, round_half_even_int, trunc_int,
)
from panelkit.operators import joins as J
from panelkit.operators.aggregates import group_count, quantile
from panelkit.operators.asof import asof_last_before
from panelkit.operators.windows import change_points, framed, shock_flags

D = dt.date


def _weeks(spark, values, weeks=None):
    weeks = weeks or list(range(1, len(values) + 1))
    rows = [("p1", D(2021, 7, 1) + dt.timedelta(days=7 * (w - 1)), i, v)
            for i, (w, v) in enumerate(zip(weeks, values))]
    return spark.createDataFrame(rows, "id string, week date, tb long, emp string")


def test_worked_example_one_switch_at_week_three(spark):
    df = _weeks(spark, ["A", "A", "B", "B"])
    out = change_points(df, "id", ["week", "tb"], "emp", "prev").collect()
    assert len(out) == 1
    assert out[0]["week"] == D(2021, 7, 15) and (out[0]["prev"], out[0]["emp"]) == ("A", "B")


def test_missing_week_lag_vs_self_join(spark):
    df = _weeks(spark, ["A", "B"], weeks=[1, 3])
    assert change_points(df, "id", ["week", "tb"], "emp", "prev").count() == 1
    sj = J.shifted_self_join(df, "id", "week", "emp", 7, "prev")
    assert sj.where(F.col("emp") != F.col("prev")).count() == 0


def test_null_employer_filtered_first(spark):
    df = _weeks(spark, ["A", None, "B"]).where(F.col("emp").isNotNull())
    out = change_points(df, "id", ["week", "tb"], "emp", "prev").collect()
    assert [(r["prev"], r["emp"]) for r in out] == [("A", "B")]


def test_change_to_or_from_null_is_not_a_switch(spark):
    df = _weeks(spark, ["A", None, "A"])
    assert change_points(df, "id", ["week", "tb"], "emp", "prev").count() == 0


def test_integer_cast_rules(spark):
    df = spark.createDataFrame([(192.6,), (-7.5,), (2.5,)], "x double")
    r = df.select(floor_int("x").alias("f"), trunc_int("x").alias("t"),
                  round_half_even_int("x").alias("r")).collect()
    assert [tuple(x) for x in r] == [(192, 192, 193), (-8, -7, -8), (2, 2, 2)]
    dec = spark.createDataFrame([(1926,)], "y int").select(
        (floor_int(F.col("y") / 10) * 10).alias("floor"),
        (round_half_even_int(F.col("y") / 10) * 10).alias("round")).first()
    assert (dec["floor"], dec["round"]) == (1920, 1930)


def test_negative_floor_division(spark):
    r = spark.createDataFrame([(-7, 10), (7, -2), (7, 2)], "a long, b long").select(
        floor_div("a", "b").alias("q"), floor_mod("a", "b").alias("m")).collect()
    assert [tuple(x) for x in r] == [(-1, 3), (-4, -1), (3, 1)]


def test_trailing_mean_and_shocks(spark):
    df = spark.createDataFrame([("p", i, float(v)) for i, v in enumerate([1, 2, 3, 9])],
                               "id string, m int, s double")
    f = framed(df, "id", ["m"], -3, -1, {"t": F.avg("s")}).orderBy("m").collect()
    assert [r["t"] for r in f] == [None, 1.0, 1.5, 2.0]
    shocks = shock_flags(df, "id", "m", "s").orderBy("m").collect()
    assert [r["m"] for r in shocks] == [1, 2, 3]


def test_zero_trailing_mean_is_not_a_shock(spark):
    df = spark.createDataFrame([("p", 0, 0.0), ("p", 1, 5.0)], "id string, m int, s double")
    assert shock_flags(df, "id", "m", "s").count() == 0


def test_null_key_joins(spark):
    a = spark.createDataFrame([(1, "a1"), (None, "a2")], "k int, va string")
    b = spark.createDataFrame([(1, "b1"), (None, "b2")], "k int, vb string")
    assert a.join(b, "k", "inner").count() == 1
    assert a.join(b, "k", "left").count() == 2
    assert J.in_table(a, b, "k").count() == 1
    anti = J.in_table(a, b, "k", negate=True).collect()
    assert len(anti) == 1 and anti[0]["k"] is None
    assert a.join(b, "k", "full").count() == 3
    assert J.outer_join(a, b, "k", "left").count() == 2
    full = J.outer_join(a, b, "k", "full")
    assert full.count() == 3
    assert {(r["va"], r["vb"]) for r in full.collect() if r["k"] is None} == \
        {(None, "b2"), ("a2", None)}


def test_interval_join_bounds(spark):
    anchors = spark.createDataFrame([("p", D(2015, 1, 1))], "id string, s date")
    events = spark.createDataFrame(
        [("p", D(2015, 1, 1)), ("p", D(2015, 3, 31)), ("p", D(2015, 4, 1)), ("p", D(2014, 12, 31))],
        "id string, t date")
    got = sorted(r["t"] for r in J.interval_join(events, anchors, "id", "t", "s", 90).collect())
    assert got == [D(2015, 1, 1), D(2015, 3, 31)]


def test_asof_equal_timestamp_does_not_match(spark):
    ts = dt.datetime(2024, 1, 1, 10, 0)
    left = spark.createDataFrame([(1, 7, ts)], "lid long, u long, t timestamp_ntz")
    right = spark.createDataFrame(
        [(10, 7, ts, 1.0), (11, 7, ts - dt.timedelta(hours=1), 2.0)],
        "rid long, u long, rt timestamp_ntz, v double")
    out = asof_last_before(left, right, "u", "t", "rt", "lid", "rid", ["rid", "v"]).collect()
    assert [(r["rid"], r["v"]) for r in out] == [(11, 2.0)]
    only_equal = right.where(F.col("rid") == 10)
    out = asof_last_before(left, only_equal, "u", "t", "rt", "lid", "rid", ["rid", "v"]).collect()
    assert out[0]["rid"] is None


def test_interpolated_quantile(spark):
    df = spark.createDataFrame([(0.0,), (10.0,)], "x double")
    assert df.agg(quantile("x", 0.9).alias("q")).first()["q"] == 9.0


def test_all_null_sum_is_null(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert df.agg(F.sum("x").alias("s")).first()["s"] is None


def test_count_keeps_null_group(spark):
    df = spark.createDataFrame([(1,), (None,), (None,)], "k int")
    got = {(r["k"], r["n"]) for r in group_count(df, "k").collect()}
    assert got == {(1, 1), (None, 2)}


def test_first_match_replace_only_first(spark):
    df = spark.createDataFrame([("a-b-c",)], "s string")
    assert df.select(first_match_replace("s", "-", "+").alias("r")).first()["r"] == "a+b-c"


def test_first_match_replace_alternation_groups_and_newlines(spark):
    df = spark.createDataFrame([("xaby",), ("a2015b7",), ("l1\nxaby\nab",), (None,)], "s string")
    one = [r[0] for r in df.select(first_match_replace("s", "a|b", "#")).collect()]
    assert one == ["x#by", "#2015b7", "l1\nx#by\nab", None]
    grp = [r[0] for r in df.select(first_match_replace("s", r"(\d)(\d)", r"<\2$1>")).collect()]
    assert grp == ["xaby", "a<02>15b7", "l1\nxaby\nab", None]
    twice = spark.createDataFrame([("abccd",)], "s string")
    assert twice.select(first_match_replace("s", r"(\w)\1", "=")).first()[0] == "ab=d"


def test_floor_div_mod_past_2_53(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(big, 1), (-big, 2), (7, -2), (-7, 2), (5, 0)], "a long, b long")
    got = [tuple(r) for r in df.select(floor_div("a", "b"), floor_mod("a", "b")).collect()]
    assert got == [(big, 0), (-big // 2, -big % 2), (7 // -2, 7 % -2), (-7 // 2, -7 % 2), (None, None)]
