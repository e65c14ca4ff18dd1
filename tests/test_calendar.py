"""Calendar frames and densified panels against plain Python."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from panelkit.operators import calendar as C
from panelkit.operators.windows import framed, time_chunk


def months(rng, n, people=5, span=40):
    rows = []
    for k in range(n):
        m = rng.randrange(span)
        rows.append((rng.choice([*[f"p{i}" for i in range(people)], None]), dt.date(2000 + m // 12, m % 12 + 1, 1),
                     float(rng.randrange(9)), k))
    rows += [("p0", None, 3.0, n), ("p0", None, 4.0, n + 1), ("lone", dt.date(2001, 5, 1), 1.0, n + 2)]
    return rows


SCHEMA = "person string, month date, v double, rec long"


def number(d):
    return None if d is None else (d.year - 1970) * 12 + d.month - 1


@pytest.mark.parametrize("frame", [(-3, -1), (-1, 1), (0, 2), (0, 0), (2, 5), (-7, -4)])
def test_frames_and_blocks(spark, frame):
    rng = random.Random(sum(frame))
    rows = months(rng, 300)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    by = defaultdict(list)
    for p, d, v, _ in rows:
        by[p, number(d)].append(v)
    want = {}
    for p, d, v, rec in rows:
        n = number(d)
        seen = by[p, None] if n is None else [x for k in range(n + frame[0], n + frame[1] + 1) for x in by[p, k]]
        want[rec] = (len(seen), round(sum(seen), 6) if seen else None, max(seen, default=None))
    aggs = {"c": F.count("v"), "s": F.sum("v"), "m": F.max("v")}
    for block in (None, 1, 5, 12, 1000):
        out = C.calendar_framed(df, "person", "month", *frame, aggs, block=block)
        assert out.columns == [*df.columns, "c", "s", "m"]
        got = {r.rec: (r.c, None if r.s is None else round(r.s, 6), r.m) for r in out.collect()}
        assert got == want, block


def test_densify(spark):
    rng = random.Random(4)
    taken = {(f"p{rng.randrange(4)}", rng.randrange(60)) for _ in range(70)}
    rows = [(p, dt.date(2000 + m // 12, m % 12 + 1, 1), float(m), m) for p, m in taken]
    df = spark.createDataFrame(rows, SCHEMA)
    want = set()
    for p in {p for p, _ in taken}:
        ms = [m for q, m in taken if q == p]
        for m in range(min(ms), max(ms) + 1):
            have = (p, m) in taken
            want.add((p, dt.date(2000 + m // 12, m % 12 + 1, 1), float(m) if have else 0.0, m if have else None, not have))
    for chunk in (None, time_chunk("month", 200)):
        got = C.densify(df, "person", "month", {"v": 0.0}, flag="new", chunk=chunk).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_densify_ties_nulls_days_and_weeks(spark):
    rows = [("a", dt.date(2000, 1, 30), 1.0, 1), ("a", dt.date(2000, 1, 30), 2.0, 2), ("a", dt.date(2000, 2, 2), 3.0, 3),
            ("a", None, 4.0, 4), (None, dt.date(2000, 1, 1), 5.0, 5), (None, dt.date(2000, 1, 3), 6.0, 6)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.person or "", str(r.month), r.rec is None) for r in
                 C.densify(df, "person", "month", {}, unit="day").collect())
    assert got == [("", "2000-01-01", False), ("", "2000-01-02", True), ("", "2000-01-03", False),
                   ("a", "2000-01-30", False), ("a", "2000-01-30", False), ("a", "2000-01-31", True),
                   ("a", "2000-02-01", True), ("a", "2000-02-02", False), ("a", "None", False)]
    weeks = spark.createDataFrame([("a", dt.date(2000, 1, 6), 1.0, 1), ("a", dt.date(2000, 1, 27), 1.0, 2)], SCHEMA)
    got = [str(r.month) for r in C.densify(weeks, "person", "month", {}, unit="week").orderBy("month").collect()]
    assert got == ["2000-01-06", "2000-01-13", "2000-01-20", "2000-01-27"]
    assert C.densify(df.where("false"), "person", "month", {}).count() == 0


def test_month_ends_stay_in_their_month(spark):
    """A 31st moved by a month lands on the month's last day, in that month."""
    df = spark.createDataFrame([("a", dt.date(2000, 1, 31), 1.0, 1), ("a", dt.date(2000, 4, 30), 1.0, 2)], SCHEMA)
    got = [str(r.month) for r in C.densify(df, "person", "month", {}).orderBy("month").collect()]
    assert got == ["2000-01-31", "2000-02-29", "2000-03-31", "2000-04-30"]


def test_dense_rows_equal_calendar_sums(spark):
    """On a densified panel row frames and calendar frames agree."""
    rng = random.Random(9)
    taken = {(f"p{rng.randrange(4)}", rng.randrange(60)) for _ in range(70)}
    df = spark.createDataFrame([(p, dt.date(2000 + m // 12, m % 12 + 1, 1), float(m), m) for p, m in taken], SCHEMA)
    dense = C.densify(df, "person", "month", {"v": 0.0})
    a = framed(dense, "person", ["month"], -3, -1, {"s": F.sum("v")})
    b = C.calendar_framed(dense, "person", "month", -3, -1, {"s": F.sum("v")}, block=7)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_one_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 AS person", "date_add(DATE '2000-01-01', CAST(id * 9 AS INT)) AS month", "id AS v")
    out = C.calendar_framed(df, "person", "month", -3, -1, {"s": F.sum("v")}, block=12)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    with pytest.raises(ValueError):
        C.calendar_framed(df, "person", "month", 1, -1, {})
    with pytest.raises(ValueError):
        C.period_number("month", "quarter")


def test_pivot_limit(spark):
    df = spark.range(30).selectExpr("1 AS k", "id AS p", "id AS v")
    assert len(C.pivot_periods(df, ["k"], "p", "v").columns) == 31
    with pytest.raises(ValueError, match="more than 5"):
        C.pivot_periods(df, ["k"], "p", "v", limit=5)
