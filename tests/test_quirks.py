"""Edge cases of the source semantics, on hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from hotspot.functions import calendar as cal
from hotspot.functions import clean as cl
from hotspot.functions.waypoints import parse_waypoints
from hotspot.operators import counts as ct


def _one(spark, values, expr, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_round_key_is_half_even(spark):
    got = _one(spark, [0.36825, 0.12345, -91.51345, 0.00005], cl.round_key, "double")
    assert got == [0.3682, 0.1234, -91.5135, 0.0]


def test_parse_date_layouts(spark):
    vals = ["2024-03-01", "01/03/2024", "1/3/24", "bad", "2024-03-01 10:00:00", "31/12/95", None, ""]
    got = _one(spark, vals, cl.parse_date)
    d = dt.date
    assert got == [d(2024, 3, 1), d(2024, 3, 1), d(2024, 3, 1), None, d(2024, 3, 1), d(1995, 12, 31), None, None]


def test_coerce_numeric_and_nan(spark):
    assert _one(spark, ["NaN", "", "abc", "1.5", " 2 "], cl.coerce_numeric) == [None, None, None, 1.5, 2.0]


def test_pad_time_and_obs_ts(spark):
    assert _one(spark, ["639", "5", "0639", "12345", "x"], cl.pad_time) == ["0639", "0005", "0639", None, None]
    df = spark.createDataFrame([(dt.date(2024, 1, 2), "2359"), (dt.date(2024, 1, 2), "2460"), (dt.date(2024, 1, 2), "15")], "d date, t string")
    got = [r[0] for r in df.select(cl.build_obs_ts("d", "t")).collect()]
    assert got == [dt.datetime(2024, 1, 2, 23, 59), None, dt.datetime(2024, 1, 2, 0, 15)]


def test_week_start_all_anchors(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(21)]
    df = spark.createDataFrame([(d, a) for d in days for a in range(7)], "d date, a int")
    got = {(r["d"], r["a"]): r["w"] for r in df.select("d", "a", cal.week_start("d", "a").alias("w")).collect()}
    for (d, a), w in got.items():
        assert w == d - dt.timedelta(days=(d.weekday() - a) % 7)


def _projects(spark, start, end, anchor=3):
    return spark.createDataFrame([(1, start, end, anchor)], "project_id bigint, start_ts timestamp_ntz, end_ts timestamp_ntz, week_anchor int")


def test_period_shorter_than_a_week_has_no_full_week(spark):
    p = _projects(spark, dt.datetime(2024, 3, 4), dt.datetime(2024, 3, 6))  # Mon..Wed, weeks start Thursday
    assert ct.week_grid(p).count() == 0


def test_kpis_use_calendar_days(spark):
    """One detection per day, end 2026-05-20: last week 7, last month 20 (calendar days)."""
    days = [dt.date(2026, 4, 1) + dt.timedelta(days=i) for i in range(50)]
    det = spark.createDataFrame([(1, "SNPP", d) for d in days], "project_id bigint, satellite string, acq_date date")
    p = _projects(spark, dt.datetime(2026, 4, 1), dt.datetime(2026, 5, 20, 23, 59))
    r = ct.count_kpis(det, p).first()
    assert (r["total_last_day"], r["total_last_week"], r["total_last_month"]) == (1, 7, 20)
    assert r["last_week_start"] == dt.date(2026, 5, 14) and r["peak_month"] == 30


def test_waypoints_skip_blank_coordinates(spark):
    p = spark.createDataFrame([(1, "A;B", "1.0;", "2.0;3.0", "")], "project_id bigint, wpt_names string, wpt_lats string, wpt_lons string, wpt_symbols string")
    rows = [tuple(r) for r in parse_waypoints(p).collect()]
    assert rows == [(1, 0, "A", 1.0, 2.0, "circle")]


def test_nan_frp_never_passes_a_threshold(spark):
    from hotspot.operators.runout import frp_predicate

    df = spark.createDataFrame([(float("nan"),), (50.0,)], "x double").select(cl.nan_to_null("x").alias("frp"))
    df = df.withColumn("filter_frp", F.lit(10.0)).withColumn("frp_mode", F.lit("gt"))
    assert df.where(frp_predicate()).count() == 1


def test_empty_inputs(spark):
    """No detections: empty frontier/daily rows, no KPI row, an all-zero calendar grid,
    frames that count zero."""
    from hotspot import schemas
    from hotspot.operators import frames, frontier, runout
    from hotspot.sources import fixtures as fx

    from conftest import SMALL

    det = spark.createDataFrame([], schemas.DETECTIONS)
    prj = fx.projects_ev(spark, SMALL)
    filtered = runout.filter_runout(det, prj)
    daily = runout.daily_runout(filtered)
    assert daily.count() == 0 and frontier.frontier(daily).count() == 0
    assert ct.count_kpis(det, prj).count() == 0
    weekly = ct.weekly_counts(det, prj)
    assert weekly.count() > 0 and weekly.where("n_detections <> 0").count() == 0
    fc = frames.frame_counts(filtered, prj)
    assert fc.count() > 0 and fc.where("n_cumulative <> 0").count() == 0
