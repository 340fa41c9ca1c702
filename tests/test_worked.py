"""Frontiers and quantiles worked by hand, needing no example files; hot groups; plan shapes."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from hotspot.operators import frontier as fr
from hotspot.operators import frp

DAILY = "project_id long, date_only string, satellite string, distance_km double"


def _daily(spark, rows):
    return spark.createDataFrame(rows, DAILY).withColumn("date_only", F.col("date_only").cast("date")).repartition(3)


# project 1: 1.5 km, then 2.0 km three days on, then 2.5 km the same day; 1.0 and 1.2 stay below, a second 2.5 is no advance
ONE = [
    (1, "2024-01-01", "SNPP", 1.0), (1, "2024-01-01", "NOAA20", 1.5), (1, "2024-01-02", "SNPP", 1.2),
    (1, "2024-01-04", "SNPP", 2.5), (1, "2024-01-04", "NOAA21", 2.0), (1, "2024-01-05", "NOAA20", 2.5),
]
TWO = [(2, "2024-02-28", "SNPP", 0.25), (2, "2024-03-01", "SNPP", 0.75)]  # over a leap day: 48 h


def test_frontier_worked_by_hand(spark):
    rows = fr.frontier(_daily(spark, ONE + TWO)).orderBy("project_id", "date", "satellite").collect()
    got = [(r.project_id, str(r.date), r.satellite, r.max_distance, r.prev_max, r.time_diff, round(r.distance_diff, 6), round(r.speed, 6)) for r in rows]
    assert got == [
        (1, "2024-01-01", "NOAA20", 1.5, 0.0, None, 1500.0, 0.0),
        (1, "2024-01-04", "NOAA21", 2.0, 1.5, 72.0, 500.0, 6.944444),
        (1, "2024-01-04", "SNPP", 2.5, 2.0, 0.0, 500.0, 0.0),
        (2, "2024-02-28", "SNPP", 0.25, 0.0, None, 250.0, 0.0),
        (2, "2024-03-01", "SNPP", 0.75, 0.25, 48.0, 500.0, 10.416667),
    ]


def test_frontier_daily_and_speed_worked_by_hand(spark):
    day = fr.frontier_daily(_daily(spark, ONE)).orderBy("date").collect()
    assert [(str(r.date), r.max_distance, round(r.speed, 6)) for r in day] == [("2024-01-01", 1.5, 0.0), ("2024-01-04", 2.5, 13.888889)]
    s = {r.project_id: r for r in fr.speed_summary(fr.frontier(_daily(spark, ONE + TWO))).collect()}
    assert (s[1].n_rows, s[1].max_distance_km, round(s[1].max_speed, 6), round(s[1].mean_speed, 6), s[1].n_zero_speed) == (3, 2.5, 6.944444, 2.314815, 2)
    assert (s[2].n_rows, round(s[2].mean_speed, 6), str(s[2].first_date), str(s[2].last_date)) == (2, 5.208333, "2024-02-28", "2024-03-01")


def _rows(spark):
    """A hot group of distinct values, one of a single value, one of values close together, one row."""
    hot = spark.range(9000).select(F.lit(1).cast("long").alias("project_id"), F.lit("SNPP").alias("satellite"), (F.pmod(F.col("id") * 7919, F.lit(9001)) / 7.0).alias("frp"), F.col("id"))
    same = spark.range(500).select(F.lit(1).cast("long"), F.lit("NOAA20"), F.lit(3.5), F.col("id"))
    near = spark.range(400).select(F.lit(2).cast("long"), F.lit("SNPP"), F.when(F.col("id") == 0, F.lit(1e9)).otherwise(1 + F.col("id") / 1e6), F.col("id"))
    one = spark.range(1).select(F.lit(3).cast("long"), F.lit("SNPP"), F.lit(2.0), F.col("id"))
    u = hot.union(same).union(near).union(one)
    return u.select("project_id", "satellite", "frp", F.timestamp_add("HOUR", F.pmod("id", F.lit(200)), F.lit("2024-01-01 01:00:00").cast("timestamp_ntz")).alias("obs_ts"))


def test_summary_of_hot_groups_equals_percentile(spark):
    rows = _rows(spark)
    got = {(r.project_id, r.satellite): r for r in frp.frp_summary(rows).collect()}
    want = rows.groupBy("project_id", "satellite").agg(F.percentile("frp", [0.25, 0.5, 0.75, 0.95]).alias("q"), F.min("frp").alias("lo"), F.max("frp").alias("hi"), F.count("*").alias("n"), F.avg("frp").alias("mean"))
    for r in want.collect():
        g = got[(r.project_id, r.satellite)]
        assert (g.n, g.min, g.max) == (r.n, r.lo, r.hi) and abs(g.mean - r.mean) <= 1e-9 * abs(r.mean)
        assert all(abs(a - b) <= 1e-9 * max(1, abs(b)) for a, b in zip((g.q1, g.median, g.q3, g.p95), r.q))


def test_cumulative_quantiles_of_hot_groups_equal_the_growing_window(spark):
    rows = _rows(spark)
    key = lambda r: (r.project_id, r.satellite, r.tick)
    a = {key(r): r for r in frp.cumulative_quantiles(rows).collect()}
    b = {key(r): r for r in frp.cumulative_quantiles_window(rows).collect()}
    assert set(a) == set(b)
    for k, r in b.items():
        assert a[k].n == r.n and all(abs(a[k][c] - r[c]) <= 1e-9 * max(1, abs(r[c])) for c in ("mean", "q25", "median", "q75"))


def test_summary_plan_keeps_no_group_together(spark):
    out = io.StringIO()
    with redirect_stdout(out):
        frp.frp_summary(_rows(spark)).explain("formatted")
    assert "ObjectHashAggregate" not in out.getvalue() and "percentile" not in out.getvalue()
