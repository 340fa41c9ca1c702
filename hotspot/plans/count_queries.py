"""Calendar counts and KPI panel: Spark plans and their SQL oracles (lineitem fixture)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hotspot.functions import calendar as cal
from hotspot.operators import counts as ct
from hotspot.plans.common import Registry
from hotspot.plans.sql_fixtures import with_fixtures
from hotspot.sources import fixtures as fx

R = Registry()
LI = ["projects_li", "det_li"]


def wk(d: str, a: str) -> str:
    return f"({d} - CAST(((isodow({d}) - 1 - {a}) % 7 + 7) % 7 AS INTEGER))"


def ffw(d: str, a: str) -> str:
    return f"({d} + CAST((({a} - (isodow({d}) - 1)) % 7 + 7) % 7 AS INTEGER))"


PL = "pl AS (SELECT project_id, CAST(start_ts AS DATE) AS sd, CAST(end_ts AS DATE) AS ed, week_anchor AS a FROM projects_li)"
DL = """dl AS (SELECT d.project_id, d.satellite, d.acq_date, pl.sd, pl.ed, pl.a
  FROM det_li d JOIN pl USING (project_id) WHERE d.acq_date BETWEEN pl.sd AND pl.ed)"""
WC = f"""wc AS (SELECT project_id, {wk('acq_date', 'a')} AS week_start, satellite, count(*) AS n FROM dl
  WHERE {wk('acq_date', 'a')} >= {ffw('sd', 'a')} GROUP BY ALL)"""
WG = f"""wg AS (SELECT project_id, CAST(unnest(generate_series(ff, lw, INTERVAL 7 DAY)) AS DATE) AS week_start
  FROM (SELECT project_id, {ffw('sd', 'a')} AS ff, {wk('ed', 'a')} AS lw FROM pl) t WHERE lw >= ff)"""
WEEKLY = """weekly AS (SELECT g.project_id, g.week_start, s.satellite, CAST(coalesce(wc.n, 0) AS BIGINT) AS n_detections
  FROM wg g CROSS JOIN sensors s LEFT JOIN wc ON wc.project_id = g.project_id AND wc.week_start = g.week_start AND wc.satellite = s.satellite)"""
MG = """mg AS (SELECT project_id, CAST(unnest(generate_series(date_trunc('month', sd), date_trunc('month', ed), INTERVAL 1 MONTH)) AS DATE) AS month_start FROM pl)"""


def mc(drop_partial: bool) -> str:
    cond = f"WHERE {wk('acq_date', 'a')} >= {ffw('sd', 'a')}" if drop_partial else ""
    return f"""mc AS (SELECT project_id, CAST(date_trunc('month', acq_date) AS DATE) AS month_start, satellite, count(*) AS n FROM dl {cond} GROUP BY ALL)"""


MONTHLY = """monthly AS (SELECT g.project_id, g.month_start, s.satellite, CAST(coalesce(mc.n, 0) AS BIGINT) AS n_detections
  FROM mg g CROSS JOIN sensors s LEFT JOIN mc ON mc.project_id = g.project_id AND mc.month_start = g.month_start AND mc.satellite = s.satellite)"""


def wide(src: str, label: str) -> str:
    sats = ["MODIS", "SNPP", "NOAA20", "NOAA21"]
    cols = ", ".join(f"CAST(sum(n_detections) FILTER (WHERE satellite = '{s}') AS BIGINT) AS {s}" for s in sats)
    return f"SELECT project_id, {label}, {cols} FROM {src} GROUP BY project_id, {label}"


def _li(spark, sf):
    return fx.detections_li(spark, sf), fx.projects_li(spark, sf)


@R.add(
    "week_start",
    with_fixtures(["det_li"], [], f"""SELECT acq_date, a AS anchor, {wk('acq_date', 'a')} AS week_start,
       {ffw('acq_date', 'a')} AS next_full_week
  FROM (SELECT DISTINCT acq_date FROM det_li) d CROSS JOIN (SELECT CAST(unnest(range(7)) AS INTEGER) AS a) t"""),
)
def q_week_start(spark, sf):
    d = fx.detections_li(spark, sf).select("acq_date").distinct()
    d = d.select("acq_date", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("anchor"))
    return d.select("acq_date", "anchor", cal.week_start("acq_date", "anchor").alias("week_start"),
                    cal.first_full_week("acq_date", "anchor").alias("next_full_week"))


@R.add(
    "month_start",
    with_fixtures(["det_li"], [], """SELECT DISTINCT acq_date, CAST(date_trunc('month', acq_date) AS DATE) AS month_start,
       last_day(acq_date) AS month_end FROM det_li"""),
)
def q_month_start(spark, sf):
    d = fx.detections_li(spark, sf).select("acq_date").distinct()
    return d.select("acq_date", cal.month_start("acq_date").alias("month_start"), cal.month_end("acq_date").alias("month_end"))


@R.add(
    "full_weeks",
    with_fixtures(LI, [PL, DL], f"SELECT project_id, satellite, acq_date FROM dl WHERE {wk('acq_date', 'a')} >= {ffw('sd', 'a')}"),
)
def q_full_weeks(spark, sf):
    det, prj = _li(spark, sf)
    p = ct.period_days(prj)
    d = det.select("project_id", "satellite", "acq_date").join(p, "project_id")
    d = d.where(F.col("acq_date").between(F.col("start_date"), F.col("end_date")))
    return d.where(cal.week_start("acq_date", "anchor") >= cal.first_full_week("start_date", "anchor")).select(
        "project_id", "satellite", "acq_date")


@R.add("weekly_counts", with_fixtures(LI, [PL, DL, WC, WG, WEEKLY], "SELECT * FROM weekly"))
def q_weekly_counts(spark, sf):
    return ct.weekly_counts(*_li(spark, sf))


@R.add("monthly_counts", with_fixtures(LI, [PL, DL, mc(False), MG, MONTHLY], "SELECT * FROM monthly"))
def q_monthly_counts(spark, sf):
    return ct.monthly_counts(*_li(spark, sf))


@R.add("monthly_counts_dashboard", with_fixtures(LI, [PL, DL, mc(True), MG, MONTHLY], "SELECT * FROM monthly"))
def q_monthly_counts_dashboard(spark, sf):
    return ct.monthly_counts(*_li(spark, sf), drop_partial_week=True)


@R.add("weekly_pivot", with_fixtures(LI, [PL, DL, WC, WG, WEEKLY], wide("weekly", "week_start")))
def q_weekly_pivot(spark, sf):
    return ct.to_wide(ct.weekly_counts(*_li(spark, sf)), "week_start")


@R.add("monthly_pivot", with_fixtures(LI, [PL, DL, mc(False), MG, MONTHLY], wide("monthly", "month_start")))
def q_monthly_pivot(spark, sf):
    return ct.to_wide(ct.monthly_counts(*_li(spark, sf)), "month_start")


@R.add(
    "fill_grid",
    with_fixtures(LI, [PL, DL, WC, WG, WEEKLY], "SELECT project_id, count(*) AS grid_cells, CAST(sum(n_detections) AS BIGINT) AS n_detections, "
                  "count(*) FILTER (WHERE n_detections = 0) AS zero_cells FROM weekly GROUP BY project_id"),
)
def q_fill_grid(spark, sf):
    w = ct.weekly_counts(*_li(spark, sf))
    return w.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("grid_cells"), F.sum("n_detections").alias("n_detections"),
        F.count_if(F.col("n_detections") == 0).alias("zero_cells"))


@R.add(
    "count_kpis",
    with_fixtures(LI, [PL, DL, "dy AS (SELECT project_id, sd, ed, a, acq_date, count(*) AS n FROM dl GROUP BY ALL)",
                       f"""base AS (SELECT project_id, sd, ed, a, max(acq_date) AS last_day,
         sum(n) FILTER (WHERE acq_date BETWEEN {wk('ed', 'a')} AND {wk('ed', 'a')} + 6) AS tlw,
         sum(n) FILTER (WHERE acq_date BETWEEN CAST(date_trunc('month', ed) AS DATE) AND last_day(ed)) AS tlm
       FROM dy GROUP BY ALL)""",
                       f"""pw AS (SELECT project_id, max(n) AS peak_week FROM (SELECT project_id, {wk('acq_date', 'a')} AS w, sum(n) AS n FROM dy
         WHERE {wk('acq_date', 'a')} >= {ffw('sd', 'a')} GROUP BY ALL) t GROUP BY project_id)""",
                       """pm AS (SELECT project_id, max(n) AS peak_month FROM (SELECT project_id, date_trunc('month', acq_date) AS m, sum(n) AS n
         FROM dy GROUP BY ALL) t GROUP BY project_id)"""],
                  f"""SELECT b.project_id, b.last_day, CAST(d.n AS BIGINT) AS total_last_day,
       {wk('b.ed', 'b.a')} AS last_week_start, {wk('b.ed', 'b.a')} + 6 AS last_week_end, CAST(coalesce(b.tlw, 0) AS BIGINT) AS total_last_week,
       CAST(date_trunc('month', b.ed) AS DATE) AS last_month, CAST(coalesce(b.tlm, 0) AS BIGINT) AS total_last_month,
       CAST(coalesce(pw.peak_week, 0) AS BIGINT) AS peak_week, CAST(coalesce(pm.peak_month, 0) AS BIGINT) AS peak_month
  FROM base b JOIN dy d ON d.project_id = b.project_id AND d.acq_date = b.last_day
  LEFT JOIN pw ON pw.project_id = b.project_id LEFT JOIN pm ON pm.project_id = b.project_id"""),
)
def q_count_kpis(spark, sf):
    return ct.count_kpis(*_li(spark, sf))


@R.add(
    "period_labels",
    with_fixtures(["projects_li"], [], """SELECT project_id, strftime(start_ts, '%d/%m/%Y') AS start_label, strftime(end_ts, '%d/%m/%Y') AS end_label,
       strftime(end_ts, '%B %Y') AS end_month_label FROM projects_li"""),
)
def q_period_labels(spark, sf):
    p = fx.projects_li(spark, sf)
    return p.select("project_id", cal.day_label("start_ts").alias("start_label"), cal.day_label("end_ts").alias("end_label"),
                    cal.month_label("end_ts").alias("end_month_label"))
