"""Detection counts on zero-filled weekly / monthly calendars, and the KPI panel.

All counts first collapse detections to (project, sensor, day) with a partial (map-side)
aggregate, so every later step works on a table bounded by the calendar, whatever the
detection volume or skew of a project.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotspot import schemas
from hotspot.functions.calendar import first_full_week, month_end, month_start, week_start
from hotspot.operators.dims import dim_join


def period_days(projects: DataFrame) -> DataFrame:
    """Project calendar bounds as dates (calendar-day semantics for counts)."""
    return projects.select(
        "project_id",
        F.to_date("start_ts").alias("start_date"),
        F.to_date("end_ts").alias("end_date"),
        F.coalesce(F.col("week_anchor"), F.lit(3)).alias("anchor"),
    )


def daily_counts(det: DataFrame, projects: DataFrame) -> DataFrame:
    """(project, satellite, day) -> n for detections inside the period (dates inclusive)."""
    p = period_days(projects)
    d = dim_join(det.select("project_id", "satellite", "acq_date"), p, "project_id")
    d = d.where(F.col("acq_date").between(F.col("start_date"), F.col("end_date")))
    return d.groupBy("project_id", "start_date", "end_date", "anchor", "satellite", "acq_date").agg(
        F.count(F.lit(1)).alias("n")
    )


def _sat_array():
    return F.array(*[F.lit(s) for s in schemas.SATELLITES])


def week_grid(projects: DataFrame) -> DataFrame:
    """Every full-week start of each period (first full week .. week containing the end)."""
    p = period_days(projects)
    first = first_full_week("start_date", "anchor")
    last = week_start("end_date", "anchor")
    seq = F.when(last >= first, F.sequence(first, last, F.expr("INTERVAL 7 DAYS"))).otherwise(F.array().cast("array<date>"))
    return p.select("project_id", F.explode(seq).alias("week_start"))


def month_grid(projects: DataFrame) -> DataFrame:
    p = period_days(projects)
    seq = F.sequence(month_start("start_date"), month_start("end_date"), F.expr("INTERVAL 1 MONTH"))
    return p.select("project_id", F.explode(seq).alias("month_start"))


def fill_grid(grid: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Calendar grid x sensors, left-joined to counts, missing -> 0."""
    g = grid.select(*grid.columns, F.explode(_sat_array()).alias("satellite"))
    j = g.join(counts, keys + ["satellite"], "left")
    return j.select(*keys, "satellite", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n_detections"))


def weekly_counts(det: DataFrame, projects: DataFrame) -> DataFrame:
    """A1: detections per anchored week and sensor; the partial first week is left out,
    the partial last week kept; zero-filled over the whole period."""
    dc = daily_counts(det, projects).withColumn("week_start", week_start("acq_date", "anchor"))
    dc = dc.where(F.col("week_start") >= first_full_week("start_date", "anchor"))
    c = dc.groupBy("project_id", "week_start", "satellite").agg(F.sum("n").alias("n"))
    return fill_grid(week_grid(projects), c, ["project_id", "week_start"])


def monthly_counts(det: DataFrame, projects: DataFrame, drop_partial_week: bool = False) -> DataFrame:
    """A2: detections per calendar month and sensor, zero-filled. Default counts every row of
    the period; drop_partial_week=True first drops the partial first week (dashboard)."""
    dc = daily_counts(det, projects)
    if drop_partial_week:
        dc = dc.where(week_start("acq_date", "anchor") >= first_full_week("start_date", "anchor"))
    c = dc.groupBy("project_id", month_start("acq_date").alias("month_start"), "satellite").agg(F.sum("n").alias("n"))
    return fill_grid(month_grid(projects), c, ["project_id", "month_start"])


def to_wide(long: DataFrame, label: str) -> DataFrame:
    """A3: one column per sensor (explicit value list: no extra job to find the values)."""
    return long.groupBy("project_id", label).pivot("satellite", schemas.SATELLITES).agg(F.sum("n_detections"))


def count_kpis(det: DataFrame, projects: DataFrame) -> DataFrame:
    """A4: last day with data and its total; totals of the week and month containing the end
    date (may be 0); peak full week; peak month. Projects with no rows in range: no row."""
    dc = daily_counts(det, projects)
    day = dc.groupBy("project_id", "start_date", "end_date", "anchor", "acq_date").agg(F.sum("n").alias("n"))
    lws = week_start("end_date", "anchor")
    lm = month_start("end_date")
    in_last_week = F.col("acq_date").between(lws, F.date_add(lws, 6))
    in_last_month = F.col("acq_date").between(lm, month_end("end_date"))
    base = day.groupBy("project_id", "start_date", "end_date", "anchor").agg(
        F.max("acq_date").alias("last_day"),
        F.max_by("n", "acq_date").alias("total_last_day"),
        F.sum(F.when(in_last_week, F.col("n")).otherwise(0)).alias("total_last_week"),
        F.sum(F.when(in_last_month, F.col("n")).otherwise(0)).alias("total_last_month"),
    )
    wk = (
        day.where(week_start("acq_date", "anchor") >= first_full_week("start_date", "anchor"))
        .groupBy("project_id", week_start("acq_date", "anchor").alias("w"))
        .agg(F.sum("n").alias("n"))
        .groupBy("project_id")
        .agg(F.max("n").alias("peak_week"))
    )
    mo = (
        day.groupBy("project_id", month_start("acq_date").alias("m"))
        .agg(F.sum("n").alias("n"))
        .groupBy("project_id")
        .agg(F.max("n").alias("peak_month"))
    )
    out = base.join(wk, "project_id", "left").join(mo, "project_id", "left")
    return out.select(
        "project_id",
        "last_day",
        F.col("total_last_day").cast("bigint").alias("total_last_day"),
        lws.alias("last_week_start"),
        F.date_add(lws, 6).alias("last_week_end"),
        F.col("total_last_week").cast("bigint").alias("total_last_week"),
        lm.alias("last_month"),
        F.col("total_last_month").cast("bigint").alias("total_last_month"),
        F.coalesce("peak_week", F.lit(0)).cast("bigint").alias("peak_week"),
        F.coalesce("peak_month", F.lit(0)).cast("bigint").alias("peak_month"),
    )
