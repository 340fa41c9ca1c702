"""Animation frames: detections seen up to, before, and on each day of the period."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hotspot.operators.dims import dim_join


def day_grid(projects: DataFrame) -> DataFrame:
    """Slider days: start date + 0 .. whole days between start and end."""
    p = projects.select(
        "project_id",
        F.to_date("start_ts").alias("d0"),
        F.timestamp_diff("DAY", F.col("start_ts"), F.col("end_ts")).cast("int").alias("nd"),
    )
    return p.select("project_id", F.explode(F.sequence(F.lit(0), F.greatest(F.col("nd"), F.lit(0)))).alias("k"), "d0").select(
        "project_id", F.date_add("d0", F.col("k")).alias("day")
    )


def daily_detections(filtered: DataFrame) -> DataFrame:
    """(project, day) -> detections that day (map-side combined)."""
    return filtered.groupBy("project_id", F.to_date("obs_ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def running_count(daily: DataFrame) -> DataFrame:
    """Cumulative detections per project over the days that have data."""
    w = Window.partitionBy("project_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("n_cumulative", F.sum("n").over(w))


def frame_counts(filtered: DataFrame, projects: DataFrame) -> DataFrame:
    """For every slider day, detections seen so far (date <= day), on the day, and
    before it. One daily count + a running sum over the day grid — never the detections x
    days expansion. Days before the period contribute to the cumulative count, as in the
    source (it filters by date <= day only)."""
    daily = daily_detections(filtered)
    grid = day_grid(projects)
    first = grid.groupBy("project_id").agg(F.min("day").alias("g0"))
    # detections before the first slider day fold into one carried-in count
    carried = dim_join(daily, first, "project_id").where(F.col("day") < F.col("g0")).groupBy("project_id").agg(
        F.sum("n").alias("n0")
    )
    g = grid.join(daily, ["project_id", "day"], "left").join(carried, "project_id", "left")
    w = Window.partitionBy("project_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    cum = F.sum(F.coalesce("n", F.lit(0))).over(w) + F.coalesce(F.col("n0"), F.lit(0))
    today = F.coalesce("n", F.lit(0))
    return g.select(
        "project_id", "day",
        cum.cast("bigint").alias("n_cumulative"),
        today.cast("bigint").alias("n_today"),
        (cum - today).cast("bigint").alias("n_before"),
    )


def as_of(filtered: DataFrame, day) -> DataFrame:
    """detections visible on `day` (date <= day), labelled 'before' or 'today'."""
    d = F.to_date("obs_ts")
    day_c = F.lit(day).cast("date") if isinstance(day, str) else day
    v = filtered.where(d <= day_c)
    return v.withColumn("state", F.when(d == day_c, F.lit("today")).otherwise(F.lit("before")))
