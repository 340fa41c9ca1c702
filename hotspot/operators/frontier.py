"""Frontier: running maximum of the daily runout, its advances and their speed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_max(daily: DataFrame, order=("date_only", "satellite"), key="project_id") -> DataFrame:
    """Running max of distance_km and the previous running max (0 before the first row).
    Runs on daily rows (at most a few per project and day), so the per-project window is
    bounded by the calendar, not by the detection volume."""
    w = Window.partitionBy(key).orderBy(*order)
    return daily.withColumn(
        "max_distance", F.max("distance_km").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn(
        "prev_max",
        F.coalesce(F.max("distance_km").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
    )


def safe_rate(num="distance_diff", den="time_diff"):
    """Num / den where den > 0, else 0."""
    return F.when(F.col(den) > 0, F.col(num) / F.col(den)).otherwise(F.lit(0.0))


def frontier(daily: DataFrame, order=("date_only", "satellite"), date_col="date_only", key="project_id") -> DataFrame:
    """Rows strictly beyond the previous running max, with hours since the previous kept
    row, the advance in metres and the speed (m/h; 0 when no time elapsed or first row)."""
    rm = running_max(daily, order, key).where(F.col("distance_km") > F.col("prev_max"))
    w = Window.partitionBy(key).orderBy(*order)
    prev_date = F.lag(date_col).over(w)
    td = (F.datediff(F.col(date_col), prev_date) * 24).cast("double")
    dd = (F.col("max_distance") - F.col("prev_max")) * 1000.0
    return (
        rm.withColumn("date", F.col(date_col))
        .withColumn("time_diff", td)
        .withColumn("distance_diff", dd)
        .withColumn("speed", safe_rate("distance_diff", "time_diff"))
    )


def frontier_daily(daily: DataFrame, key="project_id") -> DataFrame:
    """Order-free variant, one row per day (max over satellites), then W2."""
    per_day = daily.groupBy(key, "date_only").agg(F.max("distance_km").alias("distance_km"))
    return frontier(per_day, order=("date_only",), key=key).select(
        key, "date", "distance_km", "max_distance", "prev_max", "time_diff", "distance_diff", "speed"
    )


def speed_summary(front: DataFrame, key="project_id") -> DataFrame:
    """Max distance, max and mean speed (zeros included, as the source does), mean of
    the positive speeds, first and last frontier date, number of frontier rows."""
    return front.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max("max_distance").alias("max_distance_km"),
        F.max("speed").alias("max_speed"),
        F.avg("speed").alias("mean_speed"),
        F.avg(F.when(F.col("speed") > 0, F.col("speed"))).alias("speed_positive_mean"),
        F.count_if(F.col("speed") == 0).alias("n_zero_speed"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
