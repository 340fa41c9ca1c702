"""Runout: detections filtered per project, distance to the vent, daily maxima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotspot import schemas
from hotspot.functions.geo import haversine_km
from hotspot.operators.dims import dim_join

PROJECT_COLS = ["project_id", "vent_lat", "vent_lon", "start_ts", "end_ts", "filter_frp", "frp_mode", "filter_track", "ref_radius_m"]


def with_project(det: DataFrame, projects: DataFrame, cols=PROJECT_COLS) -> DataFrame:
    """Detections joined to their project's parameters (broadcast when small)."""
    return dim_join(det, projects.select(*cols), "project_id")


def frp_predicate(frp="frp", threshold="filter_frp", mode="frp_mode"):
    """mode 'gt' keeps frp >= threshold, any other mode keeps frp <= threshold."""
    f, t, m = F.col(frp), F.col(threshold), F.col(mode)
    return F.when(m == "gt", f >= t).otherwise(f <= t)


def filter_runout(det: DataFrame, projects: DataFrame) -> DataFrame:
    """F4 + P7: VIIRS detections inside the project's period (full timestamps, inclusive),
    track <= max, frp by mode; plus great-circle distance to the vent (km)."""
    d = with_project(det.where(F.col("satellite").isin(schemas.VIIRS)), projects)
    d = d.where(
        (F.col("track") <= F.col("filter_track"))
        & frp_predicate()
        & F.col("obs_ts").between(F.col("start_ts"), F.col("end_ts"))
    )
    return d.withColumn("distance_km", haversine_km("vent_lat", "vent_lon", "latitude", "longitude"))


def day_order_key():
    """One long ordering the detections of a day by (time, latitude, longitude): minute of
    the day (observation times are whole minutes, HHMM) in bits 51-61, latitude and
    longitude at the archive's 5 decimals in bits 26-50 and 0-25. Detections equal on all
    three are the same point at the same minute, so the pick among them does not matter.
    A primitive key keeps the daily aggregate a hash aggregate (a struct key would force
    a sort-based one)."""
    minute = F.hour("obs_ts") * 60 + F.minute("obs_ts")
    lat5 = F.rint(F.col("latitude") * 1e5).cast("long") + 9_000_000
    lon5 = F.rint(F.col("longitude") * 1e5).cast("long") + 18_000_000
    return F.shiftleft(minute.cast("long"), 51) + F.shiftleft(lat5, 26) + lon5


def daily_runout(filtered: DataFrame) -> DataFrame:
    """Per project, day and satellite: max distance, max FRP, and the coordinates and
    source of the first detection of the day in the order (time, latitude, longitude)."""
    d = filtered.select("project_id", F.to_date("obs_ts").alias("date_only"), "satellite", "distance_km", "frp",
                        "latitude", "longitude", "source_id", day_order_key().alias("ord"))
    return d.groupBy("project_id", "date_only", "satellite").agg(
        F.max("distance_km").alias("distance_km"), F.max("frp").alias("frp"),
        F.min_by("latitude", "ord").alias("latitude"), F.min_by("longitude", "ord").alias("longitude"),
        F.min_by("source_id", "ord").alias("source"),
    )


def daily_runout_point(filtered: DataFrame) -> DataFrame:
    """A10: like A9 but the coordinates are those of the farthest detection of the day."""
    # farthest first, then the greatest id, as one number of at most 34 digits: distances in nanometres
    # (closer ones are one place) before the id. A primitive key keeps it a hash aggregate, as in A9
    digits = "decimal(38,0)"
    far = F.expr(f"cast(cast(round(distance_km * 1e12) as decimal(17,0)) * cast(100000000000000000000 as decimal(21,0)) as {digits})")
    ident = F.expr(f"cast(cast(detection_id as decimal(20,0)) + 9223372036854775808 as {digits})")
    d = filtered.withColumn("_far", (far + F.coalesce(ident, F.lit(0).cast(digits))).cast(digits))
    of_far = lambda c, name: F.max_by(c, "_far").alias(name)
    return d.groupBy("project_id", F.to_date("obs_ts").alias("date_only"), "satellite").agg(
        F.max("distance_km").alias("distance_km"), F.max("frp").alias("frp"),
        of_far("latitude", "latitude"), of_far("longitude", "longitude"), of_far("source_id", "source"), of_far("obs_ts", "obs_ts"),
    )


def period_summary(filtered: DataFrame) -> DataFrame:
    """Mean / max FRP and distance over the filtered detections of each project."""
    return filtered.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("n_detections"),
        F.avg("frp").alias("frp_mean"), F.max("frp").alias("frp_max"),
        F.avg("distance_km").alias("dist_mean"), F.max("distance_km").alias("dist_max"),
    )


def satellite_series(filtered: DataFrame, satellites: list[str] | None = None) -> DataFrame:
    """A17 + F5: time series of FRP and distance of the chosen satellites (of all), data behind the
    charts: by project and satellite in order of time, then id (one sort, for output)."""
    d = filtered if satellites is None else filtered.where(F.col("satellite").isin(list(satellites)))
    return d.select("project_id", "satellite", "detection_id", "obs_ts", "frp", "distance_km").orderBy("project_id", "satellite", "obs_ts", "detection_id")


def radius_check(filtered: DataFrame, projects: DataFrame) -> DataFrame:
    """Reference radius (km), whether and when the runout first exceeded it."""
    p = projects.select("project_id", (F.col("ref_radius_m") / 1000.0).alias("radius_km"))
    d = filtered.select("project_id", "obs_ts", "distance_km")
    j = dim_join(d, p, "project_id")
    beyond = F.col("distance_km") > F.col("radius_km")
    agg = j.groupBy("project_id").agg(
        F.count_if(beyond).alias("n_beyond"),
        F.min(F.when(beyond, F.col("obs_ts"))).alias("first_beyond_ts"),
        F.max("distance_km").alias("max_distance_km"),
    )
    out = p.join(agg, "project_id", "left")
    return out.select(
        "project_id", "radius_km",
        F.coalesce("n_beyond", F.lit(0)).cast("bigint").alias("n_beyond"),
        (F.coalesce("n_beyond", F.lit(0)) > 0).alias("exceeded"),
        "first_beyond_ts", "max_distance_km",
    )
