"""Fixed schemas, the sensor dimension and project defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Raw per-sensor archive as delivered (CSV text). Every column is read as text and
# typed by the cleaning functions, so a bad value never fails the scan.
RAW_DETECTION = T.StructType(
    [
        T.StructField("latitude", T.StringType()),
        T.StructField("longitude", T.StringType()),
        T.StructField("bright_ti4", T.StringType()),
        T.StructField("scan", T.StringType()),
        T.StructField("track", T.StringType()),
        T.StructField("acq_date", T.StringType()),
        T.StructField("acq_time", T.StringType()),
        T.StructField("satellite", T.StringType()),
        T.StructField("instrument", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("bright_ti5", T.StringType()),
        T.StructField("frp", T.StringType()),
        T.StructField("daynight", T.StringType()),
    ]
)

# Canonical cleaned detections (one global table for all projects and sensors).
DETECTIONS = T.StructType(
    [
        T.StructField("project_id", T.LongType()),
        T.StructField("detection_id", T.LongType()),
        T.StructField("sensor", T.StringType()),
        T.StructField("satellite", T.StringType()),
        T.StructField("source_id", T.IntegerType()),
        T.StructField("acq_date", T.DateType()),
        T.StructField("acq_time", T.StringType()),
        T.StructField("obs_ts", T.TimestampNTZType()),
        T.StructField("frp", T.DoubleType()),
        T.StructField("track", T.DoubleType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
    ]
)

DAILY_RUNOUT = T.StructType(
    [
        T.StructField("date_only", T.DateType()),
        T.StructField("satellite", T.StringType()),
        T.StructField("distance_km", T.DoubleType()),
        T.StructField("frp", T.DoubleType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("source", T.IntegerType()),
    ]
)

FRONTIER = T.StructType(
    DAILY_RUNOUT.fields
    + [
        T.StructField("date", T.DateType()),
        T.StructField("max_distance", T.DoubleType()),
        T.StructField("prev_max", T.DoubleType()),
        T.StructField("time_diff", T.DoubleType()),
        T.StructField("distance_diff", T.DoubleType()),
        T.StructField("speed", T.DoubleType()),
    ]
)

VOLCANOES = T.StructType(
    [
        T.StructField("Volcano Name", T.StringType()),
        T.StructField("Latitude", T.DoubleType()),
        T.StructField("Longitude", T.DoubleType()),
    ]
)

# The sensor dimension. Archive key, satellite label, numeric source id
# (the id written into the daily maxima), and instrument family. MODIS has no map id.
SENSORS = [
    ("MODIS_NRT", "MODIS", 0, "MODIS"),
    ("VIIRS_SNPP_NRT", "SNPP", 1, "VIIRS"),
    ("VIIRS_NOAA20_NRT", "NOAA20", 2, "VIIRS"),
    ("VIIRS_NOAA21_NRT", "NOAA21", 3, "VIIRS"),
]
SENSOR_SCHEMA = "sensor string, satellite string, source_id int, family string"
SATELLITES = [s[1] for s in SENSORS]
VIIRS = [s[1] for s in SENSORS if s[3] == "VIIRS"]

# Project configuration keys, in file order, and the defaults applied
# when a key is missing.
CONFIG_KEYS = [
    "volcano",
    "lats_vent",
    "longs_vent",
    "start_day_str",
    "end_day_str",
    "filter_frp",
    "frp_filter_mode",
    "filter_track",
    "map_key",
    "include_reference_radius",
    "ref_radius_m",
    "include_shapefile",
    "shapefile_path",
    "include_reference_waypoint",
    "wpt_names",
    "wpt_lats",
    "wpt_lons",
    "wpt_symbols",
]
CONFIG_DEFAULTS = {
    "volcano": "Volcano Name",
    "lats_vent": "0.0",
    "longs_vent": "0.0",
    "start_day_str": "01/01/2026 00:00",
    "end_day_str": "01/05/2026 23:59",
    "filter_frp": "35",
    "frp_filter_mode": "gt",
    "filter_track": "0.5",
    "map_key": "INSERT_YOUR_MAP_KEY_HERE",
    "include_reference_radius": "True",
    "ref_radius_m": "5000",
    "include_shapefile": "False",
    "shapefile_path": "",
    "include_reference_waypoint": "False",
    "wpt_names": "Reference Point",
    "wpt_lats": "0.0",
    "wpt_lons": "0.0",
    "wpt_symbols": "circle",
}
MAP_KEY_PLACEHOLDER = "INSERT_YOUR_MAP_KEY_HERE"
DEFAULT_SYMBOL = "circle"

# Typed project dimension used by every operator (one row per project).
PROJECTS = T.StructType(
    [
        T.StructField("project_id", T.LongType()),
        T.StructField("volcano", T.StringType()),
        T.StructField("vent_lat", T.DoubleType()),
        T.StructField("vent_lon", T.DoubleType()),
        T.StructField("start_ts", T.TimestampNTZType()),
        T.StructField("end_ts", T.TimestampNTZType()),
        T.StructField("filter_frp", T.DoubleType()),
        T.StructField("frp_mode", T.StringType()),
        T.StructField("filter_track", T.DoubleType()),
        T.StructField("ref_radius_m", T.DoubleType()),
        T.StructField("week_anchor", T.IntegerType()),
        T.StructField("wpt_names", T.StringType()),
        T.StructField("wpt_lats", T.StringType()),
        T.StructField("wpt_lons", T.StringType()),
        T.StructField("wpt_symbols", T.StringType()),
        T.StructField("map_key", T.StringType()),
        T.StructField("include_reference_radius", T.BooleanType()),
        T.StructField("include_reference_waypoint", T.BooleanType()),
    ]
)


def sensors(spark: SparkSession) -> DataFrame:
    """4-row sensor dimension as an inline JVM table (no Python round trip); its size is
    fixed, so it may always be broadcast."""
    from pyspark.sql import functions as F

    rows = [
        F.struct(F.lit(k).alias("sensor"), F.lit(s).alias("satellite"), F.lit(i).cast("int").alias("source_id"), F.lit(f).alias("family"))
        for k, s, i, f in SENSORS
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))
