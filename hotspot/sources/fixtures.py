"""Deterministic detection/project views over the driver's tables.

The driver's tables hold no satellite detections, so every registered query runs on
views derived here from ``events``/``region`` (time-of-day detections, 5 projects) and
``lineitem`` (multi-year calendar data). Work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hotspot import schemas

N_PROJECTS = 5

_PLANS: dict = {}


def memo(fn):
    """Build a fixture view once per (session, data folder): the lazy plan is reused (no
    data is cached), which saves the driver-side expression building of every query."""

    def wrapper(spark: SparkSession, sf_dir: str, *rest) -> DataFrame:
        key = (fn.__name__, id(spark), sf_dir.rstrip("/"), *rest)
        hit = _PLANS.get(key)
        if hit is None or hit[0] is not spark:
            hit = (spark, fn(spark, sf_dir, *rest))
            _PLANS[key] = hit
        return hit[1]

    wrapper.__name__ = fn.__name__
    wrapper.__doc__ = fn.__doc__
    return wrapper


@memo
def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of a driver table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case(k: Column, values: list, default=None) -> Column:
    out = F.lit(default)
    for i in reversed(range(len(values))):
        out = F.when(k == i, F.lit(values[i])).otherwise(out)
    return out


def _ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


@memo
def projects_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One project per region: vent, period, filters, waypoints (see README §fixtures)."""
    k = F.col("r_regionkey")
    return _project_rows(read_table(spark, sf_dir, "region"), k, k, F.col("r_name"))


@memo
def projects_su(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One project per supplier (a catalogue that grows with the data), with the same variety."""
    k = F.col("s_suppkey")
    return _project_rows(read_table(spark, sf_dir, "supplier"), F.pmod(k, F.lit(N_PROJECTS)), k, F.concat(F.lit("Site "), k.cast("string")))


def _project_rows(t: DataFrame, k: Column, project_id: Column, name: Column) -> DataFrame:
    """Project rows in N_PROJECTS forms by `k`."""
    return t.select(
        project_id.cast("bigint").alias("project_id"),
        name.alias("volcano"),
        (F.lit(-0.4) + F.lit(0.1) * k).alias("vent_lat"),
        (F.lit(-91.5) + F.lit(0.1) * k).alias("vent_lon"),
        F.timestamp_add("DAY", k, _ntz("2024-01-01 00:00:00")).alias("start_ts"),
        F.timestamp_add("DAY", k, _ntz("2024-01-25 00:00:00")).alias("end_ts"),
        F.when(k == 3, F.lit(400.0)).otherwise(F.lit(5.0) + F.lit(5.0) * k).alias("filter_frp"),
        F.when(k == 3, F.lit("lt")).otherwise(F.lit("gt")).alias("frp_mode"),
        F.when(k == 2, F.lit(0.45)).otherwise(F.lit(0.5)).alias("filter_track"),
        (F.lit(13200.0) + F.lit(1000.0) * k).alias("ref_radius_m"),
        F.when(k == 1, F.lit(0)).when(k == 4, F.lit(6)).otherwise(F.lit(3)).cast("int").alias("week_anchor"),
        _case(k, ["Crater;Hut", "Crater", "", "A;B;C", "Ridge;"], "").alias("wpt_names"),
        _case(k, ["-0.35;-0.36", "-0.25", "", "-0.05;;-0.07", "0.01;abc"], "").alias("wpt_lats"),
        _case(k, ["-91.45;-91.46", "-91.35", "", "-91.2;-91.21;-91.22", "-91.1;-91.1"], "").alias("wpt_lons"),
        _case(k, ["triangle;", "circle", "circle", "star;square;x", ""], "").alias("wpt_symbols"),
        _case(k, ["", schemas.MAP_KEY_PLACEHOLDER, "k2", "k3", "k4"], "").alias("map_key"),
        (k != 2).alias("include_reference_radius"),
        k.isin(0, 3, 4).alias("include_reference_waypoint"),
    )


@memo
def projects_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar projects over lineitem: a multi-year period with partial weeks, a Monday-
    anchored one, one shorter than a week, one with no rows (1990), one covering all."""
    r = read_table(spark, sf_dir, "region")
    k = F.col("r_regionkey")
    starts = ["1996-01-03 00:00:00", "1997-03-15 00:00:00", "1998-05-06 00:00:00", "1990-01-01 00:00:00", "1995-01-01 00:00:00"]
    ends = ["1998-12-28 00:00:00", "1999-06-30 23:59:00", "1998-05-09 00:00:00", "1990-12-31 00:00:00", "2001-12-31 23:59:00"]
    return r.select(
        k.cast("bigint").alias("project_id"),
        F.col("r_name").alias("volcano"),
        (F.lit(-0.4) + F.lit(0.1) * k).alias("vent_lat"),
        (F.lit(-91.5) + F.lit(0.1) * k).alias("vent_lon"),
        _case(k, starts).cast("timestamp_ntz").alias("start_ts"),
        _case(k, ends).cast("timestamp_ntz").alias("end_ts"),
        F.lit(20.0).alias("filter_frp"),
        F.lit("gt").alias("frp_mode"),
        F.lit(0.5).alias("filter_track"),
        F.lit(15000.0).alias("ref_radius_m"),
        F.when(k == 1, F.lit(0)).when(k == 4, F.lit(6)).otherwise(F.lit(3)).cast("int").alias("week_anchor"),
        F.lit("").alias("wpt_names"),
        F.lit("").alias("wpt_lats"),
        F.lit("").alias("wpt_lons"),
        F.lit("").alias("wpt_symbols"),
        F.lit("k").alias("map_key"),
        F.lit(True).alias("include_reference_radius"),
        F.lit(False).alias("include_reference_waypoint"),
    )


def _with_sensor(df: DataFrame, spark: SparkSession) -> DataFrame:
    # The sensor dimension has 4 fixed rows: a bounded broadcast.
    return df.join(F.broadcast(schemas.sensors(spark).drop("family")), "satellite")


@memo
def detections_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean detections from events: project = user_id mod 5, sensor from the event type
    (MODIS for purchases and errors), scatter around the vent growing by day."""
    e = read_table(spark, sf_dir, "events")
    region = read_table(spark, sf_dir, "region").select("r_regionkey")
    # region has a fixed 5 rows (TPC-H): bounded broadcast
    j = e.join(F.broadcast(region), F.pmod(e.user_id, F.lit(N_PROJECTS)) == region.r_regionkey)
    k = F.col("r_regionkey")
    sat = (
        F.when(F.col("event_type") == "view", "SNPP")
        .when(F.col("event_type") == "click", "NOAA20")
        .when(F.col("event_type") == "signup", "NOAA21")
        .otherwise("MODIS")
    )
    acq_date = F.col("ts").cast("date")
    days = (F.datediff(acq_date, F.lit("2024-01-01").cast("date")) + 1).cast("double")
    scat_lat = (F.pmod(F.col("event_id") * 7919, F.lit(2001)) - 1000).cast("double") / F.lit(100000.0)
    scat_lon = (F.pmod(F.col("event_id") * 104729, F.lit(2001)) - 1000).cast("double") / F.lit(100000.0)
    base = j.select(
        k.cast("bigint").alias("project_id"),
        F.col("event_id").alias("detection_id"),
        sat.alias("satellite"),
        acq_date.alias("acq_date"),
        (F.hour("ts") * 60 + F.minute("ts")).alias("minute_of_day"),
        F.col("value").alias("frp"),
        (F.lit(0.32) + F.get_json_object("props", "$.k").cast("int").cast("double") * F.lit(0.004)).alias("track"),
        F.round(F.lit(-0.4) + F.lit(0.1) * k + scat_lat * days, 5).alias("latitude"),
        F.round(F.lit(-91.5) + F.lit(0.1) * k + scat_lon * days, 5).alias("longitude"),
    )
    return _typed(_with_sensor(base, spark))


def _typed(d: DataFrame) -> DataFrame:
    """acq_time text ('HHMM') and the observation timestamp from the minute of the day."""
    m = F.col("minute_of_day")
    hhmm = F.lpad((F.floor(m / 60) * 100 + F.pmod(m, F.lit(60))).cast("string"), 4, "0")
    return d.select(
        "project_id", "detection_id", "sensor", "satellite", "source_id", "acq_date", hhmm.alias("acq_time"),
        F.timestamp_add("MINUTE", m, F.col("acq_date").cast("timestamp_ntz")).alias("obs_ts"),
        "frp", "track", "latitude", "longitude",
    )


@memo
def _li_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    pid = F.pmod(F.col("l_suppkey"), F.lit(N_PROJECTS))
    sat = (
        F.when(F.pmod("l_linenumber", F.lit(4)) == 0, "MODIS")
        .when(F.pmod("l_linenumber", F.lit(4)) == 1, "SNPP")
        .when(F.pmod("l_linenumber", F.lit(4)) == 2, "NOAA20")
        .otherwise("NOAA21")
    )
    hh = F.pmod(F.col("l_orderkey") * 37, F.lit(24))
    mm = F.pmod(F.col("l_partkey"), F.lit(60))
    scat_lat = (F.pmod(F.col("l_partkey") * 7919 + F.col("l_linenumber") * 104729, F.lit(2001)) - 1000).cast("double") / F.lit(20000.0)
    scat_lon = (F.pmod(F.col("l_orderkey") * 104729 + F.col("l_linenumber") * 7919, F.lit(2001)) - 1000).cast("double") / F.lit(20000.0)
    return li.select(
        pid.cast("bigint").alias("project_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("detection_id"),
        sat.alias("satellite"),
        F.col("l_shipdate").cast("date").alias("acq_date"),
        hh.alias("hh"),
        mm.alias("mm"),
        (F.col("l_extendedprice") / F.lit(1000.0)).alias("frp"),
        (F.lit(0.32) + F.col("l_discount") * F.lit(3.0)).alias("track"),
        F.round(F.lit(-0.4) + F.lit(0.1) * pid + scat_lat, 5).alias("latitude"),
        F.round(F.lit(-91.5) + F.lit(0.1) * pid + scat_lon, 5).alias("longitude"),
        F.col("l_orderkey"),
    )


@memo
def detections_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean detections from lineitem (multi-year; calendar operators and the bench)."""
    b = _li_base(spark, sf_dir).withColumn("minute_of_day", F.col("hh") * 60 + F.col("mm"))
    return _typed(_with_sensor(b, spark))


@memo
def raw_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty text archive rows from lineitem: date layout by l_orderkey mod 4 (ISO, dd/MM/yyyy,
    d/M/yy, 'bad'), time without leading zeros, frp blank/text/NaN on some rows."""
    b = _li_base(spark, sf_dir)
    d = F.col("acq_date")
    lay = F.pmod(F.col("l_orderkey"), F.lit(4))
    text_date = (
        F.when(lay == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(lay == 1, F.date_format(d, "dd/MM/yyyy"))
        .when(lay == 2, F.date_format(d, "d/M/yy"))
        .otherwise(F.lit("bad"))
    )
    sel = F.pmod(F.col("detection_id"), F.lit(97))
    frp_text = (
        F.when(sel == 0, F.lit(""))
        .when(sel == 1, F.lit("n/a"))
        .when(sel == 2, F.lit("NaN"))
        .otherwise(F.col("frp").cast("string"))
    )
    b = _with_sensor(b, spark)
    return b.select(
        "project_id",
        F.col("detection_id").cast("string").alias("detection_id"),
        "sensor",
        F.col("latitude").cast("string").alias("latitude"),
        F.col("longitude").cast("string").alias("longitude"),
        F.col("track").cast("string").alias("track"),
        text_date.alias("acq_date"),
        (F.col("hh") * 100 + F.col("mm")).cast("string").alias("acq_time"),
        frp_text.alias("frp"),
    )
