"""Order and choice of the satellite series, farthest points, saved configs."""

import datetime as dt

from pyspark.sql import functions as F

from hotspot.operators import ingest, runout
from hotspot.session import new_table_path
from hotspot.sources import projects as pj


def rows(spark, data):
    df = spark.createDataFrame(data, "project_id long, satellite string, detection_id long, t string, frp double, distance_km double, latitude double, longitude double, source_id int")
    return df.withColumn("obs_ts", F.col("t").cast("timestamp_ntz")).drop("t")


DATA = [
    (1, "SNPP", 3, "2024-01-02 05:00:00", 1.0, 2.5, 0.1, 0.2, 1),
    (1, "SNPP", 1, "2024-01-02 04:00:00", 2.0, 2.5, 0.3, 0.4, 2),
    (1, "NOAA20", 9, "2024-01-01 04:00:00", 2.0, 1e-9, 0.3, 0.4, 2),
    (1, "NOAA20", -9, "2024-01-01 04:00:00", 2.0, 0.0, 0.5, 0.6, 2),
    (0, "MODIS", 2, "2024-01-03 04:00:00", None, 19000.000001, 0.3, 0.4, 2),
    (0, "MODIS", 4, "2024-01-03 04:00:00", 3.0, 19000.0, 0.7, 0.8, 3),
]


def test_series_is_ordered_and_filtered(spark):
    d = rows(spark, DATA).repartition(5)
    ids = lambda s: [r.detection_id for r in runout.satellite_series(d, s).collect()]
    assert ids(None) == [2, 4, -9, 9, 1, 3] and ids(["SNPP", "MODIS"]) == [2, 4, 1, 3] and ids([]) == []


def test_farthest_point_by_a_hash_aggregate(spark):
    out = runout.daily_runout_point(rows(spark, DATA))
    got = {(r.project_id, r.satellite): (r.latitude, r.source, r.frp, r.obs_ts) for r in out.collect()}
    assert got == {(1, "SNPP"): (0.1, 1, 2.0, dt.datetime(2024, 1, 2, 5)), (1, "NOAA20"): (0.3, 2, 2.0, dt.datetime(2024, 1, 1, 4)), (0, "MODIS"): (0.3, 2, 3.0, dt.datetime(2024, 1, 3, 4))}
    d = rows(spark, DATA).withColumns({"origin": F.lit(0), "ingest_seq": F.col("detection_id") + 10})
    first = ingest.dedup_first(d, key=["project_id"])
    assert {r.project_id: r.detection_id for r in first.collect()} == {0: 2, 1: -9}
    for df in (out, first.select("project_id", "detection_id", "frp")):
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()


def test_saved_configs_are_normalised_and_filled(spark):
    root = new_table_path(spark, "saved")
    prj = spark.sql("""select 'Mt X' volcano, 1.5d vent_lat, cast(null as double) vent_lon, timestamp_ntz'2024-03-05 13:30:00' start_ts, timestamp_ntz'2024-03-09 02:00:00' end_ts,
        cast(null as double) filter_frp, cast(null as string) frp_mode, 0.7d filter_track, cast(null as string) map_key, cast(null as boolean) include_reference_radius, 100d ref_radius_m,
        true include_reference_waypoint, cast(null as string) wpt_names, '1;2' wpt_lats, '3;4' wpt_lons, cast(null as string) wpt_symbols""")
    pj.save_projects(prj, root)
    lines = {r.value for r in spark.read.text(root).select("value").collect()}
    assert {"start_day_str=05/03/2024 00:00", "end_day_str=09/03/2024 23:59", "filter_frp=35", "frp_filter_mode=gt", "map_key=INSERT_YOUR_MAP_KEY_HERE", "longs_vent=0.0", "filter_track=0.7", "include_reference_radius=True"} <= lines
    r = pj.scan_projects(spark, root).first()
    assert (r.project_key, r.start_ts, r.end_ts, r.filter_frp, r.wpt_symbols) == ("Mt_X", dt.datetime(2024, 3, 5), dt.datetime(2024, 3, 9, 23, 59), 35.0, "circle")
