"""Readers by name, sinks that keep what exists, boxes across the 180th meridian."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from hotspot.operators import ingest, report, spatial
from hotspot.session import new_table_path
from hotspot.sources import detections as sd
from hotspot.sources import projects as pj
from hotspot.sources import sinks


@pytest.fixture()
def mixed(tmp_path):
    """Three header layouts, a second processing level, an unknown sensor and a latin-1 file."""
    files = {
        "historical_VIIRS_SNPP_NRT_Wolf.csv": "latitude,longitude,bright_ti4,track,acq_date,acq_time,frp,confidence\n-0.1,-91.5,330.1,0.4,2024-03-01,639,12.5,n\n",
        "historical_MODIS_NRT_Wolf.csv": "acq_date,acq_time,longitude,latitude,frp,brightness\n01/03/2024,1245,-91.25,0.2,40.25,310\n",
        "historical_VIIRS_NOAA20_SP_Big_One.csv": "latitude,longitude,track,acq_date,acq_time,frp\n1.5,2.5,0.3,2024-03-02,1,7\n",
        "historical_LANDSAT_NRT_Wolf.csv": "latitude,longitude,track,acq_date,acq_time,frp\n1.0,2.0,0.3,2024-03-02,1,7\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "historical_VIIRS_NOAA21_NRT_Wolf.csv").write_bytes("latitude,longitude,track,acq_date,acq_time,frp,note\n1.0,2.0,0.3,2024-03-02,1,8,caf\u00e9\n".encode("latin-1"))
    return str(tmp_path)


def test_mixed_headers_are_read_by_name(spark, mixed):
    raw = sd.tag_project_from_path(sd.scan_tagged(spark, mixed))
    rows = {r.sensor: r for r in sd.clean_detections(raw, spark, project_type="string", carry=True).collect()}
    assert set(rows) == {"VIIRS_SNPP_NRT", "MODIS_NRT", "VIIRS_NOAA20_NRT", "VIIRS_NOAA21_NRT"}
    v, m, n = rows["VIIRS_SNPP_NRT"], rows["MODIS_NRT"], rows["VIIRS_NOAA20_NRT"]
    assert (v.latitude, v.longitude, v.frp, v.track, v.bright_ti4, v.confidence, v.brightness) == (-0.1, -91.5, 12.5, 0.4, "330.1", "n", None)
    assert (m.latitude, m.longitude, m.frp, m.track, str(m.acq_date), m.acq_time, m.brightness) == (0.2, -91.25, 40.25, None, "2024-03-01", "1245", "310")
    assert n.project_id == "Big_One" and v.project_id == "Wolf" and rows["VIIRS_NOAA21_NRT"].note == "caf\u00e9"


def test_quoted_fields_blanks_and_short_lines(spark, tmp_path):
    (tmp_path / "historical_VIIRS_SNPP_NRT_Wolf.csv").write_bytes(b'latitude,longitude,note,frp,"last"\r\n1.5,2.5,"a,b c",3,x\r\n\r\n-1.5,,  d ,,\r\n7\r\n1,2,3,4,5,6,7\r\n8,9,n,\xe9,\r\n')
    got = sorted(((r.latitude, r.longitude, r.note, r.frp, r["last"]) for r in sd.read_by_name(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([("1.5", "2.5", "a,b c", "3", "x"), ("-1.5", None, "  d ", None, None), ("7", None, None, None, None), ("1", "2", "3", "4", "5"), ("8", "9", "n", "\u00e9", None)], key=str)


def test_unknown_sensor_is_logged(spark, mixed):
    raw = sd.scan_tagged(spark, mixed)
    assert [(r.reason, r.latitude) for r in sd.rejected_rows(raw).collect()] == [("sensor", "1.0")]
    assert {r.sensor: (r.rows_read, r.rows_dropped) for r in sd.reject_log(raw).collect()}[""] == (1, 1)


def test_carried_columns_survive_the_merge(spark, mixed):
    raw = sd.tag_project_from_path(sd.scan_tagged(spark, mixed))
    batch = sd.clean_detections(raw, spark, project_type="string", carry=True).withColumn("origin", F.lit(1)).withColumn("ingest_seq", F.col("source_id").cast("long"))
    path = new_table_path(spark, "archive")
    sinks.merge_into_archive(spark, path, batch)
    sinks.merge_into_archive(spark, path, batch)
    rows = sinks.read_archive_table(spark, path).collect()
    assert len(rows) == 4 and {r.confidence for r in rows} == {"n", None}


def test_merge_reads_and_rewrites_only_touched_partitions(spark):
    rows = [(p, p * 10 + m, f"2024-0{m}-05") for p in range(1, 9) for m in (1, 2)]
    df = spark.createDataFrame(rows, "project_id long, detection_id long, d string")
    df = df.select("project_id", "detection_id", F.lit("VIIRS_SNPP_NRT").alias("sensor"), F.lit("SNPP").alias("satellite"), F.lit(1).alias("source_id"), F.col("d").cast("date").alias("acq_date"), F.lit("0100").alias("acq_time"), F.col("d").cast("date").cast("timestamp_ntz").alias("obs_ts"), F.lit(1.0).alias("frp"), F.lit(0.4).alias("track"), F.lit(1.0).alias("latitude"), F.col("project_id").cast("double").alias("longitude"), F.lit(0).alias("origin"), F.col("detection_id").alias("ingest_seq"))
    path = new_table_path(spark, "archive")
    sinks.write_archive(df, path)
    files = lambda: {r[0] for r in sinks.read_archive_table(spark, path).select(F.input_file_name()).distinct().collect()}
    before = files()
    batch = df.where("project_id = 3 and detection_id = 31").withColumn("origin", F.lit(1)).withColumn("frp", F.lit(2.0))
    sinks.merge_into_archive(spark, path, batch)
    kept = {f for f in before if f"{sinks.MONTH}=2024-01" not in f}
    assert kept <= files() and len(files() - before) == 1
    rows_now = sinks.read_archive_table(spark, path)
    assert rows_now.where("frp = 2.0").count() == 1 and rows_now.count() == len(rows)


def test_only_a_missing_table_counts_as_none(spark, tmp_path):
    assert sinks.read_if_exists(spark, str(tmp_path / "none")) is None
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "part-0.parquet").write_bytes(b"no parquet at all")
    with pytest.raises(Exception) as e:
        sinks.read_if_exists(spark, str(tmp_path / "t"))
    assert not isinstance(e.value, AnalysisException) or e.value.getCondition() != "PATH_NOT_FOUND"


def _lines(spark, rows):
    return spark.createDataFrame(rows, "project_key string, line_no int, line string")


def test_saving_one_project_keeps_the_others(spark):
    root = new_table_path(spark, "projects")
    pj.write_projects(_lines(spark, [("ASIA", 0, "volcano=Asia"), ("ASIA", 1, "filter_frp=7")]), root)
    pj.write_projects(_lines(spark, [("AFRICA", 0, "volcano=Africa")]), root)
    pj.write_projects(_lines(spark, [("ASIA", 0, "volcano=Asia"), ("ASIA", 1, "filter_frp=8")]), root)
    assert sorted((r.project_key, r.filter_frp) for r in pj.scan_projects(spark, root).collect()) == [("AFRICA", 35.0), ("ASIA", 8.0)]


def test_one_key_under_two_roots_is_two_projects(spark, tmp_path):
    for root, text in (("projects", "filter_frp=1\nfilter_track=0.1\n"), ("examples", "filter_frp=99\n")):
        d = tmp_path / root / "Wolf"
        d.mkdir(parents=True)
        (d / "config_Wolf.txt").write_text(text)
    rows = pj.scan_projects(spark, [str(tmp_path / "projects"), str(tmp_path / "examples")]).collect()
    assert sorted((r.project_key, r.filter_frp, r.filter_track) for r in rows) == [("Wolf", 1.0, 0.1), ("Wolf", 99.0, 0.5)]


def test_reports_of_other_periods_stay(spark):
    path = new_table_path(spark, "report")
    for month in ("01", "02"):
        prj = spark.sql(f"select 1L project_id, timestamp_ntz'2024-{month}-01 00:00:00' start_ts, timestamp_ntz'2024-{month}-28 00:00:00' end_ts")
        rep = spark.createDataFrame([(1, "counts", "total", float(month), None)], "project_id long, section string, metric string, value_num double, value_text string")
        report.write_report(rep, prj, path)
    assert sorted(r.value_num for r in report.read_report(spark, path).collect()) == [1.0, 2.0]


BOX = "project_id long, vent_lat double, vent_lon double, ref_radius_m double"


def test_boxes_across_the_180th_meridian(spark):
    prj = spark.createDataFrame([(1, 0.0, 179.97, 5000.0), (2, 0.0, 0.0, 2_000_000.0)], BOX)
    det = spark.createDataFrame([(1, 10, 0.0, -179.99), (1, 11, 0.0, 179.96), (1, 12, 0.0, 0.0), (2, 13, 10.0, -15.0)], "project_id long, detection_id long, latitude double, longitude double")
    inside = {r.detection_id: r.inside for r in spatial.in_bbox(det, prj).collect()}
    assert inside == {10: True, 11: True, 12: False, 13: True}
    got = sorted((r.detection_id, r.project_id) for r in spatial.assign_projects(det.drop("project_id"), prj).collect())
    assert got == [(10, 1), (11, 1), (12, 2), (13, 2)]


def test_refresh_keeps_the_delivery_that_goes_on(spark):
    h = spark.createDataFrame([(1, "s", 5, "a"), (1, "s", 6, "b"), (1, "t", 5, None)], "project_id long, sensor string, acq_date int, delivery string")
    b = spark.createDataFrame([(1, "s", 5, "a"), (1, "s", 6, "c"), (1, "t", 5, "c")], "project_id long, sensor string, acq_date int, delivery string")
    assert [(r.sensor, r.acq_date) for r in ingest.refresh_anti(h, b).collect()] == [("s", 5)]


def test_migration_rewrites_only_folders_that_need_it(spark, tmp_path):
    root = tmp_path / "arch"
    for sensor, dates in (("MODIS_NRT", ["2024-03-01"]), ("VIIRS_SNPP_NRT", ["01/03/2024", "2/3/24", "bad", "2024-03-04"])):
        d = root / "project_id=Wolf" / f"sensor={sensor}"
        d.mkdir(parents=True)
        (d / "a.csv").write_text("latitude,longitude,acq_date,acq_time,frp\n" + "".join(f"1.0,2.0,{x},100,3\n" for x in dates))
    log = sinks.migrate_archive(spark, str(root)).collect()
    assert [(r.sensor, r["count"]) for r in log] == [("VIIRS_SNPP_NRT", 4)]
    assert (root / "project_id=Wolf" / "sensor=MODIS_NRT" / "a.csv").exists()
    raw = sd.read_archive(spark, str(root)).where("sensor = 'VIIRS_SNPP_NRT'")
    assert sorted(r.acq_date for r in raw.collect()) == ["2024-03-01", "2024-03-02", "2024-03-04", "bad"]
    assert sinks.migrate_archive(spark, str(root)).collect() == []
    assert sd.read_archive(spark, str(root)).count() == 5


def test_migration_of_flat_files_as_they_are_named(spark, tmp_path):
    head = "latitude,longitude,acq_date,acq_time,frp,note\n"
    flat = tmp_path / "historical_VIIRS_SNPP_NRT_Big One.csv"
    flat.write_bytes((head + "1.0,2.0,03/01/2024,100,3,caf\u00e9\n").encode("latin-1") + b"1.0,2.0,2024-01-04,1,,\n\n1.0,2.0,bad,1,4,x\n" + b'1.0,2.0,03/01/2024,1,4,"a,b"\n')
    other = tmp_path / "historical_MODIS_NRT_Wolf.csv"
    other.write_text("acq_date,latitude,longitude\n5/6/23,1.0,2.0\n")
    clean = tmp_path / "historical_VIIRS_NOAA20_NRT_Wolf.csv"
    clean.write_text(head + "1.0,2.0,2024-03-01,100,3,x\n")
    odd = tmp_path / "readme.csv"
    odd.write_text("no header\n03/01/2024\n")
    (tmp_path / "_migrating-dead").mkdir()
    before = clean.stat().st_mtime_ns, odd.stat().st_mtime_ns
    log = {r.project_id: (r.sensor, r["count"], r.n_changed, r.n_unreadable) for r in sinks.migrate_archive(spark, str(tmp_path)).collect()}
    assert log == {"Big%20One": ("VIIRS_SNPP_NRT", 4, 1, 1), "Wolf": ("MODIS_NRT", 1, 1, 0)}
    assert flat.read_text() == head + '1.0,2.0,2024-01-03,100,3,caf\u00e9\n1.0,2.0,2024-01-04,1,,\n\n1.0,2.0,bad,1,4,x\n1.0,2.0,03/01/2024,1,4,"a,b"\n'
    assert other.read_text() == "acq_date,latitude,longitude\n2023-06-05,1.0,2.0\n"
    assert before == (clean.stat().st_mtime_ns, odd.stat().st_mtime_ns)
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("_")]
    assert sinks.migrate_archive(spark, str(tmp_path)).collect() == []


def test_raw_archive_is_written_in_shares_of_bounded_size(spark, monkeypatch):
    """The rows that a writing task sorts are a share of the advisory size, not a split of the input."""
    from hotspot.plans import ingest_queries as iq

    raw = spark.range(0, 24_000, 1, 6).selectExpr("id % 2 as project_id", "cast(id as string) as detection_id", "if(id % 4 < 2, 'MODIS_NRT', 'VIIRS_SNPP_NRT') as sensor")
    monkeypatch.setattr(iq.fx, "raw_li", lambda *_: raw)

    def files():
        archive = spark.read.option("header", True).csv(iq._write_raw(spark, "unused"))
        assert archive.select("detection_id").distinct().count() == archive.count() == 24_000
        return len(archive.inputFiles())

    assert files() == 4
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8k")
    try:
        assert files() > 4
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
