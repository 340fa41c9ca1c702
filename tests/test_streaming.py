"""Streaming specifics beyond stream = batch (covered by the oracle tests)."""

from pyspark.sql import functions as F

from conftest import SMALL
from hotspot.plans.ingest_queries import merge_inputs
from hotspot.session import new_table_path
from hotspot.sources import sinks
from hotspot.streaming import jobs


def _snapshot(spark, path):
    return sorted(tuple(r) for r in sinks.read_archive_table(spark, path).select("project_id", "detection_id", "ingest_seq", "latitude").collect())


def test_replayed_batch_changes_nothing(spark):
    hist, new = merge_inputs(spark, SMALL)
    archive = new_table_path(spark, "replay-archive")
    sinks.write_archive(hist, archive)
    batch = new.drop("origin")
    assert jobs.merge_batch(spark, archive, batch, "d") is True
    first = _snapshot(spark, archive)
    assert jobs.merge_batch(spark, archive, batch, "d") is True
    assert _snapshot(spark, archive) == first
    assert jobs.merge_batch(spark, archive, batch.limit(0), "d") is False


DET = "project_id long, detection_id long, sensor string, satellite string, source_id int, acq_date date, acq_time string, obs_ts timestamp_ntz, frp double, track double, latitude double, longitude double"


def _det(spark, rows):
    """Detections (id, date, latitude) of one project and sensor."""
    data = [(1, i, "VIIRS_SNPP_NRT", "SNPP", 1, day, "0100", f"{day} 01:00:00", 9.0, 0.4, lat, 10.0) for i, day, lat in rows]
    df = spark.createDataFrame(data, DET.replace("acq_date date", "acq_date string").replace("timestamp_ntz", "string"))
    return df.withColumn("acq_date", F.col("acq_date").cast("date")).withColumn("obs_ts", F.col("obs_ts").cast("timestamp_ntz"))


def _paths(spark, *names):
    return [new_table_path(spark, n) for n in names]


def test_dedup_keeps_late_detections(spark):
    land, out, chk = _paths(spark, "land", "out", "chk")
    for rows in ([(1, "2024-03-01", 1.0)], [(2, "2024-01-01", 1.0)], [(3, "2024-01-01", 1.00001), (4, "2023-01-01", 2.0)]):
        _det(spark, rows).write.mode("append").parquet(land)
        jobs.stream_dedup(spark, land, out, chk)
    assert sorted(r.detection_id for r in spark.read.parquet(out).collect()) == [1, 2, 4]


def test_weekly_counts_late_detections(spark):
    land, out, chk = _paths(spark, "land", "out", "chk")
    for rows in ([(1, "2024-03-01", 1.0)], [(2, "2024-01-03", 1.0)], [(3, "2024-01-04", 1.0), (4, "2024-01-03", 2.0)]):
        _det(spark, rows).write.mode("append").parquet(land)
        jobs.stream_weekly(spark, land, out, chk, anchor=0)
    got = {str(r.week_start): r.n_detections for r in jobs.read_weeks(spark, out).collect()}
    assert got == {"2024-02-26": 1, "2024-01-01": 3}


def test_weekly_counts_of_two_streams_add_up(spark):
    land, land2, out, chk, chk2, chk3 = _paths(spark, "land", "land2", "out", "chk", "chk2", "chk3")
    got = lambda: {str(r.week_start): r.n_detections for r in jobs.read_weeks(spark, out).collect()}
    _det(spark, [(1, "2024-01-03", 1.0), (2, "2024-01-03", 2.0), (3, "2024-01-04", 1.0)]).write.parquet(land)
    _det(spark, [(4, "2024-01-03", 1.0), (5, "2024-01-12", 2.0), (6, "2024-01-04", 1.0)]).write.parquet(land2)
    jobs.stream_weekly(spark, land, out, chk, anchor=0)
    jobs.stream_weekly(spark, land2, out, chk2, anchor=0)
    both = {"2024-01-01": 5, "2024-01-08": 1}
    assert got() == both
    jobs.stream_weekly(spark, land, out, chk3, anchor=0)  # anew, without its checkpoint
    assert got() == both
    _det(spark, [(7, "2024-01-05", 1.0)]).write.mode("append").parquet(land2)
    jobs.stream_weekly(spark, land2, out, chk2, anchor=0)
    assert got() == {"2024-01-01": 6, "2024-01-08": 1}


def test_merge_first_load_split_delivery_and_second_stream(spark):
    land, archive, chk, land2, chk2 = _paths(spark, "land", "archive", "chk", "land2", "chk2")
    seq = lambda df: df.withColumn("ingest_seq", F.col("detection_id"))
    # no archive yet; three copies of a row are one
    seq(_det(spark, [(1, "2024-01-01", 1.0), (5, "2024-01-01", 1.0), (6, "2024-01-01", 1.0)])).write.parquet(land)
    jobs.stream_merge(spark, land, archive, chk)
    # a later fetch replaces the date
    seq(_det(spark, [(7, "2024-01-01", 7.0)])).write.mode("append").parquet(land)
    jobs.stream_merge(spark, land, archive, chk)
    assert sorted(r.detection_id for r in sinks.read_archive_table(spark, archive).collect()) == [7]
    # a named response of that date goes on in a second file and batch
    for i in (1, 2):
        seq(_det(spark, [(i, "2024-01-01", float(i))])).withColumn("delivery", F.lit("d1")).write.mode("append").parquet(land)
        jobs.stream_merge(spark, land, archive, chk)
    ids = lambda: sorted(r.detection_id for r in sinks.read_archive_table(spark, archive).collect())
    assert ids() == [1, 2]
    # another stream starts at batch 0 again
    seq(_det(spark, [(3, "2024-01-02", 3.0)])).write.parquet(land2)
    jobs.stream_merge(spark, land2, archive, chk2)
    assert ids() == [1, 2, 3]
    # a new response replaces the date
    seq(_det(spark, [(4, "2024-01-01", 4.0)])).withColumn("delivery", F.lit("again")).write.mode("append").parquet(land2)
    jobs.stream_merge(spark, land2, archive, chk2)
    assert ids() == [3, 4]


def _days(spark, rows):
    """Daily maxima (project, date, satellite, km, latitude)."""
    data = [(p, d, sat, km, 1.0, lat, 0.0, 1) for p, d, sat, km, lat in rows]
    df = spark.createDataFrame(data, "project_id long, date_only string, satellite string, distance_km double, frp double, latitude double, longitude double, source int")
    return df.withColumn("date_only", F.col("date_only").cast("date"))


def test_frontier_takes_days_in_any_order(spark):
    from hotspot import schemas

    land, out, chk = _paths(spark, "land", "out", "chk")
    assert [f.name for f in schemas.DAILY_RUNOUT.fields] == _days(spark, [(1, "2024-01-01", "SNPP", 1.0, 0.0)]).columns[1:]
    for d, km in (("2024-01-10", 3.0), ("2024-01-05", 2.0), ("2024-01-12", 2.5), ("2024-01-10", 3.0)):
        _days(spark, [(1, d, "SNPP", km, 0.0)]).write.mode("append").parquet(land)
        jobs.stream_frontier(spark, land, out, chk)
    rows = sorted((str(r.date), r.max_distance, r.time_diff) for r in spark.read.parquet(out).collect())
    assert [(d, m) for d, m, _ in rows] == [("2024-01-05", 2.0), ("2024-01-10", 3.0)] and rows[1][2] == 120.0


def test_frontier_state_equals_the_batch_frontier(spark):
    """Days of many projects in a random order, some delivered again nearer or farther, with nulls."""
    import random

    from hotspot.operators import frontier
    from hotspot.streaming import frontier_state

    rng = random.Random(2)
    rows = [(p, f"2024-0{rng.randint(1, 3)}-{rng.randint(1, 28):02d}", rng.choice(["SNPP", "NOAA20", None]), rng.choice([None, 0.0, *(round(rng.uniform(0, 9), 3) for _ in range(6))]), float(i)) for p in range(4) for i in range(60)]
    land, out, chk = _paths(spark, "land", "out", "chk")
    for k in range(3):
        _days(spark, rows[k::3]).repartition(3).write.mode("append").parquet(land)
        jobs.stream_frontier(spark, land, out, chk)
    everything = _days(spark, rows)
    best = F.max_by(F.struct("distance_km", "frp", "latitude", "longitude", "source"), F.struct("distance_km", "latitude", "longitude"))
    daily = everything.groupBy("project_id", "date_only", "satellite").agg(best.alias("r")).select("project_id", "date_only", "satellite", "r.*")
    names = frontier_state.OUT.names
    want = sorted(map(str, frontier.frontier(daily).select(*names).collect()))
    got = spark.read.schema(frontier_state.OUT).parquet(out).select(*names)
    assert sorted(map(str, got.collect())) == want and len(want) > 10


def test_frontier_reads_no_kept_table(spark, monkeypatch):
    """A batch is worked out from the state alone: the only thing that is read is the landed file."""
    land, out, chk = _paths(spark, "land", "out", "chk")
    _days(spark, [(1, "2024-01-10", "SNPP", 3.0, 0.0)]).write.parquet(land)
    jobs.stream_frontier(spark, land, out, chk)
    plans = []
    run = jobs._run

    def kept(writer):
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        plans.append(query._jsq.explainInternal(False))

    monkeypatch.setattr(jobs, "_run", kept)
    _days(spark, [(1, "2024-01-05", "SNPP", 2.0, 0.0)]).write.mode("append").parquet(land)
    jobs.stream_frontier(spark, land, out, chk)
    assert run is not kept and "TransformWithState" in plans[0] and plans[0].count("FileScan parquet") == 1 and out not in plans[0]
    assert spark.read.parquet(out).count() == 2


def test_event_time_is_zone_free(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:00",)], "s string").select(F.col("s").cast("timestamp_ntz").alias("obs_ts"))
    secs = df.select(F.unix_seconds(jobs.event_time())).first()[0]
    assert secs == 1704164640


def test_stream_ingest_reads_both_sensor_layouts(spark):
    from hotspot import schemas

    cols = [f.name for f in schemas.RAW_DETECTION.fields]
    viirs = [("-0.38123", "-91.51001", "330.1", "0.4", "0.37", "2024-03-01", "639", "N", "VIIRS", "n", "2.0NRT", "290.2", "12.5", "D")]
    modis = [("-0.38555", "-91.52002", "315.0", "1.0", "1.0", "01/03/2024", "1245", "A", "MODIS", "80", "6.1NRT", "300.0", "40.25", "D")]
    landing, out, chk = (new_table_path(spark, n) for n in ("land", "out", "chk"))
    spark.createDataFrame(viirs, ", ".join(f"{c} string" for c in cols)).write.option("header", True) \
        .csv(f"{landing}/project_id=Fernandina/sensor=VIIRS_SNPP_NRT")
    mcols = [c.replace("bright_ti4", "brightness").replace("bright_ti5", "bright_t31") for c in cols]
    spark.createDataFrame(modis, ", ".join(f"{c} string" for c in mcols)).write.option("header", True) \
        .csv(f"{landing}/project_id=Fernandina/sensor=MODIS_NRT")
    jobs.stream_ingest(spark, landing, out, chk)
    jobs.stream_ingest(spark, landing, out, chk)  # nothing new
    assert jobs.ingested(spark, out).count() == 2
    rows = {r["sensor"]: r for r in jobs.ingested(spark, out).collect()}
    assert rows["VIIRS_SNPP_NRT"]["frp"] == 12.5 and rows["VIIRS_SNPP_NRT"]["acq_time"] == "0639"
    assert rows["MODIS_NRT"]["frp"] == 40.25 and str(rows["MODIS_NRT"]["acq_date"]) == "2024-03-01"
    assert {r["project_id"] for r in rows.values()} == {"Fernandina"}


def test_stream_ingest_two_streams_and_a_lost_checkpoint(spark):
    land, land2, out, chk, chk2, chk3 = _paths(spark, "land", "land2", "out", "chk", "chk2", "chk3")

    def file(folder, k):
        rows = [(str(10 * k + i), f"{k}.5", "10.0", "2024-03-01", "100", "9.0", "0.4") for i in range(2)]
        df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ("detection_id", "latitude", "longitude", "acq_date", "acq_time", "frp", "track")))
        df.coalesce(1).write.mode("append").option("header", True).csv(f"{folder}/project_id=p/sensor=MODIS_NRT")

    ids = lambda: sorted(r.detection_id for r in jobs.ingested(spark, out).collect())
    for k in (1, 2):  # two batches of the first stream
        file(land, k)
        jobs.stream_ingest(spark, land, out, chk)
    file(land2, 3)
    jobs.stream_ingest(spark, land2, out, chk2)  # another stream's batch 0
    assert ids() == [10, 11, 20, 21, 30, 31]
    file(land, 4)
    for _ in range(2):  # the first stream anew without its checkpoint, then nothing new
        jobs.stream_ingest(spark, land, out, chk3)
        assert ids() == [10, 11, 20, 21, 30, 31, 40, 41]
    file(land, 5)
    jobs.stream_ingest(spark, land, out, chk3)
    assert ids() == [10, 11, 20, 21, 30, 31, 40, 41, 50, 51]


def _landed(folder, name, ids):
    import os

    os.makedirs(f"{folder}/project_id=p/sensor=MODIS_NRT", exist_ok=True)
    with open(f"{folder}/project_id=p/sensor=MODIS_NRT/{name}", "w") as f:
        f.write("detection_id,latitude,longitude,acq_date,acq_time,frp,track\n" + "".join(f"{i},1.5,10.0,2024-03-01,100,9.0,0.4\n" for i in ids))


def test_ingest_backlog_comes_in_batches_and_reads_no_table(spark, tmp_path, monkeypatch):
    land, out, chk = (str(tmp_path / n) for n in ("land", "out", "chk"))
    for k in range(7):
        _landed(land, f"f{k}.csv", [k])
    read, opened = sinks.read_if_exists, []
    monkeypatch.setattr(sinks, "read_if_exists", lambda s, path: opened.append(path) or read(s, path))
    jobs.stream_ingest(spark, land, out, chk, max_files=3)
    rows = jobs.ingested(spark, out)
    assert sorted(r.detection_id for r in rows.collect()) == list(range(7)) and rows.select("batch").distinct().count() == 3
    assert set(opened) == {jobs.ledger_of(out)}  # no batch has opened the table itself
    assert spark.read.parquet(jobs.ledger_of(out)).count() == 7
    opened.clear()
    jobs.stream_ingest(spark, land, out, str(tmp_path / "chk2"), max_bytes=1000)  # anew: all is known
    assert sorted(r.detection_id for r in jobs.ingested(spark, out).collect()) == list(range(7))
    assert spark.read.parquet(jobs.ledger_of(out)).count() == 7 and spark.read.parquet(out).count() == 7


def test_a_file_replaced_under_its_name_is_taken_again(spark, tmp_path):
    import os

    land, out, chk = (str(tmp_path / n) for n in ("land", "out", "chk"))
    _landed(land, "a.csv", [1, 2])
    _landed(land, "b of c%d.csv", [3])
    jobs.stream_ingest(spark, land, out, chk)
    assert jobs.ingested(spark, out).count() == 3
    _landed(land, "a.csv", [4])
    later = os.stat(f"{land}/project_id=p/sensor=MODIS_NRT/a.csv").st_mtime + 5
    os.utime(f"{land}/project_id=p/sensor=MODIS_NRT/a.csv", (later, later))
    ids = lambda: sorted(r.detection_id for r in jobs.ingested(spark, out).collect())
    jobs.stream_ingest(spark, land, out, chk)
    assert ids() == [3, 4]
    jobs.stream_ingest(spark, land, out, str(tmp_path / "chk2"))
    assert ids() == [3, 4]


def test_an_ingest_batch_applied_again_changes_nothing(spark, tmp_path, monkeypatch):
    """The job dies after the part is written, before or after its line in the ledger."""
    import shutil

    land, out, chk = (str(tmp_path / n) for n in ("land", "out", "chk"))
    _landed(land, "a.csv", [1, 2])
    jobs.stream_ingest(spark, land, out, chk)
    ids = lambda: sorted(r.detection_id for r in jobs.ingested(spark, out).collect())
    for lost in (("commits",), ("commits", "ledger")):
        for f in (tmp_path / "chk" / "commits").iterdir():
            f.unlink()
        if "ledger" in lost:
            shutil.rmtree(jobs.ledger_of(out))
        jobs.stream_ingest(spark, land, out, chk)
        assert ids() == [1, 2] and spark.read.parquet(out).count() == 2
