"""The versioned archive: a killed writer, a running reader, two writers, growing months, old versions."""

import os
import signal
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from conftest import ROOT
from hotspot.operators import ingest
from hotspot.session import new_table_path
from hotspot.sources import archive, files


def rows_of(spark, rows):
    """(project, id, date, latitude) as detections of one sensor, in the order of their ids."""
    data = [(p, i, "VIIRS_SNPP_NRT", "SNPP", 1, day, "0100", f"{day} 01:00:00", 9.0, 0.4, lat, 10.0, 1, i) for p, i, day, lat in rows]
    df = spark.createDataFrame(data, "project_id long, detection_id long, sensor string, satellite string, source_id int, d string, acq_time string, t string, frp double, track double, latitude double, longitude double, origin int, ingest_seq long")
    return df.withColumn("acq_date", F.col("d").cast("date")).withColumn("obs_ts", F.col("t").cast("timestamp_ntz")).drop("d", "t")


def ids(spark, path):
    return sorted(r.detection_id for r in archive.read_archive_table(spark, path).collect())


KILLED = """
import os, signal, sys
sys.path[:0] = [{root!r}, {tests!r}]
from hotspot.session import get_session
from hotspot.sources import archive
from test_archive import rows_of
spark = get_session("local[2]", 2)
archive.switch = lambda *a: os.kill(os.getpid(), signal.SIGKILL)  # all is written but the switch
archive.merge_into_archive(spark, {path!r}, rows_of(spark, [(1, 9, "2024-01-05", 9.0)]))
"""


def test_a_writer_killed_before_the_switch_leaves_the_archive_as_it_was(spark):
    path = new_table_path(spark, "killed")
    archive.merge_into_archive(spark, path, rows_of(spark, [(1, 1, "2024-01-05", 1.0), (1, 2, "2024-02-05", 2.0)]))
    env = os.environ | {"PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", KILLED.format(root=ROOT, tests=os.path.join(ROOT, "tests"), path=path)], env=env, capture_output=True, timeout=300)
    assert done.returncode == -signal.SIGKILL
    assert len(files.children(spark, f"{path}/_manifests")) == 2 and len(files.children(spark, f"{path}/_versions")) == 1
    assert ids(spark, path) == [1, 2]
    archive.merge_into_archive(spark, path, rows_of(spark, [(1, 9, "2024-01-05", 9.0)]))  # tried again
    assert ids(spark, path) == [2, 9]
    time.sleep(1.1)
    assert archive.remove_old(spark, path, 0.5) > 0 and ids(spark, path) == [2, 9]
    live = {f"commit={p.commit}" for p in archive.snapshot(spark, path).parts}
    assert {n for n, _ in files.children(spark, f"{path}/_data")} == live
    assert archive.remove_old(spark, path, 0.5) == 0


def test_a_running_reader_keeps_its_version(spark):
    path = new_table_path(spark, "reader")
    archive.merge_into_archive(spark, path, rows_of(spark, [(1, 1, "2024-01-05", 1.0), (2, 2, "2024-01-06", 2.0)]))
    before = archive.read_archive_table(spark, path)
    for k in range(3, 6):
        archive.merge_into_archive(spark, path, rows_of(spark, [(1, k, "2024-01-05", float(k))]))
    assert sorted(r.detection_id for r in before.collect()) == [1, 2] and ids(spark, path) == [2, 5]
    assert archive.remove_old(spark, path, 3600) == 0  # replaced just now: kept for readers
    assert sorted(r.detection_id for r in before.collect()) == [1, 2]


def test_a_second_writer_goes_on_from_the_first(spark, monkeypatch):
    path = new_table_path(spark, "writers")
    archive.merge_into_archive(spark, path, rows_of(spark, [(1, 1, "2024-01-05", 1.0)]))
    switch, other = archive.switch, []

    def late(*args):
        if not other:  # another writer comes first, once
            other.append(1)
            archive.merge_into_archive(spark, path, rows_of(spark, [(1, 2, "2024-01-06", 2.0)]))
        switch(*args)

    monkeypatch.setattr(archive, "switch", late)
    log = archive.merge_into_archive(spark, path, rows_of(spark, [(1, 3, "2024-01-07", 3.0)])).collect()
    assert ids(spark, path) == [1, 2, 3] and [(r.rows_new, r.rows_total) for r in log] == [(1, 3)]
    other.clear()
    with pytest.raises(archive.VersionTaken):
        archive.merge_into_archive(spark, path, rows_of(spark, [(1, 4, "2024-01-08", 3.0)]), tries=1)
    assert ids(spark, path) == [1, 2, 3]


def test_months_get_as_many_buckets_as_their_rows_ask_for(spark, monkeypatch):
    monkeypatch.setattr(archive, "BUCKET_ROWS", 10)
    path = new_table_path(spark, "grows")
    # one project holds nearly all rows
    day = lambda k: f"2024-01-{1 + k % 28:02d}"
    archive.merge_into_archive(spark, path, rows_of(spark, [(1, k, day(k), float(k)) for k in range(10)] + [(2, 100, "2024-03-01", 1.0)]))
    assert archive.snapshot(spark, path).buckets() == {"2024-01": 1, "2024-03": 1}
    archive.merge_into_archive(spark, path, rows_of(spark, [(1, k, day(k), float(k)) for k in range(10, 28)]))
    held = archive.snapshot(spark, path)
    assert held.buckets() == {"2024-01": 4, "2024-03": 1} and sum(p.rows for p in held.parts) == 29
    assert len([p for p in held.parts if p.month == "2024-01"]) == 4 and ids(spark, path) == [*range(28), 100]
    # a later batch of one date touches one bucket of its month
    archive.merge_into_archive(spark, path, rows_of(spark, [(1, 50, day(3), 50.0)]))
    now = archive.snapshot(spark, path)
    assert len(set(now.parts) - set(held.parts)) == 1 and ids(spark, path) == sorted([*(k for k in range(28) if k != 3), 50, 100])
    assert archive.read_archive_table(spark, path, "2024-02", "2024-12").count() == 1


def test_log_counts_the_whole_archive_without_reading_it(spark):
    path = new_table_path(spark, "log")
    archive.merge_into_archive(spark, path, rows_of(spark, [(1, 1, "2024-01-05", 1.0), (1, 2, "2024-02-05", 2.0), (2, 3, "2024-02-05", 2.0)]))
    # id 4 replaces id 1, 5 is a near copy of it, 6 has no place
    log = archive.merge_into_archive(spark, path, rows_of(spark, [(1, 4, "2024-01-05", 1.0), (1, 5, "2024-01-05", 1.00001), (1, 6, "2024-01-09", None)])).collect()
    assert [tuple(r) for r in log] == [(1, "VIIRS_SNPP_NRT", 3, 1, 1, 2)]
    assert ids(spark, path) == [2, 3, 4]


def test_a_date_that_comes_again_without_a_place_is_emptied(spark):
    path = new_table_path(spark, "empty")
    archive.merge_into_archive(spark, path, rows_of(spark, [(1, 1, "2024-01-05", 1.0), (1, 2, "2024-02-05", 1.0)]))
    archive.merge_into_archive(spark, path, rows_of(spark, [(1, 3, "2024-01-05", None)]))
    assert ids(spark, path) == [2] and {p.month for p in archive.snapshot(spark, path).parts} == {"2024-02"}


def test_whole_months_are_replaced_by_a_write(spark):
    path = new_table_path(spark, "write")
    archive.write_archive(rows_of(spark, [(1, 1, "2024-01-05", 1.0), (2, 2, "2024-01-06", 1.0), (1, 3, "2024-02-05", 1.0)]), path)
    archive.write_archive(rows_of(spark, [(1, 4, "2024-01-07", 1.0)]).withColumn("note", F.lit("x")), path)
    assert ids(spark, path) == [3, 4]
    assert {(r.detection_id, r.note) for r in archive.read_archive_table(spark, path).collect()} == {(3, None), (4, "x")}
    archive.merge_into_archive(spark, path, rows_of(spark, [(1, 5, "2024-02-05", 1.0)]).limit(0))
    assert ids(spark, path) == [3, 4]
    with pytest.raises(FileNotFoundError):
        archive.read_archive_table(spark, path + "-none")


def test_one_pass_merge_reads_each_side_once_for_rows(spark):
    """History once, the batch once for its rows and once for its dates; the log reads neither."""
    h = rows_of(spark, [(1, 1, "2024-01-05", 1.0)]).withColumn("origin", F.lit(0))
    paths = [new_table_path(spark, n) for n in ("h", "b")]
    for df, p in zip((h, h.withColumn("origin", F.lit(1))), paths):
        df.write.parquet(p)
    hist, batch = (spark.read.parquet(p) for p in paths)
    plan = ingest.merge_detections(hist, batch)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 3 and "SortAggregate" not in ingest.merge_detections(hist, batch)._jdf.queryExecution().executedPlan().toString()
