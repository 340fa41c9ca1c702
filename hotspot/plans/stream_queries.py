"""Streaming jobs run to completion (availableNow) on landed files and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from hotspot.operators import runout as ro
from hotspot.plans import count_queries as cq
from hotspot.plans import ingest_queries as iq
from hotspot.plans.common import Registry, round6
from hotspot.plans.runout_queries import DAILY, FILTERED, FRONT_COLS, frontier_ctes
from hotspot.plans.sql_fixtures import r6, with_fixtures
from hotspot.session import new_table_path
from hotspot.sources import fixtures as fx
from hotspot.streaming import jobs

R = Registry()


def _paths(spark, name):
    return tuple(new_table_path(spark, f"{name}-{p}") for p in ("landing", "out", "chk"))


@R.add("stream_ingest", iq.SCANNED)
def q_stream_ingest(spark, sf):
    """Dirty text files land in project/sensor folders; the stream types and cleans them."""
    landing, out, chk = _paths(spark, "ingest")
    fx.raw_li(spark, sf).write.partitionBy("project_id", "sensor").option("header", True).csv(landing)
    jobs.stream_ingest(spark, landing, out, chk, project_type="bigint")
    return round6(jobs.ingested(spark, out).drop("batch", "_path"))


DEDUP_SQL = with_fixtures(["det_ev"], ["""src AS (SELECT *, true AS first FROM det_ev UNION ALL
    SELECT * REPLACE (latitude + 0.00001 AS latitude), false FROM det_ev)"""],
    """SELECT project_id, sensor, round_even(latitude * 10000, 0) / 10000 AS lat_r, round_even(longitude * 10000, 0) / 10000 AS lon_r,
       acq_date, acq_time, coalesce(min(detection_id) FILTER (WHERE first), min(detection_id)) AS detection_id FROM src GROUP BY ALL""")


@R.add("stream_dedup", DEDUP_SQL)
def q_stream_dedup(spark, sf):
    """The later half of the table lands and is processed, then the earlier half (all late),
    then all of it again as 4-dp near copies and as exact copies; the surviving keys, and the
    ids that survive for them, equal the batch result."""
    landing, out, chk = _paths(spark, "dedup")
    d = fx.detections_ev(spark, sf)
    near = d.withColumn("latitude", F.col("latitude") + 0.00001)
    late = F.col("acq_date") < F.lit("2024-01-16").cast("date")
    for part in (d.where(~late), d.where(late), near.unionByName(d)):
        part.write.mode("append").parquet(landing)
        jobs.stream_dedup(spark, landing, out, chk)
    return spark.read.parquet(out).select(*jobs.DEDUP_KEY, "detection_id")


@R.add("stream_merge", with_fixtures(["det_ev"], iq.MERGE_CTES, "SELECT project_id, detection_id, sensor, satellite, source_id, acq_date, acq_time, obs_ts, "
                                      + r6("frp", "track", "latitude", "longitude") + ", ingest_seq FROM merged"))
def q_stream_merge(spark, sf):
    """The new batch arrives as two landings, the later days first; each micro-batch is
    merged into the archive; a run with nothing new changes nothing."""
    hist, new = iq.merge_inputs(spark, sf)
    landing, archive, chk = _paths(spark, "merge")
    from hotspot.sources import sinks

    sinks.write_archive(hist, archive)
    cols = [f.name for f in jobs.MERGE_INPUT.fields if f.name != "delivery"]
    cut = F.lit("2024-01-21").cast("date")
    new.where(F.col("acq_date") > cut).select(*cols).write.parquet(landing)
    jobs.stream_merge(spark, landing, archive, chk)
    new.where(F.col("acq_date") <= cut).select(*cols).write.mode("append").parquet(landing)
    jobs.stream_merge(spark, landing, archive, chk)
    jobs.stream_merge(spark, landing, archive, chk)  # nothing new: no change
    return round6(sinks.read_archive_table(spark, archive).select(*iq.DET_COLS, "ingest_seq"))


@R.add("stream_weekly", with_fixtures(["det_li"], [], f"""SELECT project_id, {cq.wk('acq_date', '3')} AS week_start, satellite, count(*) AS n_detections
  FROM det_li GROUP BY ALL"""))
def q_stream_weekly(spark, sf):
    """T4: tumbling Thursday-anchored weeks per project and satellite (no calendar fill)."""
    landing, out, chk = _paths(spark, "weekly")
    d = fx.detections_li(spark, sf)
    cut = F.col("acq_date") < F.lit("1996-01-01").cast("date")
    for part in (d.where(~cut), d.where(cut)):  # the second landing is years late
        part.write.mode("append").parquet(landing)
        jobs.stream_weekly(spark, landing, out, chk, anchor=3)
    return jobs.read_weeks(spark, out)


@R.add("stream_frontier", with_fixtures(["projects_ev", "det_ev"], [FILTERED, DAILY] + frontier_ctes(), "SELECT project_id, date_only, satellite, source, date, "
                                        + r6("distance_km", "frp", "latitude", "longitude", "max_distance", "prev_max", "time_diff", "distance_diff", "speed")
                                        + " FROM front"))
def q_stream_frontier(spark, sf):
    """T5: daily maxima arrive in four landings, the second week last; each run replays
    the days from the earliest new one on."""
    landing, out, chk = _paths(spark, "frontier")
    daily = ro.daily_runout(ro.filter_runout(fx.detections_ev(spark, sf), fx.projects_ev(spark, sf)))
    bounds = ["0001-01-01", "2024-01-08", "2024-01-15", "2024-01-22", "9999-12-31"]
    spans = list(zip(bounds, bounds[1:]))
    for lo, hi in (spans[0], spans[2], spans[3], spans[1]):  # one stream run each
        part = daily.where((F.col("date_only") >= F.lit(lo).cast("date")) & (F.col("date_only") < F.lit(hi).cast("date")))
        part.write.mode("append").parquet(landing)
        jobs.stream_frontier(spark, landing, out, chk)
    back = spark.read.parquet(out).withColumn("project_id", F.col("project_id").cast("bigint"))
    return round6(back.select(*FRONT_COLS))
