"""Ingest: typing/cleaning, archive scans, merge and logs — Spark plans and SQL oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hotspot.functions import clean as cl
from hotspot.operators import ingest as ing
from hotspot.plans.common import Registry, round6
from hotspot.plans.sql_fixtures import r6, with_fixtures
from hotspot.session import new_table_path
from hotspot.sources import detections as sd
from hotspot.sources import fixtures as fx
from hotspot.sources import sinks

R = Registry()

LAYOUT = "((detection_id // 8) % 4)"
FRP_BAD = "(detection_id % 97 IN (0, 1, 2))"
DET_COLS = ["project_id", "detection_id", "sensor", "satellite", "source_id", "acq_date", "acq_time", "obs_ts",
            "frp", "track", "latitude", "longitude"]

# expected typed rows after reading the dirty text archive back
SCANNED = with_fixtures(["det_li"], [], f"""SELECT project_id, detection_id, sensor, satellite, source_id, acq_date, acq_time, obs_ts,
       CASE WHEN {FRP_BAD} THEN NULL ELSE round(frp, 6) END AS frp, {r6('track', 'latitude', 'longitude')}
  FROM det_li WHERE {LAYOUT} <> 3""")


def _raw(spark, sf):
    return fx.raw_li(spark, sf)


def _write_raw(spark, sf) -> str:
    """The dirty text archive (project/sensor folders), written to a fresh folder."""
    path = new_table_path(spark, "raw-archive")
    # a task sorts its rows by folder before it writes: shares of the advisory size, whatever the input's splits
    raw = _raw(spark, sf).hint("rebalance", "project_id", "sensor")
    raw.write.partitionBy("project_id", "sensor").option("header", True).csv(path)
    return path


_ARCHIVES: dict = {}


def _raw_archive(spark, sf) -> str:
    """The text archive the scan queries read: written once per (session, data folder) and
    never modified afterwards (it stands for an archive that already exists)."""
    key = (id(spark), sf.rstrip("/"))
    hit = _ARCHIVES.get(key)
    if hit is None or hit[0] is not spark:
        hit = (spark, _write_raw(spark, sf))
        _ARCHIVES[key] = hit
    return hit[1]


@R.add(
    "coerce_numeric",
    with_fixtures(["det_li"], [], f"SELECT detection_id, CASE WHEN {FRP_BAD} THEN NULL ELSE round(frp, 6) END AS frp, "
                  + r6("track", "latitude") + " FROM det_li"),
)
def q_coerce_numeric(spark, sf):
    r = _raw(spark, sf)
    return round6(r.select(F.col("detection_id").cast("bigint").alias("detection_id"), cl.coerce_numeric("frp").alias("frp"),
                           cl.coerce_numeric("track").alias("track"), cl.coerce_numeric("latitude").alias("latitude")))


@R.add("pad_time", with_fixtures(["det_li"], [], "SELECT detection_id, acq_time FROM det_li"))
def q_pad_time(spark, sf):
    r = _raw(spark, sf)
    return r.select(F.col("detection_id").cast("bigint").alias("detection_id"), cl.pad_time("acq_time").alias("acq_time"))


@R.add(
    "parse_date",
    with_fixtures(["det_li"], [], f"SELECT detection_id, CASE WHEN {LAYOUT} = 3 THEN NULL ELSE acq_date END AS acq_date FROM det_li"),
)
def q_parse_date(spark, sf):
    r = _raw(spark, sf)
    return r.select(F.col("detection_id").cast("bigint").alias("detection_id"), cl.parse_date("acq_date").alias("acq_date"))


@R.add(
    "build_obs_ts",
    with_fixtures(["det_li"], [], f"SELECT detection_id, CASE WHEN {LAYOUT} = 3 THEN NULL ELSE obs_ts END AS obs_ts FROM det_li"),
)
def q_build_obs_ts(spark, sf):
    r = _raw(spark, sf)
    return r.select(F.col("detection_id").cast("bigint").alias("detection_id"),
                    cl.build_obs_ts(cl.parse_date("acq_date"), "acq_time").alias("obs_ts"))


@R.add(
    "iso_date",
    with_fixtures(["det_li"], [], f"SELECT detection_id, CASE WHEN {LAYOUT} = 3 THEN NULL ELSE strftime(acq_date, '%Y-%m-%d') END AS acq_date FROM det_li"),
)
def q_iso_date(spark, sf):
    r = _raw(spark, sf)
    return r.select(F.col("detection_id").cast("bigint").alias("detection_id"), cl.iso_date(cl.parse_date("acq_date")).alias("acq_date"))


@R.add(
    "migrate_dates",
    with_fixtures(["det_li"], [], f"SELECT detection_id, CASE WHEN {LAYOUT} = 3 THEN 'bad' ELSE strftime(acq_date, '%Y-%m-%d') END AS acq_date FROM det_li"),
)
def q_migrate_dates(spark, sf):
    # applied twice: the second pass must change nothing (idempotent)
    m = ing.migrate_dates(ing.migrate_dates(_raw(spark, sf)))
    return m.select(F.col("detection_id").cast("bigint").alias("detection_id"), "acq_date")


@R.add(
    "round_key",
    with_fixtures(["det_ev"], [], """SELECT detection_id, round_even(latitude * 10000, 0) / 10000 AS lat_r, round_even(longitude * 10000, 0) / 10000 AS lon_r,
       round_even((latitude + 0.00001) * 10000, 0) / 10000 AS lat_r_shift FROM det_ev"""),
)
def q_round_key(spark, sf):
    d = fx.detections_ev(spark, sf)
    return d.select("detection_id", cl.round_key("latitude").alias("lat_r"), cl.round_key("longitude").alias("lon_r"),
                    cl.round_key(F.col("latitude") + 0.00001).alias("lat_r_shift"))


@R.add(
    "drop_incomplete",
    with_fixtures(["det_li"], [], f"SELECT project_id, detection_id FROM det_li WHERE {LAYOUT} <> 3"),
)
def q_drop_incomplete(spark, sf):
    r = _raw(spark, sf)
    typed = r.select("project_id", F.col("detection_id").cast("bigint").alias("detection_id"),
                     cl.coerce_numeric("latitude").alias("latitude"), cl.coerce_numeric("longitude").alias("longitude"),
                     cl.parse_date("acq_date").alias("acq_date"))
    return ing.drop_incomplete(typed).select("project_id", "detection_id")


@R.add("scan_detections", SCANNED)
def q_scan_detections(spark, sf):
    """Dirty text archive (Hive-style project/sensor directories) read and typed."""
    raw = sd.read_archive(spark, _raw_archive(spark, sf))
    return round6(sd.clean_detections(raw, spark))


@R.add("scan_tagged", SCANNED)
def q_scan_tagged(spark, sf):
    """The same archive scanned recursively, sensor and project taken from the path."""
    raw = sd.scan_tagged(spark, _raw_archive(spark, sf))
    raw = raw.withColumn("project_id", F.col("project_key").cast("bigint"))
    return round6(sd.clean_detections(raw, spark))


@R.add(
    "union_sensors",
    with_fixtures(["det_li"], [], "SELECT detection_id, sensor, CASE WHEN satellite = 'MODIS' THEN NULL ELSE round(track, 6) END AS track FROM det_li"),
)
def q_union_sensors(spark, sf):
    """Per-sensor frames with different column sets (MODIS carries no track here)."""
    d = fx.detections_li(spark, sf).select("detection_id", "sensor", "satellite", "track")
    viirs = d.where(F.col("satellite") != "MODIS").drop("satellite")
    modis = d.where(F.col("satellite") == "MODIS").select("detection_id", "sensor")
    return round6(ing.union_all([viirs, modis]))


@R.add(
    "reject_log",
    with_fixtures(["det_li"], [], f"""SELECT project_id, sensor, count(*) AS rows_read, count(*) FILTER (WHERE {LAYOUT} = 3) AS bad_date,
       count(*) FILTER (WHERE {LAYOUT} = 3) AS rows_dropped, count(*) FILTER (WHERE {FRP_BAD}) AS frp_null
  FROM det_li GROUP BY project_id, sensor"""),
)
def q_reject_log(spark, sf):
    return sd.reject_log(_raw(spark, sf))


@R.add(
    "rejected_rows",
    with_fixtures(["det_li"], [], f"SELECT project_id, detection_id, sensor, 'bad' AS acq_date, 'date' AS reason FROM det_li WHERE {LAYOUT} = 3"),
)
def q_rejected_rows(spark, sf):
    """Q29: the dropped rows themselves, with the reason."""
    r = sd.rejected_rows(_raw(spark, sf))
    return r.select("project_id", F.col("detection_id").cast("bigint").alias("detection_id"), "sensor", "acq_date", "reason")


# ---- merge ----------------------------------------------------------------------------


def merge_inputs(spark, sf):
    """History and a new batch that together hold the whole events detections: history is
    every detection up to 20 Jan, the batch is all from 18 Jan on (so 18-20 Jan are refreshed)
    and carries a near copy of each of its rows (latitude moved by 0.00001: most fall on
    the same 4-dp key and are removed, the ones crossing a rounding boundary stay)."""
    d = fx.detections_ev(spark, sf)
    hist = d.where(F.col("acq_date") <= F.lit("2024-01-20").cast("date"))
    hist = hist.withColumn("origin", F.lit(0)).withColumn("ingest_seq", F.col("detection_id") * 2)
    new0 = d.where(F.col("acq_date") >= F.lit("2024-01-18").cast("date"))
    copies = new0.withColumn("latitude", F.col("latitude") + 0.00001).withColumn("ingest_seq", F.col("detection_id") * 2 + 1)
    new = new0.withColumn("ingest_seq", F.col("detection_id") * 2).unionByName(copies).withColumn("origin", F.lit(1))
    return hist, new


MERGE_CTES = [
    """hist AS (SELECT *, 0 AS origin, detection_id * 2 AS ingest_seq FROM det_ev WHERE acq_date <= DATE '2024-01-20')""",
    """new0 AS (SELECT * FROM det_ev WHERE acq_date >= DATE '2024-01-18')""",
    """new AS (SELECT *, 1 AS origin, detection_id * 2 AS ingest_seq FROM new0
  UNION ALL SELECT * REPLACE (latitude + 0.00001 AS latitude), 1 AS origin, detection_id * 2 + 1 AS ingest_seq FROM new0)""",
    """kept AS (SELECT * FROM hist h WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.project_id = h.project_id AND n.sensor = h.sensor AND n.acq_date = h.acq_date))""",
    """uni AS (SELECT * FROM kept UNION ALL SELECT * FROM new)""",
    """comp AS (SELECT * FROM uni WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND acq_date IS NOT NULL)""",
    """merged AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY project_id, sensor, round_even(latitude * 10000, 0) / 10000,
       round_even(longitude * 10000, 0) / 10000, acq_date, acq_time ORDER BY origin, ingest_seq) AS rn FROM comp) t WHERE rn = 1)""",
]
MERGED_SELECT = ("SELECT project_id, detection_id, sensor, satellite, source_id, acq_date, acq_time, obs_ts, "
                 + r6("frp", "track", "latitude", "longitude") + ", origin, ingest_seq FROM merged")


@R.add("exclude_dates", with_fixtures(["det_ev"], MERGE_CTES[:4], "SELECT project_id, detection_id FROM kept"))
def q_exclude_dates(spark, sf):
    hist, new = merge_inputs(spark, sf)
    return ing.refresh_anti(hist, new).select("project_id", "detection_id")


@R.add("refresh_anti", with_fixtures(["det_ev"], MERGE_CTES[:4], "SELECT project_id, sensor, acq_date, count(*) AS n FROM kept GROUP BY ALL"))
def q_refresh_anti(spark, sf):
    hist, new = merge_inputs(spark, sf)
    return ing.refresh_anti(hist, new).groupBy("project_id", "sensor", "acq_date").agg(F.count(F.lit(1)).alias("n"))


@R.add("distinct_dates", with_fixtures(["det_ev"], MERGE_CTES[:3], "SELECT DISTINCT project_id, sensor, acq_date FROM new"))
def q_distinct_dates(spark, sf):
    _, new = merge_inputs(spark, sf)
    return ing.distinct_dates(new)


@R.add("union_batches", with_fixtures(["det_ev"], MERGE_CTES[:5], "SELECT project_id, detection_id, origin, ingest_seq, " + r6("latitude") + " FROM uni"))
def q_union_batches(spark, sf):
    hist, new = merge_inputs(spark, sf)
    u = ing.union_all([ing.refresh_anti(hist, new), new])
    return round6(u.select("project_id", "detection_id", "origin", "ingest_seq", "latitude"))


@R.add("dedup_first", with_fixtures(["det_ev"], MERGE_CTES, "SELECT project_id, detection_id, origin, ingest_seq FROM merged"))
def q_dedup_first(spark, sf):
    hist, new = merge_inputs(spark, sf)
    u = ing.drop_incomplete(ing.union_all([ing.refresh_anti(hist, new), new]))
    return ing.dedup_first(ing.with_round_keys(u)).select("project_id", "detection_id", "origin", "ingest_seq")


@R.add("merge_detections", with_fixtures(["det_ev"], MERGE_CTES, MERGED_SELECT))
def q_merge_detections(spark, sf):
    hist, new = merge_inputs(spark, sf)
    return round6(ing.merge_detections(hist, new))


@R.add(
    "merge_log",
    with_fixtures(["det_ev"], MERGE_CTES, """SELECT project_id, sensor,
       CAST(coalesce(nb.n, 0) AS BIGINT) AS rows_new, CAST(coalesce(h.n, 0) - coalesce(kp.n, 0) AS BIGINT) AS rows_refreshed,
       CAST(coalesce(c.n, 0) - coalesce(t.n, 0) AS BIGINT) AS duplicates_removed, CAST(coalesce(t.n, 0) AS BIGINT) AS rows_total
  FROM (SELECT project_id, sensor, count(*) AS n FROM hist GROUP BY ALL) h
  FULL JOIN (SELECT project_id, sensor, count(*) AS n FROM kept GROUP BY ALL) kp USING (project_id, sensor)
  FULL JOIN (SELECT project_id, sensor, count(*) AS n FROM new GROUP BY ALL) nb USING (project_id, sensor)
  FULL JOIN (SELECT project_id, sensor, count(*) AS n FROM comp GROUP BY ALL) c USING (project_id, sensor)
  FULL JOIN (SELECT project_id, sensor, count(*) AS n FROM merged GROUP BY ALL) t USING (project_id, sensor)"""),
)
def q_merge_log(spark, sf):
    hist, new = merge_inputs(spark, sf)
    return ing.merge_log(ing.merge_tagged(hist, new))


@R.add(
    "write_archive",
    with_fixtures(["det_ev"], [], "SELECT project_id, detection_id, acq_date, acq_time, strftime(acq_date, '%Y-%m') AS acq_month FROM det_ev"),
)
def q_write_archive(spark, sf):
    """K1: write the detections as the month-partitioned archive, read it back."""
    path = new_table_path(spark, "archive")
    sinks.write_archive(fx.detections_ev(spark, sf), path)
    return sinks.read_archive_table(spark, path).select("project_id", "detection_id", "acq_date", "acq_time", "acq_month")


@R.add("merge_into_archive", with_fixtures(["det_ev"], MERGE_CTES, MERGED_SELECT))
def q_merge_into_archive(spark, sf):
    """Incremental merge: history written as the archive, the batch merged in place (only
    the touched months rewritten); the months it does not touch stay as they were."""
    hist, new = merge_inputs(spark, sf)
    path = new_table_path(spark, "archive")
    sinks.write_archive(hist, path)
    sinks.merge_into_archive(spark, path, new)
    return round6(sinks.read_archive_table(spark, path).select(*DET_COLS, "origin", "ingest_seq"))


@R.add("landing_ingest", SCANNED)
def q_landing_ingest(spark, sf):
    """Response files of many request windows in a landing folder (some empty, header
    only) read as one batch and typed; empty files contribute nothing."""
    path = _write_raw(spark, sf)
    empty = _raw(spark, sf).limit(0).drop("project_id", "sensor")
    empty.write.option("header", True).mode("overwrite").csv(f"{path}/project_id=0/sensor=VIIRS_SNPP_NRT/empty")
    raw = sd.read_archive(spark, path)
    return round6(sd.clean_detections(raw, spark))


@R.add("sort_archive", with_fixtures(["det_ev"], [], "SELECT project_id, detection_id, acq_date, acq_time, true AS in_order FROM det_ev"))
def q_sort_archive(spark, sf):
    """O2: newest first inside each partition (no global sort); the row set is unchanged, and no
    row is newer than the one before it in its partition."""
    d = ing.sort_archive(fx.detections_ev(spark, sf)).select("project_id", "detection_id", "acq_date", "acq_time")
    d = d.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    when = F.concat(F.date_format("acq_date", "yyyyMMdd"), "acq_time")
    before = F.lag(when).over(Window.partitionBy("_part").orderBy("_at"))
    return d.withColumn("in_order", F.coalesce(before >= when, F.lit(True))).drop("_part", "_at")
