"""Report sections, KPI long table and derived-table sinks/scans (with SQL oracles)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hotspot.operators import counts as ct
from hotspot.operators import frontier as fr
from hotspot.operators import report as rp
from hotspot.operators import runout as ro
from hotspot.plans import count_queries as cq
from hotspot.plans.common import Registry, round6
from hotspot.plans.runout_queries import DAILY, FILTERED, FRONT_COLS, frontier_ctes
from hotspot.plans.sql_fixtures import r6, with_fixtures
from hotspot.session import cut_lineage, new_table_path
from hotspot.sources import fixtures as fx
from hotspot.sources import sinks

R = Registry()
EV = ["projects_ev", "det_ev"]

PL_EV = cq.PL.replace("projects_li", "projects_ev")
DL_EV = cq.DL.replace("det_li", "det_ev")
wk, ffw = cq.wk, cq.ffw
KPI_CTES = [
    PL_EV, DL_EV,
    "dy AS (SELECT project_id, sd, ed, a, acq_date, count(*) AS n FROM dl GROUP BY ALL)",
    f"""base AS (SELECT project_id, sd, ed, a, max(acq_date) AS last_day,
       sum(n) FILTER (WHERE acq_date BETWEEN {wk('ed', 'a')} AND {wk('ed', 'a')} + 6) AS tlw,
       sum(n) FILTER (WHERE acq_date BETWEEN CAST(date_trunc('month', ed) AS DATE) AND last_day(ed)) AS tlm FROM dy GROUP BY ALL)""",
    f"""pw AS (SELECT project_id, max(n) AS peak_week FROM (SELECT project_id, {wk('acq_date', 'a')} AS w, sum(n) AS n FROM dy
       WHERE {wk('acq_date', 'a')} >= {ffw('sd', 'a')} GROUP BY ALL) t GROUP BY project_id)""",
    """pm AS (SELECT project_id, max(n) AS peak_month FROM (SELECT project_id, date_trunc('month', acq_date) AS m, sum(n) AS n FROM dy GROUP BY ALL) t GROUP BY project_id)""",
    f"""kpi AS (SELECT b.project_id, b.last_day, CAST({wk('b.ed', 'b.a')} AS DATE) AS lws, CAST(date_trunc('month', b.ed) AS DATE) AS lmo, d.n AS total_last_day, coalesce(b.tlw, 0) AS total_last_week, coalesce(b.tlm, 0) AS total_last_month,
       coalesce(pw.peak_week, 0) AS peak_week, coalesce(pm.peak_month, 0) AS peak_month
     FROM base b JOIN dy d ON d.project_id = b.project_id AND d.acq_date = b.last_day
     LEFT JOIN pw ON pw.project_id = b.project_id LEFT JOIN pm ON pm.project_id = b.project_id)""",
]
SUMMARY_CTES = [
    """psum AS (SELECT project_id, count(*) AS n_detections, avg(frp) AS frp_mean, max(frp) AS frp_max, avg(distance_km) AS dist_mean,
       max(distance_km) AS dist_max FROM filtered GROUP BY project_id)""",
    """ssum AS (SELECT project_id, count(*) AS n_rows, max(max_distance) AS max_distance_km, max(speed) AS max_speed, avg(speed) AS mean_speed,
       min(date) AS first_date, max(date) AS last_date FROM front GROUP BY project_id)""",
]


def _unit(metric: str) -> str:
    unit = rp.UNITS.get(metric)
    return f"'{unit}'" if unit else "CAST(NULL AS VARCHAR)"


def _num(src: str, section: str, cols: list[str]) -> list[str]:
    return [f"SELECT project_id, '{section}' AS section, '{c}' AS metric, round(CAST({c} AS DOUBLE), 6) AS value_num, CAST(NULL AS VARCHAR) AS value_text, "
            f"{_unit(c)} AS unit FROM {src}" for c in cols]


def _txt(src: str, section: str, cols: dict[str, str]) -> list[str]:
    return [f"SELECT project_id, '{section}' AS section, '{c}' AS metric, CAST(NULL AS DOUBLE) AS value_num, {e} AS value_text, "
            f"{_unit(c)} AS unit FROM {src}" for c, e in cols.items()]


REPORT_SELECT = "\nUNION ALL ".join(
    _num("projects_ev", "project", ["vent_lat", "vent_lon", "filter_frp", "filter_track", "ref_radius_m"])
    + _txt("projects_ev", "project", {"volcano": "volcano", "frp_mode": "frp_mode", "period_start": "strftime(start_ts, '%Y-%m-%d %H:%M')", "period_end": "strftime(end_ts, '%Y-%m-%d %H:%M')"})
    + _num("kpi", "counts", ["total_last_day", "total_last_week", "total_last_month", "peak_week", "peak_month"])
    + _txt("kpi", "counts", {"last_day": "strftime(last_day, '%Y-%m-%d')", "last_week_start": "strftime(lws, '%Y-%m-%d')",
                             "last_week_end": "strftime(lws + 6, '%Y-%m-%d')", "last_month": "strftime(lmo, '%Y-%m')"})
    + _num("psum", "runout", ["n_detections", "frp_mean", "frp_max", "dist_mean", "dist_max"])
    + _num("ssum", "speed", ["n_rows", "max_distance_km", "max_speed", "mean_speed"])
    + _txt("ssum", "speed", {"first_date": "strftime(first_date, '%Y-%m-%d')", "last_date": "strftime(last_date, '%Y-%m-%d')"})
)
REPORT_SQL = with_fixtures(EV, [FILTERED, DAILY] + frontier_ctes() + KPI_CTES + SUMMARY_CTES, REPORT_SELECT)


def _report(spark, sf):
    det, prj = fx.detections_ev(spark, sf), fx.projects_ev(spark, sf)
    filtered = ro.filter_runout(det, prj)
    front = fr.frontier(ro.daily_runout(filtered))
    return rp.report_kpis(prj, ct.count_kpis(det, prj), ro.period_summary(filtered), fr.speed_summary(front))


@R.add("report_kpis", REPORT_SQL)
def q_report_kpis(spark, sf):
    return round6(_report(spark, sf))


@R.add("write_report", REPORT_SQL)
def q_write_report(spark, sf):
    """K6: the report table written as JSON per project and read back."""
    path = new_table_path(spark, "report")
    rp.write_report(round6(_report(spark, sf)), fx.projects_ev(spark, sf), path)
    return rp.read_report(spark, path).select("project_id", "section", "metric", "value_num", "value_text", "unit")


@R.add(
    "available_sections",
    with_fixtures(EV, [FILTERED, DAILY] + frontier_ctes() + [PL_EV, DL_EV], """SELECT p.project_id,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n_counts, coalesce(c.n, 0) > 0 AS has_counts,
       CAST(coalesce(f.n, 0) AS BIGINT) AS n_runout, coalesce(f.n, 0) > 0 AS has_runout,
       CAST(coalesce(d.n, 0) AS BIGINT) AS n_daily, coalesce(d.n, 0) > 0 AS has_daily,
       CAST(coalesce(s.n, 0) AS BIGINT) AS n_speed, coalesce(s.n, 0) > 0 AS has_speed
  FROM projects_ev p
  LEFT JOIN (SELECT project_id, count(*) AS n FROM dl GROUP BY ALL) c USING (project_id)
  LEFT JOIN (SELECT project_id, count(*) AS n FROM filtered GROUP BY ALL) f USING (project_id)
  LEFT JOIN (SELECT project_id, count(*) AS n FROM daily GROUP BY ALL) d USING (project_id)
  LEFT JOIN (SELECT project_id, count(*) AS n FROM front GROUP BY ALL) s USING (project_id)"""),
)
def q_available_sections(spark, sf):
    det, prj = fx.detections_ev(spark, sf), fx.projects_ev(spark, sf)
    p = ct.period_days(prj)
    in_period = det.join(p, "project_id").where(F.col("acq_date").between(F.col("start_date"), F.col("end_date")))
    filtered = ro.filter_runout(det, prj)
    daily = ro.daily_runout(filtered)
    return rp.available_sections(prj, {"counts": in_period, "runout": filtered, "daily": daily, "speed": fr.frontier(daily)})


@R.add(
    "sort_detections",
    with_fixtures(EV, [FILTERED], "SELECT project_id, detection_id, obs_ts, satellite, " + r6("latitude", "longitude")
                  + ", row_number() OVER (PARTITION BY project_id ORDER BY obs_ts, satellite, latitude, longitude, detection_id) AS position FROM filtered"),
)
def q_sort_detections(spark, sf):
    """O1: detections in the total order (time, satellite, position, id), with the position at
    which each comes out within its project."""
    f = ro.filter_runout(fx.detections_ev(spark, sf), fx.projects_ev(spark, sf))
    f = f.orderBy("project_id", "obs_ts", "satellite", "latitude", "longitude", "detection_id")
    f = f.select("project_id", "detection_id", "obs_ts", "satellite", "latitude", "longitude", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    f = cut_lineage(f)  # places are those of one sort
    # a project's rows follow each other in a partition: only (project, partition) pairs are put in order
    k = ["project_id", "_part"]
    parts = f.groupBy(*k).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("project_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*k, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = F.col("_before") + F.col("_at") - F.col("_first") + 1
    return round6(f.join(parts, k).withColumn("position", at).drop("_part", "_at", "_first", "_before"))


def _write_filtered(spark, sf) -> str:
    f = ro.filter_runout(fx.detections_ev(spark, sf), fx.projects_ev(spark, sf))
    path = new_table_path(spark, "filtered")
    f = f.select("project_id", "detection_id", "satellite", "obs_ts", "frp", "distance_km", "latitude", "longitude")
    sinks.write_by_month(f, path, "obs_ts")
    return path


@R.add(
    "write_filtered",
    with_fixtures(EV, [FILTERED], "SELECT project_id, detection_id, satellite, obs_ts, " + r6("frp", "distance_km", "latitude", "longitude")
                  + " FROM filtered"),
)
def q_write_filtered(spark, sf):
    """K2: filtered detections written as Parquet partitioned by month, read back whole."""
    back = spark.read.parquet(_write_filtered(spark, sf))
    return round6(back.select(F.col("project_id").cast("bigint").alias("project_id"), "detection_id", "satellite", "obs_ts", "frp",
                              "distance_km", "latitude", "longitude"))


@R.add(
    "scan_filtered",
    with_fixtures(EV, [FILTERED], "SELECT project_id, detection_id, satellite, obs_ts, " + r6("frp", "distance_km")
                  + " FROM filtered"),
)
def q_scan_filtered(spark, sf):
    """The whole filtered table read back with a pruned column set (pruning of months
    and pushed-down filters are asserted in the plan tests)."""
    back = spark.read.parquet(_write_filtered(spark, sf))
    return round6(back.select(F.col("project_id").cast("bigint").alias("project_id"), "detection_id", "satellite", "obs_ts", "frp", "distance_km"))


@R.add(
    "write_daily_runout",
    with_fixtures(EV, [FILTERED, DAILY], "SELECT project_id, date_only, satellite, source, " + r6("distance_km", "frp", "latitude", "longitude") + " FROM daily"),
)
def q_write_daily_runout(spark, sf):
    """K3 + S6: daily maxima written and read back."""
    d = ro.daily_runout(ro.filter_runout(fx.detections_ev(spark, sf), fx.projects_ev(spark, sf)))
    path = new_table_path(spark, "daily")
    sinks.write_table(d, path)
    return round6(spark.read.parquet(path))


@R.add(
    "write_frontier",
    with_fixtures(EV, [FILTERED, DAILY] + frontier_ctes(), "SELECT project_id, date_only, satellite, source, date, "
                  + r6("distance_km", "frp", "latitude", "longitude", "max_distance", "prev_max", "time_diff", "distance_diff", "speed") + " FROM front"),
)
def q_write_frontier(spark, sf):
    """K4 + S7: frontier written and read back."""
    d = fr.frontier(ro.daily_runout(ro.filter_runout(fx.detections_ev(spark, sf), fx.projects_ev(spark, sf)))).select(*FRONT_COLS)
    path = new_table_path(spark, "frontier")
    sinks.write_table(d, path)
    return round6(spark.read.parquet(path))


def _daily_ev(spark, sf):
    return ro.daily_runout(ro.filter_runout(fx.detections_ev(spark, sf), fx.projects_ev(spark, sf)))


@R.add(
    "scan_daily_runout",
    with_fixtures(EV, [FILTERED, DAILY], "SELECT project_id, date_only, satellite, source, " + r6("distance_km", "frp", "latitude", "longitude") + " FROM daily"),
)
def q_scan_daily_runout(spark, sf):
    """Daily maxima as text files in the example layout (one folder per project), read
    back with the fixed schema (the same reader takes the shipped example files)."""
    from hotspot import schemas

    path = new_table_path(spark, "daily-csv")
    _daily_ev(spark, sf).write.partitionBy("project_id").option("header", True).csv(path)
    back = spark.read.option("header", True).schema(schemas.DAILY_RUNOUT).csv(path)
    return round6(back.withColumn("project_id", F.col("project_id").cast("bigint")))


@R.add(
    "scan_frontier",
    with_fixtures(EV, [FILTERED, DAILY] + frontier_ctes(), "SELECT project_id, date_only, satellite, source, date, "
                  + r6("distance_km", "frp", "latitude", "longitude", "max_distance", "prev_max", "time_diff", "distance_diff", "speed") + " FROM front"),
)
def q_scan_frontier(spark, sf):
    """Frontier as text files in the example layout, read back with the fixed schema."""
    from hotspot import schemas

    path = new_table_path(spark, "frontier-csv")
    fr.frontier(_daily_ev(spark, sf)).select(*FRONT_COLS).write.partitionBy("project_id").option("header", True).csv(path)
    back = spark.read.option("header", True).schema(schemas.FRONTIER).csv(path)
    return round6(back.withColumn("project_id", F.col("project_id").cast("bigint")).select(*FRONT_COLS))
