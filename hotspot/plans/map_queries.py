"""Frames, map extent, waypoints, boxes and requests: Spark plans and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from hotspot import schemas
from hotspot.functions import calendar as cal
from hotspot.functions.waypoints import pack_waypoints, parse_waypoints
from hotspot.operators import frames as fm
from hotspot.operators import runout as ro
from hotspot.operators import spatial as sp
from hotspot.plans.common import Registry, round6
from hotspot.plans.runout_queries import FILTERED
from hotspot.plans.sql_fixtures import r6, with_fixtures
from hotspot.sources import fixtures as fx

R = Registry()
EV = ["projects_ev", "det_ev"]


def _filtered(spark, sf):
    return ro.filter_runout(fx.detections_ev(spark, sf), fx.projects_ev(spark, sf))


GRID = """grid AS (SELECT project_id, CAST(unnest(generate_series(CAST(start_ts AS DATE),
    CAST(start_ts AS DATE) + CAST(floor(date_diff('second', start_ts, end_ts) / 86400.0) AS INTEGER), INTERVAL 1 DAY)) AS DATE) AS day
  FROM projects_ev)"""
FRAMES = """frames AS (SELECT g.project_id, g.day,
    CAST(count(f.detection_id) AS BIGINT) AS n_cumulative,
    CAST(count(f.detection_id) FILTER (WHERE CAST(f.obs_ts AS DATE) = g.day) AS BIGINT) AS n_today,
    CAST(count(f.detection_id) FILTER (WHERE CAST(f.obs_ts AS DATE) < g.day) AS BIGINT) AS n_before
  FROM grid g LEFT JOIN filtered f ON f.project_id = g.project_id AND CAST(f.obs_ts AS DATE) <= g.day
  GROUP BY g.project_id, g.day)"""


@R.add("frame_counts", with_fixtures(EV, [FILTERED, GRID, FRAMES], "SELECT * FROM frames"))
def q_frame_counts(spark, sf):
    return fm.frame_counts(_filtered(spark, sf), fx.projects_ev(spark, sf))


@R.add("frames_join", with_fixtures(EV, [FILTERED, GRID, FRAMES], "SELECT project_id, day, n_cumulative FROM frames"))
def q_frames_join(spark, sf):
    """Day grid joined to detections seen up to each day — computed as a running sum."""
    return fm.frame_counts(_filtered(spark, sf), fx.projects_ev(spark, sf)).select("project_id", "day", "n_cumulative")


@R.add(
    "running_count",
    with_fixtures(EV, [FILTERED], """SELECT project_id, day, n, CAST(sum(n) OVER (PARTITION BY project_id ORDER BY day) AS BIGINT) AS n_cumulative
  FROM (SELECT project_id, CAST(obs_ts AS DATE) AS day, count(*) AS n FROM filtered GROUP BY ALL) t"""),
)
def q_running_count(spark, sf):
    return fm.running_count(fm.daily_detections(_filtered(spark, sf)))


@R.add(
    "as_of",
    with_fixtures(EV, [FILTERED], """SELECT project_id, detection_id, CASE WHEN CAST(obs_ts AS DATE) = DATE '2024-01-12' THEN 'today' ELSE 'before' END AS state
  FROM filtered WHERE CAST(obs_ts AS DATE) <= DATE '2024-01-12'"""),
)
def q_as_of(spark, sf):
    return fm.as_of(_filtered(spark, sf), "2024-01-12").select("project_id", "detection_id", "state")


WAYPOINTS = [
    """wsp AS (SELECT project_id, include_reference_waypoint AS inc,
    list_transform(string_split(coalesce(wpt_names, ''), ';'), lambda x: trim(x)) AS nm,
    list_transform(string_split(coalesce(wpt_lats, ''), ';'), lambda x: trim(x)) AS la,
    list_transform(string_split(coalesce(wpt_lons, ''), ';'), lambda x: trim(x)) AS lo,
    list_transform(string_split(coalesce(wpt_symbols, ''), ';'), lambda x: trim(x)) AS sy FROM projects_ev)""",
    """wpi AS (SELECT *, unnest(range(greatest(len(nm), len(la), len(lo), len(sy)))) AS i FROM wsp)""",
    """wp AS (SELECT project_id, inc, CAST(i AS INTEGER) AS pos, coalesce(nm[i + 1], '') AS name,
    TRY_CAST(la[i + 1] AS DOUBLE) AS lat, TRY_CAST(lo[i + 1] AS DOUBLE) AS lon, coalesce(nullif(sy[i + 1], ''), 'circle') AS symbol
  FROM wpi WHERE coalesce(la[i + 1], '') <> '' AND coalesce(lo[i + 1], '') <> ''
    AND TRY_CAST(la[i + 1] AS DOUBLE) IS NOT NULL AND TRY_CAST(lo[i + 1] AS DOUBLE) IS NOT NULL)""",
]


def _su(ctes: list[str]) -> list[str]:
    """The same on the supplier projects."""
    return [c.replace("projects_ev", "projects_su") for c in ctes]


@R.add("parse_waypoints", with_fixtures(["projects_su"], _su(WAYPOINTS), "SELECT project_id, pos, name, " + r6("lat", "lon") + ", symbol FROM wp"))
def q_parse_waypoints(spark, sf):
    return round6(parse_waypoints(fx.projects_su(spark, sf)))


@R.add("pack_waypoints", with_fixtures(["projects_su"], _su(WAYPOINTS), "SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY pos) - 1 AS INTEGER) AS pos, "
                                        "name, " + r6("lat", "lon") + ", symbol FROM wp"))
def q_pack_waypoints(spark, sf):
    """Pack the parsed waypoints back into lists and parse again (round trip: same
    waypoints in the same order; positions close the gaps of skipped entries)."""
    p = fx.projects_su(spark, sf)
    packed = pack_waypoints(parse_waypoints(p))
    return round6(parse_waypoints(packed))


BOXES = """boxes AS (SELECT project_id,
    round(vent_lon - ref_radius_m / (CAST(111320.0 AS DOUBLE) * greatest(cos(radians(vent_lat)), CAST(1e-6 AS DOUBLE))), 5) AS west,
    round(vent_lat - ref_radius_m / CAST(111320.0 AS DOUBLE), 5) AS south,
    round(vent_lon + ref_radius_m / (CAST(111320.0 AS DOUBLE) * greatest(cos(radians(vent_lat)), CAST(1e-6 AS DOUBLE))), 5) AS east,
    round(vent_lat + ref_radius_m / CAST(111320.0 AS DOUBLE), 5) AS north FROM projects_ev)"""


@R.add(
    "bbox",
    with_fixtures(["projects_su"], _su([BOXES]), "SELECT project_id, west, south, east, north, printf('%.5f,%.5f,%.5f,%.5f', west, south, east, north) AS area FROM boxes"),
)
def q_bbox(spark, sf):
    return sp.project_boxes(fx.projects_su(spark, sf))


@R.add(
    "assign_projects",
    with_fixtures(EV, [BOXES], """SELECT d.detection_id, b.project_id FROM det_ev d
  JOIN boxes b ON d.latitude BETWEEN b.south AND b.north AND d.longitude BETWEEN b.west AND b.east"""),
)
def q_assign_projects(spark, sf):
    det = fx.detections_ev(spark, sf).drop("project_id")
    return sp.assign_projects(det, fx.projects_ev(spark, sf)).select("detection_id", "project_id")


@R.add(
    "in_bbox",
    with_fixtures(EV, [BOXES], """SELECT d.detection_id, d.project_id,
       d.latitude BETWEEN b.south AND b.north AND d.longitude BETWEEN b.west AND b.east AS inside
  FROM det_ev d JOIN boxes b USING (project_id)"""),
)
def q_in_bbox(spark, sf):
    return sp.in_bbox(fx.detections_ev(spark, sf), fx.projects_ev(spark, sf)).select("detection_id", "project_id", "inside")


@R.add(
    "extent",
    with_fixtures(EV, [FILTERED] + WAYPOINTS, """SELECT project_id,
       CASE WHEN s = n THEN s - 0.005 ELSE s END AS south, CASE WHEN s = n THEN n + 0.005 ELSE n END AS north,
       CASE WHEN w = e THEN w - 0.005 ELSE w END AS west, CASE WHEN w = e THEN e + 0.005 ELSE e END AS east
  FROM (SELECT p.project_id,
          least(p.vent_lat, d.d_s, CASE WHEN p.include_reference_radius THEN p.vent_lat - p.ref_radius_m / CAST(111000.0 AS DOUBLE) END, x.w_s) AS s,
          greatest(p.vent_lat, d.d_n, CASE WHEN p.include_reference_radius THEN p.vent_lat + p.ref_radius_m / CAST(111000.0 AS DOUBLE) END, x.w_n) AS n,
          least(p.vent_lon, d.d_w, CASE WHEN p.include_reference_radius THEN p.vent_lon - p.ref_radius_m / (CAST(111000.0 AS DOUBLE) * greatest(cos(radians(p.vent_lat)), CAST(1e-6 AS DOUBLE))) END, x.w_w) AS w,
          greatest(p.vent_lon, d.d_e, CASE WHEN p.include_reference_radius THEN p.vent_lon + p.ref_radius_m / (CAST(111000.0 AS DOUBLE) * greatest(cos(radians(p.vent_lat)), CAST(1e-6 AS DOUBLE))) END, x.w_e) AS e
        FROM projects_ev p
        LEFT JOIN (SELECT project_id, min(latitude) AS d_s, max(latitude) AS d_n, min(longitude) AS d_w, max(longitude) AS d_e FROM filtered GROUP BY ALL) d USING (project_id)
        LEFT JOIN (SELECT project_id, min(lat) AS w_s, max(lat) AS w_n, min(lon) AS w_w, max(lon) AS w_e FROM wp WHERE inc GROUP BY ALL) x USING (project_id)) t"""),
)
def q_extent(spark, sf):
    return round6(sp.extent(_filtered(spark, sf), fx.projects_ev(spark, sf)))


@R.add(
    "request_manifest",
    with_fixtures(["projects_su"], _su([BOXES]), """SELECT b.project_id, s.sensor, c.chunk_start, least(c.chunk_start + 4, c.ed) AS chunk_end,
       CAST(date_diff('day', c.chunk_start, least(c.chunk_start + 4, c.ed)) + 1 AS INTEGER) AS day_range,
       printf('%.5f,%.5f,%.5f,%.5f', b.west, b.south, b.east, b.north) AS area
  FROM boxes b
  JOIN (SELECT project_id, CAST(end_ts AS DATE) AS ed,
          CAST(unnest(generate_series(CAST(start_ts AS DATE), CAST(end_ts AS DATE), INTERVAL 5 DAY)) AS DATE) AS chunk_start
        FROM projects_su) c USING (project_id)
  CROSS JOIN (VALUES ('MODIS_NRT'), ('VIIRS_SNPP_NRT'), ('VIIRS_NOAA20_NRT'), ('VIIRS_NOAA21_NRT')) s(sensor)"""),
)
def q_request_manifest(spark, sf):
    return sp.request_manifest(fx.projects_su(spark, sf), [s[0] for s in schemas.SENSORS])


@R.add(
    "time_fraction",
    with_fixtures(EV, [FILTERED], """SELECT detection_id, round(f, 6) AS fraction, CAST(floor(f * 4) AS INTEGER) AS colour_class FROM (
    SELECT detection_id, least(greatest(CAST(date_diff('second', start_ts, obs_ts) AS DOUBLE) / CAST(date_diff('second', start_ts, end_ts) AS DOUBLE), 0.0), 1.0) AS f
    FROM filtered) t"""),
)
def q_time_fraction(spark, sf):
    f = _filtered(spark, sf)
    fr = cal.time_fraction("obs_ts", "start_ts", "end_ts")
    return round6(f.select("detection_id", fr.alias("fraction"), cal.colour_class(fr).alias("colour_class")))


@R.add(
    "period_ticks",
    with_fixtures(["projects_su"], [], """SELECT project_id, CAST(i AS INTEGER) AS i,
       start_ts + to_seconds(CAST(floor(CAST(date_diff('second', start_ts, end_ts) AS DOUBLE) * i / 5.0) AS BIGINT)) AS tick
  FROM projects_su, (SELECT unnest(range(6)) AS i) t"""),
)
def q_period_ticks(spark, sf):
    p = fx.projects_su(spark, sf)
    return p.select("project_id", F.posexplode(cal.period_ticks("start_ts", "end_ts", 6)).alias("i", "tick"))


@R.add(
    "unit_conversions",
    with_fixtures(EV, [FILTERED], """SELECT project_id, round(ref_radius_m / 1000.0, 6) AS radius_km, round(max(distance_km) * 1000.0, 6) AS max_distance_m,
       round(CAST(date_diff('day', min(CAST(obs_ts AS DATE)), max(CAST(obs_ts AS DATE))) * 24 AS DOUBLE), 6) AS span_hours
  FROM filtered GROUP BY project_id, ref_radius_m"""),
)
def q_unit_conversions(spark, sf):
    """Km <-> m and hours between dates."""
    f = _filtered(spark, sf)
    g = f.groupBy("project_id", "ref_radius_m").agg(F.max("distance_km").alias("dmax"), F.min(F.to_date("obs_ts")).alias("d0"),
                                                    F.max(F.to_date("obs_ts")).alias("d1"))
    return round6(g.select("project_id", (F.col("ref_radius_m") / 1000.0).alias("radius_km"), (F.col("dmax") * 1000.0).alias("max_distance_m"),
                           cal.hours_between_dates("d0", "d1").alias("span_hours")))


@R.add(
    "view_zoom",
    with_fixtures(EV, [FILTERED], """SELECT p.project_id, round(greatest(p.ref_radius_m / 1000.0, coalesce(f.dmax, p.ref_radius_m / 1000.0)), 6) AS view_km,
       CASE WHEN v < 2 THEN 15 WHEN v < 5 THEN 14 WHEN v < 10 THEN 13 WHEN v < 20 THEN 12 WHEN v < 50 THEN 11 ELSE 10 END AS zoom
  FROM projects_ev p LEFT JOIN (SELECT project_id, max(distance_km) AS dmax FROM filtered GROUP BY ALL) f USING (project_id),
       LATERAL (SELECT greatest(p.ref_radius_m / 1000.0, coalesce(f.dmax, p.ref_radius_m / 1000.0)) AS v) t"""),
)
def q_view_zoom(spark, sf):
    return round6(sp.view_zoom(_filtered(spark, sf), fx.projects_ev(spark, sf)))
