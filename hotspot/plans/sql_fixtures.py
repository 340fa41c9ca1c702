"""DuckDB-dialect CTEs equal to ``hotspot.sources.fixtures`` (the oracle side).

Arithmetic is written in the same operation order as the Spark side, with explicit
DOUBLE casts, so both engines produce the same IEEE values.
"""

from __future__ import annotations

SENSORS = """sensors AS (
  SELECT * FROM (VALUES ('MODIS_NRT', 'MODIS', 0, 'MODIS'), ('VIIRS_SNPP_NRT', 'SNPP', 1, 'VIIRS'),
                        ('VIIRS_NOAA20_NRT', 'NOAA20', 2, 'VIIRS'), ('VIIRS_NOAA21_NRT', 'NOAA21', 3, 'VIIRS'))
         t(sensor, satellite, source_id, family))"""

PROJECTS_EV = """projects_ev AS (
  SELECT CAST(r_regionkey AS BIGINT) AS project_id, r_name AS volcano,
         CAST(-0.4 AS DOUBLE) + CAST(0.1 AS DOUBLE) * r_regionkey AS vent_lat,
         CAST(-91.5 AS DOUBLE) + CAST(0.1 AS DOUBLE) * r_regionkey AS vent_lon,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(r_regionkey) AS start_ts,
         TIMESTAMP '2024-01-25 00:00:00' + to_days(r_regionkey) AS end_ts,
         CASE WHEN r_regionkey = 3 THEN CAST(400.0 AS DOUBLE) ELSE CAST(5.0 AS DOUBLE) + CAST(5.0 AS DOUBLE) * r_regionkey END AS filter_frp,
         CASE WHEN r_regionkey = 3 THEN 'lt' ELSE 'gt' END AS frp_mode,
         CASE WHEN r_regionkey = 2 THEN CAST(0.45 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS filter_track,
         CAST(13200.0 AS DOUBLE) + CAST(1000.0 AS DOUBLE) * r_regionkey AS ref_radius_m,
         CAST(CASE WHEN r_regionkey = 1 THEN 0 WHEN r_regionkey = 4 THEN 6 ELSE 3 END AS INTEGER) AS week_anchor,
         ['Crater;Hut', 'Crater', '', 'A;B;C', 'Ridge;'][r_regionkey + 1] AS wpt_names,
         ['-0.35;-0.36', '-0.25', '', '-0.05;;-0.07', '0.01;abc'][r_regionkey + 1] AS wpt_lats,
         ['-91.45;-91.46', '-91.35', '', '-91.2;-91.21;-91.22', '-91.1;-91.1'][r_regionkey + 1] AS wpt_lons,
         ['triangle;', 'circle', 'circle', 'star;square;x', ''][r_regionkey + 1] AS wpt_symbols,
         ['', 'INSERT_YOUR_MAP_KEY_HERE', 'k2', 'k3', 'k4'][r_regionkey + 1] AS map_key,
         r_regionkey <> 2 AS include_reference_radius, r_regionkey IN (0, 3, 4) AS include_reference_waypoint
  FROM region)"""

# the same rows for every supplier, in the forms of its key modulo 5
PROJECTS_SU = (
    PROJECTS_EV.replace("projects_ev AS (", "projects_su AS (")
    .replace("CAST(r_regionkey AS BIGINT) AS project_id, r_name AS volcano", "CAST(s_suppkey AS BIGINT) AS project_id, 'Site ' || s_suppkey AS volcano")
    .replace("to_days(r_regionkey)", "to_days(CAST(s_suppkey % 5 AS INTEGER))")
    .replace("r_regionkey", "(s_suppkey % 5)")
    .replace("FROM region", "FROM supplier")
)

PROJECTS_LI = """projects_li AS (
  SELECT CAST(r_regionkey AS BIGINT) AS project_id, r_name AS volcano,
         CAST(-0.4 AS DOUBLE) + CAST(0.1 AS DOUBLE) * r_regionkey AS vent_lat,
         CAST(-91.5 AS DOUBLE) + CAST(0.1 AS DOUBLE) * r_regionkey AS vent_lon,
         CAST(['1996-01-03 00:00:00', '1997-03-15 00:00:00', '1998-05-06 00:00:00', '1990-01-01 00:00:00',
               '1995-01-01 00:00:00'][r_regionkey + 1] AS TIMESTAMP) AS start_ts,
         CAST(['1998-12-28 00:00:00', '1999-06-30 23:59:00', '1998-05-09 00:00:00', '1990-12-31 00:00:00',
               '2001-12-31 23:59:00'][r_regionkey + 1] AS TIMESTAMP) AS end_ts,
         CAST(20.0 AS DOUBLE) AS filter_frp, 'gt' AS frp_mode, CAST(0.5 AS DOUBLE) AS filter_track,
         CAST(15000.0 AS DOUBLE) AS ref_radius_m,
         CAST(CASE WHEN r_regionkey = 1 THEN 0 WHEN r_regionkey = 4 THEN 6 ELSE 3 END AS INTEGER) AS week_anchor,
         '' AS wpt_names, '' AS wpt_lats, '' AS wpt_lons, '' AS wpt_symbols, 'k' AS map_key,
         true AS include_reference_radius, false AS include_reference_waypoint
  FROM region)"""

DET_EV = """det_ev AS (
  SELECT CAST(r.r_regionkey AS BIGINT) AS project_id, e.event_id AS detection_id,
         s.sensor, s.satellite, s.source_id,
         CAST(e.ts AS DATE) AS acq_date,
         strftime(e.ts, '%H%M') AS acq_time,
         CAST(CAST(e.ts AS DATE) AS TIMESTAMP) + to_minutes(CAST(hour(e.ts) * 60 + minute(e.ts) AS BIGINT)) AS obs_ts,
         e.value AS frp,
         CAST(0.32 AS DOUBLE) + CAST(CAST(e.props->>'k' AS INTEGER) AS DOUBLE) * CAST(0.004 AS DOUBLE) AS track,
         round(CAST(-0.4 AS DOUBLE) + CAST(0.1 AS DOUBLE) * r.r_regionkey
               + CAST(((e.event_id * 7919) % 2001) - 1000 AS DOUBLE) / CAST(100000.0 AS DOUBLE)
                 * CAST(date_diff('day', DATE '2024-01-01', CAST(e.ts AS DATE)) + 1 AS DOUBLE), 5) AS latitude,
         round(CAST(-91.5 AS DOUBLE) + CAST(0.1 AS DOUBLE) * r.r_regionkey
               + CAST(((e.event_id * 104729) % 2001) - 1000 AS DOUBLE) / CAST(100000.0 AS DOUBLE)
                 * CAST(date_diff('day', DATE '2024-01-01', CAST(e.ts AS DATE)) + 1 AS DOUBLE), 5) AS longitude
  FROM events e
  JOIN region r ON r.r_regionkey = e.user_id % 5
  JOIN sensors s ON s.satellite = CASE e.event_type WHEN 'view' THEN 'SNPP' WHEN 'click' THEN 'NOAA20'
                                                     WHEN 'signup' THEN 'NOAA21' ELSE 'MODIS' END)"""

LI_BASE = """li_base AS (
  SELECT CAST(l_suppkey % 5 AS BIGINT) AS project_id, l_orderkey * 8 + l_linenumber AS detection_id,
         CASE l_linenumber % 4 WHEN 0 THEN 'MODIS' WHEN 1 THEN 'SNPP' WHEN 2 THEN 'NOAA20' ELSE 'NOAA21' END AS satellite,
         CAST(l_shipdate AS DATE) AS acq_date,
         (l_orderkey * 37) % 24 AS hh, l_partkey % 60 AS mm,
         l_extendedprice / CAST(1000.0 AS DOUBLE) AS frp,
         CAST(0.32 AS DOUBLE) + l_discount * CAST(3.0 AS DOUBLE) AS track,
         round(CAST(-0.4 AS DOUBLE) + CAST(0.1 AS DOUBLE) * (l_suppkey % 5)
               + CAST(((l_partkey * 7919 + l_linenumber * 104729) % 2001) - 1000 AS DOUBLE) / CAST(20000.0 AS DOUBLE), 5) AS latitude,
         round(CAST(-91.5 AS DOUBLE) + CAST(0.1 AS DOUBLE) * (l_suppkey % 5)
               + CAST(((l_orderkey * 104729 + l_linenumber * 7919) % 2001) - 1000 AS DOUBLE) / CAST(20000.0 AS DOUBLE), 5) AS longitude,
         l_orderkey
  FROM lineitem)"""

DET_LI = """det_li AS (
  SELECT b.project_id, b.detection_id, s.sensor, b.satellite, s.source_id, b.acq_date,
         printf('%02d%02d', b.hh, b.mm) AS acq_time,
         CAST(b.acq_date AS TIMESTAMP) + to_minutes(CAST(b.hh * 60 + b.mm AS BIGINT)) AS obs_ts,
         b.frp, b.track, b.latitude, b.longitude
  FROM li_base b JOIN sensors s ON s.satellite = b.satellite)"""

_ORDER = ["sensors", "projects_ev", "projects_su", "projects_li", "det_ev", "li_base", "det_li"]
_TEXT = {
    "sensors": SENSORS,
    "projects_ev": PROJECTS_EV,
    "projects_su": PROJECTS_SU,
    "projects_li": PROJECTS_LI,
    "det_ev": DET_EV,
    "li_base": LI_BASE,
    "det_li": DET_LI,
}
_NEEDS = {"det_ev": ["sensors"], "det_li": ["sensors", "li_base"]}


def with_fixtures(names: list[str], body_ctes: list[str], select: str) -> str:
    """WITH <fixture ctes needed by `names`>, <body ctes> <select>."""
    need: set[str] = set()
    for n in names:
        need.add(n)
        need.update(_NEEDS.get(n, []))
    ctes = [_TEXT[n] for n in _ORDER if n in need] + list(body_ctes)
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + select


def r6(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c.split('.')[-1]}" for c in cols)
