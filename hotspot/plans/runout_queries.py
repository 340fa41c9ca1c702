"""Runout, daily maxima, frontier and speed: Spark plans and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from hotspot import schemas
from hotspot.functions.geo import haversine_km
from hotspot.operators import frontier as fr
from hotspot.operators import runout as ro
from hotspot.plans.common import Registry, round6
from hotspot.plans.sql_fixtures import r6, with_fixtures
from hotspot.sources import fixtures as fx

R = Registry()

HAV_SQL = """CAST(6371.0 AS DOUBLE) * 2 * asin(sqrt(least(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2)
        + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2), 1.0)))"""

FILTERED = """filtered AS (
  SELECT d.*, p.vent_lat, p.vent_lon, p.start_ts, p.end_ts, p.filter_frp, p.frp_mode, p.filter_track, p.ref_radius_m,
         """ + HAV_SQL.format(lat1="p.vent_lat", lon1="p.vent_lon", lat2="d.latitude", lon2="d.longitude") + """ AS distance_km
  FROM det_ev d JOIN projects_ev p USING (project_id)
  WHERE d.satellite IN ('SNPP', 'NOAA20', 'NOAA21') AND d.track <= p.filter_track
    AND (CASE WHEN p.frp_mode = 'gt' THEN d.frp >= p.filter_frp ELSE d.frp <= p.filter_frp END)
    AND d.obs_ts BETWEEN p.start_ts AND p.end_ts)"""

DAILY = """daily AS (
  SELECT project_id, date_only, satellite, distance_km, frp, latitude, longitude, source FROM (
    SELECT project_id, CAST(obs_ts AS DATE) AS date_only, satellite,
           max(distance_km) OVER g AS distance_km, max(frp) OVER g AS frp, latitude, longitude, source_id AS source,
           row_number() OVER (PARTITION BY project_id, CAST(obs_ts AS DATE), satellite
                              ORDER BY obs_ts, latitude, longitude, detection_id) AS rn
    FROM filtered WINDOW g AS (PARTITION BY project_id, CAST(obs_ts AS DATE), satellite)) t WHERE rn = 1)"""


def frontier_ctes(src: str = "daily", order: str = "date_only, satellite", name: str = "front") -> list[str]:
    return [
        f"""{name}_rm AS (
  SELECT *, max(distance_km) OVER (PARTITION BY project_id ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS max_distance,
         coalesce(max(distance_km) OVER (PARTITION BY project_id ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS prev_max
  FROM {src})""",
        f"""{name}_k AS (
  SELECT *, date_only AS date,
         CAST(date_diff('day', lag(date_only) OVER (PARTITION BY project_id ORDER BY {order}), date_only) * 24 AS DOUBLE) AS time_diff,
         (max_distance - prev_max) * 1000.0 AS distance_diff
  FROM {name}_rm WHERE distance_km > prev_max)""",
        f"""{name} AS (SELECT *, CASE WHEN time_diff > 0 THEN distance_diff / time_diff ELSE 0.0 END AS speed FROM {name}_k)""",
    ]


EV = ["projects_ev", "det_ev"]


def _filtered(spark, sf):
    return ro.filter_runout(fx.detections_ev(spark, sf), fx.projects_ev(spark, sf))


def _daily(spark, sf):
    return ro.daily_runout(_filtered(spark, sf))


@R.add(
    "with_project",
    with_fixtures(EV, [], "SELECT d.project_id, d.detection_id, p.volcano, " + r6("p.vent_lat", "p.vent_lon", "p.filter_frp")
                  + ", p.frp_mode FROM det_ev d JOIN projects_ev p USING (project_id)"),
)
def q_with_project(spark, sf):
    d = ro.with_project(fx.detections_ev(spark, sf).select("project_id", "detection_id"), fx.projects_ev(spark, sf),
                        ["project_id", "volcano", "vent_lat", "vent_lon", "filter_frp", "frp_mode"])
    return round6(d)


@R.add(
    "with_sensor",
    with_fixtures(["sensors", "li_base"], [], "SELECT b.detection_id, s.sensor, s.source_id, s.family FROM li_base b JOIN sensors s USING (satellite)"),
)
def q_with_sensor(spark, sf):
    from hotspot.operators.dims import fixed_broadcast

    b = fx._li_base(spark, sf).select("detection_id", "satellite")
    return b.join(fixed_broadcast(schemas.sensors(spark)), "satellite").select("detection_id", "sensor", "source_id", "family")


@R.add(
    "haversine_km",
    with_fixtures(EV, [], "SELECT d.detection_id, round(" + HAV_SQL.format(lat1="p.vent_lat", lon1="p.vent_lon", lat2="d.latitude", lon2="d.longitude")
                  + ", 6) AS distance_km FROM det_ev d JOIN projects_ev p USING (project_id)"),
)
def q_haversine(spark, sf):
    d = ro.with_project(fx.detections_ev(spark, sf), fx.projects_ev(spark, sf))
    return round6(d.select("detection_id", haversine_km("vent_lat", "vent_lon", "latitude", "longitude").alias("distance_km")))


@R.add(
    "filter_period",
    with_fixtures(EV, [], "SELECT d.project_id, d.detection_id FROM det_ev d JOIN projects_ev p USING (project_id) "
                  "WHERE d.obs_ts BETWEEN p.start_ts AND p.end_ts"),
)
def q_filter_period(spark, sf):
    d = ro.with_project(fx.detections_ev(spark, sf), fx.projects_ev(spark, sf))
    return d.where(F.col("obs_ts").between(F.col("start_ts"), F.col("end_ts"))).select("project_id", "detection_id")


@R.add(
    "filter_track",
    with_fixtures(EV, [], "SELECT d.project_id, d.detection_id FROM det_ev d JOIN projects_ev p USING (project_id) WHERE d.track <= p.filter_track"),
)
def q_filter_track(spark, sf):
    d = ro.with_project(fx.detections_ev(spark, sf), fx.projects_ev(spark, sf))
    return d.where(F.col("track") <= F.col("filter_track")).select("project_id", "detection_id")


@R.add(
    "filter_frp",
    with_fixtures(EV, [], "SELECT d.project_id, d.detection_id FROM det_ev d JOIN projects_ev p USING (project_id) "
                  "WHERE CASE WHEN p.frp_mode = 'gt' THEN d.frp >= p.filter_frp ELSE d.frp <= p.filter_frp END"),
)
def q_filter_frp(spark, sf):
    d = ro.with_project(fx.detections_ev(spark, sf), fx.projects_ev(spark, sf))
    return d.where(ro.frp_predicate()).select("project_id", "detection_id")


@R.add(
    "filter_satellite",
    with_fixtures(["det_ev"], [], "SELECT d.project_id, d.detection_id, d.satellite FROM det_ev d JOIN sensors s USING (satellite) WHERE s.family = 'VIIRS'"),
)
def q_filter_satellite(spark, sf):
    d = fx.detections_ev(spark, sf)
    return d.where(F.col("satellite").isin(schemas.VIIRS)).select("project_id", "detection_id", "satellite")


@R.add(
    "filter_runout",
    with_fixtures(EV, [FILTERED], "SELECT project_id, detection_id, satellite, source_id, obs_ts, "
                  + r6("frp", "track", "latitude", "longitude", "distance_km") + " FROM filtered"),
)
def q_filter_runout(spark, sf):
    f = _filtered(spark, sf)
    return round6(f.select("project_id", "detection_id", "satellite", "source_id", "obs_ts", "frp", "track", "latitude", "longitude", "distance_km"))


@R.add(
    "daily_runout",
    with_fixtures(EV, [FILTERED, DAILY], "SELECT project_id, date_only, satellite, source, "
                  + r6("distance_km", "frp", "latitude", "longitude") + " FROM daily"),
)
def q_daily_runout(spark, sf):
    return round6(_daily(spark, sf))


@R.add(
    "daily_runout_point",
    with_fixtures(EV, [FILTERED], """SELECT project_id, date_only, satellite, source, obs_ts, """
                  + r6("distance_km", "frp", "latitude", "longitude") + """ FROM (
    SELECT project_id, CAST(obs_ts AS DATE) AS date_only, satellite, source_id AS source, obs_ts, latitude, longitude,
           max(distance_km) OVER g AS distance_km, max(frp) OVER g AS frp,
           row_number() OVER (PARTITION BY project_id, CAST(obs_ts AS DATE), satellite ORDER BY distance_km DESC, detection_id DESC) AS rn
    FROM filtered WINDOW g AS (PARTITION BY project_id, CAST(obs_ts AS DATE), satellite)) t WHERE rn = 1"""),
)
def q_daily_runout_point(spark, sf):
    return round6(ro.daily_runout_point(_filtered(spark, sf)))


@R.add(
    "period_summary",
    with_fixtures(EV, [FILTERED], """SELECT project_id, count(*) AS n_detections, round(avg(frp), 6) AS frp_mean, round(max(frp), 6) AS frp_max,
       round(avg(distance_km), 6) AS dist_mean, round(max(distance_km), 6) AS dist_max FROM filtered GROUP BY project_id"""),
)
def q_period_summary(spark, sf):
    return round6(ro.period_summary(_filtered(spark, sf)))


@R.add(
    "satellite_series",
    with_fixtures(EV, [FILTERED], "SELECT project_id, satellite, detection_id, obs_ts, " + r6("frp", "distance_km") + " FROM filtered"),
)
def q_satellite_series(spark, sf):
    return round6(ro.satellite_series(_filtered(spark, sf)))


@R.add(
    "radius_check",
    with_fixtures(EV, [FILTERED], """SELECT p.project_id, round(p.ref_radius_m / 1000.0, 6) AS radius_km,
       CAST(coalesce(a.n_beyond, 0) AS BIGINT) AS n_beyond, coalesce(a.n_beyond, 0) > 0 AS exceeded,
       a.first_beyond_ts, round(a.max_distance_km, 6) AS max_distance_km
  FROM projects_ev p LEFT JOIN (
    SELECT f.project_id, count(*) FILTER (WHERE f.distance_km > f.ref_radius_m / 1000.0) AS n_beyond,
           min(f.obs_ts) FILTER (WHERE f.distance_km > f.ref_radius_m / 1000.0) AS first_beyond_ts,
           max(f.distance_km) AS max_distance_km
    FROM filtered f GROUP BY f.project_id) a USING (project_id)"""),
)
def q_radius_check(spark, sf):
    return round6(ro.radius_check(_filtered(spark, sf), fx.projects_ev(spark, sf)))


@R.add(
    "running_max",
    with_fixtures(EV, [FILTERED, DAILY, frontier_ctes()[0]], "SELECT project_id, date_only, satellite, "
                  + r6("distance_km", "max_distance", "prev_max") + " FROM front_rm"),
)
def q_running_max(spark, sf):
    return round6(fr.running_max(_daily(spark, sf)).select("project_id", "date_only", "satellite", "distance_km", "max_distance", "prev_max"))


FRONT_COLS = ["project_id", "date_only", "satellite", "distance_km", "frp", "latitude", "longitude", "source",
              "date", "max_distance", "prev_max", "time_diff", "distance_diff", "speed"]


@R.add(
    "frontier",
    with_fixtures(EV, [FILTERED, DAILY] + frontier_ctes(), "SELECT project_id, date_only, satellite, source, date, "
                  + r6("distance_km", "frp", "latitude", "longitude", "max_distance", "prev_max", "time_diff", "distance_diff", "speed")
                  + " FROM front"),
)
def q_frontier(spark, sf):
    return round6(fr.frontier(_daily(spark, sf)).select(*FRONT_COLS))


DAILY_MAX = "daily_max AS (SELECT project_id, date_only, max(distance_km) AS distance_km FROM daily GROUP BY project_id, date_only)"


@R.add(
    "frontier_daily",
    with_fixtures(EV, [FILTERED, DAILY, DAILY_MAX] + frontier_ctes("daily_max", "date_only", "fd"),
                  "SELECT project_id, date, " + r6("distance_km", "max_distance", "prev_max", "time_diff", "distance_diff", "speed") + " FROM fd"),
)
def q_frontier_daily(spark, sf):
    return round6(fr.frontier_daily(_daily(spark, sf)))


@R.add(
    "speed_summary",
    with_fixtures(EV, [FILTERED, DAILY] + frontier_ctes(), """SELECT project_id, count(*) AS n_rows, round(max(max_distance), 6) AS max_distance_km,
       round(max(speed), 6) AS max_speed, round(avg(speed), 6) AS mean_speed,
       round(avg(speed) FILTER (WHERE speed > 0), 6) AS speed_positive_mean,
       count(*) FILTER (WHERE speed = 0) AS n_zero_speed, min(date) AS first_date, max(date) AS last_date
  FROM front GROUP BY project_id"""),
)
def q_speed_summary(spark, sf):
    return round6(fr.speed_summary(fr.frontier(_daily(spark, sf))))


@R.add(
    "new_maximum",
    with_fixtures(EV, [FILTERED, DAILY] + frontier_ctes(), "SELECT project_id, date_only, satellite, " + r6("distance_km", "prev_max") + " FROM front_k"),
)
def q_new_maximum(spark, sf):
    """daily rows strictly beyond the previous running maximum."""
    rm = fr.running_max(_daily(spark, sf))
    return round6(rm.where(F.col("distance_km") > F.col("prev_max")).select("project_id", "date_only", "satellite", "distance_km", "prev_max"))


@R.add(
    "safe_rate",
    with_fixtures(EV, [FILTERED, DAILY] + frontier_ctes(), "SELECT project_id, date, satellite, "
                  + r6("time_diff", "distance_diff") + ", round(CASE WHEN time_diff > 0 THEN distance_diff / time_diff ELSE 0.0 END, 6) AS rate FROM front"),
)
def q_safe_rate(spark, sf):
    """Advance rate where time elapsed, else 0 (never a division by zero or NULL)."""
    f = fr.frontier(_daily(spark, sf))
    return round6(f.select("project_id", "date", "satellite", "time_diff", "distance_diff",
                           fr.safe_rate("distance_diff", "time_diff").alias("rate")))
