"""Project catalogue queries: config files, validation, volcano lookup (with SQL oracles)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hotspot.plans.common import Registry, round6
from hotspot.plans.sql_fixtures import with_fixtures
from hotspot.session import new_table_path
from hotspot.sources import fixtures as fx
from hotspot.sources import projects as pj

R = Registry()


def _config_lines(spark, sf):
    """Config lines of the supplier projects, with the cases a reader must handle: keys left
    out (project 2: filter_frp, map_key -> defaults), a comment line, and a key repeated
    later with spaces around '=' (project 5: the later filter_track wins)."""
    p = fx.projects_su(spark, sf)
    lines = pj.config_lines(p)
    k = F.col("project_key")
    two = pj.project_key(F.lit("Site 2"))
    zero = pj.project_key(F.lit("Site 5"))
    lines = lines.where(~((k == two) & F.col("key").isin("filter_frp", "map_key")))
    extra = p.select(pj.project_key("volcano").alias("project_key")).where(F.col("project_key") == zero).select(
        "project_key", F.lit(-1).alias("line_no"), F.lit("comment").alias("key"), F.lit("# filter_track=9").alias("line")
    ).unionByName(
        p.select(pj.project_key("volcano").alias("project_key")).where(F.col("project_key") == zero).select(
            "project_key", F.lit(99).alias("line_no"), F.lit("filter_track").alias("key"), F.lit("filter_track = 0.7").alias("line"))
    )
    return lines.unionByName(extra)


def _scanned(spark, sf):
    root = new_table_path(spark, "projects")
    pj.write_projects(_config_lines(spark, sf), root)
    return pj.scan_projects(spark, root)


PKEY = "replace(trim(s_name), ' ', '_')"


@R.add(
    "scan_projects",
    with_fixtures(["projects_su"], [], """SELECT replace(trim(volcano), ' ', '_') AS project_key, volcano, round(vent_lat, 6) AS vent_lat,
       round(vent_lon, 6) AS vent_lon, start_ts, end_ts,
       CASE WHEN project_id = 2 THEN CAST(35 AS DOUBLE) ELSE round(filter_frp, 6) END AS filter_frp, frp_mode,
       CASE WHEN project_id = 5 THEN CAST(0.7 AS DOUBLE) ELSE round(filter_track, 6) END AS filter_track,
       round(ref_radius_m, 6) AS ref_radius_m, 3 AS week_anchor, wpt_names, wpt_lats, wpt_lons, wpt_symbols,
       CASE WHEN project_id = 2 THEN 'INSERT_YOUR_MAP_KEY_HERE' ELSE map_key END AS map_key,
       include_reference_radius, include_reference_waypoint FROM projects_su"""),
)
def q_scan_projects(spark, sf):
    """S3 + K5: project configs written as key=value files and scanned back, typed."""
    return round6(_scanned(spark, sf))


@R.add(
    "write_projects",
    with_fixtures(["projects_su"], [], """SELECT replace(trim(volcano), ' ', '_') AS project_key,
       CASE WHEN project_id IN (1, 3) THEN end_ts + INTERVAL 7 DAY ELSE end_ts END AS end_ts FROM projects_su"""),
)
def q_write_projects(spark, sf):
    """K5 table form: re-saved projects (1 and 3, end moved a week) replace their rows."""
    p = fx.projects_su(spark, sf).withColumn("project_key", pj.project_key("volcano"))
    new = p.where(F.col("project_id").isin(1, 3)).withColumn("end_ts", F.timestamp_add("DAY", F.lit(7), F.col("end_ts")))
    return pj.upsert_projects(p, new).select("project_key", "end_ts")


@R.add(
    "project_key",
    with_fixtures([], [], f"SELECT s_suppkey, {PKEY} AS project_key, replace({PKEY}, '_', ' ') AS display_name FROM supplier"),
)
def q_project_key(spark, sf):
    r = fx.read_table(spark, sf, "supplier")
    return r.select("s_suppkey", pj.project_key("s_name").alias("project_key"),
                    pj.display_name(pj.project_key("s_name")).alias("display_name"))


@R.add(
    "validate_projects",
    with_fixtures(["projects_su"], [], """SELECT project_id, start_ts IS NOT NULL AS start_ok, end_ts IS NOT NULL AS end_ok, end_ts > start_ts AS order_ok,
       CAST(floor(date_diff('second', start_ts, end_ts) / 86400.0) AS BIGINT) AS period_days,
       trim(coalesce(map_key, '')) <> '' AND trim(coalesce(map_key, '')) <> 'INSERT_YOUR_MAP_KEY_HERE' AS key_ok FROM projects_su"""),
)
def q_validate_projects(spark, sf):
    return pj.validate_projects(fx.projects_su(spark, sf))


@R.add(
    "advance_period",
    with_fixtures(["projects_su"], [], """SELECT project_id, CAST(end_ts AS DATE) AS end_date, CAST(end_ts AS DATE) + 1 AS end_plus_1d,
       CAST(end_ts AS DATE) + 7 AS end_plus_7d FROM projects_su"""),
)
def q_advance_period(spark, sf):
    return pj.advance_period(fx.projects_su(spark, sf))


def _write_catalogue(spark, sf) -> str:
    n = fx.read_table(spark, sf, "nation")
    r = fx.read_table(spark, sf, "region")
    cat = n.select(F.col("n_name").alias("Volcano Name"), (F.lit(-1.0) + F.lit(0.05) * F.col("n_nationkey")).alias("Latitude"),
                   (F.lit(-92.0) + F.lit(0.05) * F.col("n_nationkey")).alias("Longitude")).unionByName(
        r.select(F.col("r_name").alias("Volcano Name"), (F.lit(-0.45) + F.lit(0.1) * F.col("r_regionkey")).alias("Latitude"),
                 (F.lit(-91.45) + F.lit(0.1) * F.col("r_regionkey")).alias("Longitude"))).unionByName(
        # the same names again, further down and elsewhere: the first entry is the one that counts
        r.select(F.col("r_name").alias("Volcano Name"), (F.lit(-9.0) + F.col("r_regionkey")).cast("double").alias("Latitude"), F.lit(10.0).alias("Longitude")))
    path = new_table_path(spark, "volcanoes")
    cat.write.option("header", True).csv(path)
    return path


CATALOGUE = """cat AS (SELECT n_name AS volcano, CAST(-1.0 AS DOUBLE) + CAST(0.05 AS DOUBLE) * n_nationkey AS lat,
    CAST(-92.0 AS DOUBLE) + CAST(0.05 AS DOUBLE) * n_nationkey AS lon, 0 AS ord FROM nation
  UNION ALL SELECT r_name, CAST(-0.45 AS DOUBLE) + CAST(0.1 AS DOUBLE) * r_regionkey, CAST(-91.45 AS DOUBLE) + CAST(0.1 AS DOUBLE) * r_regionkey, 1 FROM region
  UNION ALL SELECT r_name, CAST(-9.0 AS DOUBLE) + r_regionkey, CAST(10.0 AS DOUBLE), 2 FROM region),
first AS (SELECT volcano, arg_min(lat, ord) AS lat, arg_min(lon, ord) AS lon FROM cat GROUP BY volcano)"""


@R.add("scan_volcanoes", with_fixtures([], [CATALOGUE], 'SELECT volcano AS "Volcano Name", round(lat, 6) AS "Latitude", round(lon, 6) AS "Longitude" FROM cat'))
def q_scan_volcanoes(spark, sf):
    v = pj.read_volcanoes(spark, _write_catalogue(spark, sf))
    return round6(v.select("Volcano Name", "Latitude", "Longitude"))


@R.add(
    "lookup_vent",
    with_fixtures(["projects_ev"], [CATALOGUE], """SELECT p.project_id, p.volcano, round(c.lat, 6) AS cat_lat, round(c.lon, 6) AS cat_lon
  FROM projects_ev p LEFT JOIN first c ON c.volcano = p.volcano"""),
)
def q_lookup_vent(spark, sf):
    v = pj.read_volcanoes(spark, _write_catalogue(spark, sf))
    return round6(pj.lookup_vent(fx.projects_ev(spark, sf), v))


@R.add("sort_projects", with_fixtures(["projects_su"], [], """SELECT replace(trim(volcano), ' ', '_') AS project_key, volcano AS label,
       row_number() OVER (ORDER BY volcano) AS position FROM projects_su"""))
def q_sort_projects(spark, sf):
    """Projects listed by label (a distributed range sort), with the position each row comes
    out at (the catalogue is small enough to number)."""
    p = fx.projects_su(spark, sf)
    p = p.select(pj.project_key("volcano").alias("project_key"), F.col("volcano").alias("label")).orderBy("label")
    out = p.withColumn("_at", F.monotonically_increasing_id())
    return out.select("project_key", "label", F.row_number().over(Window.orderBy("_at")).cast("bigint").alias("position"))


@R.add("first_match", with_fixtures([], [CATALOGUE], "SELECT volcano, round(lat, 6) AS lat FROM first"))
def q_first_match(spark, sf):
    """O3: first catalogue row per name (file order); region names come twice."""
    v = pj.read_volcanoes(spark, _write_catalogue(spark, sf))
    f = v.groupBy(F.col("Volcano Name").alias("volcano")).agg(F.min_by("Latitude", F.struct("_file", "_row")).alias("lat"))
    return round6(f)



