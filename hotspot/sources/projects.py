"""Project catalogue: key=value config files <-> typed project rows, volcano catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hotspot import schemas
from hotspot.functions.clean import build_obs_ts, parse_date

CONFIG_NAME_RE = r"config_([^/]+)\.txt$"
CONFIG_DIR_RE = r"project_key=([^/]+)/"
DATE_TIME_FMT = "dd/MM/yyyy HH:mm"


def project_key(name) -> Column:
    """Display name -> folder key (trim, spaces -> underscores)."""
    c = F.col(name) if isinstance(name, str) else name
    return F.regexp_replace(F.trim(c), " ", "_")


def display_name(key) -> Column:
    c = F.col(key) if isinstance(key, str) else key
    return F.regexp_replace(c, "_", " ")


def _py_bool(c: Column) -> Column:
    return F.when(c, F.lit("True")).when(~c, F.lit("False"))


def _num_text(c: Column) -> Column:
    return c.cast("string")


def config_lines(projects: DataFrame) -> DataFrame:
    """Typed projects -> (project_key, line_no, line) in the fixed key order."""
    values = {
        "volcano": F.col("volcano"),
        "lats_vent": _num_text(F.col("vent_lat")),
        "longs_vent": _num_text(F.col("vent_lon")),
        "start_day_str": F.date_format("start_ts", DATE_TIME_FMT),
        "end_day_str": F.date_format("end_ts", DATE_TIME_FMT),
        "filter_frp": _num_text(F.col("filter_frp")),
        "frp_filter_mode": F.col("frp_mode"),
        "filter_track": _num_text(F.col("filter_track")),
        "map_key": F.col("map_key"),
        "include_reference_radius": _py_bool(F.col("include_reference_radius")),
        "ref_radius_m": _num_text(F.col("ref_radius_m")),
        "include_shapefile": F.lit("False"),
        "shapefile_path": F.lit(""),
        "include_reference_waypoint": _py_bool(F.col("include_reference_waypoint")),
        "wpt_names": F.col("wpt_names"),
        "wpt_lats": F.col("wpt_lats"),
        "wpt_lons": F.col("wpt_lons"),
        "wpt_symbols": F.col("wpt_symbols"),
    }
    items = F.array(*[
        F.struct(F.lit(i).alias("line_no"), F.lit(k).alias("key"), F.coalesce(values[k], F.lit(schemas.CONFIG_DEFAULTS[k])).alias("value"))
        for i, k in enumerate(schemas.CONFIG_KEYS)
    ])
    x = projects.select(project_key("volcano").alias("project_key"), F.explode(items).alias("kv"))
    return x.select("project_key", "kv.line_no", "kv.key", F.concat("kv.key", F.lit("="), "kv.value").alias("line"))


def normalised(projects: DataFrame) -> DataFrame:
    """K5: periods from the first minute of their first day to the last of their last one; what a
    project leaves open is filled with the defaults when its lines are made."""
    day = lambda c: F.to_date(c).cast("timestamp_ntz")
    return projects.withColumns({"start_ts": day("start_ts"), "end_ts": F.timestamp_add("MINUTE", F.lit(24 * 60 - 1), day("end_ts"))})


def save_projects(projects: DataFrame, root: str) -> None:
    """K5: typed projects as config files, normalised; other projects' files stay."""
    write_projects(config_lines(normalised(projects)), root)


def write_projects(lines: DataFrame, root: str) -> None:
    """K5: one config file per project under project_key=<key>/ (all lines of a project in
    one file, in key order). Only the given projects' folders are replaced."""
    (
        lines.repartition("project_key")
        .sortWithinPartitions("project_key", "line_no")
        .select("project_key", "line")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("project_key")
        .text(root)
    )


def _typed_double(c: Column, default: str) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(default).cast("double"))


def _typed_bool(c: Column, default: str) -> Column:
    v = F.lower(F.coalesce(c, F.lit(default)))
    return F.when(v == "true", F.lit(True)).when(v == "false", F.lit(False)).otherwise(F.lit(default.lower() == "true"))


def parse_period_ts(c: Column) -> Column:
    """'dd/MM/yyyy HH:mm' (time optional) -> TIMESTAMP_NTZ via the row-wise date parser."""
    s = F.trim(c)
    d = parse_date(F.split(s, " ").getItem(0))
    t = F.coalesce(F.get(F.split(s, " "), 1), F.lit("00:00"))
    return build_obs_ts(d, F.regexp_replace(t, ":", ""))


def scan_projects(spark: SparkSession, roots, glob: str = "*.txt") -> DataFrame:
    """S3: every config file below `roots` -> one typed row per project. Lines are
    'key=value' (split at the first '='; '#' lines skipped; both sides trimmed); the last
    occurrence of a key wins; missing keys take the defaults. Files are told apart by their
    folder, so one key under two roots gives two rows."""
    t = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .text(roots)
        .select(F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("seq"))
    )
    t = t.where(F.col("value").contains("=") & ~F.col("value").startswith("#"))
    parts = F.split("value", "=", 2)
    dir_key = F.regexp_extract("path", CONFIG_DIR_RE, 1)
    kv = t.select(
        F.when(dir_key != "", dir_key).otherwise(F.regexp_extract("path", CONFIG_NAME_RE, 1)).alias("project_key"),
        F.regexp_replace("path", "/[^/]*$", "").alias("folder"),
        F.trim(parts.getItem(0)).alias("key"),
        F.trim(F.get(parts, 1)).alias("value"),
        "seq",
    )
    wide = kv.groupBy("project_key", "folder").pivot("key", schemas.CONFIG_KEYS).agg(F.max_by("value", "seq"))
    d = schemas.CONFIG_DEFAULTS
    col = lambda k: F.col(k)
    txt = lambda k: F.coalesce(col(k), F.lit(d[k]))
    return wide.select(
        "project_key",
        F.coalesce(col("volcano"), display_name("project_key")).alias("volcano"),
        _typed_double(col("lats_vent"), d["lats_vent"]).alias("vent_lat"),
        _typed_double(col("longs_vent"), d["longs_vent"]).alias("vent_lon"),
        parse_period_ts(txt("start_day_str")).alias("start_ts"),
        parse_period_ts(txt("end_day_str")).alias("end_ts"),
        _typed_double(col("filter_frp"), d["filter_frp"]).alias("filter_frp"),
        txt("frp_filter_mode").alias("frp_mode"),
        _typed_double(col("filter_track"), d["filter_track"]).alias("filter_track"),
        _typed_double(col("ref_radius_m"), d["ref_radius_m"]).alias("ref_radius_m"),
        F.lit(3).alias("week_anchor"),
        txt("wpt_names").alias("wpt_names"),
        txt("wpt_lats").alias("wpt_lats"),
        txt("wpt_lons").alias("wpt_lons"),
        txt("wpt_symbols").alias("wpt_symbols"),
        txt("map_key").alias("map_key"),
        _typed_bool(col("include_reference_radius"), d["include_reference_radius"]).alias("include_reference_radius"),
        _typed_bool(col("include_reference_waypoint"), d["include_reference_waypoint"]).alias("include_reference_waypoint"),
    )


def upsert_projects(existing: DataFrame, new: DataFrame, key: str = "project_key") -> DataFrame:
    """K5 (table form): replace rows of re-saved projects, keep the others."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def validate_projects(projects: DataFrame) -> DataFrame:
    """P20: data-quality flags per project (dates present, end after start, period length,
    API key present and not the placeholder)."""
    key = F.trim(F.coalesce("map_key", F.lit("")))
    return projects.select(
        "project_id",
        F.col("start_ts").isNotNull().alias("start_ok"),
        F.col("end_ts").isNotNull().alias("end_ok"),
        (F.col("end_ts") > F.col("start_ts")).alias("order_ok"),
        F.timestamp_diff("DAY", F.col("start_ts"), F.col("end_ts")).alias("period_days"),
        ((key != "") & (key != schemas.MAP_KEY_PLACEHOLDER)).alias("key_ok"),
    )


def advance_period(projects: DataFrame) -> DataFrame:
    """The end date moved on by one day and by one week."""
    return projects.select(
        "project_id",
        F.to_date("end_ts").alias("end_date"),
        F.date_add(F.to_date("end_ts"), 1).alias("end_plus_1d"),
        F.date_add(F.to_date("end_ts"), 7).alias("end_plus_7d"),
    )


def read_volcanoes(spark: SparkSession, path: str) -> DataFrame:
    """The volcano catalogue (name, latitude, longitude) with an explicit schema, plus
    the file position of each row (first match wins on duplicate names)."""
    df = spark.read.option("header", True).schema(schemas.VOLCANOES).csv(path)
    return df.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_row")
    )


def lookup_vent(projects: DataFrame, volcanoes: DataFrame) -> DataFrame:
    """J7 + O3: default vent of each project from the catalogue entry with its name (the
    first such entry in file order)."""
    first = volcanoes.groupBy(F.col("Volcano Name").alias("volcano")).agg(
        F.min_by(F.struct(F.col("Latitude").alias("lat"), F.col("Longitude").alias("lon")), F.struct("_file", "_row")).alias("v")
    )
    j = projects.join(first, "volcano", "left")
    return j.select("project_id", "volcano", F.col("v.lat").alias("cat_lat"), F.col("v.lon").alias("cat_lon"))
