"""Detection archive readers: text archives (CSV) -> typed, cleaned detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hotspot import schemas
from hotspot.functions.clean import build_obs_ts, coerce_numeric, pad_time, parse_date
from hotspot.operators.dims import fixed_broadcast
from hotspot.session import cut_lineage

# The sensor part of archive file and folder names, e.g.
# historical_VIIRS_SNPP_NRT_<project>.csv, and the project part of such a name.
SENSOR_KEY_RE = r"((?:MODIS|VIIRS)(?:_[A-Z]+[0-9]*)??(?:_(?:NRT|SP|URT|RT))|(?:MODIS|VIIRS)(?:_(?:SNPP|NOAA[0-9]+|[A-Z]+[0-9]+))?)(?=_|/|\.|$)"
PROJECT_FROM_NAME_RE = r"historical_(?:MODIS|VIIRS)(?:_[A-Z0-9]+)*?(?:_(?:NRT|SP|URT|RT))_(.+)\.csv$"
PROJECT_FROM_DIR_RE = r"project_id=([^/]+)"
#: Columns that every header line names.
HEADER_NAMES = ("latitude", "longitude")


def header_names(header: str) -> list[str]:
    return [c.strip().strip('"').lstrip("\ufeff") for c in header.split(",")]


def decoded(c: str | Column, encoding: str | None = None) -> Column:
    """Text by itself: UTF-8 where it is, else latin-1 (or the given encoding for all)."""
    c = F.col(c) if isinstance(c, str) else c
    if encoding:
        return F.decode(c.cast("binary"), encoding)
    return F.when(F.is_valid_utf8(c), c).otherwise(F.decode(c.cast("binary"), "ISO-8859-1"))


def text_lines(spark: SparkSession, path, glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Lines of text files (`_path`, `_line`; `_block`, `_at`: their order in a file), files listed once,
    and the header line of each file (`_path`, `_header`), as a written table of one row per file."""
    lines = spark.read.option("recursiveFileLookup", True)
    lines = (lines.option("pathGlobFilter", glob) if glob else lines).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("_path"), F.col("value").alias("_line"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    low = F.lower("_line")
    heads = lines.where(low.contains(HEADER_NAMES[0]) & low.contains(HEADER_NAMES[1]))
    return lines, cut_lineage(heads.groupBy("_path").agg(F.max("_line").alias("_header")))


def read_by_name(spark: SparkSession, path, glob: str | None = None, encoding: str | None = None) -> DataFrame:
    """Text archives whose files may differ in header: columns are addressed by name, so one that a
    file lacks is NULL for its rows. Every line is decoded by itself (UTF-8, else latin-1, unless
    `encoding` is given). Hive-style folders (project_id=/sensor=) become columns; `_path` is the row's file.

    Files are listed once. A first pass finds each file's header line; different headers are few, and
    only they come to the driver. All rows are then one scan, whatever the number of layouts: a line is
    parsed by position and its fields are named by the layout of its file, which, where there are
    several, a join on the path brings (one row per file, as a written table)."""
    lines, heads = text_lines(spark, path, glob)
    layouts = sorted(r[0] for r in heads.select("_header").distinct().collect())
    if not layouts:
        return spark.createDataFrame([], "latitude string, longitude string, project_id string, sensor string, _path string")
    # a file without a header has no columns: with one layout its lines are told by a join as well
    rows = lines.join(heads, "_path").where((F.col("_line") != F.col("_header")) & (F.trim("_line") != ""))
    named = [header_names(h) for h in layouts]
    fields = [f"_c{k}" for k in range(max(map(len, named)))]
    # a generator of one row: the line is parsed once, however often its fields are used above
    parsed = F.from_csv(decoded("_line", encoding), ", ".join(f"{f} string" for f in fields), {"mode": "PERMISSIVE"})
    rows = rows.select("_path", "_header", F.inline(F.array(parsed)))
    columns = []
    for name in dict.fromkeys(c for names in named for c in names):
        at = [(h, names.index(name)) for h, names in zip(layouts, named) if name in names]
        places = {k for _, k in at}
        if len(at) == len(layouts) and len(places) == 1:
            value = F.col(f"_c{places.pop()}")
        else:
            value = F.coalesce(*[F.when(F.col("_header") == h, F.col(f"_c{k}")) for h, k in at])
        columns.append(value.alias(name))
    folder = lambda key: F.regexp_extract("_path", f"{key}=([^/]+)/", 1)
    known = {c for names in named for c in names}
    columns += [F.when(folder(key) != "", folder(key)).alias(key) for key in ("project_id", "sensor") if key not in known]
    return rows.select(*columns, "_path")


def read_archive(spark: SparkSession, path, encoding: str | None = None) -> DataFrame:
    """Text archive(s) with a header; every column stays text (no inference), columns
    are addressed by name so sensor layouts with different column sets read alike."""
    return read_by_name(spark, path, encoding=encoding).drop("_path")


def scan_tagged(spark: SparkSession, root: str, glob: str = "*.csv", encoding: str | None = None) -> DataFrame:
    """All archives below `root` matching `glob`; sensor key and project are taken from
    each row's file path (historical_<SENSOR>_<project>.csv, or project_id=/sensor= dirs)."""
    df = read_by_name(spark, root, glob, encoding).drop("project_id", "sensor")
    path = F.col("_path")
    name_project = F.regexp_extract(path, PROJECT_FROM_NAME_RE, 1)
    dir_project = F.regexp_extract(path, PROJECT_FROM_DIR_RE, 1)
    dir_sensor = F.regexp_extract(path, "sensor=([^/]+)/", 1)
    name_sensor = F.regexp_extract(path, SENSOR_KEY_RE, 1)
    return df.select(
        *[c for c in df.columns if c != "_path"],
        F.when(dir_sensor != "", dir_sensor).otherwise(name_sensor).alias("sensor"),
        F.when(dir_project != "", dir_project).otherwise(name_project).alias("project_key"),
    )


def _text(df: DataFrame, name: str):
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


# Columns that typing consumes; all others are carried through as delivered.
TYPED = {"project_id", "detection_id", "sensor", "latitude", "longitude", "frp", "track", "acq_date", "acq_time", "satellite", "project_key"}


def sensor_name(c) -> Column:
    """The sensor dimension's key of an archive key: all processing levels of a satellite
    (NRT, SP, RT, URT) are one sensor."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, "_(SP|URT|RT)$", "_NRT")


def known_sensor(c) -> Column:
    return F.coalesce(sensor_name(c).isin([s[0] for s in schemas.SENSORS]), F.lit(False))


def clean_detections(raw: DataFrame, spark: SparkSession, drop_incomplete: bool = True, project_type: str = "bigint", carry: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """P1-P4 + J2 + F7: type the text columns (bad numbers and NaN -> NULL, three date
    layouts row by row, padded time, observation timestamp), attach the sensor dimension,
    and (by default) drop rows without position, date or known sensor (`rejected_rows` lists
    them). With `carry` the other delivered columns (brightness, scan, instrument, confidence,
    version, day/night, ...) go along as text, the delivered satellite as `satellite_code`; without
    it, only those named in `keep` do."""
    more = [c for c in raw.columns if (carry and c not in TYPED) or c in keep]
    code = [F.col("satellite").alias("satellite_code")] if carry and "satellite" in raw.columns else []
    d = raw.select(
        *[F.col(f"`{c}`") for c in more],
        *code,
        (F.col("project_id") if "project_id" in raw.columns else F.lit(None)).cast(project_type).alias("project_id"),
        _text(raw, "detection_id").alias("detection_id_text"),
        sensor_name("sensor").alias("sensor"),
        coerce_numeric(_text(raw, "latitude")).alias("latitude"),
        coerce_numeric(_text(raw, "longitude")).alias("longitude"),
        coerce_numeric(_text(raw, "frp")).alias("frp"),
        coerce_numeric(_text(raw, "track")).alias("track"),
        parse_date(_text(raw, "acq_date")).alias("acq_date"),
        pad_time(_text(raw, "acq_time")).alias("acq_time"),
    )
    ident = F.coalesce(
        F.col("detection_id_text").try_cast("bigint"),
        F.xxhash64("sensor", "latitude", "longitude", "acq_date", "acq_time", "frp", "track"),
    )
    d = d.withColumn("detection_id", ident).withColumn("obs_ts", build_obs_ts("acq_date", "acq_time"))
    # the sensor dimension has 4 fixed rows
    d = d.join(fixed_broadcast(schemas.sensors(spark).drop("family")), "sensor", "left")
    if drop_incomplete:
        d = d.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & F.col("acq_date").isNotNull() & F.col("satellite").isNotNull())
    return d.select(*[f.name for f in schemas.DETECTIONS.fields], *[f"`{c}`" for c in more], *(["satellite_code"] if code else []))


def tag_project_from_path(raw: DataFrame) -> DataFrame:
    """project_id from the archive path (project_id=<key>/ folder or
    historical_<SENSOR>_<project>.csv name), as text."""
    return raw.withColumn("project_id", F.col("project_key")).drop("project_key")


def rejected_rows(raw: DataFrame) -> DataFrame:
    """Q29: the raw rows the cleaner drops (no readable position or date, unknown sensor), as
    delivered, with the reason — kept for inspection instead of vanishing silently."""
    lat = coerce_numeric(_text(raw, "latitude"))
    lon = coerce_numeric(_text(raw, "longitude"))
    date = parse_date(_text(raw, "acq_date"))
    reason = (
        F.when(date.isNull(), F.lit("date"))
        .when(lat.isNull() | lon.isNull(), F.lit("position"))
    )
    if "sensor" in raw.columns:
        reason = reason.when(~known_sensor("sensor"), F.lit("sensor"))
    return raw.select("*", reason.alias("reason")).where(F.col("reason").isNotNull())


def reject_log(raw: DataFrame) -> DataFrame:
    """Per project and sensor, rows read and rows dropped for a missing position, an
    unparseable date or an unknown sensor, plus rows whose FRP is unreadable (kept, FRP NULL)."""
    lat = coerce_numeric(_text(raw, "latitude"))
    lon = coerce_numeric(_text(raw, "longitude"))
    date = parse_date(_text(raw, "acq_date"))
    frp = coerce_numeric(_text(raw, "frp"))
    keys = [c for c in ("project_id", "sensor") if c in raw.columns]
    return raw.groupBy(*[F.col(k).cast("bigint").alias(k) if k == "project_id" else F.col(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(date.isNull()).alias("bad_date"),
        F.count_if(lat.isNull() | lon.isNull() | date.isNull() | (~known_sensor("sensor") if "sensor" in raw.columns else F.lit(False))).alias("rows_dropped"),
        F.count_if(frp.isNull()).alias("frp_null"),
    )
