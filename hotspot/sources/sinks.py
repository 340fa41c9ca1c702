"""Writers: detection archive (see `archive`), migration of text archives, derived tables."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hotspot.functions.clean import is_iso_text, iso_date, parse_date
from hotspot.session import cut_lineage
from hotspot.sources import detections, files
from hotspot.sources.archive import BUCKET, MONTH, merge_into_archive, read_archive_table, write_archive

_MIGRATING = "_migrating-"
_MIGRATED = "path string, project_id string, sensor string, count long, n_changed long, n_unreadable long"


def read_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at `path`, or None where there is none yet. Any other error (a read
    that fails, no permission) is raised: it must not pass for an empty table."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def migrate_archive(spark: SparkSession, path: str) -> DataFrame:
    """P6 on a text archive: in every file whose dates are in other layouts these become ISO, whether it
    is named historical_<SENSOR>_<project>.csv or lies in project_id=/sensor= folders. Header, other
    fields and the order of the lines stay (the text comes out as UTF-8); dates that cannot be read,
    and lines with quotes, stay as they are. Files without a date to change are not touched, so a
    second run rewrites nothing.

    Copy on write by file: new files are written beside by Spark, one task per file, and each takes
    its old one's place in one rename; after a crash a file is old or new, and another run goes on.
    Returns the files rewritten: path, project, sensor, rows, dates changed, dates that cannot be read."""
    for name, _ in files.children(spark, path):
        if name.startswith(_MIGRATING):  # of a run that died
            files.remove(spark, f"{path}/{name}")
    lines, heads = detections.text_lines(spark, path)
    headers = [r[0] for r in heads.select("_header").distinct().collect()]  # as many as layouts
    at = {h: detections.header_names(h).index("acq_date") for h in headers if "acq_date" in detections.header_names(h)}
    if not at:
        return spark.createDataFrame([], _MIGRATED)
    place = F.coalesce(*[F.when(F.col("_header") == h, F.lit(k)) for h, k in sorted(at.items())])
    rows = lines.join(heads, "_path").withColumns({"_line": detections.decoded("_line"), "_place": place})
    fields = F.split("_line", ",", -1)
    rows = rows.withColumn("_date", F.when((F.col("_line") != F.col("_header")) & ~F.contains("_line", F.lit('"')), F.get(fields, F.col("_place"))))
    iso = iso_date(parse_date("_date"))
    old = ~is_iso_text("_date") & iso.isNotNull()
    rows = rows.withColumn("_iso", F.when(old, iso))
    row = F.trim("_line") != ""
    counts = rows.groupBy("_path", "_header").agg(
        (F.count_if(row) - 1).alias("count"), F.count("_iso").alias("n_changed"), F.count_if(row & F.col("_iso").isNull() & ~is_iso_text("_date") & F.col("_date").isNotNull()).alias("n_unreadable")
    )
    dirty = cut_lineage(counts.where("n_changed > 0").withColumn("_key", F.sha2("_path", 256)))
    beside = f"{path.rstrip('/')}/{_MIGRATING}{uuid.uuid4().hex}"
    line = F.when(F.col("_iso").isNotNull(), F.array_join(F.transform(fields, lambda x, k: F.when(k == F.col("_place"), F.col("_iso")).otherwise(x)), ",")).otherwise(F.col("_line"))
    new = rows.join(dirty.select("_path", "_key"), "_path").select("_key", line.alias("value"), "_block", "_at")
    new.repartition("_key").sortWithinPartitions("_key", "_block", "_at").select("_key", "value").write.partitionBy("_key").text(beside)
    for r in dirty.select("_path", "_key").toLocalIterator():  # names only
        (part,) = [n for n, _ in files.children(spark, f"{beside}/_key={r['_key']}") if n.startswith("part-")]
        files.replace(spark, f"{beside}/_key={r['_key']}/{part}", r["_path"])
    files.remove(spark, beside)
    project = F.coalesce(F.nullif(F.regexp_extract("_path", detections.PROJECT_FROM_DIR_RE, 1), F.lit("")), F.regexp_extract("_path", detections.PROJECT_FROM_NAME_RE, 1))
    sensor = F.coalesce(F.nullif(F.regexp_extract("_path", "sensor=([^/]+)/", 1), F.lit("")), F.regexp_extract("_path", detections.SENSOR_KEY_RE, 1))
    return dirty.select(F.col("_path").alias("path"), project.alias("project_id"), sensor.alias("sensor"), "count", "n_changed", "n_unreadable")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """K3, K4: derived tables as Parquet. With `partition_by` only the partitions that `df` holds are
    replaced, so the results of other projects stay."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    w.parquet(path)


def _partitions(spark: SparkSession, path: str, by: list[str], projects: set[str]) -> dict[str, set[str]]:
    """Folders of these projects' partitions with the names of their files (as Spark lists them too)."""
    folders = [path.rstrip("/")]
    for k, c in enumerate(by):
        below = [(at, n) for at in folders for n, _ in files.children(spark, at) if n.startswith(f"{c}=")]
        folders = [f"{at}/{n}" for at, n in below if k or unquote(n.partition("=")[2]) in projects]
    return {at: {n for n, _ in files.children(spark, at)} for at in folders}


def write_projects_table(df: DataFrame, path: str, projects: list | None = None, then_by: tuple[str, ...] = ()) -> None:
    """K2-K4: the rows of each project in `df` replace its rows in the table at `path`; other projects
    stay. Of those in `projects` (the ones worked on) partitions that get no rows any more go as well,
    after the new ones are in place: those that hold files of before only. AQE sizes the writers, so a hot
    project is written by many tasks."""
    by, wanted = ["project_id", *then_by], {str(p) for p in projects or ()}
    before = _partitions(df.sparkSession, path, by, wanted)
    df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    for at, names in _partitions(df.sparkSession, path, by, wanted).items():
        if names <= before.get(at, set()):
            files.remove(df.sparkSession, at)


def read_projects_table(spark: SparkSession, path: str, schema: StructType, projects: DataFrame) -> DataFrame:
    """The rows of these projects in such a table, with the columns it was written from."""
    rows = spark.read.schema(schema).parquet(path).select(*schema.names)
    return rows.join(projects.select("project_id").distinct(), "project_id", "left_semi").select(*schema.names)


def write_by_month(df: DataFrame, path: str, time_col: str, projects: list | None = None) -> None:
    """K2: a large derived table by project and month."""
    write_projects_table(df.withColumn(MONTH, F.date_format(time_col, "yyyy-MM")), path, projects, (MONTH,))


__all__ = [
    "BUCKET", "MONTH", "merge_into_archive", "migrate_archive", "read_archive_table", "read_if_exists", "read_projects_table",
    "write_archive", "write_by_month", "write_projects_table", "write_table",
]
