"""Report: which result sections exist per project, and the KPI tables in long form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Units of the metrics that have one
UNITS = {
    "vent_lat": "deg", "vent_lon": "deg", "filter_frp": "MW", "filter_track": "km", "ref_radius_m": "m",
    "frp_mean": "MW", "frp_max": "MW", "dist_mean": "km", "dist_max": "km",
    "max_distance_km": "km", "max_speed": "m/h", "mean_speed": "m/h",
}
SECTIONS = ("project", "counts", "runout", "speed")


def available_sections(projects: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """per project, the row count of each result table and whether it is non-empty."""
    out = projects.select("project_id")
    for name, t in tables.items():
        c = t.groupBy("project_id").agg(F.count(F.lit(1)).alias(f"n_{name}"))
        out = out.join(c, "project_id", "left")
    cols = ["project_id"]
    for name in tables:
        n = F.coalesce(F.col(f"n_{name}"), F.lit(0)).cast("bigint")
        cols += [n.alias(f"n_{name}"), (n > 0).alias(f"has_{name}")]
    return out.select(*cols)


def _long(df: DataFrame, section: str, num: list[str], text: list[str]) -> DataFrame:
    parts = []
    if num:
        n = df.select("project_id", *[F.col(c).cast("double").alias(c) for c in num])
        parts.append(n.unpivot("project_id", num, "metric", "value_num").withColumn("value_text", F.lit(None).cast("string")))
    if text:
        t = df.select("project_id", *[F.col(c).cast("string").alias(c) for c in text])
        parts.append(t.unpivot("project_id", text, "metric", "value_text").withColumn("value_num", F.lit(None).cast("double")))
    u = reduce(lambda a, b: a.unionByName(b), parts)
    unit = F.coalesce(*[F.when(F.col("metric") == m, F.lit(x)) for m, x in UNITS.items()])
    return u.select("project_id", F.lit(section).alias("section"), "metric", "value_num", "value_text", unit.alias("unit"))


def report_kpis(projects: DataFrame, counts: DataFrame, runout: DataFrame, speed: DataFrame, sections=SECTIONS) -> DataFrame:
    """The report's KPI tables as one long table (project, section, metric, value),
    for the chosen sections."""
    p = projects.select(
        "project_id", "volcano", "frp_mode", "vent_lat", "vent_lon", "filter_frp", "filter_track", "ref_radius_m",
        F.date_format("start_ts", "yyyy-MM-dd HH:mm").alias("period_start"),
        F.date_format("end_ts", "yyyy-MM-dd HH:mm").alias("period_end"),
    )
    parts = {
        "project": _long(p, "project", ["vent_lat", "vent_lon", "filter_frp", "filter_track", "ref_radius_m"], ["volcano", "frp_mode", "period_start", "period_end"]),
        "counts": _long(counts.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("last_day", "last_week_start", "last_week_end")})
                        .withColumn("last_month", F.date_format("last_month", "yyyy-MM")), "counts",
                        ["total_last_day", "total_last_week", "total_last_month", "peak_week", "peak_month"],
                        ["last_day", "last_week_start", "last_week_end", "last_month"]),
        "runout": _long(runout, "runout", ["n_detections", "frp_mean", "frp_max", "dist_mean", "dist_max"], []),
        "speed": _long(speed.withColumn("first_date", F.date_format("first_date", "yyyy-MM-dd"))
                       .withColumn("last_date", F.date_format("last_date", "yyyy-MM-dd")), "speed",
                       ["n_rows", "max_distance_km", "max_speed", "mean_speed"], ["first_date", "last_date"]),
    }
    return reduce(lambda a, b: a.unionByName(b), [parts[s] for s in sections])


REPORT_SCHEMA = "project_id bigint, section string, metric string, value_num double, value_text string, unit string"


def write_report(report: DataFrame, projects: DataFrame, path: str) -> None:
    """K6: the long KPI table as JSON, one directory per project and reporting period
    (project_id=<id>/period=<start>_<end>/); reports of other projects and periods stay."""
    period = F.concat_ws("_", F.date_format("start_ts", "yyyyMMdd"), F.date_format("end_ts", "yyyyMMdd"))
    r = report.join(projects.select("project_id", period.alias("period")), "project_id")
    r.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id", "period").json(path)


def read_report(spark, path: str) -> DataFrame:
    """All reports below `path`; project_id and period come from the folders."""
    return spark.read.schema(REPORT_SCHEMA + ", period string").json(path)
