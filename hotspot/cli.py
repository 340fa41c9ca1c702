"""Command line: run the analyses over real archives and project configs.

    python -m hotspot merge   --archive ARCHIVE --landing LANDING
    python -m hotspot migrate --landing LANDING
    python -m hotspot analyse --archive ARCHIVE --projects CONFIG_ROOT --out OUT

`merge` reads detection text files below LANDING (historical_<SENSOR>_<project>.csv or
project_id=<key>/sensor=<SENSOR>/ folders), types and cleans them and merges them into the
month-partitioned Parquet ARCHIVE (only touched months are rewritten). `analyse` reads the
archive and every config_*.txt below CONFIG_ROOT and writes, per project, the tables of the
source's modules: filtered detections, daily maxima, frontier, speed, weekly/monthly counts,
KPIs, FRP statistics, frames, extent and the long report table. Projects are keyed by their
folder key. Paths may be on any Hadoop-compatible shared file system.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from hotspot.operators import counts, frames, frontier, frp, report, runout, spatial
from hotspot.session import cut_lineage
from hotspot.sources import detections, projects, sinks


def _session() -> SparkSession:
    # shuffle sizing is left to AQE: it coalesces small partitions to the advisory size
    # and splits skewed ones; the cluster's own settings take precedence
    return (
        SparkSession.builder.appName("hotspot")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def merge(spark: SparkSession, archive: str, landing: str, glob: str = "*.csv"):
    raw = detections.tag_project_from_path(detections.scan_tagged(spark, landing, glob))
    batch = detections.clean_detections(raw, spark, project_type="string", carry=True)
    # arrival order inside the batch: non-negative and below 2^62 as the merge requires; the
    # batch is written once, so that the order does not depend on how often it is read
    batch = batch.withColumn("origin", F.lit(1)).withColumn("ingest_seq", F.monotonically_increasing_id())
    return sinks.merge_into_archive(spark, archive, cut_lineage(batch))


def analyse(spark: SparkSession, archive: str, config_root: str, out: str, glob: str = "config_*.txt", week_day: int | None = None, sections=report.SECTIONS) -> None:
    """`week_day` (Monday = 0) starts the weeks of all projects instead of their own anchor; `sections`
    are those of the report."""
    prj = projects.scan_projects(spark, config_root, glob=glob).withColumn("project_id", F.col("project_key"))
    if week_day is not None:
        prj = prj.withColumn("week_anchor", F.lit(week_day))
    # months any project can use: the others are not even listed
    lo, hi = prj.agg(F.min("start_ts"), F.max("end_ts")).first()
    months = (lo.strftime("%Y-%m"), hi.strftime("%Y-%m")) if lo is not None and hi is not None else ()
    det = sinks.read_archive_table(spark, archive, *months)
    det = det.drop(sinks.MONTH, sinks.BUCKET, "origin", "ingest_seq")
    # the large filtered table and the daily maxima are written first and read back
    extra = ("vent_lat", "vent_lon", "start_ts", "end_ts", "filter_frp", "frp_mode", "filter_track", "ref_radius_m")
    base = out.rstrip("/")
    keys = [r[0] for r in prj.select("project_id").distinct().collect()]  # the catalogue of this run
    filtered = runout.filter_runout(det, prj).drop(*extra)
    sinks.write_by_month(filtered, f"{base}/filtered_detections", "obs_ts", keys)
    filtered = sinks.read_projects_table(spark, f"{base}/filtered_detections", filtered.schema, prj)
    daily = runout.daily_runout(filtered)
    sinks.write_projects_table(daily, f"{base}/daily_runout", keys)
    daily = sinks.read_projects_table(spark, f"{base}/daily_runout", daily.schema, prj)
    front = frontier.frontier(daily)
    rows = frp.frp_rows(det, prj)
    summary = frp.frp_summary(rows)
    tables = {
        "frontier": front,
        "speed_summary": frontier.speed_summary(front),
        "weekly_counts": counts.weekly_counts(det, prj),
        "monthly_counts": counts.monthly_counts(det, prj),
        "count_kpis": counts.count_kpis(det, prj),
        "frp_summary": summary,
        "frp_histogram": frp.frp_histogram(rows, summary),
        "frp_cumulative": frp.cumulative_quantiles(rows),
        "frame_counts": frames.frame_counts(filtered, prj),
        "extent": spatial.extent(filtered, prj),
    }
    tables["report"] = report.report_kpis(prj, tables["count_kpis"], runout.period_summary(filtered), tables["speed_summary"], sections)
    for name, df in tables.items():
        sinks.write_projects_table(df, f"{base}/{name}", keys)


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="hotspot", description="Hotspot detection analytics on Spark.")
    sub = ap.add_subparsers(dest="cmd", required=True)
    m = sub.add_parser("merge", help="type, clean and merge landed detection files into the archive")
    m.add_argument("--archive", required=True, help="month-partitioned Parquet archive (created on first load)")
    m.add_argument("--landing", required=True, help="folder of landed text files (searched recursively)")
    m.add_argument("--glob", default="*.csv", help="file name pattern of landed files")
    g = sub.add_parser("migrate", help="rewrite dates of a text archive to ISO, folder by folder where needed")
    g.add_argument("--landing", required=True, help="text archive in project_id=/sensor= folders")
    a = sub.add_parser("analyse", help="run every analysis for every project and write the result tables")
    a.add_argument("--archive", required=True, help="the detections archive written by merge")
    a.add_argument("--projects", required=True, help="folder holding the project config files")
    a.add_argument("--out", required=True, help="output folder; one Parquet table per result")
    a.add_argument("--glob", default="config_*.txt", help="file name pattern of config files")
    a.add_argument("--week-day", type=int, choices=range(7), metavar="0-6", help="weekday on which weeks start, Monday = 0 (default: Thursday)")
    a.add_argument("--sections", nargs="+", choices=report.SECTIONS, default=list(report.SECTIONS), help="sections of the report")
    args = ap.parse_args(argv)
    spark = _session()
    if args.cmd == "merge":
        log = merge(spark, args.archive, args.landing, args.glob)
        if log is not None:
            log.show(truncate=False)
    elif args.cmd == "migrate":
        sinks.migrate_archive(spark, args.landing).show(truncate=False)
    else:
        analyse(spark, args.archive, args.projects, args.out, args.glob, args.week_day, args.sections)


if __name__ == "__main__":
    main()
