"""End to end on real-layout inputs: text archives in project/sensor folders and project
config files -> merge into the archive -> every analysis table."""

from pyspark.sql import functions as F

from conftest import SMALL
from hotspot import cli
from hotspot.operators import counts
from hotspot.session import new_table_path
from hotspot.sources import fixtures as fx
from hotspot.sources import projects as pj
from hotspot.sources import sinks


def test_merge_then_analyse(spark):
    prj = fx.projects_li(spark, SMALL)
    keys = prj.select("project_id", pj.project_key("volcano").alias("key"))
    raw = fx.raw_li(spark, SMALL).join(keys, "project_id").drop("project_id").withColumnRenamed("key", "project_id")
    landing, archive, cfg, out = (new_table_path(spark, n) for n in ("landing", "archive", "cfg", "out"))
    raw.write.partitionBy("project_id", "sensor").option("header", True).csv(landing)
    first = cli.merge(spark, archive, landing).agg(F.sum("rows_new"), F.sum("rows_refreshed")).first()  # first load
    assert first[0] > 0 and first[1] == 0
    n_archive = sinks.read_archive_table(spark, archive).count()
    # every row except the ones with an unreadable date ('bad' layout) is archived
    assert n_archive == fx.detections_li(spark, SMALL).where(F.pmod(F.floor(F.col("detection_id") / 8), F.lit(4)) != 3).count()
    log = cli.merge(spark, archive, landing)  # the same files again: every date is refreshed
    r = log.agg(F.sum("rows_refreshed"), F.sum("rows_total")).first()
    assert (r[0], r[1]) == (n_archive, n_archive)
    assert sinks.read_archive_table(spark, archive).count() == n_archive  # idempotent

    pj.write_projects(pj.config_lines(prj), cfg)
    weeks = counts.weekly_counts(fx.detections_li(spark, SMALL), prj).withColumn("project_id", F.lit("OTHER"))
    sinks.write_projects_table(weeks.limit(1).withColumn("n_detections", F.lit(7).cast("long")), f"{out}/weekly_counts")
    cli.analyse(spark, archive, cfg, out, glob="*.txt")
    weekly = spark.read.parquet(f"{out}/weekly_counts").where("project_id <> 'OTHER'")
    readable = fx.detections_li(spark, SMALL).where(F.pmod(F.floor(F.col("detection_id") / 8), F.lit(4)) != 3)
    expected = counts.weekly_counts(readable, prj).agg(F.sum("n_detections")).first()[0]
    assert weekly.agg(F.sum("n_detections")).first()[0] == expected
    for name in ("frontier", "daily_runout", "frp_cumulative", "report", "frame_counts", "extent", "count_kpis"):
        assert spark.read.parquet(f"{out}/{name}").count() > 0, name
    kept = spark.read.parquet(f"{out}/weekly_counts").where("project_id = 'OTHER'")
    assert [r.n_detections for r in kept.collect()] == [7]  # results of a project of another root stay

    monday = new_table_path(spark, "monday")
    cli.analyse(spark, archive, cfg, monday, glob="*.txt", week_day=0, sections=("counts", "speed"))
    starts = spark.read.parquet(f"{monday}/weekly_counts").select(F.weekday("week_start")).distinct().collect()
    assert [r[0] for r in starts] == [0] and weekly.select(F.weekday("week_start")).distinct().first()[0] == 3
    assert {r[0] for r in spark.read.parquet(f"{monday}/report").select("section").distinct().collect()} == {"counts", "speed"}


def test_results_are_replaced_by_project(spark):
    path = new_table_path(spark, "results")
    save = lambda rows, projects: sinks.write_projects_table(spark.createDataFrame(rows, "project_id string, acq_month string, n long"), path, projects, ("acq_month",))
    rows = lambda: sorted((r.project_id, r.acq_month, r.n) for r in spark.read.schema("n long, project_id string, acq_month string").parquet(path).collect())
    save([("a b/c", "2024-01", 1), ("a b/c", "2024-02", 2), ("1", "2024-01", 3)], ["a b/c", "1"])
    save([("two", "2024-01", 4)], ["two"])
    assert rows() == [("1", "2024-01", 3), ("a b/c", "2024-01", 1), ("a b/c", "2024-02", 2), ("two", "2024-01", 4)]
    save([("a b/c", "2024-02", 5)], ["a b/c", "two"])  # a period has moved on; another has no rows left
    assert rows() == [("1", "2024-01", 3), ("a b/c", "2024-02", 5)]
    save([], ["a b/c"])
    assert rows() == [("1", "2024-01", 3)]
    one = spark.createDataFrame([("1",)], "project_id string")
    back = sinks.read_projects_table(spark, path, spark.createDataFrame([], "project_id string, n long").schema, one)
    assert [tuple(r) for r in back.collect()] == [("1", 3)]
