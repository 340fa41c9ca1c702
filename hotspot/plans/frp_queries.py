"""FRP statistics: Spark plans and their SQL oracles (events fixture)."""

from __future__ import annotations

from hotspot.operators import frp
from hotspot.plans.common import Registry, round6
from hotspot.plans.sql_fixtures import r6, with_fixtures
from hotspot.sources import fixtures as fx

R = Registry()
EV = ["projects_ev", "det_ev"]

FR = """fr AS (SELECT d.project_id, d.satellite, d.obs_ts, d.frp FROM det_ev d JOIN projects_ev p USING (project_id)
  WHERE d.satellite IN ('SNPP', 'NOAA20', 'NOAA21') AND d.frp IS NOT NULL AND d.obs_ts IS NOT NULL
    AND d.acq_date BETWEEN CAST(p.start_ts AS DATE) AND CAST(p.end_ts AS DATE))"""
SUMMARY = """summ AS (SELECT project_id, satellite, count(frp) AS n, min(frp) AS min, quantile_cont(frp, 0.25) AS q1,
    quantile_cont(frp, 0.5) AS median, avg(frp) AS mean, quantile_cont(frp, 0.75) AS q3, quantile_cont(frp, 0.95) AS p95,
    max(frp) AS max FROM fr GROUP BY project_id, satellite)"""
CUM = """gb AS (SELECT project_id, satellite, CAST(CAST(min(obs_ts) AS DATE) AS TIMESTAMP) AS t0,
    CAST(CAST(max(obs_ts) AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY AS t1 FROM fr GROUP BY project_id, satellite),
ticks AS (SELECT project_id, satellite, unnest(generate_series(t0, t1, INTERVAL 12 HOUR)) AS tick FROM gb),
cum AS (SELECT t.project_id, t.satellite, t.tick, count(*) AS n,
    CAST(sum(CAST(f.frp AS DECIMAL(38, 10))) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS mean, quantile_cont(f.frp, 0.25) AS q25,
    quantile_cont(f.frp, 0.5) AS median, quantile_cont(f.frp, 0.75) AS q75
  FROM ticks t JOIN fr f ON f.project_id = t.project_id AND f.satellite = t.satellite AND f.obs_ts <= t.tick
  GROUP BY t.project_id, t.satellite, t.tick)"""
CUM_SQL = with_fixtures(EV, [FR, CUM], "SELECT project_id, satellite, tick, n, " + r6("mean", "q25", "median", "q75") + " FROM cum")


def _rows(spark, sf):
    return frp.frp_rows(fx.detections_ev(spark, sf), fx.projects_ev(spark, sf))


@R.add(
    "frp_summary",
    with_fixtures(EV, [FR, SUMMARY], "SELECT project_id, satellite, n, " + r6("min", "q1", "median", "mean", "q3", "p95", "max") + " FROM summ"),
)
def q_frp_summary(spark, sf):
    return round6(frp.frp_summary(_rows(spark, sf)))


@R.add(
    "frp_overall",
    with_fixtures(EV, [FR, SUMMARY], "SELECT project_id, round(avg(mean), 6) AS mean_of_means, round(avg(q3), 6) AS mean_of_q3, "
                  "count(*) AS n_satellites FROM summ GROUP BY project_id"),
)
def q_frp_overall(spark, sf):
    return round6(frp.frp_overall(frp.frp_summary(_rows(spark, sf))))


@R.add(
    "frp_histogram",
    with_fixtures(EV, [FR, SUMMARY], """SELECT h.project_id, h.satellite, h.bin_start, h.n, round(s.p95 * 1.9, 6) AS x_limit
  FROM (SELECT project_id, satellite, CAST(floor(frp / 10.0) * 10.0 AS DOUBLE) AS bin_start, count(*) AS n FROM fr GROUP BY ALL) h
  JOIN summ s USING (project_id, satellite)"""),
)
def q_frp_histogram(spark, sf):
    rows = _rows(spark, sf)
    return round6(frp.frp_histogram(rows, frp.frp_summary(rows)))


@R.add("frp_cumulative", CUM_SQL)
def q_frp_cumulative(spark, sf):
    return round6(frp.cumulative_quantiles(_rows(spark, sf)))


@R.add("cumulative_quantiles_window", CUM_SQL)
def q_cumulative_window(spark, sf):
    return round6(frp.cumulative_quantiles_window(_rows(spark, sf)))


@R.add(
    "ticks_join",
    with_fixtures(EV, [FR, CUM], "SELECT project_id, satellite, tick, n FROM cum"),
)
def q_ticks_join(spark, sf):
    """J8 alone: detections assigned to their first tick, cumulative counts per tick."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    r, grid = frp.assign_ticks(_rows(spark, sf))
    c = r.groupBy(*frp.G, "idx").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*frp.G).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    g = grid.join(c, frp.G + ["idx"], "left").withColumn("n", F.sum(F.coalesce("c", F.lit(0))).over(w))
    return g.where(F.col("n") > 0).select(*frp.G, F.timestamp_add("HOUR", F.col("idx") * 12, F.col("d0").cast("timestamp_ntz")).alias("tick"), "n")


@R.add("cumulative_quantiles_approx", with_fixtures(EV, [FR, CUM], "SELECT project_id, satellite, tick, n, round(mean, 6) AS mean, TRUE AS within_bound FROM cum"))
def q_cumulative_approx(spark, sf):
    """Approximate (KLL) variant: n and mean exact, and every quantile's exact rank within the bound."""
    return round6(frp.certified_quantiles(_rows(spark, sf)).select(*frp.G, "tick", "n", "mean", "within_bound"))


@R.add("cumulative_quantiles", CUM_SQL)
def q_cumulative_quantiles(spark, sf):
    """W3 as its own key: the exact two-level cumulative quantiles (A8 applies it to FRP)."""
    return round6(frp.cumulative_quantiles(_rows(spark, sf)))
