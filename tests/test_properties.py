"""Properties: idempotent merge, monotone frontier, partitioning-independent results,
approximate quantiles within their error bound."""

from pyspark.sql import functions as F

from conftest import SMALL
from hotspot.operators import frontier as fr
from hotspot.operators import frp
from hotspot.operators import ingest as ing
from hotspot.operators import runout as ro
from hotspot.plans.ingest_queries import merge_inputs
from hotspot.sources import fixtures as fx


def _ids(df):
    return sorted((r["project_id"], r["detection_id"], r["ingest_seq"]) for r in df.select("project_id", "detection_id", "ingest_seq").collect())


def test_merge_is_idempotent(spark):
    hist, new = merge_inputs(spark, SMALL)
    once = ing.merge_detections(hist, new)
    again = ing.merge_detections(once.withColumn("origin", F.lit(0)), new)
    assert _ids(once) == _ids(again)


def test_merge_keeps_no_duplicate_keys(spark):
    hist, new = merge_inputs(spark, SMALL)
    m = ing.with_round_keys(ing.merge_detections(hist, new))
    assert m.groupBy(*ing.DEDUP_KEY).count().where("count > 1").count() == 0


def _daily(spark):
    return ro.daily_runout(ro.filter_runout(fx.detections_ev(spark, SMALL), fx.projects_ev(spark, SMALL)))


def test_frontier_strictly_increasing(spark):
    rows = fr.frontier(_daily(spark)).select("project_id", "date_only", "satellite", "max_distance").collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        by.setdefault(r[0], []).append(r[3])
    for seq in by.values():
        assert all(b > a for a, b in zip(seq, seq[1:]))


def test_result_independent_of_partitioning(spark):
    d = _daily(spark)
    a = sorted(tuple(r) for r in fr.frontier(d.repartition(1)).collect())
    b = sorted(tuple(r) for r in fr.frontier(d.repartition(7, "satellite")).collect())
    assert a == b


def test_approx_quantiles_within_rank_error(spark):
    rows = frp.frp_rows(fx.detections_ev(spark, SMALL), fx.projects_ev(spark, SMALL))
    approx = {(r[0], r[1], r[2]): r["q25"] for r in frp.cumulative_quantiles_approx(rows).collect()}
    exact = frp.cumulative_quantiles_window(rows, quantiles=(0.15, 0.35))
    checked = 0
    for r in exact.collect():
        a = approx[(r[0], r[1], r[2])]
        if r["n"] >= 20:
            assert r["p15"] - 1e-9 <= a <= r["p35"] + 1e-9
            checked += 1
    assert checked > 0


def test_ranks_of_given_values_match_brute_force(spark):
    """A heavy value, an outlier, ties and small groups; every answer's rank counted over all its rows."""
    import datetime as dt
    import random

    rng, t0 = random.Random(4), dt.datetime(2024, 1, 1, 0, 30)
    rows = [(1, "SNPP", t0 + dt.timedelta(minutes=rng.randrange(8000)), rng.choice([5.0, 5.0, round(rng.random() * 50, 1)])) for _ in range(2500)]
    rows += [(1, "SNPP", t0, 1e9), (2, "SNPP", t0, -3.0), (2, "NOAA20", t0, 1.0), (2, "NOAA20", t0 + dt.timedelta(days=3), 2.0)]
    df = spark.createDataFrame(rows, "project_id int, satellite string, obs_ts timestamp_ntz, frp double")
    out = frp.certified_quantiles(df).collect()
    assert {(r.project_id, r.satellite) for r in out} == {(1, "SNPP"), (2, "SNPP"), (2, "NOAA20")}
    for r in out:
        v = [x[3] for x in rows if x[:2] == (r.project_id, r.satellite) and x[2] <= r.tick]
        worst = max(max(sum(x < q for x in v) / len(v) - p, p - sum(x <= q for x in v) / len(v), 0.0) for q, p in ((r.q25, 0.25), (r.median, 0.5), (r.q75, 0.75)))
        assert r.n == len(v) and abs(r.rank_error - worst) < 1e-12 and r.within_bound == (worst <= frp.RANK_ERROR)
    assert all(r.within_bound for r in out)
    far = df.groupBy(*frp.G).agg(F.max("frp").alias("median"))  # the greatest value is no median
    ticks = spark.createDataFrame([(r.project_id, r.satellite, r.tick) for r in out if r.project_id == 1], "project_id int, satellite string, tick timestamp_ntz")
    top = frp.exact_ranks(df, ticks.join(far, frp.G), ["median"]).collect()
    assert len(top) == ticks.count() and all(r.upto - r.below == 1 and r.value == 1e9 for r in top)
    assert frp.certified_quantiles(df.limit(0)).count() == 0


def test_exact_cumulative_equals_window_form(spark):
    rows = frp.frp_rows(fx.detections_ev(spark, SMALL), fx.projects_ev(spark, SMALL))
    a = sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in frp.cumulative_quantiles(rows).collect())
    b = sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in frp.cumulative_quantiles_window(rows).collect())
    assert a == b


def test_value_ranges_hold_about_equally_many_values(spark):
    """A million distinct values, one far outlier and one value of a third of the rows."""
    from hotspot.operators import frp

    v = spark.range(1_000_000).select(F.lit(1).alias("project_id"), F.lit("SNPP").alias("satellite"), F.pow(F.col("id") / 1e6, F.lit(7)).alias("frp"), F.when(F.col("id") == 500_000, 500_000).otherwise(1).cast("long").alias("c"))
    v = v.unionByName(spark.createDataFrame([(1, "SNPP", 1e9, 1)], "project_id int, satellite string, frp double, c long"))
    vals, spans = frp.value_ranges(v, "c")
    sizes = [r["count"] for r in vals.groupBy("range").count().collect()]
    assert sum(r.n for r in spans.collect()) == 1_500_000
    assert sum(sizes) == 1_000_001 and len(sizes) > 50 and max(sizes) <= 4 * sum(sizes) / len(sizes)


def test_summary_equals_percentile_with_outliers_and_heavy_values(spark):
    from hotspot.operators import frp

    rows = spark.range(30_000).select((F.col("id") % 3).alias("project_id"), F.lit("SNPP").alias("satellite"), F.when(F.col("id") % 4 == 0, 5.25).when(F.col("id") == 7, 1e12).otherwise(F.round(F.rand(3) * 100, 2)).alias("frp"))
    rows = rows.unionByName(spark.createDataFrame([(9, "NOAA20", 3.5)], "project_id long, satellite string, frp double"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    got = {r.project_id: (r.n, r.min, r.q1, r.median, r.q3, r.p95, r.max) for r in frp.frp_summary(rows).collect()}
    want = rows.groupBy("project_id").agg(F.count("*"), F.min("frp"), *[F.percentile("frp", p) for p in (0.25, 0.5, 0.75, 0.95)], F.max("frp")).collect()
    assert len(got) == 4
    for r in want:
        assert all(abs(a - b) < 1e-9 * max(1, abs(b)) for a, b in zip(got[r[0]], r[1:]))
    counts = frp.running_counts(rows.groupBy(*frp.G, "frp").agg(F.count("*").alias("c")), "c").collect()
    by = {}
    for r in sorted(counts, key=lambda r: (r.project_id, r.frp)):
        assert r.before == by.get(r.project_id, 0)
        by[r.project_id] = r.before + r.c
