"""Fire radiative power (FRP) statistics per project and satellite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hotspot import schemas
from hotspot.functions.calendar import seconds_between
from hotspot.operators.counts import period_days
from hotspot.operators.dims import dim_join
from hotspot.session import kept

G = ["project_id", "satellite"]
QUANTILES = (0.25, 0.5, 0.75)
TICK_HOURS = 12


def frp_rows(det: DataFrame, projects: DataFrame) -> DataFrame:
    """VIIRS detections of each project's period (acq_date inclusive), no track/FRP filter;
    rows without FRP or time are left out (they carry no value to describe)."""
    p = period_days(projects).select("project_id", "start_date", "end_date")
    d = det.where(F.col("satellite").isin(schemas.VIIRS) & F.col("frp").isNotNull() & F.col("obs_ts").isNotNull())
    d = dim_join(d.select("project_id", "satellite", "acq_date", "obs_ts", "frp"), p, "project_id")
    return d.where(F.col("acq_date").between(F.col("start_date"), F.col("end_date"))).select(*G, "obs_ts", "frp")


#: Value ranges that a group's distinct values are cut into, and how exact their cut points are.
RANGES, ACCURACY = 64, 20


def value_ranges(vals: DataFrame, count: str, *stats: Column) -> tuple[DataFrame, DataFrame]:
    """`vals(group, frp, count)`, one row per distinct value, with the value's `range`, and per range its
    rows (`n`), the rows of the group below it (`base`) and the group's `total` and `stats`.

    The cut points part a group's values, however they are spread, into up to RANGES ranges of about
    equally many. They are approximate and come out a little different each time they are
    taken, so values and ranges are written once. A value is one row, so one that holds most of the rows
    weighs no more than others."""
    vals = kept(vals, "values")
    cuts = F.percentile_approx("frp", [k / RANGES for k in range(1, RANGES)], ACCURACY * RANGES)
    spans = kept(vals.groupBy(*G).agg(F.array_distinct(cuts).alias("cuts"), F.sum(count).alias("total"), *stats), "cuts")
    below = F.size(F.filter("cuts", lambda x: x < F.col("frp")))
    vals = kept(vals.join(spans.select(*G, "cuts"), G).select(*vals.columns, below.alias("range")), "ranges")
    before = Window.partitionBy(*G).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows
    at = vals.groupBy(*G, "range").agg(F.sum(count).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return vals, at.join(spans.drop("cuts"), G)


def _within(count: str) -> Column:
    """Rows of the group below the value, from those below its range."""
    w = Window.partitionBy(*G, "range").orderBy("frp").rowsBetween(Window.unboundedPreceding, -1)
    return F.col("base") + F.coalesce(F.sum(count).over(w), F.lit(0))


def running_counts(vals: DataFrame, count: str) -> DataFrame:
    """(group, frp, count) rows with `before`, the rows of the group below the value, and `total`.
    No group's distinct values meet in one task: only those of one range are put in order together."""
    names = vals.columns
    vals, ranges = value_ranges(vals, count)
    return vals.join(ranges, [*G, "range"]).select(*names, "total", _within(count).alias("before"))


def frp_summary(rows: DataFrame) -> DataFrame:
    """A5: min, quartiles, mean, p95, max (exact, linearly interpolated quantiles): the values at
    the needed ranks are those whose running count holds them. The rows are read once, and only the
    ranges that hold a needed rank are put in order."""
    ps = (0.25, 0.5, 0.75, 0.95)
    h = rows.groupBy(*G, "frp").agg(F.count(F.lit(1)).alias("c"), F.sum("frp").alias("s"))
    h, ranges = value_ranges(h, "c", F.min("frp").alias("min"), F.max("frp").alias("max"), (F.sum("s") / F.sum("c")).alias("mean"))
    pos = [(F.col("total") - 1) * F.lit(p) for p in ps]
    ranks = F.array(*[f(x).cast("long") for x in pos for f in (F.floor, F.ceil)])
    ranges = ranges.where(F.exists(ranks, lambda k: (k >= F.col("base")) & (k < F.col("base") + F.col("n"))))
    v = h.join(ranges, [*G, "range"]).select(*G, "frp", "c", "total", "min", "max", "mean", _within("c").alias("before"))
    holds = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("c")), F.col("frp")))
    a = v.groupBy(*G).agg(
        *[F.first(c).alias(c) for c in ("total", "min", "max", "mean")],
        *[holds(f(x)).alias(f"{side}{k}") for k, x in enumerate(pos) for side, f in (("lo", F.floor), ("hi", F.ceil))],
    )
    q = [F.col(f"lo{k}") + (F.col(f"hi{k}") - F.col(f"lo{k}")) * (x - F.floor(x)) for k, x in enumerate(pos)]
    return a.select(*G, F.col("total").alias("n"), "min", q[0].alias("q1"), q[1].alias("median"), "mean", q[2].alias("q3"), q[3].alias("p95"), "max")


def frp_overall(summary: DataFrame) -> DataFrame:
    """Unweighted mean over satellites (with data) of the mean and of Q3."""
    return summary.groupBy("project_id").agg(
        F.avg("mean").alias("mean_of_means"), F.avg("q3").alias("mean_of_q3"), F.count(F.lit(1)).alias("n_satellites")
    )


def frp_histogram(rows: DataFrame, summary: DataFrame, width: float = 10.0) -> DataFrame:
    """Counts per FRP bin of `width` MW anchored at 0, with the display limit 1.9 x p95."""
    b = rows.groupBy(*G, (F.floor(F.col("frp") / width) * width).cast("double").alias("bin_start")).agg(
        F.count(F.lit(1)).alias("n")
    )
    lim = summary.select(*G, (F.col("p95") * 1.9).alias("x_limit"))
    return b.join(lim, G)


# ---- cumulative statistics every 12 h ---------------------------------------------------


def assign_ticks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Give each row its first tick (the next 12-h mark at or after it) and build the
    per-group tick grid: from the first midnight to the midnight after the last row,
    starting at the first tick that has rows. Returns (rows with idx, grid(g, idx, t0))."""
    bounds = rows.groupBy(*G).agg(
        F.to_date(F.min("obs_ts")).alias("d0"), F.to_date(F.max("obs_ts")).alias("d1")
    )
    # one row per (project, satellite); a plain join: once the aggregate has run, AQE sees
    # its real size and broadcasts it (or keeps the shuffle join if it is large)
    r = rows.join(bounds, G)
    t0 = F.col("d0").cast("timestamp_ntz")
    secs = seconds_between(t0, F.col("obs_ts"))
    r = r.withColumn("idx", F.ceil(secs / float(TICK_HOURS * 3600)).cast("int"))
    first = r.groupBy(*G).agg(F.min("idx").alias("i0"))
    grid = bounds.join(first, G).select(
        *G, "d0", F.explode(F.sequence(F.col("i0"), ((F.datediff("d1", "d0") + 1) * (24 // TICK_HOURS)).cast("int"))).alias("idx")
    )
    return r.select(*G, "idx", "frp"), grid


def _tick_ts(d0="d0", idx="idx"):
    return F.timestamp_add("HOUR", F.col(idx) * TICK_HOURS, F.col(d0).cast("timestamp_ntz"))


EXACT = "decimal(38,10)"


def exact_mean(total, n):
    """Mean from an exact decimal sum: independent of summation order and partitioning."""
    return total.cast("double") / n.cast("double")


def _running_mean(r: DataFrame, grid: DataFrame) -> DataFrame:
    per_tick = r.groupBy(*G, "idx").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("frp").cast(EXACT)).alias("s"))
    w = Window.partitionBy(*G).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    g = grid.join(per_tick, G + ["idx"], "left")
    n = F.sum(F.coalesce("c", F.lit(0))).over(w)
    s = F.sum("s").over(w)
    return g.select(*G, "d0", "idx", n.alias("n"), exact_mean(s, n).alias("mean"))


def _epoch_ticks(rows: DataFrame) -> DataFrame:
    """Tick index of every row counted from the epoch: tick k is the instant k x 12 h, and
    a row belongs to the first tick at or after it. Ticks fall on midnight and noon, so
    they coincide with the source's grid starting at the first midnight."""
    secs = seconds_between(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("obs_ts"))
    return rows.withColumn("idx", F.ceil(secs / float(TICK_HOURS * 3600)).cast("long"))


def _epoch_tick_ts(idx="idx"):
    return F.timestamp_add("HOUR", F.col(idx) * TICK_HOURS, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def _tick_buckets(rows: DataFrame, min_bucket: int = 16) -> tuple[DataFrame, DataFrame]:
    """Steps 1-3 of W3: the (tick, value) counts with each value's bucket, and per tick and bucket that
    has rows by then their number (`ct`), that of all buckets up to it (`cle`), of all (`n`), and the sum."""
    r = _epoch_ticks(rows)
    # the compressed table is used in several places: the rows are read once
    h = kept(r.groupBy(*G, "idx", "frp").agg(F.count(F.lit(1)).alias("c"), F.max(F.to_date("obs_ts")).alias("dmax")), "tick-values")
    # grid bounds from the compressed table (no second pass over the rows)
    bounds = h.groupBy(*G).agg(F.min("idx").alias("i0"), F.max("dmax").alias("d1"))
    last = ((F.unix_date("d1") + 1) * (24 // TICK_HOURS)).cast("long")
    grid = bounds.select(*G, F.explode(F.sequence(F.col("i0"), last)).alias("idx"))
    h = h.drop("dmax")
    vals = h.groupBy(*G, "frp").agg(F.sum("c").alias("nv"))
    size = F.greatest(F.lit(min_bucket), F.ceil(F.sqrt(F.col("total") / 6.0))).cast("long")
    vals = running_counts(vals, "nv").select(*G, "frp", F.floor(F.col("before") / size).cast("int").alias("bucket"))
    hb = h.join(vals, G + ["frp"])
    nb = vals.groupBy(*G).agg((F.max("bucket") + 1).alias("nb"))
    bt = hb.groupBy(*G, "idx", "bucket").agg(
        F.sum("c").alias("c"), F.sum(F.col("frp").cast(EXACT) * F.col("c")).alias("s")
    )

    dense = grid.join(nb, G).select(*G, "idx", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("bucket"))
    dense = dense.join(bt, G + ["idx", "bucket"], "left")
    w_t = Window.partitionBy(*G, "bucket").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    dense = dense.select(*G, "idx", "bucket", F.sum(F.coalesce("c", F.lit(0))).over(w_t).alias("ct"),
                         F.sum("s").over(w_t).alias("cs"))
    by_tick = Window.partitionBy(*G, "idx")
    w_b = by_tick.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    dense = dense.select(
        "*", F.sum("ct").over(w_b).alias("cle"), F.sum("ct").over(by_tick).alias("n"), F.sum("cs").over(by_tick).alias("total")
    ).where(F.col("ct") > 0)
    return hb, dense


def cumulative_quantiles(rows: DataFrame, quantiles=QUANTILES, min_bucket: int = 16) -> DataFrame:
    """W3 (A8): exact expanding count, mean and quantiles at every 12-h tick, by two-level
    rank selection — no per-tick re-scan of the rows and no group gathered into one task.

    1. rows -> (group, tick, value) counts (map-side combine; a hot value or group shrinks
       to at most one entry per tick);
    2. the distinct values of a group are cut into value buckets of about sqrt(N/6) rows by
       their cumulative count (each value in exactly one bucket), which is itself two-level;
    3. a dense (tick x bucket) grid of counts and exact sums — bounded by calendar x buckets,
       not by rows — gets running sums over ticks, then over buckets: each grid row knows
       the ranks it holds at its tick, so the bucket of every needed rank is found without
       any join or per-row array scan;
    4. only that bucket's entries up to the tick are ranked to pick the value; the two
       neighbouring ranks are interpolated linearly (same rule as pandas / percentile).
    Work per group ~ ticks x sqrt(N) instead of ticks x N.
    """
    hb, dense = _tick_buckets(rows, min_bucket)
    ranks = []
    for qi, p in enumerate(quantiles):
        pos = (F.col("n") - 1) * F.lit(float(p))
        for side, rk in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            rk = rk.cast("long")
            hit = (F.col("cle") - F.col("ct") <= rk) & (rk < F.col("cle"))
            ranks.append(F.struct(F.lit(qi).alias("qi"), F.lit(side).alias("side"), (rk - F.col("cle") + F.col("ct")).alias("r_in"),
                                  (pos - F.floor(pos)).alias("frac"), hit.alias("hit")))
    q = dense.select(*G, "idx", "bucket", "n", exact_mean(F.col("total"), F.col("n")).alias("mean"),
                     F.explode(F.array(*ranks)).alias("k")).where(F.col("k.hit"))
    q = q.select(*G, "idx", "bucket", "n", "mean", "k.qi", "k.side", "k.r_in", "k.frac")

    qk = G + ["idx", "qi", "side"]
    cand = q.join(hb.select(*G, "bucket", F.col("idx").alias("eidx"), "frp", "c"), G + ["bucket"])
    cand = cand.where(F.col("eidx") <= F.col("idx"))
    # running count in value order (equal values are adjacent, so the first entry whose
    # running count passes the rank carries the value of that rank)
    run = F.sum("c").over(Window.partitionBy(*qk).orderBy("frp", "eidx").rowsBetween(Window.unboundedPreceding, 0))
    picked = cand.withColumn("run", run).where(F.col("run") > F.col("r_in")).groupBy(*qk, "frac", "n", "mean").agg(
        F.min("frp").alias("v")
    )
    names = _qnames(quantiles)
    aggs = [F.max("n").alias("n"), F.max("mean").alias("mean")]
    for i, nm in enumerate(names):
        lo = F.max(F.when((F.col("qi") == i) & (F.col("side") == "lo"), F.col("v")))
        hi = F.max(F.when((F.col("qi") == i) & (F.col("side") == "hi"), F.col("v")))
        fr = F.max(F.when(F.col("qi") == i, F.col("frac")))
        aggs.append((lo + (hi - lo) * fr).alias(nm))
    out = picked.groupBy(*G, "idx").agg(*aggs)
    return out.select(*G, _epoch_tick_ts().alias("tick"), "n", "mean", *names)


def _qnames(quantiles) -> list[str]:
    named = {0.25: "q25", 0.5: "median", 0.75: "q75"}
    return [named.get(p, f"p{int(round(p * 100))}") for p in quantiles]


def cumulative_quantiles_window(rows: DataFrame, quantiles=QUANTILES) -> DataFrame:
    """The same result as a growing-window percentile (rows and empty tick rows in one
    window per group). Simple, but each group is one window partition: small groups only."""
    r, grid = assign_ticks(rows)
    g = grid.select(*G, "d0", "idx", F.lit(None).cast("double").alias("frp"), F.lit(1).alias("is_tick"))
    d0 = grid.select(*G, "d0").distinct()
    rr = r.join(d0, G).select(*G, "d0", "idx", "frp", F.lit(0).alias("is_tick"))
    u = g.unionByName(rr)
    w = Window.partitionBy(*G).orderBy("idx").rangeBetween(Window.unboundedPreceding, 0)
    names = _qnames(quantiles)
    u = u.select(
        *G, "d0", "idx", "is_tick",
        F.count("frp").over(w).alias("n"), exact_mean(F.sum(F.col("frp").cast(EXACT)).over(w), F.count("frp").over(w)).alias("mean"),
        F.percentile("frp", list(quantiles)).over(w).alias("q"),
    )
    u = u.where((F.col("is_tick") == 1) & (F.col("n") > 0))
    return u.select(*G, _tick_ts().alias("tick"), "n", "mean", *[F.col("q")[i].alias(nm) for i, nm in enumerate(names)])


#: Size parameter of the sketches, and the rank error (share of the rows) that their answers are held to:
#: 15 standard errors of a sketch of this size.
SKETCH_K, RANK_ERROR = 800, 0.02


def cumulative_quantiles_approx(rows: DataFrame, quantiles=QUANTILES, k: int = SKETCH_K) -> DataFrame:
    """Approximate quantiles from KLL sketches — one sketch per tick, merged as a
    running window aggregate. Exact n and mean; quantiles within the sketch's rank error.
    Sketches are random: `certified_quantiles` measures the error of the answers given."""
    r, grid = assign_ticks(rows)
    per_tick = r.groupBy(*G, "idx").agg(F.expr(f"kll_sketch_agg_double(frp, {int(k)})").alias("sk"))
    g = grid.join(per_tick, G + ["idx"], "left")
    w = Window.partitionBy(*G).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("msk", F.expr("kll_merge_agg_double(sk)").over(w))
    mean = _running_mean(r, grid)
    g = g.join(mean.select(*G, "idx", "n", "mean"), G + ["idx"]).where(F.col("n") > 0)
    names = _qnames(quantiles)
    qs = [F.expr(f"kll_sketch_get_quantile_double(msk, {float(p)})").alias(nm) for p, nm in zip(quantiles, names)]
    return g.select(*G, _tick_ts().alias("tick"), "n", "mean", *qs)


def exact_ranks(rows: DataFrame, answers: DataFrame, names: list[str]) -> DataFrame:
    """For values given per tick (`answers(group, tick, *names)`, each a value that the group has by then):
    `(group, tick, name, value, below, upto)`, the rows by that tick with a lesser value, and with one not
    greater. Buckets below the value's own are counted whole, as in W3; only its own bucket is read."""
    hb, dense = _tick_buckets(rows)
    idx = seconds_between(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("tick")) / (TICK_HOURS * 3600)
    a = answers.withColumn("idx", idx.cast("long")).unpivot([*G, "tick", "idx"], names, "name", "value")
    buckets = hb.select(*G, F.col("frp").alias("value"), "bucket").distinct()
    a = a.join(buckets, [*G, "value"], "left").join(dense.select(*G, "idx", "bucket", (F.col("cle") - F.col("ct")).alias("base")), [*G, "idx", "bucket"], "left")
    entries = hb.select(*G, "bucket", F.col("idx").alias("eidx"), "frp", "c")
    near = a.join(entries, [*G, "bucket"], "left").where(F.col("eidx").isNull() | (F.col("eidx") <= F.col("idx")))
    count = lambda hit: F.max("base") + F.sum(F.when(hit, F.col("c")).otherwise(0))
    return near.groupBy(*G, "tick", "name", "value").agg(count(F.col("frp") < F.col("value")).alias("below"), count(F.col("frp") <= F.col("value")).alias("upto"))


def certified_quantiles(rows: DataFrame, quantiles=QUANTILES, k: int = SKETCH_K, error: float = RANK_ERROR) -> DataFrame:
    """W3b with proof: the approximate quantiles of every tick, the greatest distance of their exact ranks
    from the ranks asked for (`rank_error`, as a share of the rows; 0 where the value covers its rank)
    and whether it is within `error` (`within_bound`). The answers are written once, as sketches
    are random, so those checked are those returned."""
    names = _qnames(quantiles)
    approx = kept(cumulative_quantiles_approx(rows, quantiles, k), "sketched")
    ranks = exact_ranks(rows, approx, names)
    share = F.element_at(F.create_map(*[F.lit(x) for nm, p in zip(names, quantiles) for x in (nm, float(p))]), F.col("name"))
    ranks = ranks.join(approx.select(*G, "tick", "n"), [*G, "tick"])
    off = F.greatest(F.col("below") / F.col("n") - share, share - F.col("upto") / F.col("n"), F.lit(0.0))
    # a value that the group does not hold has no rank, and its tick no bound
    worst = ranks.groupBy(*G, "tick").agg(F.when(F.count("upto") == len(names), F.max(off)).alias("rank_error"))
    return approx.join(worst, [*G, "tick"], "left").withColumn("within_bound", F.coalesce(F.col("rank_error") <= error, F.lit(False)))
