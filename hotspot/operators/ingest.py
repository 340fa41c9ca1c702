"""Merging new detection batches into the archive (refresh, union, de-duplication)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotspot import schemas
from hotspot.functions.clean import build_obs_ts, is_iso_text, iso_date, parse_date, round_key

DET_COLS = [f.name for f in schemas.DETECTIONS.fields]
REFRESH_KEY = ["project_id", "sensor", "acq_date"]
DEDUP_KEY = ["project_id", "sensor", "lat_r", "lon_r", "acq_date", "acq_time"]


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Concatenate by column name (missing columns become NULL)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_dates(batch: DataFrame) -> DataFrame:
    """The (project, sensor, date) triples a batch delivers."""
    return batch.select(*REFRESH_KEY).where(F.col("acq_date").isNotNull()).distinct()


def refresh_anti(history: DataFrame, batch: DataFrame) -> DataFrame:
    """History rows whose (project, sensor, date) the batch re-delivers are dropped.
    A left-anti join (no NOT IN null trap); the date set is small and is joined by hash.

    Where both sides carry `delivery`, rows of the delivery that the batch goes on with stay:
    one response split over several batches does not refresh itself away."""
    kept = history.join(distinct_dates(batch), REFRESH_KEY, "left_anti")
    if "delivery" not in history.columns or "delivery" not in batch.columns:
        return kept
    key = [*REFRESH_KEY, "delivery"]
    return kept.unionByName(history.join(batch.select(*key).where("delivery is not null").distinct(), key, "left_semi"))


def drop_incomplete(df: DataFrame) -> DataFrame:
    """rows without a position or a date cannot be placed and are dropped."""
    return df.dropna(subset=["latitude", "longitude", "acq_date"])


def dedup_first(df: DataFrame, key=DEDUP_KEY, order=("origin", "ingest_seq")) -> DataFrame:
    """One row per key, the one lowest in `order` (history before new, then arrival).
    Written as a min_by aggregate, so a key with a huge group of copies is pre-reduced
    map-side instead of being sorted in a single task. The default order is packed into one
    long, as in the merge, and each column picked by it: a hash aggregate, of the columns in use."""
    cols = [c for c in df.columns if c not in key]
    first, then = order
    if (first, then) == ("origin", "ingest_seq"):
        by = F.shiftleft(F.col(first).cast("long"), SEQ_BITS) + F.col(then)
        return df.withColumn("_ord", by).groupBy(*key).agg(*[F.min_by(c, "_ord").alias(c) for c in cols])
    best = F.min_by(F.struct(*cols), F.struct(*order))
    return df.groupBy(*key).agg(best.alias("r")).select(*key, "r.*")


def with_round_keys(df: DataFrame) -> DataFrame:
    """4-decimal half-even position keys (matching numpy rounding)."""
    return df.withColumn("lat_r", round_key("latitude")).withColumn("lon_r", round_key("longitude"))


SEQ_BITS = 62  # ingest_seq must lie in [0, 2^62)


def merge_tagged(history: DataFrame, batch: DataFrame) -> DataFrame:
    """The merge in one pass over both inputs: per de-duplication key its first row that stays, and
    how many rows of it were new (`n_new`), refreshed away (`n_refreshed`) and complete among
    those that stay (`n_kept`; 0: no row is left).

    It is one hash aggregate: (origin, ingest_seq) is packed into one long and every kept value is
    a primitive `min_by` on it. Rows of copies are reduced map-side."""
    sides = [_staying(history, batch).withColumn("_new", F.lit(False)), batch.withColumns({"_stays": F.lit(True), "_new": F.lit(True)})]
    u = with_round_keys(union_all(sides))
    complete = F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & F.col("acq_date").isNotNull()
    u = u.withColumn("_kept", F.col("_stays") & complete)
    order = F.shiftleft(F.col("origin").cast("long"), SEQ_BITS) + F.col("ingest_seq")
    u = u.withColumn("_ord", F.when(F.col("_kept"), order))  # others are passed over by min_by
    vals = ["detection_id", "frp", "track", "latitude", "longitude", "origin", "ingest_seq"]
    # whatever else the files carried (brightness, confidence, ...) goes along
    vals += [c for c in u.columns if c not in {*DET_COLS, *DEDUP_KEY, *vals, "_ord", "_kept", "_stays", "_new"}]
    counts = {"n_new": F.col("_new"), "n_refreshed": ~F.col("_stays"), "n_kept": F.col("_kept")}
    return u.groupBy(*DEDUP_KEY).agg(*[F.min_by(c, "_ord").alias(c) for c in vals], *[F.count_if(x).alias(n) for n, x in counts.items()])


def _staying(history: DataFrame, batch: DataFrame) -> DataFrame:
    """J5 as a flag: `_stays` is false for history rows whose date the batch delivers again, unless it
    goes on with their delivery (see `refresh_anti`). The date sets are small: plain hash joins."""
    out = history.join(distinct_dates(batch).withColumn("_again", F.lit(True)), REFRESH_KEY, "left")
    again = F.coalesce("_again", F.lit(False))
    if "delivery" in history.columns and "delivery" in batch.columns:
        key = [*REFRESH_KEY, "delivery"]
        out = out.join(batch.select(*key).where("delivery is not null").distinct().withColumn("_goes_on", F.lit(True)), key, "left")
        again = again & ~F.coalesce("_goes_on", F.lit(False))
    return out.withColumn("_stays", ~again).drop("_again", "_goes_on")


def merged_rows(tagged: DataFrame) -> DataFrame:
    """The rows that a merge leaves; the columns that follow from the key (satellite, source id,
    observation time) are attached again."""
    sens = F.broadcast(schemas.sensors(tagged.sparkSession).select("sensor", "satellite", "source_id"))  # fixed 4 rows
    d = tagged.where("n_kept > 0").join(sens, "sensor").withColumn("obs_ts", build_obs_ts("acq_date", "acq_time"))
    more = [c for c in tagged.columns if c not in {*DET_COLS, *DEDUP_KEY, "origin", "ingest_seq", "n_new", "n_refreshed", "n_kept"}]
    return d.select(*DET_COLS, "origin", "ingest_seq", *more)


def merge_detections(history: DataFrame, batch: DataFrame) -> DataFrame:
    """U4: refresh the batch's dates, union, drop incomplete rows, de-duplicate on
    (project, sensor, 4-dp position, date, time) keeping the first by (origin, ingest_seq).
    Inputs carry `origin` (0 history, 1 new) and `ingest_seq` in [0, 2^62); the result is
    idempotent: merging the same batch again yields the same table."""
    return merged_rows(merge_tagged(history, batch))


def merge_log(tagged: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Per project and sensor — new rows delivered, history rows refreshed away,
    duplicates removed, total after the merge. It reads only what the merging pass has counted; `totals`
    (project_id as text, sensor, rows_total) are those of a table of which the merge saw a part."""
    k = ["project_id", "sensor"]
    total = F.sum("n_kept")
    left = F.count_if(F.col("n_kept") > 0)
    log = tagged.groupBy(*k).agg(F.sum("n_new").alias("rows_new"), F.sum("n_refreshed").alias("rows_refreshed"), (total - left).alias("duplicates_removed"), left.alias("rows_total"))
    if totals is None:
        return log
    t = totals.withColumnsRenamed({"project_id": "_project", "sensor": "_sensor", "rows_total": "_total"})
    same = F.col("project_id").cast("string").eqNullSafe(F.col("_project")) & F.col("sensor").eqNullSafe(F.col("_sensor"))
    return log.join(t, same, "left").select(*k, "rows_new", "rows_refreshed", "duplicates_removed", F.coalesce("_total", F.lit(0)).alias("rows_total"))


def migrate_dates(raw: DataFrame) -> DataFrame:
    """Rewrite acq_date text to ISO; ISO and unparseable text stay as they are, so the
    operation is idempotent."""
    parsed = iso_date(parse_date("acq_date"))
    keep = is_iso_text("acq_date")
    return raw.withColumn("acq_date", F.when(keep, F.col("acq_date")).otherwise(F.coalesce(parsed, F.col("acq_date"))))


def sort_archive(df: DataFrame) -> DataFrame:
    """O2: newest first inside each output partition (no global sort/shuffle)."""
    return df.sortWithinPartitions(F.col("acq_date").desc(), F.col("acq_time").desc())
