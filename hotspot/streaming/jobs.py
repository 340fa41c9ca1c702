"""Structured Streaming: incremental ingest, de-duplication, merge, weekly counts, frontier.

Every job reads a file landing area (new files = new data), keeps its progress in a
checkpoint in the shared folder and can be re-run with trigger(availableNow) to catch up:
a restarted job resumes from the checkpoint. No job drops rows for coming late, and every step
gives the same tables when a batch is applied again. What earlier batches have brought is known
from a ledger of files (T1), from the state store (T4, T5) or from the touched partitions of the
kept table (T2, T3).
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hotspot import schemas
from hotspot.functions.calendar import seconds_between
from hotspot.functions.clean import round_key
from hotspot.session import cut_lineage
from hotspot.sources import detections as sd
from hotspot.sources import sinks
from hotspot.streaming.frontier_state import OUT, FrontierState

EPOCH = "1970-01-01 00:00:00"


def event_time(ntz_col: str = "obs_ts"):
    """TIMESTAMP_NTZ wall clock -> TIMESTAMP at the same UTC instant (windows need TIMESTAMP);
    independent of the session time zone."""
    return F.timestamp_seconds(seconds_between(F.lit(EPOCH).cast("timestamp_ntz"), F.col(ntz_col)))


def _run(writer) -> None:
    """Until all landed files are processed, however long that takes; a failure is raised."""
    writer.trigger(availableNow=True).start().awaitTermination()


# ---- T1 ------------------------------------------------------------------------------

#: Files of one micro-batch of a text ingest: a backlog of any size comes in batches of at most as many.
MAX_FILES = 10_000
#: Parts of the ledger of ingested files; a batch reads only those that its files' names hash to.
LEDGER_SLOTS = 64
_FILES = "path string, modificationTime timestamp, length long, content binary"
_LEDGER = "path string, length long, modified timestamp, batch string, slot int"
_FILE_KEY = ["path", "length", "modified"]


def ledger_of(out: str) -> str:
    return out.rstrip("/") + "_files"


def _ledger(spark: SparkSession, out: str, slots: list[int] | None = None) -> DataFrame | None:
    old = sinks.read_if_exists(spark, ledger_of(out))
    if old is None:
        return None
    old = spark.read.schema(_LEDGER).parquet(ledger_of(out))  # an append-only table of one row per file and delivery
    return old if slots is None else old.where(F.col("slot").isin(slots))


def ingested(spark: SparkSession, out: str) -> DataFrame:
    """The rows of an ingested table: those of the newest delivery of each file, each once."""
    rows, seen = spark.read.parquet(out), _ledger(spark, out)
    if seen is None:
        return rows.limit(0)
    # of a file that two streams have brought at a time, the delivery of the first name counts
    last = seen.groupBy("path").agg(F.max_by("batch", F.struct("modified", "batch")).alias("batch"))
    return rows.join(last.withColumnRenamed("path", "_path"), ["_path", "batch"], "left_semi").select(*rows.columns)


def stream_ingest(spark: SparkSession, landing: str, out: str, checkpoint: str, project_type: str = "string", carry: bool = False, max_files: int = MAX_FILES, max_bytes: int | None = None) -> None:
    """Text files landing in project_id=/sensor= folders -> typed, cleaned detections in a
    Parquet table by micro-batch (same cleaning as the batch reader). Columns are read by name:
    each batch's files are grouped by their header lines. A batch takes at most `max_files` files,
    or about `max_bytes` bytes of them where that is given.

    The stream itself lists files and does not read them. A ledger beside the table (`<out>_files`:
    path, length, modification time, batch) says which have been brought, so no batch reads the
    table: files that any stream has brought are passed over, also after a lost checkpoint. The file
    source knows files by name alone; those replaced under an old name are found by the ledger when a
    run begins, and taken again. A part (`batch`: the checkpoint's own id and the batch number,
    replaced when it is applied again) is written before the ledger names it; `ingested` reads the
    parts that the ledger names, each file's newest delivery."""

    def bring(s: SparkSession, rows: list, part: str) -> None:
        clean = sd.clean_detections(sd.read_by_name(s, [r.at for r in rows]), s, project_type=project_type, carry=carry, keep=("_path",))
        clean.withColumn("batch", F.lit(part)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)
        known = s.createDataFrame([(r.path, r.length, r.modified, part, r.slot) for r in rows], _LEDGER)
        known.coalesce(1).write.mode("append").partitionBy("slot").parquet(ledger_of(out))

    def apply(new: DataFrame, batch_id: int) -> None:
        s, new = new.sparkSession, _listed(new, "name")
        found = new.collect()  # of one batch
        seen = _ledger(s, out, sorted({r.slot for r in found})) if found else None
        if seen is not None:
            found = s.createDataFrame(found, new.schema).join(seen, _FILE_KEY, "left_anti").collect()
        if found:
            bring(s, found, f"{json.loads(s.read.text(f'{checkpoint}/metadata').first()[0])['id']}-{batch_id}")

    def again() -> None:
        now = _listed(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(landing), "_metadata.file_path")
        while (seen := _ledger(spark, out)) is not None:
            found = now.join(seen, "path", "left_semi").join(seen, _FILE_KEY, "left_anti").orderBy("path").limit(max_files).collect()
            if not found:
                return
            bring(spark, found, "again-" + hashlib.sha256(repr([(r.path, r.length, r.modified) for r in found]).encode()).hexdigest()[:32])

    again()
    src = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", True)
    src = src.option("maxBytesPerTrigger", max_bytes) if max_bytes else src.option("maxFilesPerTrigger", max_files)
    files = src.load(landing).select("path", "length", "modificationTime", F.col("_metadata.file_path").alias("name"))  # the content is not read
    _run(files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint))


def _listed(files: DataFrame, name: str) -> DataFrame:
    """Files by the name that their rows carry (signs such as blanks are coded in it), and where to read them."""
    files = files.select(F.col("path").alias("at"), F.col(name).alias("path"), "length", F.col("modificationTime").alias("modified"))
    return files.withColumn("slot", F.pmod(F.xxhash64("path"), F.lit(LEDGER_SLOTS)).cast("int"))


# ---- T2 ------------------------------------------------------------------------------

DEDUP_KEY = ["project_id", "sensor", "lat_r", "lon_r", "acq_date", "acq_time"]


def stream_dedup(spark: SparkSession, landing: str, out: str, checkpoint: str) -> None:
    """Each detection (project, sensor, 4-dp position, date, time) is kept once: the first of
    its batch in (observation time, id, latitude, longitude) order, unless an earlier batch has
    brought it. The table is partitioned by month, and only the months of a batch are compared
    with it, so nothing is forgotten and nothing is dropped for coming late."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        s = batch.sparkSession
        d = batch.withColumn("lat_r", round_key("latitude")).withColumn("lon_r", round_key("longitude"))
        rest = [c for c in d.columns if c not in DEDUP_KEY]
        first = F.min_by(F.struct(*rest), F.struct("obs_ts", "detection_id", "latitude", "longitude"))
        d = d.groupBy(*DEDUP_KEY).agg(first.alias("r")).select(*DEDUP_KEY, "r.*").withColumn(sinks.MONTH, F.date_format("acq_date", "yyyy-MM"))
        old = sinks.read_if_exists(s, out)
        if old is not None:
            months = [r[0] for r in d.select(sinks.MONTH).distinct().collect()]  # of one batch
            known = old.where(F.col(sinks.MONTH).isin(months)).select(*DEDUP_KEY)
            same = [d[c].eqNullSafe(known[c]) for c in DEDUP_KEY]
            d = d.join(known, same, "left_anti")
        cut_lineage(d).write.mode("append").partitionBy(sinks.MONTH).parquet(out)

    _run(spark.readStream.schema(schemas.DETECTIONS).parquet(landing).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint))


# ---- T3 ------------------------------------------------------------------------------

MERGE_INPUT = T.StructType(schemas.DETECTIONS.fields + [T.StructField("ingest_seq", T.LongType()), T.StructField("delivery", T.StringType())])


def merge_batch(spark: SparkSession, archive: str, batch: DataFrame, delivery: str) -> bool:
    """Merge one micro-batch into the archive; returns whether it had rows. A batch applied again
    gives the same archive. Rows without a `delivery` belong to the given one."""
    if batch.isEmpty():
        return False
    own = F.coalesce("delivery", F.lit(delivery)) if "delivery" in batch.columns else F.lit(delivery)
    sinks.merge_into_archive(spark, archive, batch.withColumn("delivery", own).withColumn("origin", F.lit(1)))
    return True


def stream_merge(spark: SparkSession, landing: str, archive: str, checkpoint: str) -> None:
    """Every micro-batch is merged into the archive (refresh the batch's dates, de-duplicate,
    rewrite only touched partitions); the first one makes the archive. What lands later replaces its
    dates, as every fetch does; only a response that names its `delivery` may be split over batches:
    rows of one delivery never refresh each other away. Files that name none are one delivery with
    the others of their batch."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        merge_batch(s, archive, batch, f"{json.loads(s.read.text(f'{checkpoint}/metadata').first()[0])['id']}-{batch_id}")

    src = spark.readStream.schema(MERGE_INPUT).parquet(landing)
    _run(src.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint))


# ---- T4 ------------------------------------------------------------------------------

WEEK_KEY = ["project_id", "week_start", "satellite"]


def upsert_weeks(spark: SparkSession, out: str, changed: DataFrame, stream: str) -> None:
    """Replace one stream's changed (project, week, satellite) counts. The table is partitioned by
    stream and month; only the touched months of this stream are read and rewritten (dynamic partition
    overwrite), from a checkpoint, so the write never reads the files it replaces. The
    table is aggregated (projects x sensors x weeks), so one file per month is enough."""
    changed = changed.select(*WEEK_KEY, "n_detections").withColumns({"stream": F.lit(stream), "month": F.date_format("week_start", "yyyy-MM")})
    months = [r[0] for r in changed.select("month").distinct().collect()]  # months open in one batch
    old = sinks.read_if_exists(spark, out)
    if old is not None:
        old = old.where((F.col("stream") == stream) & F.col("month").isin(months)).select(*changed.columns)
        changed = old.join(changed.select(*WEEK_KEY), WEEK_KEY, "left_anti").unionByName(changed)
    merged = cut_lineage(changed)
    merged.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stream", "month").parquet(out)


def read_weeks(spark: SparkSession, out: str) -> DataFrame:
    """Detections per (project, week, satellite) over all streams that write to the table."""
    return spark.read.parquet(out).groupBy(*WEEK_KEY).agg(F.sum("n_detections").alias("n_detections"))


def stream_weekly(spark: SparkSession, landing: str, out: str, checkpoint: str, anchor: int = 3) -> None:
    """T4: detections per (project, anchored week, satellite) as tumbling 7-day windows.
    1970-01-01 was a Thursday, so a week starting on weekday `anchor` (Monday = 0) is a
    window offset of (anchor - 3) mod 7 days. The state holds one count per project, week and
    satellite, which the calendar bounds, and no watermark: a detection of any age is counted.
    Each micro-batch upserts the counts it changed (update mode).

    The table holds a part per stream, and `read_weeks` adds them up. A stream is known by its
    landing folder: two of them count both, and one that begins anew without its checkpoint counts its
    files again from nothing, in the place of its old part (while it catches up, with fewer)."""
    offset = (anchor - 3) % 7
    stream = hashlib.sha256(landing.rstrip("/").encode()).hexdigest()[:16]
    df = spark.readStream.schema(schemas.DETECTIONS).parquet(landing).withColumn("event_ts", event_time())
    w = F.window("event_ts", "7 days", "7 days", f"{offset} days")
    agg = df.groupBy("project_id", w.alias("w"), "satellite").agg(F.count(F.lit(1)).alias("n_detections"))

    def publish(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        start = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds(F.col("w.start")) / 86400).cast("int"))
        changed = batch.select("project_id", start.alias("week_start"), "satellite", "n_detections")
        upsert_weeks(batch.sparkSession, out, changed, stream)

    _run(agg.writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", checkpoint))


# ---- T5 ------------------------------------------------------------------------------

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_frontier(spark: SparkSession, landing: str, out: str, checkpoint: str) -> None:
    """T5: the frontier kept incrementally, by project in the RocksDB state store (`FrontierState`): the
    daily maxima and the frontier itself. A day may come in any order; only the days from it on are
    replayed, and no table is read. What comes out is the frontier of each project that a batch
    has changed, which replaces that project's rows. A day that is delivered again counts once, by its
    largest distance; a row without a date is left out."""
    schema = T.StructType([T.StructField("project_id", T.LongType()), *schemas.DAILY_RUNOUT.fields])
    days = spark.readStream.schema(schema).parquet(landing)
    front = days.groupBy("project_id").transformWithStateInPandas(FrontierState(), outputStructType=OUT, outputMode="Update", timeMode="None")

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.hint("rebalance", "project_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(out)

    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKSDB)  # map state needs it
    try:
        _run(front.writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", checkpoint))
    finally:
        spark.conf.set(_STORE, before)
