"""The detection archive: immutable commits, and one small file that says which of them hold.

    <path>/_data/commit=<id>/acq_month=<yyyy-MM>/project_bucket=<n>/   rows, never changed
    <path>/_counts/commit=<id>/                                        rows per partition, project, sensor
    <path>/_manifests/<number>-<id>/                                   partitions of a version
    <path>/_versions/<number>                                          the switch: names the manifest

A commit writes new folders, then the manifest of all partitions, then the version file, which comes
into being whole or not at all. What was written before the switch is seen by nobody; what a reader
has opened stays until ``remove_old`` takes versions that were replaced long ago.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hotspot.operators import ingest
from hotspot.session import cut_lineage
from hotspot.sources import files

MONTH, BUCKET = "acq_month", "project_bucket"
#: Rows that a partition is made for; a month has the least power of two of them that holds its rows.
BUCKET_ROWS = 4_000_000
_KEYS = T.StructType([T.StructField(MONTH, T.StringType()), T.StructField(BUCKET, T.IntegerType())])
_MANIFEST = "acq_month string, project_bucket int, buckets int, commit string, rows long"
_COUNTS = "acq_month string, project_bucket int, project_id string, sensor string, rows long"


class VersionTaken(RuntimeError):
    """Another writer has switched first."""


@dataclass(frozen=True)
class Part:
    month: str
    bucket: int
    buckets: int
    commit: str
    rows: int


@dataclass(frozen=True)
class Snapshot:
    """One version of an archive: its columns and its partitions (their number follows the bytes, as
    that of the files that Spark lists does)."""

    path: str
    version: int
    schema: T.StructType
    parts: tuple[Part, ...]

    def buckets(self) -> dict[str, int]:
        return {p.month: p.buckets for p in self.parts}

    def read(self, spark: SparkSession, parts: tuple[Part, ...] | None = None) -> DataFrame:
        """The rows of these partitions (of all), with the partition columns."""
        schema = T.StructType(self.schema.fields + _KEYS.fields)
        folders = [f"{self.path}/_data/commit={p.commit}/{MONTH}={p.month}/{BUCKET}={p.bucket}" for p in (self.parts if parts is None else parts)]
        if not folders:
            return spark.createDataFrame([], schema)
        rows = spark.read.schema(schema).option("basePath", f"{self.path}/_data").parquet(*folders)
        return rows.select(*schema.names)

    def totals(self, spark: SparkSession) -> DataFrame:
        """Rows by project and sensor, from the counts written with each commit."""
        if not self.parts:
            return spark.createDataFrame([], "project_id string, sensor string, rows_total long")
        held = spark.createDataFrame([(p.month, p.bucket, p.commit) for p in self.parts], "acq_month string, project_bucket int, commit string")
        folders = sorted({f"{self.path}/_counts/commit={p.commit}" for p in self.parts})
        counts = spark.read.schema(f"{_COUNTS}, commit string").option("basePath", f"{self.path}/_counts").parquet(*folders)
        return counts.join(held, [MONTH, BUCKET, "commit"], "left_semi").groupBy("project_id", "sensor").agg(F.sum("rows").alias("rows_total"))


def snapshot(spark: SparkSession, path: str) -> Snapshot | None:
    """The version that holds now; None where there is no archive."""
    path = path.rstrip("/")
    try:
        versions = spark.read.schema("value string").option("wholetext", True).text(f"{path}/_versions")
        last = versions.select("value", F.col("_metadata.file_name").alias("name")).orderBy(F.col("name").desc()).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        last = None
    if last is None:
        return None
    said = json.loads(last["value"])
    return Snapshot(path, int(last["name"]), T.StructType.fromJson(said["schema"]), _manifest(spark, path, said["manifest"]))


def _manifest(spark: SparkSession, path: str, name: str) -> tuple[Part, ...]:
    rows = spark.read.schema(_MANIFEST).parquet(f"{path}/_manifests/{name}").collect()
    return tuple(sorted((Part(r[0], r[1], r[2], r[3], r[4]) for r in rows), key=lambda p: (p.month, p.bucket)))


def read_archive_table(spark: SparkSession, path: str, first_month: str | None = None, last_month: str | None = None) -> DataFrame:
    """The archive as it is now; later commits change nothing of it. Months outside the bounds
    (yyyy-MM, inclusive) are not even listed."""
    held = snapshot(spark, path)
    if held is None:
        raise FileNotFoundError(f"no archive at {path}")
    parts = tuple(p for p in held.parts if (first_month or "") <= p.month <= (last_month or "~"))
    return held.read(spark, parts)


def buckets_for(rows: int) -> int:
    return 1 << max(0, -(-rows // BUCKET_ROWS) - 1).bit_length()


def _month() -> Column:
    return F.date_format("acq_date", "yyyy-MM")


def _placed(rows: DataFrame, buckets: dict[str, int]) -> DataFrame:
    """Rows with month and bucket. All that a merge compares, the rows of one project, sensor and
    date, lies in one bucket, and no project, however large, in one alone."""
    known = F.create_map(*[F.lit(x) for pair in sorted(buckets.items()) for x in pair]) if buckets else F.lit(None).cast("map<string,int>")
    spread = F.xxhash64(F.col("project_id").cast("string"), "sensor", "acq_date")
    return rows.withColumn(MONTH, _month()).withColumn(BUCKET, F.pmod(spread, F.coalesce(F.try_element_at(known, MONTH), F.lit(1))).cast("int"))


def _rows_by_month(rows: DataFrame) -> dict[str, int]:
    """Bounded by the calendar."""
    return dict(tuple(r) for r in rows.where(F.col("acq_date").isNotNull()).groupBy(_month()).count().collect())


def commit(spark: SparkSession, path: str, rows: DataFrame, base: Snapshot | None, replaced: set[tuple[str, int]], buckets: dict[str, int]) -> Snapshot:
    """The next version: `base` without the replaced partitions, with these rows. Raises VersionTaken,
    and leaves the archive as it was, where another writer has made that version."""
    path = path.rstrip("/")
    name, version = uuid.uuid4().hex, (base.version if base else 0) + 1
    rows = rows.drop(MONTH, BUCKET)
    more = [f for f in base.schema.fields if f.name not in rows.columns] if base else []
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields + more])
    # writers follow the size of the data: AQE cuts large partitions and joins small ones; newest first in a file
    laid = _placed(rows, buckets).hint("rebalance", MONTH, BUCKET)
    laid = laid.sortWithinPartitions(MONTH, BUCKET, "project_id", F.col("acq_date").desc(), F.col("acq_time").desc())
    data = f"{path}/_data/commit={name}"
    laid.write.partitionBy(MONTH, BUCKET).parquet(data)
    back = spark.read.schema(T.StructType([f for f in schema.fields if f.name in ("project_id", "sensor")] + _KEYS.fields)).parquet(data)
    by = back.groupBy(MONTH, BUCKET, F.col("project_id").cast("string").alias("project_id"), "sensor").agg(F.count("*").alias("rows"))
    by.write.parquet(f"{path}/_counts/commit={name}")
    new = spark.read.schema(_COUNTS).parquet(f"{path}/_counts/commit={name}").groupBy(MONTH, BUCKET).agg(F.sum("rows")).collect()
    parts = [p for p in base.parts if (p.month, p.bucket) not in replaced] if base else []
    parts += [Part(m, b, buckets.get(m, 1), name, n) for m, b, n in new]
    manifest = f"{version:010d}-{name}"
    spark.createDataFrame([(p.month, p.bucket, p.buckets, p.commit, p.rows) for p in parts], _MANIFEST).coalesce(1).write.parquet(f"{path}/_manifests/{manifest}")
    switch(spark, path, version, json.dumps({"manifest": manifest, "schema": schema.jsonValue()}))
    return Snapshot(path, version, schema, tuple(sorted(parts, key=lambda p: (p.month, p.bucket))))


def switch(spark: SparkSession, path: str, version: int, said: str) -> None:
    if not files.create_once(spark, f"{path}/_versions/{version:010d}", said):
        raise VersionTaken(f"version {version} of {path} was made by another writer")


def write_archive(df: DataFrame, path: str) -> Snapshot:
    """K1 + O2: the rows as archive; months that `df` holds are replaced whole, others stay."""
    spark = df.sparkSession
    base = snapshot(spark, path)
    buckets = {m: buckets_for(n) for m, n in _rows_by_month(df).items()}
    replaced = {(p.month, p.bucket) for p in base.parts if p.month in buckets} if base else set()
    return commit(spark, path, df.where(F.col("acq_date").isNotNull()), base, replaced, buckets)


def merge_into_archive(spark: SparkSession, path: str, batch: DataFrame, tries: int = 5) -> DataFrame:
    """U4 on the archive: only the partitions that hold a date of the batch are read and written anew
    (a month that outgrows its buckets is, whole); a first load goes the same way. Where another writer
    switches in between, the merge is done again on what that one made. Returns the merge log, of
    which inputs and result are counted in the one pass that merges."""
    arriving = _rows_by_month(batch)
    for left in reversed(range(tries)):
        base = snapshot(spark, path)
        held, rows = (base.buckets(), {}) if base else ({}, {})
        for p in base.parts if base else ():
            rows[p.month] = rows.get(p.month, 0) + p.rows
        buckets = {m: max(held.get(m, 1), buckets_for(rows.get(m, 0) + n)) for m, n in arriving.items()}
        grown = {m for m in buckets if m in held and buckets[m] > held[m]}
        # bounded by the partitions of the months in the batch
        touched = {tuple(r) for r in _placed(batch.where(F.col("acq_date").isNotNull()), buckets).select(MONTH, BUCKET).distinct().collect()}
        old = tuple(p for p in base.parts if p.month in grown or (p.month, p.bucket) in touched) if base else ()
        hist = base.read(spark, old).drop(MONTH, BUCKET) if base else batch.limit(0)
        hist = hist.withColumn("origin", F.lit(0))
        if "ingest_seq" not in hist.columns:
            hist = hist.withColumn("ingest_seq", F.pmod(F.col("detection_id"), F.lit(1 << ingest.SEQ_BITS)))
        tagged = cut_lineage(ingest.merge_tagged(hist, batch))
        try:
            done = commit(spark, path, ingest.merged_rows(tagged), base, {(p.month, p.bucket) for p in old}, buckets)
            return cut_lineage(ingest.merge_log(tagged, done.totals(spark)))
        except VersionTaken:
            if not left:
                raise
    raise AssertionError("not reached")


def remove_old(spark: SparkSession, path: str, seconds: float) -> int:
    """Versions replaced longer ago than that go, with what only they hold and what crashed writers have
    left; the age must be above the longest read and the longest write. Returns the folders removed."""
    path = path.rstrip("/")
    before = time.time() - seconds
    versions = sorted((n, t) for n, t in files.children(spark, f"{path}/_versions") if n.isdigit())
    gone = [n for (n, _), (_, replaced) in zip(versions, versions[1:]) if replaced < before]
    kept = [n for n, _ in versions if n not in gone]
    for n in gone:  # first what makes them findable
        files.remove(spark, f"{path}/_versions/{n}")
    live, manifests = set(), set()
    for r in spark.read.schema("value string").option("wholetext", True).text([f"{path}/_versions/{n}" for n in kept]).collect() if kept else []:
        manifests.add(json.loads(r["value"])["manifest"])
    for m in manifests:
        live |= {f"commit={p.commit}" for p in _manifest(spark, path, m)}
    removed = 0
    for folder, needed in (("_manifests", manifests), ("_data", live), ("_counts", live)):
        for n, t in files.children(spark, f"{path}/{folder}"):
            if n not in needed and t < before:
                files.remove(spark, f"{path}/{folder}/{n}")
                removed += 1
    return removed
