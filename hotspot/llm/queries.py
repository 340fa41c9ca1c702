"""Registered queries of the training-data operators: key -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hotspot.llm import license_scan, mixing, url_filter, warc_revisit
from hotspot.llm.ctph import edited_fingerprints
from hotspot.llm.decontam import contaminated
from hotspot.llm.divergence import ORACLE_SQL as DIVERGENCE_SQL
from hotspot.llm.divergence import source_divergence
from hotspot.llm.fill_middle import ORACLE_SQL as FILL_MIDDLE_SQL
from hotspot.llm.fill_middle import fill_in_middle
from hotspot.llm.jaccard_join import ORACLE_SQL as JACCARD_SQL
from hotspot.llm.jaccard_join import jaccard_join
from hotspot.llm.language_id import identify_documents
from hotspot.llm.pii import pseudonymise
from hotspot.llm.suffix_dedup import ORACLE_SQL as SUFFIX_SQL
from hotspot.llm.suffix_dedup import suffix_dedup
from hotspot.llm.topk_search import ORACLE_SQL as TOP_K_SQL
from hotspot.llm.topk_search import top_k


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.RULES)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every document."""
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, target and taken words of every document, sources mixed 3 : 1 : 2 to 150 % of all words."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by its text, declaration and address."""
    return identify_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms, and what was replaced."""
    out = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.coalesce(F.size("pii"), F.lit(0)).cast("long").alias("n_pii"), F.array_join(F.transform("pii", lambda m: m["kind"]), ",").alias("kinds"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piecewise fingerprints of every document and its edited text."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document without its repeated 100-byte strings."""
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document."""
    return jaccard_join(table(spark, sf_dir, "documents"))


def op10_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of the capture log of all pages, resolved."""
    out = warc_revisit.resolve_revisits(warc_revisit.capture_log(table(spark, sf_dir, "pages")))
    h = F.col("headers")
    fields = h["content-length"].alias("content_length"), h["date"].alias("date_field"), h["cache-control"].alias("cache_control")
    return out.select("record_id", "canonical", "ts", "outcome", "source_id", "source_ts", "digest", *fields)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document arranged for fill-in-middle training, and of the text restored from it."""
    return fill_in_middle(table(spark, sf_dir, "documents"), outputs=False).drop("pieces", "output")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source from the others of its language, and its most marked terms."""
    return source_divergence(table(spark, sf_dir, "documents"))


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best rows of every fiftieth vector by inner product."""
    return top_k(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_license_scan, op3_decontamination, op4_mixing, op5_language_id,
        op6_pii, op7_fingerprints, op8_suffix_dedup, op9_jaccard_join, op10_warc_revisit,
        op11_fill_middle, op12_divergence, op13_top_k,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": url_filter.ORACLE_SQL,
    "op2_license_scan": license_scan.oracle_sql(),
    "op4_mixing": mixing.ORACLE_SQL,
    "op8_suffix_dedup": SUFFIX_SQL,
    "op9_jaccard_join": JACCARD_SQL,
    "op10_warc_revisit": warc_revisit.ORACLE_SQL,
    "op11_fill_middle": FILL_MIDDLE_SQL,
    "op12_divergence": DIVERGENCE_SQL,
    "op13_top_k": TOP_K_SQL,
}
