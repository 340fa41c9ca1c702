"""Training-corpus pipeline: five stages over ``documents``, each written and read again.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the
columns of ``documents``. ``run`` applies them in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hotspot.llm import mixing
from hotspot.llm.common import fresh, row_keyed, stored
from hotspot.llm.decontam import contaminated
from hotspot.llm.jaccard_join import one_of_each_class
from hotspot.llm.language_id import identify_documents
from hotspot.llm.pii import pseudonymise


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those without one (or without letters) go. Every row is judged
    and kept by itself, with null or repeated ids as well."""
    rows, key = row_keyed(docs)
    verdicts = identify_documents(rows, spark.read.parquet(f"{sf_dir}/pages.parquet"), key_col=key)
    rejected = stored(verdicts.where("not accepted").select(key), "rejected")
    return rows.join(rejected, key, "left_anti").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each class of near duplicates; rows are decided each by itself."""
    return one_of_each_class(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; every row is decided by itself, with null or repeated ids as well."""
    rows, key = row_keyed(docs)
    hits = contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
    hits = stored(hits.select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return rows.join(hits, key, "left_anti").select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms for personal values; ``n_chars`` follows the new text."""
    old, found = fresh("old"), fresh("pii")
    out = pseudonymise(docs.withColumn(old, F.col("text")), pii_col=found)
    kind = docs.schema["n_chars"].dataType
    changed = ~F.col("text").eqNullSafe(F.col(old))
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars"))).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, one row for each copy (``copy`` from 1)."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("language_id", language_stage),
    ("jaccard_join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: Pseudonyms and the language model are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other; every stage's rows are written and read as the next one's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
