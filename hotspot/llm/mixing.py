"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Every document of a source expects ``target / source size`` copies. Documents lie in a fixed
order within their source; the prefix sum of expected copies plus one random offset per
source crosses so many integers at each document as copies of it are taken. The prefix sum
is two-level: documents are dealt to chunks of bounded size, chunk counts are summed first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hotspot.llm.common import fresh, stored, unique_ids, with_row_key

WEIGHTS = (3, 1, 2)
SHARE, LIMIT, SEED = 1.5, 2.0, "mix"
#: Documents in a chunk, about.
CHUNK = 1_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit(*parts: Column) -> Column:
    """A number in [0, 1) from the hash of the parts, the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """``sizes(source, source_size)`` to ``(source, source_size, target)``.

    Sources by code point, null last, take the weights in turn. The total is ``share`` times all
    sizes, dealt by weight; no target passes ``limit`` times its size, and what is above goes to
    the others by weight until none is above. Solved directly: by rising ratio of limit to weight,
    the sources that reach their limit are a prefix, and the rest shares the remainder.
    """
    byte_order = F.encode(F.col("source"), "utf-8")
    order = Window.orderBy(F.col("source").isNull(), byte_order)
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("top", F.col("source_size") * F.lit(float(limit)))
    rising = Window.orderBy(F.col("top") / F.col("w"), F.col("source").isNull(), byte_order)
    before, from_here = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_ = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumns({"total": F.sum("source_size").over(all_) * F.lit(float(share)), "capped": F.coalesce(F.sum("top").over(before), F.lit(0.0)), "rest": F.sum("w").over(from_here)})
    t = t.withColumn("level", (F.col("total") - F.col("capped")) / F.col("rest"))
    # the level that holds is that of the first source below its limit; it is the largest of those in question
    t = t.withColumn("level", F.max(F.when(F.col("level") * F.col("w") <= F.col("top"), F.col("level"))).over(all_))
    return t.select("source", "source_size", F.least("top", F.coalesce(F.col("level") * F.col("w"), F.col("top"))).alias("target"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", ties: tuple[str, ...] = ()) -> DataFrame:
    """How often the mix takes every document: ``(doc_id, size, source, source_size, target, copies, taken)``.

    One row per row of ``docs``. Documents are ordered within their source by size, then by hashed
    id, so that a source's taken words come within about one long document of its target. ``copies``
    is at most the limit rounded up. Null and empty texts have size 0; a null source is a source of
    its own; rows without an id and rows that repeat an id are taken each for itself; a source
    without words has target 0 and no copies. An empty table gives an empty result; other columns
    are ignored, but those named in ``ties`` (not like one of the result) order rows of the same id
    and come with the result. Nothing but totals per source meets in one task.
    """
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string")))
    d = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), key.alias("key"), *ties), "sizes")
    by_size = stored(d.groupBy("source", "size").agg(F.count("*").alias("docs")), "by_size")
    t = targets(by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).cast("long").alias("source_size")), weights, share, limit)
    offset = unit(F.lit(seed), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    t = t.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"), offset.alias("offset"))
    # chunk = leading part of the hashed id within (source, size): as many parts as its count asks for
    parts = F.greatest(F.lit(1), F.pow(F.lit(16.0), F.ceil(F.log(16.0, F.col("docs") / F.lit(float(CHUNK)))))).cast("long")
    by_size = by_size.withColumn("digits", F.when(F.col("docs") <= CHUNK, 0).otherwise(F.round(F.log(16.0, parts.cast("double")))).cast("int"))
    same = F.col("d.source").eqNullSafe(F.col("g.source")) & (F.col("d.size") == F.col("g.size"))
    more = [f"d.{c}" for c in ties]
    d = d.alias("d").join(by_size.alias("g"), same).select("d.doc_id", "d.source", "d.size", "d.key", *more, F.expr("substring(d.key, 1, g.digits)").alias("chunk"))
    chunks = d.groupBy("source", "size", "chunk").agg(F.count("*").alias("n"))
    # chunks of a source: one row per size and chunk, far fewer than documents
    before = Window.partitionBy("source").orderBy("size", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("source", "size", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "chunk").orderBy("key", *ties))
    # by chunk: partitions by (source, size) alone, as the join may leave them, would hold a whole hot group
    d = d.repartition("source", "size", "chunk").withColumn("rank", rank)
    same = F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.size") == F.col("c.size")) & (F.col("d.chunk") == F.col("c.chunk"))
    d = d.alias("d").join(chunks.alias("c"), same).select("d.doc_id", "d.source", "d.size", *more, (F.col("d.rank") + F.col("c.base")).alias("at"))
    at = F.col("at").cast("double")
    crossed = F.floor(at * F.col("rate") + F.col("offset")) - F.floor((at - 1) * F.col("rate") + F.col("offset"))
    out = d.alias("d").join(t.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).withColumn("copies", crossed.cast("long"))
    return out.select("doc_id", "size", "d.source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *ties)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken, with ``copy`` from 1.

    Rows that repeat an id, or have none, are taken and emitted each for itself, whatever their other
    columns hold (ordered by a hash of them, so that reruns give the same). A column named ``copy`` is
    replaced. Only where ids repeat or are missing are the rows written with a number each.
    """
    row, same, n = fresh("row"), fresh("same"), fresh("copies")
    names = [c for c in docs.columns if c != "copy"]
    rows, key, ties = docs.select(*names), id_col, ()
    if not unique_ids(docs, id_col):
        rows, key, ties = with_row_key(rows, row, same), row, (same, row)
    taken = mix(rows, id_col=id_col, ties=ties, **options).where("copies > 0")
    taken = taken.select(F.col(row if ties else "doc_id").alias(key), F.col("copies").alias(n))
    out = rows.join(taken.hint("shuffle_hash"), key)
    return out.select(*names, F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))).alias("copy"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix|' || doc_id::VARCHAR) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)]::DOUBLE AS w,
             source_size * 2.0::DOUBLE AS top FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
                 - coalesce(sum(top) OVER (ORDER BY top / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER (ORDER BY top / w, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
t AS (SELECT source, source_size, least(top, coalesce((SELECT max(lev) FROM l WHERE lev * w <= top) * w, top)) AS target,
             ('0x' || substr(md5('mix|' || coalesce('=' || source, '')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate, t.u,
             row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.key)::DOUBLE AS pos
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((floor(pos * rate + u) - floor((pos - 1) * rate + u))::BIGINT * size)::BIGINT AS taken
FROM r
"""
