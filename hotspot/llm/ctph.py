"""Document fingerprints by context-triggered piecewise hashing, and neighbour comparison.

A rolling hash of seven bytes ends a chunk wherever it hits a value that the block size
sets; every chunk gives one character, so an edit changes the characters near it only.
Fingerprints of equal, double or half block size are compared by edit distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotspot.llm.common import by_value, prefix_hash, shuffle_partitions, span_hash

by_value(__name__)

# fixed values of the published scheme: rolling window, least block size, signature length, common run
ROLL, LEAST_BLOCK, SIGNATURE, COMMON = 7, 3, 64, 7
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def _rolling(data: np.ndarray) -> np.ndarray:
    """Mixed 32-bit hash of the ``ROLL`` bytes that end at each byte."""
    x = np.concatenate((np.zeros(ROLL - 1, np.uint32), data.astype(np.uint32) + np.uint32(1)))
    r = np.zeros(len(data), np.uint32)
    for j in range(ROLL):
        r = r * np.uint32(0x01000193) + x[j : j + len(data)]
    r ^= r >> np.uint32(15)
    r *= np.uint32(0x85EBCA6B)
    return r ^ (r >> np.uint32(13))


def _ends(r: np.ndarray, block: int) -> np.ndarray:
    """Chunk ends at a block size of 3 * 2^k: where ``r % block == block - 1``."""
    low = np.uint32(block // LEAST_BLOCK - 1)
    at = np.flatnonzero((r & low) == low)
    return at[r[at] % np.uint32(LEAST_BLOCK) == LEAST_BLOCK - 1] + 1


def _signature(prefix: np.ndarray, ends: np.ndarray, n: int, length: int) -> str:
    ends = ends[: length - 1]  # the last character stands for all that is left
    start = np.concatenate(([0], ends))
    end = np.concatenate((ends, [n]))
    if start[-1] == n:
        start, end = start[:-1], end[:-1]
    return _ALPHABET[(span_hash(prefix, start, end) >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(data: bytes) -> str:
    """``block:signature:signature at double block`` of the whole text; empty: ``3::``."""
    n, block = len(data), LEAST_BLOCK
    if not n:
        return f"{LEAST_BLOCK}::"
    a = np.frombuffer(data, np.uint8)
    r, prefix = _rolling(a), prefix_hash(a)
    while block * SIGNATURE < n:
        block *= 2
    ends = _ends(r, block)
    while block > LEAST_BLOCK and len(ends) < SIGNATURE // 2:
        block //= 2
        ends = _ends(r, block)
    return f"{block}:{_signature(prefix, ends, n, SIGNATURE)}:{_signature(prefix, _ends(r, 2 * block), n, SIGNATURE // 2)}"


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, one step of machine words per character of ``b`` (Myers 1999, Hyyro 2003)."""
    if not a or not b:
        return len(a) + len(b)
    peq: dict[str, int] = {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    pv, mv, score = full, 0, len(a)
    for c in b:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ((ph << 1) | 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
    return score


def _score(a: str, b: str) -> float:
    if a == b:
        return 1.0
    run = min(COMMON, len(a), len(b))
    if not run or {a[i : i + run] for i in range(len(a) - run + 1)}.isdisjoint(b[i : i + run] for i in range(len(b) - run + 1)):
        return 0.0
    return 1.0 - edit_distance(a, b) / max(len(a), len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1; 0 for block sizes that cannot be compared or without a common run of characters."""
    if x == y:
        return 1.0
    bx, x1, x2 = x.split(":")
    by, y1, y2 = y.split(":")
    bx, by = int(bx), int(by)
    if bx == by:
        return max(_score(x1, y1), _score(x2, y2) if x2 and y2 else 0.0)
    if bx == 2 * by:
        return _score(x1, y2)
    return _score(x2, y1) if by == 2 * bx else 0.0


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one bucket in id order, each with the next; a head row only closes the row before it."""
    held = None
    for b in batches:
        out: list[tuple] = []
        for i, t, head in zip(*(b.column(k).to_pylist() for k in range(3))):
            fp = fingerprint(t.encode("utf-8", "surrogatepass"))
            if held is not None:
                own, text, own_fp = held
                cut = len(text) // 4
                edited = (text[: len(text) - cut] + t[:cut]).encode("utf-8", "surrogatepass")
                edited_fp = fingerprint(edited)
                out.append((own, len(text), hashlib.sha256(edited).hexdigest(), own_fp, edited_fp, likeness(own_fp, edited_fp), likeness(own_fp, fp)))
            held = None if head else (i, t, fp)
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint)`` of every whole text (null: that of the empty text); no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint((t or "").encode("utf-8", "surrogatepass")) for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text, of its edited form, and their likeness.

    Edited: the last quarter (rounded down) of the code points gives way to as many first code
    points, or all, of the next document by ascending id; the first follows the last. Returns
    ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.
    Null and empty texts are empty. Rows without an id come first; rows that repeat an id follow
    each other in the order of their texts. An empty table gives an empty result; other columns
    are ignored. Texts are range-partitioned by id once, by splitters from the ids alone; the
    first text of each bucket (one per partition) is also sent to the bucket before.
    """
    spark = docs.sparkSession
    lowest = -(2**63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = shuffle_partitions(spark)
    ids = rows.select("doc_id")
    cuts = ids.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 100 * n).alias("p")).first()["p"] or []
    cuts = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def bucket(i):
        import pandas as pd

        return pd.Series(np.searchsorted(cuts, i.to_numpy(), side="right").astype(np.int32))

    # one row per partition
    lows = sorted((r["b"], r["low"]) for r in ids.select("doc_id", bucket("doc_id").alias("b")).groupBy("b").agg(F.min("doc_id").alias("low")).collect())
    heads = [(lows[k - 1][0], low) for k, (_, low) in enumerate(lows)]  # the first closes the last
    small = spark.createDataFrame(heads, "b int, doc_id long")
    first = rows.join(F.broadcast(small), "doc_id").groupBy("b", "doc_id").agg(F.min("text").alias("text")).select("doc_id", "text", F.lit(True).alias("head"), "b")
    dealt = rows.select("doc_id", "text", F.lit(False).alias("head"), bucket("doc_id").alias("b")).unionByName(first)
    laid = dealt.repartitionById(n, F.col("b")).sortWithinPartitions("head", "doc_id", "text").select("doc_id", "text", "head")
    return laid.mapInArrow(_walk, _OUT).withColumn("doc_id", F.when(F.col("doc_id") != lowest, F.col("doc_id")))
