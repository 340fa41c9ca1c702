"""Helpers of the training-data operators: byte hashing, word shingles, shared tables, components."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hotspot.session import cut_lineage, new_table_path

_U = np.uint64
# fixed values: odd multipliers of the two byte hashes, the finaliser's constants
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Rows that one task of a component round may write.
ROUND_ROWS = 100_000
_POWERS: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def by_value(*modules: str) -> None:
    """Ship the named modules' functions with the job, so that executors need no installed package."""
    for m in modules:
        cloudpickle.register_pickle_by_value(sys.modules[m])


by_value(__name__)


def broadcast_by_value(spark: SparkSession, obj) -> Broadcast:
    """Broadcast of an object with its class, which ``sent_value`` rebuilds where no package is installed."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(obj))


def sent_value(sent: Broadcast):
    return cloudpickle.loads(sent.value)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (a permutation), element-wise."""
    x = (x ^ (x >> _U(30))) * _U(_MIX[0])
    x = (x ^ (x >> _U(27))) * _U(_MIX[1])
    return x ^ (x >> _U(31))


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of a hash base, powers of its inverse modulo 2^64, and a value for each byte."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n + 1:
        size = max(1 << 16, 1 << int(n).bit_length())
        base = _BASES[which]
        inv = pow(base, -1, 1 << 64)
        pw = np.full(size, base, np.uint64)
        ipw = np.full(size, inv, np.uint64)
        pw[0] = ipw[0] = 1
        table = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASES[1 - which]))
        have = (np.multiply.accumulate(pw), np.multiply.accumulate(ipw), table)
        _POWERS[which] = have
    return have


def prefix_hash(data: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums of a polynomial byte hash modulo 2^64; see ``span_hash``."""
    pw, _, table = _powers(len(data), which)
    out = np.zeros(len(data) + 1, np.uint64)
    terms = table.take(data)
    terms *= pw[: len(data)]
    np.cumsum(terms, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start, end, which: int = 0) -> np.ndarray:
    """Hash of ``data[start:end]`` for arrays of bounds: equal bytes give equal hashes anywhere."""
    _, ipw, _ = _powers(len(prefix), which)
    return mix((prefix[end] - prefix[start]) * ipw[start])


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 bytes; words are runs without ASCII white space."""
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[0::2], edge[1::2]


def word_hashes(data: np.ndarray) -> np.ndarray:
    s, e = word_bounds(data)
    return span_hash(prefix_hash(data), s, e)


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles of the lower-cased text.

    A text of fewer than ``k`` words has one shingle, all of its words; a text without
    words (null or empty included) has none.
    """
    w = word_hashes(np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8))
    if not len(w):
        return w
    k = min(k, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h = h * _U(_BASES[1]) + w[i : len(w) - k + 1 + i]
    return np.unique(mix(h))


def shingle_sets(texts: list[str | None], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``shingles`` of several texts, one set after the other, and where each set begins (and the last ends)."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw), np.uint8)
    s, e = word_bounds(data)
    w = span_hash(prefix_hash(data), s, e)
    first = np.concatenate(([0], np.searchsorted(s, np.cumsum([len(r) + 1 for r in raw]))))
    most = max(0, len(w) - k + 1)
    h = np.zeros(most, np.uint64)
    for i in range(k):
        h = h * _U(_BASES[1]) + w[i : most + i]
    h = mix(h)
    sets = []
    for at, n in zip(first.tolist(), np.diff(first).tolist()):
        if n >= k:
            sets.append(np.sort(h[at : at + n - k + 1]))
        else:
            one = np.zeros(min(n, 1), np.uint64)
            for i in range(n):
                one = one * _U(_BASES[1]) + w[at + i]
            sets.append(mix(one))
    size = np.array([len(x) for x in sets], np.int64)
    start = np.concatenate(([0], np.cumsum(size)))
    values = np.concatenate([np.zeros(0, np.uint64), *sets])
    new = np.concatenate(([True], values[1:] != values[:-1]))[: len(values)]
    new[start[:-1][size > 0]] = True
    return values[new], np.concatenate(([0], np.cumsum(new)))[start]


def chunks(texts: list[str | None], chars: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Bounds of successive texts of about that many characters together."""
    lo = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= chars:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as the long that Spark keeps, same order: the lowest value becomes the lowest long."""
    return (x ^ _U(1 << 63)).view(np.int64)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to a fresh table in the shared folder and read it back: computed once, and not
    again when an executor is lost."""
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unique_ids(df: DataFrame, id_col: str) -> bool:
    """Whether every row has an id, and one of its own."""
    return df.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n")).where("n > 1 or id is null").isEmpty()


def with_row_key(df: DataFrame, row: str, content: str) -> DataFrame:
    """``df``, written and read back with a unique number per row (``row``) and a hash of the row's
    columns (``content``), which does not depend on where the row lies."""
    hashed = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in hashed]
    return stored(df.withColumns({row: F.monotonically_increasing_id(), content: F.xxhash64(F.lit(0), *columns)}), "rows")


def row_keyed(df: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """``df`` with a column that names every row, and that column: the id where each row has one of its
    own, else a number, for which the rows are written once."""
    if unique_ids(df, id_col):
        return df, id_col
    row = fresh("row")
    return with_row_key(df, row, fresh("content")), row


def fresh(prefix: str) -> str:
    """A column name that no input column can have."""
    return f"__{prefix}_{uuid.uuid4().hex[:8]}"


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: ``(node, label)``, label = smallest node.

    Each round joins every node to the neighbour of least hashed value, follows those
    pointers twice and replaces the edges by those between the new representatives, so
    edges shrink geometrically, also along chains. All of it is joins and map-side combined
    aggregates: nothing of a component meets in one task or the driver but a row count.
    """
    spark = edges.sparkSession
    most = shuffle_partitions(spark)

    def tasks(rows: int) -> int:
        """A few rows need few tasks and files."""
        return max(1, min(most, -(-rows // ROUND_ROWS)))

    e = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps: list[DataFrame] = []
    most_rows = 0
    while left := e.count():
        most_rows = max(most_rows, 2 * left)
        if len(steps) >= most_rounds:
            raise RuntimeError("components do not converge")
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # least hashed neighbour or the node itself
        near = both.groupBy("a").agg(F.min(F.xxhash64("b")).alias("hb"))
        pick = both.withColumn("hb", F.xxhash64("b")).join(near, ["a", "hb"]).groupBy("a").agg(F.min("b").alias("b"), F.first("hb").alias("hb"))
        step = pick.select(F.col("a").alias("node"), F.when((F.col("hb") < F.xxhash64("a")) | ((F.col("hb") == F.xxhash64("a")) & (F.col("b") < F.col("a"))), F.col("b")).otherwise(F.col("a")).alias("to"))
        for _ in range(2):
            nxt = step.select(F.col("node").alias("to"), F.col("to").alias("to2"))
            step = step.join(nxt, "to").select("node", F.col("to2").alias("to"))
        step = stored(step.coalesce(tasks(2 * left)), "step")
        steps.append(step)
        s1 = step.select(F.col("node").alias("a"), F.col("to").alias("ra"))
        s2 = step.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        e = e.join(s1, "a").join(s2, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        e = stored(e.coalesce(tasks(left)), "edges")
    if not steps:
        return spark.createDataFrame([], "node long, label long")
    out = steps[-1].select("node", F.col("to").alias("root"))
    for step in reversed(steps[:-1]):
        nxt = out.select(F.col("node").alias("to"), "root")
        out = step.join(nxt, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    out = stored(out.coalesce(tasks(most_rows)), "roots")
    return out.join(out.groupBy("root").agg(F.min("node").alias("label")), "root").select("node", "label")


__all__ = [
    "broadcast_by_value", "by_value", "chunks", "components", "cut_lineage", "fresh", "mix", "prefix_hash", "row_keyed", "sent_value", "shingle_sets", "shingles",
    "shuffle_partitions", "signed", "span_hash", "stored", "unique_ids", "with_row_key", "word_bounds", "word_hashes",
]
