"""Removal of repeated byte strings by a distributed, sparse suffix array.

A window is a string of ``length`` bytes. Its leading token is the least hash among its
``gram``-byte substrings, so equal windows have equal leading tokens wherever they lie.
Neighbouring windows of one document with one leading token form a run; a run's suffix is
its leading token, the hash of all its bytes, its document and its start. Only run starts
enter the suffix array (about one in ``(length - gram) / 2`` bytes).

Sampled splitters range-partition the suffixes by these tokens, each bucket sorts them by
multikey quicksort (a further token is looked at only inside runs of equal earlier ones),
and equal neighbours repeat an earlier run: every window of theirs starts earlier as well.
Where one leading token has several different runs, the first of each goes on, window by
window, into a second suffix array of the windows themselves, in which buckets compare
their first row with the last row of the bucket before. Together they decide every window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hotspot.llm.common import by_value, prefix_hash, shuffle_partitions, signed, span_hash, stored

by_value(__name__)

LENGTH, GRAM = 100, 32
#: Bytes of text hashed at a time.
CHUNK = 1 << 18
#: Rows that a task combines or compares at a time; rows of one leading token beyond which its windows are dealt one by one.
HELD, CROWD = 400_000, 64
_ROW = "t1 long, t2 long, doc_id long, start long, n int, state int"
_NAMES = ["t1", "t2", "doc_id", "start", "n", "state"]
#: States of a row: to be sorted, to be sorted and looked into for repeats inside the run, known to be repeated.
SORT, INNER, DONE = 0, 1, 2


def multikey_sort(columns: list[np.ndarray]) -> np.ndarray:
    """Order of rows by several token columns: three-way quicksort on the first, later columns only
    inside runs of equal earlier ones."""
    order = np.argsort(columns[0], kind="quicksort")
    equal = np.ones(max(0, len(order) - 1), bool)
    for k, col in enumerate(columns[1:], 1):
        prev = columns[k - 1][order]
        equal &= prev[1:] == prev[:-1]
        open_ = np.zeros(len(order), bool)
        open_[1:] |= equal
        open_[:-1] |= equal
        at = np.flatnonzero(open_)
        if not len(at):
            break
        run = np.cumsum(np.concatenate(([True], ~equal)))[at]
        part = order[at]
        order[at] = part[np.lexsort((col[part], run))]
    return order


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours."""
    n = len(h)
    pad = -n % w
    x = np.concatenate((h, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF)))).reshape(-1, w)
    left = np.minimum.accumulate(x, axis=1).ravel()
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def _runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Runs in concatenated texts: ``(text, start, n, lead, all, inner)``; no window crosses two texts."""
    w = length - gram + 1
    if len(data) < length:
        return None
    p, q = prefix_hash(data), prefix_hash(data, 1)
    at = np.arange(len(data) - gram + 1)
    h = span_hash(p, at, at + gram)
    low = _sliding_min(h, w)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = owner[: len(low)] == owner[length - 1 : length - 1 + len(low)]
    cut = np.concatenate(([True], (low[1:] != low[:-1]) | (owner[1 : len(low)] != owner[: len(low) - 1]) | (whole[1:] != whole[:-1])))
    start = np.flatnonzero(cut)
    end = np.concatenate((start[1:], [len(low)]))
    keep = whole[start]
    start, end = start[keep], end[keep]
    lead = low[start]
    # a run whose leading token occurs twice in it may repeat a window inside itself
    n = end - start
    # (a run longer than most is periodic and does)
    long_ = n > 3 * w
    hits = np.where(long_, 2, 0).astype(np.int32)
    short = np.flatnonzero(~long_)
    s, m, mine = start[short], n[short] + (w - 1), lead[short]
    for t in range(int(m.max(initial=0))):
        hits[short] += (h[np.minimum(s + t, len(h) - 1)] == mine) & (t < m)
    return owner[start], start, n, lead, span_hash(q, start, end + (length - 1), 1), hits > 1


def _batch(columns) -> pa.RecordBatch:
    t1, t2, doc, start, n, state = columns
    return pa.RecordBatch.from_arrays([pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int32()), pa.array(state, pa.int32())], _NAMES)


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _combine(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Before the shuffle: of equal tokens in one batch the first goes on, the others are repeats."""
    order = multikey_sort(cols[:4])
    cols = [c[order] for c in cols]
    same = (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1])
    cols[5][1:][same] = DONE
    return cols


def _suffixes(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        held = 0
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            texts = [t or b"" for t in b.column(1).to_pylist()]
            for lo, hi in _chunks(texts):
                offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts[lo:hi]])))
                found = _runs(np.frombuffer(b"".join(texts[lo:hi]), np.uint8), offsets, length, gram)
                if found is not None:
                    text, start, n, lead, all_, inner = found
                    parts.append((signed(lead), signed(all_), ids[lo + text], start - offsets[text], n.astype(np.int32), np.where(inner, INNER, SORT).astype(np.int32)))
                    held += len(start)
                if held >= HELD:
                    yield _batch(_combine([np.concatenate(x) for x in zip(*parts)]))
                    parts, held = [], 0
        if parts:
            yield _batch(_combine([np.concatenate(x) for x in zip(*parts)]))

    return run


def _bucket(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray] | None:
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return None
    t = pa.Table.from_batches(rows)
    cols = [t.column(i).to_numpy() for i in range(6)]
    order = multikey_sort(cols[:4])
    return [c[order] for c in cols]


def _compare_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket of run suffixes: repeats (DONE) and first runs to look into (SORT).

    The bucket's lowest and highest leading tokens may go on in the next bucket: their first
    runs are looked into as well."""
    cols = _bucket(batches)
    if cols is None:
        return
    t1, t2, state = cols[0], cols[1], cols[5]
    known = state == DONE
    lead_same = t1[1:] == t1[:-1]
    again = np.concatenate(([False], lead_same & (t2[1:] == t2[:-1])))
    run = np.cumsum(np.concatenate(([True], ~lead_same))) - 1
    kinds = np.bincount(run, ~again)  # different runs with this leading token
    kinds[[0, -1]] = 2
    first = ~again & ~known & ((kinds[run] > 1) | (state == INNER))
    out = known | again | first
    cols[5] = np.where(first, SORT, DONE).astype(np.int32)
    yield _batch([c[out] for c in cols])


_OPEN = "k1 long, k2 long, k3 long, k4 long, doc_id long, start long, state int, data binary"
_OPEN_NAMES = ["k1", "k2", "k3", "k4", "doc_id", "start", "state", "data"]


def _opened(length: int):
    """Runs to look into, per text in ``spans`` (a list of lead, start, n, crowded).

    A run goes out with its bytes, keyed by its leading token; one of a crowded token goes out as
    single windows, keyed by their own hashes, of which equal ones are first combined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs: list[tuple] = []
            parts = []
            ends, (lead, start, count, crowd) = _spans(b.column(2))
            for k, (i, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                own = range(ends[k], ends[k + 1])
                crowded = [np.arange(start[x], start[x] + count[x]) for x in own if crowd[x]]
                runs.extend((lead[x], i, start[x], t[start[x] : start[x] + count[x] + length - 1]) for x in own if not crowd[x])
                if crowded:
                    at = np.unique(np.concatenate(crowded))
                    parts.append(_hashed(np.frombuffer(t, np.uint8), at, length, i, at))
            zero = np.zeros(len(runs), np.int64)
            if runs:
                key, doc, at = (np.array([r[k] for r in runs], np.int64) for k in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(zero) for _ in range(3)), pa.array(doc), pa.array(at), pa.array(zero.astype(np.int32)), pa.array([r[3] for r in runs], pa.binary())], _OPEN_NAMES)
            if parts:
                c = _combine([np.concatenate(x) for x in zip(*parts)])
                yield pa.RecordBatch.from_arrays([*(pa.array(c[k]) for k in (0, 1, 2, 3, 2, 3)), pa.array(c[5]), pa.nulls(len(c[0])).cast(pa.binary())], _OPEN_NAMES)

    return run


def _hashed(data: np.ndarray, at: np.ndarray, length: int, doc, start: np.ndarray) -> tuple:
    """Window suffixes: both hashes of the windows at ``at``, documents, starts, and two unused columns."""
    h = signed(span_hash(prefix_hash(data), at, at + length)), signed(span_hash(prefix_hash(data, 1), at, at + length, 1))
    return *h, np.broadcast_to(np.asarray(doc, np.int64), at.shape).copy(), start, np.ones(len(at), np.int32), np.zeros(len(at), np.int32)


_EDGE = "t1 long, t2 long, doc_id long, start long, n int, part int, last boolean"


def _edge_batch(cols, part, last) -> pa.RecordBatch:
    n = len(cols[0])
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.int32()), pa.array([part] * n, pa.int32()), pa.array([last] * n, pa.bool_())], ["t1", "t2", "doc_id", "start", "n", "part", "last"])


def _joined(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Repeated windows with those that follow each other in one text as one row."""
    if not len(cols[0]):
        return cols
    order = np.lexsort((cols[3], cols[2]))
    doc, start = cols[2][order], cols[3][order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:] - 1, [len(doc) - 1]))
    zero = np.zeros(len(first), np.int64)
    return [zero, zero, doc[first], start[first], (start[last] - start[first] + 1).astype(np.int32)]


def _spans(column: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets and flat fields of an array of structs, without a Python object for each."""
    flat = column.flatten()
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.cumsum(n))), [f.to_numpy(zero_copy_only=False) for f in flat.flatten()]


def _again(cols: list[np.ndarray]) -> list[np.ndarray]:
    order = multikey_sort(cols[:4])
    cols = [c[order] for c in cols]
    same = (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1])
    again = np.concatenate((np.zeros(min(1, len(order)), bool), same)) | (cols[5] == DONE)
    return [c[again] for c in cols]


def _compare_windows(length: int):
    """A bucket of windows: repeats; and the first and last single window for the neighbouring buckets.

    Runs of one leading token are all in one bucket; of single windows equal ones may lie in several."""

    def of_runs(rows: list[tuple]) -> list[np.ndarray]:
        data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        size = np.array([len(r[3]) for r in rows])
        n = size - (length - 1)
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        step = np.arange(n.sum()) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
        return _again(list(_hashed(data, np.repeat(first, n) + step, length, np.repeat([r[1] for r in rows], n), np.repeat([r[2] for r in rows], n) + step)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        rows: list[tuple] = []
        held = 0
        single = []
        for b in batches:  # in the order of k1
            alone = b.column(7).is_null()
            w = b.filter(alone)
            if w.num_rows:
                single.append([w.column(k).to_numpy() for k in (0, 1, 4, 5)] + [np.ones(w.num_rows, np.int32), w.column(6).to_numpy()])
            r = b.filter(pc.invert(alone))
            for row in zip(*(r.column(k).to_pylist() for k in (0, 4, 5, 7))):
                if held >= HELD and rows[-1][0] != row[0]:
                    yield _edge_batch(_joined(of_runs(rows)), None, None)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[3])
        if rows:
            yield _edge_batch(_joined(of_runs(rows)), None, None)
        if single:
            cols = [np.concatenate(x) for x in zip(*single)]
            order = multikey_sort(cols[:4])
            for at, last in ((order[:1], False), (order[-1:], True)):
                yield _edge_batch([c[at] for c in cols], part, last)
            yield _edge_batch(_joined(_again(cols)), None, None)

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs(doc_id long, text binary)`` to ``(doc_id, start, n)``: windows at ``start .. start + n - 1``
    of the text also start earlier in the corpus (smaller id, or same text and smaller offset)."""
    n = shuffle_partitions(docs.sparkSession)
    suffixes = docs.mapInArrow(_suffixes(length, gram), _ROW)
    runs = stored(suffixes.repartitionByRange(n, "t1", "t2", "doc_id", "start").mapInArrow(_compare_runs, _ROW).select("t1", "doc_id", "start", "n", "state"), "runs")
    open_ = runs.where(F.col("state") == SORT).select("t1", "doc_id", "start", "n")
    crowds = open_.groupBy("t1").count().where(F.col("count") > CROWD).select("t1", F.lit(True).alias("crowded"))
    open_ = open_.join(crowds, "t1", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    open_ = open_.groupBy("doc_id").agg(F.collect_list(F.struct("t1", "start", "n", "crowded")).alias("spans"))
    windows = docs.join(open_.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "spans").mapInArrow(_opened(length), _OPEN)
    order = ["k1", "k2", "k3", "k4"]
    found = stored(windows.repartitionByRange(n, *order).sortWithinPartitions("k1").mapInArrow(_compare_windows(length), _EDGE), "windows")
    # two rows per bucket, whatever the input
    edges = found.where("part is not null")
    w = Window.orderBy("part", "last")
    before = edges.withColumns({f"b_{c}": F.lag(c).over(w) for c in ("t1", "t2", "last")})
    across = before.where("not last and b_last and t1 = b_t1 and t2 = b_t2").select("doc_id", "start", "n")
    return runs.where(F.col("state") == DONE).select("doc_id", "start", "n").unionByName(found.where("part is null").select("doc_id", "start", "n")).unionByName(across)


def _cutter(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            ends, (starts, counts) = _spans(b.column(2))
            for k, (i, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                t, cuts = t or b"", []
                if ends[k] < ends[k + 1]:
                    s = starts[ends[k] : ends[k + 1]]
                    e = s + counts[ends[k] : ends[k + 1]] + (length - 1)
                    order = np.argsort(s, kind="stable")
                    s, e = s[order], np.maximum.accumulate(e[order])
                    new = np.concatenate(([True], s[1:] > e[:-1]))
                    cuts = list(zip(s[new].tolist(), e[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(s) - 1]))].tolist()))
                kept, at = [], 0
                for lo, hi in cuts:
                    kept.append(t[at:lo])
                    at = hi
                kept.append(t[at:])
                text = b"".join(kept)
                for o, x in zip(out, (i, len(t), [{"start": lo, "end": hi} for lo, hi in cuts], text, hashlib.sha256(text).hexdigest())):
                    o.append(x)
            spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], spans_type), pa.array(out[3], pa.binary()), pa.array(out[4], pa.string())], ["doc_id", "n_bytes", "removed", "kept", "kept_sha256"])

    return run


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text without the bytes covered by a ``length``-byte string that also starts earlier.

    Returns ``(doc_id, n_bytes, removed, kept, kept_sha256)``: size in UTF-8 bytes, the maximal
    removed runs as ``[start, end)`` byte offsets, the remaining bytes and their SHA-256. Earlier
    means in a smaller id, or in the same text at a smaller offset; strings never cross texts and
    are judged on the input. A null text is empty; texts shorter than ``length`` stay whole. A row
    without an id comes before all others. Rows that repeat an id are one text: the least by bytes
    counts for all of them, and one row is returned. An empty table gives an empty result; other
    columns are ignored. Equality of strings is decided on two independent 64-bit hashes.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    lowest = -(2**63)
    rows = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(lowest)))
    repeated = rows.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.isEmpty():
        one = rows.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(b""))).alias("text"))
        rows = rows.join(repeated, "doc_id", "left_anti").unionByName(one)
    spans = repeated_spans(rows, length, gram).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    cut = rows.join(spans.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "spans")
    spans_type = "array<struct<start: bigint, end: bigint>>"
    out = cut.mapInArrow(_cutter(length), f"doc_id long, n_bytes long, removed {spans_type}, kept binary, kept_sha256 string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != lowest, F.col("doc_id")))


#: Every window of every text, for small tables.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, length(x) // 2 AS n, unnest(range(0, length(x) // 200 + 1)) AS c, x FROM d),
q AS (SELECT doc_id, n, c, substr(x, 200 * c + 1, 400) AS y FROM p),
w AS (SELECT doc_id, n, 100 * c + o AS i, md5(substr(y, 2 * o + 1, 200)) AS h FROM q, (SELECT unnest(range(100)) AS o) WHERE 100 * c + o + 100 <= n),
g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM w),
c AS (SELECT doc_id, i, i > max(i + 100) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS apart FROM g WHERE k > 1),
b AS (SELECT doc_id, i, sum(coalesce(apart, TRUE)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c),
r AS (SELECT doc_id, run, min(i) AS lo, max(i) + 100 AS hi FROM b GROUP BY doc_id, run),
o AS (SELECT doc_id, run, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS prev FROM r),
k AS (SELECT d.doc_id, string_agg(substr(x, 2 * prev + 1, 2 * (lo - prev)), '' ORDER BY lo) AS head, max(hi) AS last, count(*) AS n, sum(hi - lo) AS gone
      FROM o JOIN d ON d.doc_id = o.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
