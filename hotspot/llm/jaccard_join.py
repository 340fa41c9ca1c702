"""N-gram Jaccard self-join: MinHash LSH forest, then exact verification.

Rows of equal shingle sets become one representative. Every representative enters each of
``trees`` prefix tries with a signature of ``depth`` MinHash values per tree. The matched
prefix is shortened from ``depth`` until pairs at the threshold are met in some trie with
the target recall; a sort by (node at that length, remaining values) is the trie, and
one pass over it gives the candidates: all pairs below nodes of few members, chains of neighbours
below others. Candidates whose sizes or signatures are too far apart for the threshold are dropped,
the rest forms candidate groups. The pass also keeps the members of the nodes of many: there all pairs
of different groups are compared by sizes and signatures, block against block, and join their groups.
In the groups every pair is verified exactly on the shingle sets, block against block, giving counts
and spanning links only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotspot.llm.common import by_value, chunks, components, fresh, mix, shingle_sets, shuffle_partitions, signed, stored, unique_ids, with_row_key

by_value(__name__)

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 16, 8, 0.999
#: Probability that the signatures of a pair at the threshold agree too little for the pair to be pursued.
MISSED = 1e-6
#: Neighbours looked at in each trie order; members of a block in the exact step. Of the nodes of more
#: than ``NEAR + 1`` members, one in so many has its neighbours chained.
NEAR, BLOCK, CHAINED = 3, 256, 4
#: Members of a block of a crowded node, whose signatures are compared; of them, those compared at once.
CROWD, CHUNK = 4096, 256


def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Shorten the prefix from ``depth`` until ``1 - (1 - s^d)^trees`` reaches the recall at the threshold."""
    d = depth
    while d > 1 and 1 - (1 - threshold**d) ** trees < recall:
        d -= 1
    return d


def least_agreement(threshold: float = THRESHOLD, k: int = TREES * DEPTH, missed: float = MISSED) -> int:
    """The most equal values of ``k`` that a pair at the threshold falls short of with probability ``missed`` at most."""
    below, need = 0.0, 0
    while need < k and (below := below + math.comb(k, need) * threshold**need * (1 - threshold) ** (k - need)) <= missed:
        need += 1
    return need


def fingerprint(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def minhashes(values: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """``k`` MinHash values (32 bits each) of each set of 64-bit hashes; the sets, none empty, lie one after the other."""
    a = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    b = mix(np.arange(k + 1, 2 * k + 1, dtype=np.uint64))
    out = np.empty((k, len(starts)), np.uint64)
    h = np.empty_like(values)
    for i in range(k if len(starts) else 0):
        np.multiply(values, a[i], out=h)
        h += b[i]
        np.minimum.reduceat(h, starts, out=out[i])
    return np.ascontiguousarray((out >> np.uint64(32)).astype(np.uint32).T)


def _signer(words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, ns, sigs = [], [], []
            texts = b.column(1).to_pylist()
            for lo, hi in chunks(texts):
                values, at = shingle_sets(texts[lo:hi], words)
                size = np.diff(at)
                signed_ = iter(minhashes(values, at[:-1][size > 0], k))
                ns.extend(size.tolist())
                for i, n in enumerate(size.tolist()):
                    fps.append(fingerprint(values[at[i] : at[i + 1]]) if n else None)
                    sigs.append(next(signed_).tobytes() if n else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary()), pa.array(ns, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "fp", "n", "sig"])

    return run


def _planter(trees: int, depth: int, d: int):
    """One row per tree: the node of the first ``d`` values, the rest as an order key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, trees, depth).astype(np.uint64)
            n = len(sig)
            node = np.broadcast_to(mix(np.arange(trees, dtype=np.uint64) + np.uint64(7919)), (n, trees)).copy()
            for j in range(d):
                node = mix(node * np.uint64(31) + sig[:, :, j])
            rest = np.zeros((n, trees, 2), np.uint64)
            for q in range(2):
                for j in range(2):
                    at = d + 2 * q + j
                    rest[:, :, q] = (rest[:, :, q] << np.uint64(32)) | (sig[:, :, at] if at < depth else np.uint64(0))
            own = pa.array(np.repeat(b.column(0).to_numpy(zero_copy_only=False), trees))
            yield pa.RecordBatch.from_arrays([pa.array(signed(node.ravel())), pa.array(signed(rest[:, :, 0].ravel())), pa.array(signed(rest[:, :, 1].ravel())), own], ["node", "k1", "k2", "doc_id"])

    return run


_SCAN = "a long, b long, node long, doc_id long, edge boolean"
_SCANNED = ["a", "b", "node", "doc_id", "edge"]


def _neighbours(near: int):
    """Rows sorted by node to pairs and members: all pairs of a node of up to ``near + 1`` rows; of a node of
    more, all members, and successive ones as pairs if it is one of the chained. A node at either end of the
    partition may go on in the next: its members are given, as ``edge`` if they are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_n, held_d = np.zeros(0, np.int64), np.zeros(0, np.int64)
        # node and last member of a run that is given as it comes; whether the partition's first run is not over
        going: tuple[int, int] | None = None
        first = True
        for b in batches:
            node = np.concatenate((held_n, b.column(0).to_numpy()))
            doc = np.concatenate((held_d, b.column(1).to_numpy()))
            if not len(node):
                continue
            start = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            size = np.diff(np.append(start, len(node)))
            many = size > near + 1
            on = going is not None and going[0] == node[0]
            many[0] |= on
            first = first and (going is None or on)
            edge = np.zeros(len(size), bool)
            edge[0] = first and len(size) > 1 and not many[0]
            first = first and len(size) == 1
            # the last run may go on in the next batch: a short one is held until it is over
            cut = len(node) if many[-1] else int(start[-1])
            chain = np.repeat(many, size)[:cut] & (node[:cut] % CHAINED == 0)
            given = np.repeat(many | edge, size)[:cut]
            a, c = [], []
            for g in range(1, min(near, cut - 1) + 1):
                same = node[g:cut] == node[: cut - g]
                at = np.flatnonzero(same & (~given[g:] | chain[g:] if g == 1 else ~given[g:]))
                a.append(doc[at])
                c.append(doc[at + g])
            if on and chain[0]:
                a.append(np.array([going[1]]))
                c.append(doc[:1])
            a, c = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, c))
            none = pa.nulls(len(a))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.bool_())], _SCANNED)
            yield _members(node[:cut][given], doc[:cut][given], np.repeat(edge, size)[:cut][given])
            going = (int(node[-1]), int(doc[-1])) if many[-1] else None
            held_n, held_d = node[cut:], doc[cut:]
        yield _members(held_n, held_d, np.ones(len(held_n), bool))

    return run


def _members(node: np.ndarray, doc: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(node)).cast(pa.int64())
    return pa.RecordBatch.from_arrays([none, none, pa.array(node), pa.array(doc), pa.array(edge)], _SCANNED)


def forest(reps: DataFrame, trees: int, depth: int, d: int) -> DataFrame:
    """One pass over the sorted tries of ``reps(doc_id, sig)``, written: pairs ``(a, b)``, and members
    ``(node, doc_id, edge)`` of nodes of more than ``NEAR + 1`` rows or at a border of partitions."""
    spark = reps.sparkSession
    rows = reps.select("doc_id", "sig").mapInArrow(_planter(trees, depth, d), "node long, k1 long, k2 long, doc_id long")
    order = ["node", "k1", "k2", "doc_id"]
    # sampled splitters also cut a crowded node, hence the edge rows
    sorted_rows = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    return stored(sorted_rows.select("node", "doc_id").mapInArrow(_neighbours(NEAR), _SCAN), "forest")


def candidate_pairs(scan: DataFrame) -> DataFrame:
    """Distinct candidate pairs ``(a, b)``, ``a < b``, of a ``forest``, linear in its input: all pairs below nodes
    of up to ``NEAR + 1`` members, chains below one in ``CHAINED`` of the others (``crowded_pairs``)."""
    # a few rows per partition, whatever the input
    edge = scan.where("edge").select("node", "doc_id")
    across = edge.withColumnRenamed("doc_id", "a").join(edge.withColumnRenamed("doc_id", "b"), "node").where("a < b").select("a", "b")
    pairs = scan.where("a is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.unionByName(across).distinct()


def _agree(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint32).reshape(b.num_rows, -1) for i in (2, 3))
            keep = pa.array((x == y).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    return run


def close_pairs(reps: DataFrame, threshold: float, trees: int, depth: int, d: int, scan: DataFrame | None = None) -> DataFrame:
    """Candidate pairs ``(a, b)`` of ``reps(doc_id, sig, n)``, or of their ``forest`` if it is there, that sizes
    and signatures do not rule out."""
    pairs = candidate_pairs(scan if scan is not None else forest(reps, trees, depth, d))
    sa, sb = (reps.select(F.col("doc_id").alias(c), F.col("sig").alias(f"s{c}"), F.col("n").alias(f"n{c}")) for c in ("a", "b"))
    # a set has at least that share of the other's size; then their signatures are compared
    alike = pairs.join(sa, "a").join(sb, "b").where(F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)
    return alike.select("a", "b", "sa", "sb").mapInArrow(_agree(least_agreement(threshold, trees * depth)), "a long, b long")


def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _linker(threshold: float, least: int):
    """Spanning links between the labels in each (node, lo, hi) block pair, by sizes and signatures of all
    pairs of different labels; rows arrive sorted by it and by label."""

    def links(rows: list[tuple]) -> tuple[list, list]:
        lo, hi = rows[0][1:3]
        names, label = np.unique(np.array([r[4] for r in rows], np.int64), return_inverse=True)
        block = np.array([r[3] for r in rows])
        size = np.array([r[5] for r in rows], np.float64)
        sig = np.frombuffer(b"".join(r[6] for r in rows), np.uint32).reshape(len(rows), -1)
        # equal values have equal low bytes, which are compared first
        low = sig.astype(np.uint8)
        parent = list(range(len(names)))
        a, b = [], []
        # one block with itself, or the one with the other
        left, right = (np.flatnonzero(block == x) for x in (lo, hi))
        for p in range(0, len(left), CHUNK):
            i = left[p : p + CHUNK]
            x = np.ascontiguousarray(low[i].T)
            for q in range(p if lo == hi else 0, len(right), CHUNK):
                j = right[q : q + CHUNK]
                open_ = label[i][:, None] != label[j][None, :]
                if not open_.any():
                    continue
                smaller, larger = np.minimum(size[i][:, None], size[j][None, :]), np.maximum(size[i][:, None], size[j][None, :])
                open_ &= smaller >= threshold * larger - 1e-9
                if not open_.any():
                    continue
                # rows and columns without an open pair need no comparison
                rows_, cols = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
                same = np.zeros((len(rows_), len(cols)), np.uint8 if sig.shape[1] < 256 else np.uint16)
                equal = np.empty(same.shape, bool)
                for u, v in zip(x[:, rows_], low[j[cols]].T):
                    np.equal(u[:, None], np.ascontiguousarray(v)[None, :], out=equal)
                    same += equal.view(np.uint8)
                u, v = np.nonzero(open_[np.ix_(rows_, cols)] & (same >= least))
                u, v = rows_[u], cols[v]
                keep = [(sig[i[u[w : w + 4096]]] == sig[j[v[w : w + 4096]]]).sum(axis=1) >= least for w in range(0, len(u), 4096)]
                if not any(k.any() for k in keep):
                    continue
                keep = np.concatenate(keep)
                u, v = u[keep], v[keep]
                for u, v in np.unique(np.stack((label[i][u], label[j][v]), axis=1), axis=0).tolist():
                    u, v = _root(parent, u), _root(parent, v)
                    if u != v:
                        parent[max(u, v)] = min(u, v)
                        a.append(int(names[u]))
                        b.append(int(names[v]))
                # labels joined here are one from now on
                label = np.array([_root(parent, k) for k in range(len(names))])[label]
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: tuple[list, list] = ([], [])

        def flush() -> None:
            if len(held) > 1:
                for o, x in zip(out, links(held)):
                    o.extend(x)
            held.clear()

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if held and held[0][:3] != row[:3]:
                    flush()
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])
            out = ([], [])
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])

    return run


def crowded_pairs(reps: DataFrame, near: DataFrame, scan: DataFrame, threshold: float, trees: int, depth: int) -> DataFrame:
    """Pairs ``(a, b)`` of the labels of ``near(node, label)`` (a row of ``reps`` without one is its own) that span
    all pairs below one node of the ``forest`` which sizes and signatures do not rule out. Pairs below nodes of up
    to ``NEAR + 1`` members are known; of the others those of different labels are compared."""
    spark = reps.sparkSession
    nodes = scan.where("a is null").select("node", "doc_id").join(near.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    nodes = nodes.select("node", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    crowds = nodes.groupBy("node").agg(F.count("*").alias("members"), F.min("label").alias("least"), F.max("label").alias("most"))
    crowds = stored(crowds.where((F.col("members") > NEAR + 1) & (F.col("least") < F.col("most"))).select("node", F.ceil(F.col("members") / F.lit(CROWD)).cast("int").alias("blocks")), "crowds")
    members = nodes.join(crowds, "node").join(reps, "doc_id")
    mine = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    dealt = members.withColumn("block", mine).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("node", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "label", "n", "sig")
    key = ["node", "lo", "hi"]
    rows = dealt.repartition(shuffle_partitions(spark), *key).sortWithinPartitions(*key, "label")
    return rows.mapInArrow(_linker(threshold, least_agreement(threshold, trees * depth)), "a long, b long").distinct()


def candidate_groups(reps: DataFrame, threshold: float, trees: int, depth: int, d: int) -> DataFrame:
    """``(node, label)``: groups of ``reps(doc_id, sig, n)`` that hold every pair below one node which sizes
    and signatures do not rule out."""
    scan = forest(reps, trees, depth, d)
    near = components(close_pairs(reps, threshold, trees, depth, d, scan))
    joined = components(crowded_pairs(reps, near, scan, threshold, trees, depth))
    alone = joined.select("node").join(near, "node", "left_anti").select("node", F.col("node").alias("label"))
    wider = joined.select(F.col("node").alias("label"), F.col("label").alias("wide"))
    return near.unionByName(alone).join(wider, "label", "left").select("node", F.coalesce("wide", "label").alias("label"))


def _set_maker(words: int):
    """Shingle sets of the group members; a row of a repeated id whose text is not the one kept goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, sets = [], []
            texts, fps = b.column(1).to_pylist(), b.column(2).to_pylist()
            for lo, hi in chunks(texts):
                values, at = shingle_sets(texts[lo:hi], words)
                for i in range(lo, hi):
                    s = values[at[i - lo] : at[i - lo + 1]]
                    if len(s) and fingerprint(s) == fps[i]:
                        keep.append(i)
                        sets.append(s.tobytes())
            rows = b.take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sets, pa.binary()), *(rows.column(i) for i in range(3, 6))], ["doc_id", "words", "copies", "label", "blocks"])

    return run


def _matches(sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of Jaccard similarity at or above the threshold."""
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.concatenate(([True], values[1:] != values[:-1]))
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    both = np.zeros((len(sets), len(sets)), np.float64)
    if len(column):
        column = np.cumsum(np.concatenate(([0], column[1:] != column[:-1]))).astype(np.int64)
        for lo in range(0, int(column[-1]) + 1, 8192):
            a, z = np.searchsorted(column, (lo, lo + 8192))
            x = np.zeros((len(sets), 8192 if column[-1] >= lo + 8192 else int(column[-1]) - lo + 1), np.float32)
            x[owner[a:z], column[a:z] - lo] = 1
            both += x @ x.T
    union = n[:, None] + n[None, :] - both
    i, j = np.nonzero(np.triu(both >= threshold * union - 1e-9, 1))
    return i, j


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index of the component of each of ``n`` nodes, joined by pairs ``(i, j)``."""
    root = np.arange(n)
    while True:
        u, v = root[i], root[j]
        apart = u != v
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(u, v)[apart], np.minimum(u, v)[apart])
        while (root[root] != root).any():
            root = root[root]


def _verifier(threshold: float):
    """Exact links in each (label, lo, hi) block pair; rows arrive sorted by it. Out: link counts and spanning links."""

    def links(rows: list[tuple]) -> tuple[list, list, list]:
        label, lo, hi = rows[0][:3]
        i, j = _matches([np.frombuffer(r[5], np.uint64) for r in rows], threshold)
        block = np.array([r[3] for r in rows])
        if lo != hi:
            cross = block[i] != block[j]
            i, j = i[cross], j[cross]
        if not len(i):
            return [], [], []
        copies = np.array([r[6] for r in rows])
        count = np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
        root = _roots(len(rows), i, j)
        own = np.flatnonzero(count).tolist()
        return [rows[x][4] for x in own], [rows[root[x]][4] for x in own], [int(count[x]) for x in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: tuple[list, list, list] = ([], [], [])

        def flush() -> None:
            if len(held) > 1:
                for o, x in zip(out, links(held)):
                    o.extend(x)
            held.clear()

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(7))):
                if held and held[0][:3] != row[:3]:
                    flush()
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "root", "links"])
            out = ([], [], [])
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "root", "links"])

    return run


def jaccard_join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate classes of the word-shingle sets: ``(doc_id, class_id, n_links, rep_id)``.

    One row per distinct ``doc_id``: the smallest id of its connected component of links
    (Jaccard similarity of the sets >= ``threshold``), the number of other documents linked to
    it, and the smallest id of an equal shingle set. Words are runs without ASCII white space,
    lower-cased; a text of fewer than ``words`` words has one shingle. Null, empty and blank
    texts have no shingle and are linked to nothing. A row without an id is left out. Rows that
    repeat an id are one document, whose text is that of least set fingerprint. An empty table
    gives an empty result. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    d = prefix_length(threshold, trees, depth, recall)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    sig = stored(own.mapInArrow(_signer(words, trees * depth), "doc_id long, fp binary, n long, sig binary"), "signatures")
    ids = sig.groupBy("doc_id").agg(F.min("fp").alias("fp"))
    classes = stored(ids.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("rep_id"), F.count("*").alias("copies")), "sets")
    # an id has one fingerprint in ``classes``
    reps = sig.join(classes, (sig.fp == classes.fp) & (sig.doc_id == classes.rep_id)).select(sig.fp, "doc_id", "sig", "n").dropDuplicates(["fp", "doc_id"])
    reps = stored(reps.select("doc_id", "sig", "n"), "representatives")
    groups = candidate_groups(reps, threshold, trees, depth, d)
    sizes = groups.groupBy("label").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    members = groups.join(sizes, "label").join(classes, groups.node == classes.rep_id).select(F.col("node").alias("doc_id"), "fp", "copies", "label", "blocks")
    sets = own.join(members.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "fp", "copies", "label", "blocks").mapInArrow(_set_maker(words), "doc_id long, words binary, copies long, label long, blocks int")
    mine = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    dealt = sets.withColumn("block", mine).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("label", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "doc_id", "words", "copies")
    key = ["label", "lo", "hi"]
    found = stored(dealt.repartition(shuffle_partitions(spark), *key).sortWithinPartitions(*key).mapInArrow(_verifier(threshold), "doc_id long, root long, links long"), "links")
    counts = found.groupBy("doc_id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("doc_id").alias("a"), F.col("root").alias("b")))
    known = classes.join(counts, classes.rep_id == counts.doc_id, "left").drop("doc_id").join(roots, F.col("rep_id") == roots.node, "left")
    known = known.select("fp", "rep_id", F.coalesce("label", "rep_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = ids.join(known, "fp", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("rep_id", "doc_id").alias("rep_id"))


def keep_one(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without all but the first document of each class.

    Of equal rows of a kept id one stays; rows that repeat it with other columns all stay, as
    ``classes`` tells nothing of them (``one_of_each_class`` does). Rows without an id are no
    document of any class and stay.
    """
    dropped = classes.where("doc_id <> class_id").select(F.col("doc_id").alias(id_col))
    repeated = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col)
    left = docs.join(dropped, id_col, "left_anti")
    once = left.join(repeated, id_col, "left_anti")
    again = left.join(repeated, id_col, "left_semi").dropDuplicates()
    return once.select(*docs.columns).unionByName(again.select(*docs.columns))


def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row of ``docs``, that of least id, of each class of near duplicates among all its rows.

    Every row is a document by itself, decided by its own text, with null or repeated ids as well;
    among rows of the same id the first by a hash of the columns stays, and any id comes before none.
    Rows without a word are alike to nothing and stay. Only where ids repeat or are missing are the
    rows written with a number each; elsewhere the id is that number.
    """
    if unique_ids(docs, id_col):
        dropped = stored(jaccard_join(docs, id_col=id_col, **options), "classes").where("doc_id <> class_id")
        return docs.join(dropped.select(F.col("doc_id").alias(id_col)), id_col, "left_anti").select(*docs.columns)
    row, content = fresh("row"), fresh("content")
    rows = with_row_key(docs, row, content)
    classes = stored(jaccard_join(rows, id_col=row, **options), "classes").where("n_links > 0")
    members = rows.select(row, content, F.col(id_col).alias("id")).join(classes.select(F.col("doc_id").alias(row), "class_id"), row)
    members = stored(members, "members")
    first = members.groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull(), "id", content, row)).alias("first"))
    dropped = members.join(first.select(F.col("first")[row].alias(row)), row, "left_anti").select(row)
    return rows.join(dropped, row, "left_anti").select(*docs.columns)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' '))) AS g
      FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS fp FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, label) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(label) AS label FROM r GROUP BY node),
k AS (SELECT a, count(*) AS n FROM e GROUP BY a),
f AS (SELECT fp, min(doc_id) AS rep FROM n GROUP BY fp)
SELECT c.node AS doc_id, c.label AS class_id, coalesce(k.n, 0)::BIGINT AS n_links, coalesce(f.rep, c.node) AS rep_id
FROM c LEFT JOIN k ON k.a = c.node LEFT JOIN n ON n.doc_id = c.node LEFT JOIN f ON f.fp = n.fp
"""
