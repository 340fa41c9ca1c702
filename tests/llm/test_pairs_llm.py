"""Jaccard join, suffix dedup and piecewise fingerprints against brute force and on edge cases."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from hotspot.llm.common import chunks, components, shingle_sets, shingles
from hotspot.llm.ctph import edit_distance, edited_fingerprints, fingerprint, fingerprints, likeness
from hotspot.llm.jaccard_join import DEPTH, THRESHOLD, TREES, _matches, _neighbours, _roots, _signer, candidate_groups, candidate_pairs, close_pairs, forest, jaccard_join, keep_one, least_agreement, one_of_each_class, prefix_length
from hotspot.llm.suffix_dedup import multikey_sort, suffix_dedup

SCHEMA = "doc_id long, text string, fp string, label long, copies string, b int, start int"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, 3) for i, t in rows], SCHEMA).repartition(3)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def brute_classes(rows, k=5, least=0.8):
    docs = {}
    for i, t in rows:
        w = (t or "").lower().split()
        docs[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    ids = sorted(docs)
    links = {i: [j for j in ids if j != i and docs[i] and docs[j] and len(docs[i] & docs[j]) >= least * len(docs[i] | docs[j])] for i in ids}
    label = {i: i for i in ids}
    for _ in ids:
        for i in ids:
            for j in links[i]:
                label[i] = label[j] = min(label[i], label[j])
    return {i: (label[i], len(links[i])) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    base = words(rng, 120).split()
    for i in range(40):  # near copies of one text, not all near each other
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = words(rng, 1)
        rows.append((i, " ".join(w)))
    rows += [(100 + i, words(rng, rng.randint(1, 60))) for i in range(40)]
    rows += [(200 + i, rows[45][1].upper()) for i in range(5)]
    return rows + [(300, ""), (301, None), (302, " \n\t"), (303, "one two"), (304, "One  Two"), (305, words(rng, 20_000))]


def test_jaccard_join_matches_brute_force(spark):
    rows = corpus(1)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join(make(spark, rows)).collect()}
    assert got == brute_classes(rows)
    assert got[303] == got[304] == (303, 1) and got[300] == (300, 0)


def test_jaccard_join_repeated_null_and_empty(spark):
    out = jaccard_join(make(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")])).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in out) == [(1, 1, 1), (2, 1, 1)]
    assert jaccard_join(make(spark, [])).collect() == []


def test_keep_one(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "q"), (2, "a b c d e f"), (3, "z")]
    docs = make(spark, rows)
    kept = keep_one(docs, jaccard_join(docs))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3]


def test_one_of_each_class_decides_every_row(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "g h i j k l"), (1, "m n o p q"), (2, "a b c d e f"), (2, "r s t u v"), (None, "m n o p q"), (None, "w x"), (4, "w x"), (5, None)]
    docs = make(spark, rows)
    for df in (docs, docs.repartition(3)):
        kept = one_of_each_class(df)
        assert kept.columns == docs.columns
        want = [(1, "a b c d e f"), (1, "g h i j k l"), (1, "m n o p q"), (2, "r s t u v"), (4, "w x"), (5, None)]
        assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted((i, t or "") for i, t in want)


def test_prefix_is_shortened_to_the_recall():
    d = prefix_length(0.8, 16, 8, 0.999)
    assert 1 - (1 - 0.8**d) ** 16 >= 0.999 > 1 - (1 - 0.8 ** (d + 1)) ** 16


def test_least_agreement_misses_one_in_a_million():
    short = lambda n: sum(math.comb(128, i) * 0.8**i * 0.2 ** (128 - i) for i in range(n))
    assert short(least_agreement()) <= 1e-6 < short(least_agreement() + 1)
    assert least_agreement(1.0) == 128


def test_texts_of_one_template_form_no_groups(spark):
    """60 of 100 shingles are everybody's (similarity 0.43); only planted copies, one word added, are alike."""
    rng = random.Random(6)
    common = words(rng, 64).split()
    texts = [" ".join(common + [f"w{rng.randrange(10**9)}" for _ in range(40)]) for _ in range(3000)]
    texts += [t + " more" for t in texts[:100]]
    docs = make(spark, list(enumerate(texts)))
    sig = docs.select("doc_id", "text").mapInArrow(_signer(5, TREES * DEPTH), "doc_id long, fp binary, n long, sig binary")
    close = {(r.a, r.b) for r in close_pairs(sig.select("doc_id", "sig", "n"), THRESHOLD, TREES, DEPTH, prefix_length()).collect()}
    planted = {(k, 3000 + k) for k in range(100)}
    assert planted <= close and len(close) < 200
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join(docs).collect()}
    assert got == {i: (i % 3000, int(i < 100 or i >= 3000)) for i in range(3100)}


def template_rows(n, copies, seed):
    """``n`` texts of one template, no two linked, in which ``copies`` have a linked copy; and what the join returns."""
    rng = random.Random(seed)
    base = words(rng, 399).split()
    ids = rng.sample(range(10**6), n + copies)
    texts = []
    for i in range(n):  # seven words apart: 35 shingles of 395 lost, similarity about 0.7
        w = list(base)
        for at in range(0, 399, 57):
            w[at + rng.randrange(50)] = f"u{i}x{at}"
        texts.append(w)
    for i in range(copies):  # six more: similarity at least 0.85
        texts.append([f"v{i}x{k}" if k in at else x for at in [rng.sample(range(399), 6)] for k, x in enumerate(texts[i])])
    alike = {i: n + i for i in range(copies)}
    alike |= {b: a for a, b in alike.items()}
    expect = {ids[i]: (min(ids[i], ids[alike.get(i, i)]), int(i in alike)) for i in range(n + copies)}
    return [(ids[i], " ".join(w)) for i, w in enumerate(texts)], expect


def test_alike_signatures_far_apart_in_a_crowded_node_are_grouped(spark):
    """Rows 0 and 11 meet below one node only, with ten unlike rows between them in its order."""
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 2**32, (12, TREES, DEPTH), dtype=np.uint32)
    sig[:, 0] = sig[0, 0]
    sig[11, 1:, 1:] = sig[0, 1:, 1:]
    reps = spark.createDataFrame([(i, bytearray(sig[i].tobytes()), 100) for i in range(12)], "doc_id long, sig binary, n long")
    of = (THRESHOLD, TREES, DEPTH, prefix_length())
    assert close_pairs(reps, *of).collect() == []
    assert sorted(map(tuple, candidate_groups(reps, *of).collect())) == [(0, 0), (11, 0)]


def test_crowds_are_compared_block_against_block(spark, monkeypatch):
    from hotspot.llm import jaccard_join as module

    monkeypatch.setattr(module, "CROWD", 16)
    monkeypatch.setattr(module, "CHUNK", 5)
    rows, expect = template_rows(90, 15, 12)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join(make(spark, rows)).collect()}
    assert got == expect


def test_near_copies_give_few_pairs_and_one_group(spark):
    """A document of a large node enters no pair for each of its neighbours in each tree, only those of a few chains."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32)
    sigs = [np.where(rng.random(len(base)) < 0.03, rng.integers(0, 2**32, len(base), dtype=np.uint32), base) for _ in range(400)]
    reps = spark.createDataFrame([(i, bytearray(x.tobytes()), 100) for i, x in enumerate(sigs)], "doc_id long, sig binary, n long")
    of = (THRESHOLD, TREES, DEPTH, prefix_length())
    assert close_pairs(reps, *of).count() < 400 * 5  # by three neighbours in every tree: 4,221
    assert candidate_pairs(forest(reps, *of[1:])).count() < 400 * 5
    assert sorted(map(tuple, candidate_groups(reps, *of).collect())) == [(i, 0) for i in range(400)]


@pytest.mark.parametrize("batch", [1, 3, 7, 1000])
def test_forest_pass_covers_every_node(batch):
    """Whatever the cuts between batches and partitions: a node's pairs are given, or all of its members."""
    rng = random.Random(batch)
    node = sorted(x for x in range(60) for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 9, 30])))
    rows = [(x, i) for i, x in enumerate(node)]
    rng = np.random.default_rng(batch)
    cuts = [0, *sorted(rng.integers(0, len(rows), 5).tolist()), len(rows)]
    pairs, members, edge = set(), {}, {}
    for lo, hi in zip(cuts, cuts[1:]):
        part = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[at : min(at + batch, hi)]], pa.int64()) for k in (0, 1)], ["node", "doc_id"]) for at in range(lo, hi, batch)]
        for out in _neighbours(3)(iter(part)):
            for r in out.to_pylist():
                if r["a"] is not None:
                    assert node[r["a"]] == node[r["b"]] and r["a"] < r["b"]
                    pairs.add((r["a"], r["b"]))
                else:
                    members.setdefault(r["node"], []).append(r["doc_id"])
                    if r["edge"]:
                        edge.setdefault(r["node"], []).append(r["doc_id"])
    pairs |= {(x, y) for m in edge.values() for x in m for y in m if x < y}
    for x in set(node):
        own = [i for i, y in enumerate(node) if y == x]
        if len(own) > 4:
            assert sorted(members[x]) == own
        else:
            assert {(i, j) for i in own for j in own if i < j} <= pairs
    assert sum(len(m) for x, m in members.items() if node.count(x) < 5) <= 8 * len(cuts)


def test_roots_span_the_pairs():
    rng = np.random.default_rng(7)
    for n, m in ((1, 0), (50, 20), (200, 150), (300, 2000)):
        i, j = rng.integers(0, n, m), rng.integers(0, n, m)
        want = list(range(n))
        for _ in range(n):
            for x, y in zip(i.tolist(), j.tolist()):
                want[x] = want[y] = min(want[x], want[y])
        assert _roots(n, i, j).tolist() == want
    assert _roots(300, np.arange(299), np.arange(1, 300)).tolist() == [0] * 300


@pytest.mark.parametrize("k", [1, 3, 5])
def test_shingle_sets_are_those_of_each_text(k):
    rng = random.Random(k)
    texts = [None, "", " \n\t", "a", "A  b", "one two three four five six", "ß ΑΣ ΑΣ\x1fx", "\ud800 y", "z " * 9]
    texts += [words(rng, rng.randint(0, 12)) for _ in range(40)] + [words(rng, 3000), None]
    for chars in (1, 200, 1 << 17):
        got = []
        for lo, hi in chunks(texts, chars):
            values, at = shingle_sets(texts[lo:hi], k)
            got += [values[x:y].tolist() for x, y in zip(at, at[1:])]
        assert got == [shingles(t, k).tolist() for t in texts]


def test_matches_are_exact_over_column_chunks():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    sets = [np.unique(base[rng.random(len(base)) < p]) for p in (1.0, 0.95, 0.9, 0.85, 0.5)]
    i, j = _matches(sets, 0.8)
    want = {(x, y) for x in range(5) for y in range(x + 1, 5) if len(np.intersect1d(sets[x], sets[y])) >= 0.8 * len(np.union1d(sets[x], sets[y]))}
    assert set(zip(i.tolist(), j.tolist())) == want and want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 30)] + [(7, 7)]
    random.Random(3).shuffle(edges)
    got = dict((r.node, r.label) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(30)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_dedup(rows, length):
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(b[s : s + length])
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(b), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("length", "gram"), [(100, 32), (24, 8)])
def test_suffix_dedup_matches_brute_force(spark, length, gram):
    rng = random.Random(length)
    common = words(rng, 40)
    rows = [(i, words(rng, rng.randint(0, 40)) + " " + common[rng.randrange(60) :] + words(rng, 30)) for i in range(150)]
    rows += [(200, "a" * 5000), (201, "ab" * 700 + "c" + "ab" * 700), (202, ""), (203, None), (204, rows[0][1]), (205, rows[3][1][40:300]), (206, "é" * 400), (207, words(rng, 15_000))]
    got = {r.doc_id: (r.n_bytes, len(r.removed), r.kept_sha256) for r in suffix_dedup(make(spark, rows), length, gram).collect()}
    assert got == brute_dedup(rows, length)


def test_suffix_dedup_spans_kept_text_and_edges(spark):
    text = "".join(random.Random(8).choices("abcdefghij", k=300))
    out = {r.doc_id: r for r in suffix_dedup(make(spark, [(2, text + "!"), (1, text), (None, text), (2, text + "!")])).collect()}
    assert len(out) == 3 and out[None].removed == []
    assert [tuple(x) for x in out[1].removed] == [(0, 300)] and out[1].kept == b""
    assert bytes(out[2].kept) == b"!"
    assert suffix_dedup(make(spark, [])).collect() == []


def test_multikey_sort_is_lexicographic():
    rng = np.random.default_rng(5)
    cols = [rng.integers(0, 4, 500) for _ in range(4)]
    got = [tuple(c[i] for c in cols) for i in multikey_sort(cols)]
    assert got == sorted(zip(*cols))


def test_edit_distance():
    def plain(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    rng = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 70))) for _ in range(2))
        assert edit_distance(a, b) == plain(a, b)


def test_fingerprint_likeness():
    rng = random.Random(6)
    a, b = words(rng, 3000), words(rng, 3000)
    x = fingerprint(a.encode())
    assert likeness(x, fingerprint(a.encode())) == 1.0 and likeness(x, fingerprint(b.encode())) == 0.0
    assert likeness(x, fingerprint((a[:9000] + "changed" + a[9010:]).encode())) > 0.9
    assert fingerprint(b"") == "3::" and likeness("3::", "3::") == 1.0


def test_edited_fingerprints_walk_in_id_order(spark):
    rng = random.Random(7)
    rows = [(i, words(rng, rng.randint(1, 80))) for i in range(0, 200, 2)] + [(1, ""), (3, None), (5, "ß" * 50)]
    got = {r.doc_id: r for r in edited_fingerprints(make(spark, rows)).collect()}
    rows = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 4
        edited = (t[: len(t) - cut] + nxt[:cut]).encode()
        own = fingerprint(t.encode())
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited).hexdigest(), own, fingerprint(edited))
        assert r.near_edited == likeness(own, fingerprint(edited)) and r.near_next == likeness(own, fingerprint(nxt.encode()))


def test_edited_fingerprints_edges(spark):
    assert edited_fingerprints(make(spark, [])).collect() == []
    one = edited_fingerprints(make(spark, [(9, "abcdefgh")])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    out = edited_fingerprints(make(spark, [(1, "bb"), (1, "aa"), (None, "cccc")])).collect()
    assert sorted(((r.doc_id or 0), r.n_chars) for r in out) == [(0, 4), (1, 2), (1, 2)]
    assert {r.doc_id: r.fingerprint for r in fingerprints(make(spark, [(1, "x"), (2, None)])).collect()} == {1: fingerprint(b"x"), 2: "3::"}
