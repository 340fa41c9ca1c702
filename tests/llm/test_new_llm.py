"""Fill-in-middle, source divergence and exact top-k search on hand-made rows, against plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from hotspot.llm import topk_search
from hotspot.llm.divergence import source_divergence
from hotspot.llm.fill_middle import cut, fill_in_middle, restore, restored
from hotspot.llm.topk_search import top_k

# fill in middle


def plain_fim(doc_id, text, seed=7, fim=100, spm=50):
    """The contract, on strings."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim:
        return len(units), "plain", None, None, text
    if h4 % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def fim_rows():
    rng = random.Random(3)
    lines = ["a\n", "\n", "é\U0001f600x\n", "<P\n", "S>\n", "\r\n", "  y\n", "<"]
    texts = [None, "", "one", "\n", "<S>in\n", "a\nb<M", *("".join(rng.choices(lines, k=rng.randint(1, 12))) for _ in range(60)), "long line " * 200_000 + "\n" + "x\n" * 100_000]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "no\nid\n"), (7, "again\nagain\n"), (7, "again\nagain\n"), (-5, "minus\n" * 3)]


@pytest.mark.parametrize("rates", [(100, 50), (40, 100), (0, 50)])
def test_fill_in_middle(spark, rates):
    rows = fim_rows()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, output string, n int")
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.output_sha256, r.restored_sha256) for r in fill_in_middle(df, fim=rates[0], spm=rates[1]).collect()), key=str)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted(((i, *(x := plain_fim(i, t, 7, *rates)), sha(x[4]), sha(t or "")) for i, t in rows), key=str)
    assert got == want


def test_fill_in_middle_round_trip_and_edges(spark):
    rows = fim_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    back = restored(fill_in_middle(df, seed=11)).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    chars = fill_in_middle(df, unit="char").collect()
    assert sorted((str(r.doc_id), r.n) for r in chars) == sorted((str(i), len(t or "")) for i, t in rows)
    assert all(r.restored_sha256 == hashlib.sha256(t.encode()).hexdigest() for r in chars for t in [dict(rows)[r.doc_id] or ""] if r.doc_id != 7)
    bare = fill_in_middle(df, outputs=False).collect()
    assert len(bare) == len(rows) and all(r.output is None and r.pieces is None for r in bare)
    assert fill_in_middle(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        fill_in_middle(df, unit="page")


def test_pieces():
    whole = [(0, 0, 4), (1, 0, 3), (0, 10, 5)]
    spans = cut(whole, 2, 6)
    assert spans == [[(0, 0, 2)], [(0, 2, 2), (1, 0, 2)], [(1, 2, 1), (0, 10, 5)]]
    assert cut(whole, 0, 12) == [[], whole, []] and cut([], 0, 0) == [[], [], []] and cut(whole, 4, 4)[1] == []
    assert restore(b"<P><S><M>", "psm") == [] and restore(b"<S>c<P>a<M>b", "spm") == [(0, 7, 1), (0, 11, 1), (0, 3, 1)]
    with pytest.raises(ValueError):
        restore(b"<P>a<M>b", "psm")


# source divergence


def plain_divergence(rows, least=3, most=200):
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= least}
        sources = {d[1] for d in own}
        n = {s: Counter(t for d in own if d[1] == s for t in d[2] if t in kept) for s in sources}
        total = sum(n.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))
        gap = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            p = {t: share(n[s], t) for t in kept}
            pairs = [(sum(gap(p[t], share(n[o], t)) for t in kept), o) for o in sources if o != s]
            marked = [(gap(p[t], share(total, t)), t) for t in kept if n[s][t] and p[t] > share(total, t)]
            for part, found in (("pair", pairs), ("term", marked)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(found, 1) if part == "pair" or k <= most]
    return sorted(out)


def divergence_rows():
    rng = random.Random(5)
    vocabulary = ["the", "The", "éa", "Éa", "z", "zz", "naïve", "x1y", "\U0001f600", " ", *(f"w{chr(97 + a)}{chr(97 + b)}" for a in range(9) for b in range(9))]
    rows = []
    for _ in range(400):
        source = rng.choice(["a", "a", "a", "b", "c", "ß", None, ""])
        rows.append((rng.choice(["en", "en", "de", None]), source, " ".join(rng.choices(vocabulary[: rng.choice([5, 30, 91])], k=rng.randint(0, 30)))))
    rows += [("en", s, "copied text of the same words") for s in ("a", "b", "b", "c", "only") for _ in range(40)]
    rows += [("xx", "p", "alone words"), ("xx", "q", None), ("yy", "p", "1 2 3"), ("zz", "p", "one"), ("zz", "p", "one"), ("zz", "p", "one one"), ("zz", "q", "two")]
    return rows + [("en", "long", "Long_words and-others " * 50_000)]


def test_source_divergence(spark):
    rows = divergence_rows()
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "lang string, source string, text string, n int, term string").repartition(7)
    got = source_divergence(df)
    assert sorted(map(tuple, got.collect())) == plain_divergence(rows)
    assert sorted(map(tuple, source_divergence(df, least_docs=1, most_terms=3).collect())) == plain_divergence(rows, 1, 3)
    assert source_divergence(df.limit(0)).collect() == []


def test_source_divergence_of_many_sources_in_small_steps(spark, monkeypatch):
    from hotspot.llm import divergence

    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "PAIRS", 40)
    rng = random.Random(8)
    rows = [("l", f"s{rng.randint(0, 30)}", " ".join(rng.choices(["aa", "bb", "cc", "dd", "ee", "ff"], k=4))) for _ in range(500)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert sorted(map(tuple, source_divergence(df).collect())) == plain_divergence(rows)


# exact search


def plain_top_k(rows, every=50, k=5, scale=256):
    good = [(n, i, [int(np.floor(scale * x)) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and np.isfinite(x) and np.isfinite(scale * x) for x in v)]
    out = []
    for n, i, q in good:
        if i % every == 0:
            scores = sorted((-min(max(sum(a * b for a, b in zip(q, v)), -(2**63)), 2**63 - 1), j) for m, j, v in good if m != n)
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def found(df, **args):
    return sorted(map(tuple, top_k(df, **args).select("query_id", "rank", "vec_id", "score").collect()))


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.normal(size=6).round(2)]) for i in range(700)]
    rows += [(int(i), rows[0][1]) for i in range(700, 760)]  # ties of a hot vector
    rows += [(50, [1.0] * 6), (50, [-1.0] * 6), (2, [0.5] * 6), (-100, [0.25] * 6)]  # repeated ids, a negative one
    rows += [(1000, []), (1050, [2.0]), (1100, [1.0] * 9), (1001, None), (1002, [None, 1.0]), (1150, [float("nan")] * 6), (1200, [float("inf")]), (None, [9.0] * 6)]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<double>, key int, id int").repartition(5)
    want = plain_top_k(rows)
    assert found(df) == want
    monkeypatch.setattr(topk_search, "PASS", 30)  # several passes, groups of a few blocks
    monkeypatch.setattr(topk_search, "HELD", 3)
    monkeypatch.setattr(topk_search, "BLOCK", 8)
    assert found(df, k=3, every=25) == plain_top_k(rows, 25, 3)


def test_top_k_edges(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [1.0]), (50, [1e200, -1e200]), (51, [1e200, 3.0]), (52, [-1e200, 1e200]), (53, [1e307])], "vec_id long, embedding array<double>")
    assert found(df) == plain_top_k([tuple(r) for r in df.collect()])
    large = [(i, [float(3**k * (i % 7 - 3)) for k in range(20)] + [float(i)]) for i in range(120)]
    assert found(spark.createDataFrame(large, "vec_id long, embedding array<double>"), scale=2**20) == plain_top_k(large, scale=2**20)
    assert found(df.limit(0)) == [] and found(df.where("vec_id = 0")) == []
    floats = spark.createDataFrame([(0, [0.1, -0.3]), (1, [0.7, 0.2]), (100, [0.5, 0.5])], "vec_id int, embedding array<float>")
    assert found(floats) == plain_top_k([(r.vec_id, r.embedding) for r in floats.collect()])


def test_bounds_leave_out_blocks_of_other_clusters():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 32)) * 256
    batch = []
    for k, c in enumerate(centres):
        m = np.floor(c + rng.normal(size=(64, 32)) * 8)
        ids = np.arange(64 * k, 64 * (k + 1), dtype=np.int64)
        batch.append({"n": 64, "dims": 32, "ids": ids.tobytes(), "keys": ids.tobytes(), "vectors": m.tobytes(), "high": m.max(0).tobytes(), "low": m.min(0).tobytes()})
    held = topk_search._Held(batch)
    opened = []
    whole = topk_search._product

    def counted(a, b):
        opened.append(len(a))
        return whole(a, b)

    q, keys = np.concatenate([r[:2] for r in held.rows]), np.concatenate([k[:2] for k in held.keys])
    best = topk_search._Best(np.full(len(q), -(2**63), np.int64), 5)
    topk_search._product, kept = counted, topk_search._product
    try:
        topk_search.search_blocks(held, q, keys, best)
    finally:
        topk_search._product = kept
    assert sum(opened) < 0.2 * len(q) * len(batch)
    scores = q @ np.concatenate(held.rows).T
    scores[np.arange(len(q)), keys] = -np.inf
    assert sorted(best.score.tolist()) == sorted(np.sort(scores, axis=1)[:, -5:].ravel().astype(np.int64).tolist())
