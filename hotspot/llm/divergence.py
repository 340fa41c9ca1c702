"""Source divergence audit: how far the words of each source of a language lie from its other sources.

Identical texts of a language collapse into one with a multiplicity per source, so each text is
tokenised once and adds its weighted counts. What two sources do not share follows from the
number of their terms per count; only terms that both hold are paired.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hotspot.llm.common import by_value, shuffle_partitions, stored

by_value(__name__)

#: Runs of ASCII letters and of all beyond ASCII, as UTF-8 bytes.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
#: Counts that a task holds before it passes them on; pairs, and sums of pairs, that it holds at a time.
HELD, PAIRS = 500_000, 1_000_000
_SCALE_STEPS = 3  # 10^9 as three digits of 1000


def terms(text: bytes) -> list[bytes]:
    """Terms of a text, A to Z lower-cased (bytes of ``lower`` beyond ASCII stay)."""
    return TERM.findall(text.lower())


def collapsed(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``(lang, text, sources array<struct<source,n>>)``: one row per different text of a language.

    Copies are counted, and one text kept, before anything is shuffled, so no group of copies meets in
    one task; the array is as long as the text has different sources."""
    d = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))))
    d = d.withColumn("digest", F.unhex(F.sha2("text", 256)))
    key = ["lang", "digest"]
    texts = d.groupBy(*key).agg(F.first("text").alias("text"))
    copies = d.groupBy(*key, "source").agg(F.count("*").alias("n")).groupBy(*key).agg(F.collect_list(F.struct("source", "n")).alias("sources"))
    return texts.join(copies, key).select("lang", "text", "sources")


def term_counts(texts: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences of the term, and documents that hold it, by source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}  # occurrences and documents of a group

        def out() -> pa.RecordBatch:
            sizes = [len(n) for n, _ in counts.values()]
            cols = [pa.array(np.repeat(np.array([k[i] for k in counts], object), sizes), pa.string()) for i in (0, 1)]
            cols.append(pa.array([t for n, _ in counts.values() for t in n], pa.binary()))
            cols.append(pa.array([x for n, _ in counts.values() for x in n.values()], pa.int64()))
            cols.append(pa.array([docs[t] for n, docs in counts.values() for t in n], pa.int64()))
            counts.clear()
            return pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "n", "docs"])

        for b in batches:
            for k, (lang, text, sources) in enumerate(zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist())):
                found = terms(text.as_buffer().to_pybytes())
                own = Counter(found) if len(sources) > 1 or sources[0]["n"] > 1 else None  # once for all copies
                for s in sources if found else ():
                    n, docs = counts.setdefault((lang, s["source"]), (Counter(), Counter()))
                    if own is None:
                        n.update(found)
                        docs.update(set(found))
                    else:
                        for t, x in own.items():
                            n[t] += x * s["n"]
                            docs[t] += s["n"]
                if k % 64 == 63 and sum(len(n) for n, _ in counts.values()) >= HELD:
                    yield out()
        if counts:
            yield out()

    some = texts.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return some.withColumn("term", F.col("term").cast("string")).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, size: str) -> Column:
    """``1 + floor(10^9 * (count + 1) / size)`` in longs, three decimal digits at a time: exact for
    sizes to 9 * 10^15. ``count + 1`` is at most ``size``."""
    left, whole = f"({count} + 1L)", "1L"
    for k in reversed(range(_SCALE_STEPS)):
        whole += f" + {1000**k}L * (({left} * 1000L) div {size})"
        left = f"(({left} * 1000L) % {size})"
    return F.expr(whole)


def _gap(p: str, q: str) -> str:
    return f"((({p} - {q}) * ({p} - {q})) div {q})"


def _np_gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _sums(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, v = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(k)
    k, v = k[order], v[order]
    first = np.flatnonzero(np.diff(k, prepend=-1)) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(v, first) if len(k) else v


def shared_terms(rows: DataFrame) -> DataFrame:
    """Per task ``(lang, source, item, v)``: over the terms that both sources hold, what the gap of
    their shares differs from that of the parts that hold it for one source only.

    ``rows(lang, term, source, p, p0)``: share of the term in the source, and that of a term it lacks. Rows lie
    by (lang, term), which has one row per source at most; pairs of sources are added up where their terms lie.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[tuple[str, str], int] = {}
        held: list[pa.RecordBatch] = []
        keys: list[np.ndarray] = []
        sums: list[np.ndarray] = []

        def pairs(whole: pa.Table) -> None:
            nonlocal keys, sums
            n = len(whole)
            if not n:
                return
            names = list(zip(whole.column(0).to_pylist(), whole.column(2).to_pylist()))
            code = np.array([codes.setdefault(x, len(codes)) for x in names], np.int64)
            p, p0 = (whole.column(k).to_numpy() for k in (3, 4))
            new = np.ones(n, bool)
            new[1:] = _changes(whole)
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, n))
            size, start = np.repeat(size, size), np.repeat(start, size)
            done = np.cumsum(size)
            at = 0
            while at < n:
                end = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS, side="right")))
                i = np.repeat(np.arange(at, end), size[at:end])
                j = np.arange(len(i)) - np.repeat(np.cumsum(size[at:end]) - size[at:end], size[at:end]) + start[i]
                i, j = i[i != j], j[i != j]
                v = _np_gap(p[i], p[j]) - _np_gap(p[i], p0[j]) - _np_gap(p0[i], p[j]) + _np_gap(p0[i], p0[j])
                k, v = _sums([code[i] << 32 | code[j]], [v])
                keys.append(k)
                sums.append(v)
                if sum(map(len, keys)) > PAIRS:
                    k, v = _sums(keys, sums)
                    keys, sums = [k], [v]
                at = end

        def out() -> pa.RecordBatch:
            nonlocal keys, sums
            k, v = _sums(keys, sums)
            keys, sums = [], []
            name = list(codes)
            a, b = [name[x] for x in k >> 32], [name[x] for x in k & 0xFFFFFFFF]
            cols = [pa.array([x[0] for x in a], pa.string()), pa.array([x[1] for x in a], pa.string()), pa.array([x[1] for x in b], pa.string()), pa.array(v)]
            return pa.RecordBatch.from_arrays(cols, ["lang", "source", "item", "v"])

        for b in batches:
            held.append(b)
            if sum(len(x) for x in held) >= 50_000:
                whole = pa.Table.from_batches(held).combine_chunks()
                cut = np.flatnonzero(_changes(whole))
                last = int(cut[-1]) + 1 if len(cut) else 0  # the last term may go on
                pairs(whole.slice(0, last).combine_chunks())
                held = whole.slice(last).combine_chunks().to_batches()
                if sum(map(len, keys)) > PAIRS:
                    yield out()
        if held:
            pairs(pa.Table.from_batches(held).combine_chunks())
        if keys:
            yield out()

    laid = rows.select("lang", "term", "source", "p", "p0").repartition(shuffle_partitions(rows.sparkSession), "lang", "term").sortWithinPartitions("lang", "term")
    return laid.mapInArrow(run, "lang string, source string, item string, v long")


def _changes(t: pa.Table) -> np.ndarray:
    """Where a row's (lang, term) is not that of the row before, from the second row."""
    n = len(t)
    if n < 2:
        return np.zeros(0, bool)
    differs = [pc.not_equal(t.column(k).slice(1), t.column(k).slice(0, n - 1)).to_numpy() for k in (0, 1)]
    return (differs[0] | differs[1]).astype(bool)


def source_divergence(docs: DataFrame, *, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """Divergence of every (lang, source) group from each other source of its lang, and the terms in which it
    exceeds the lang: ``(lang, source, part, item, value, rank)``.

    Kept terms of a lang are those in ``least_docs`` of its documents or more. A group (and the lang) gives
    each the share ``p = 1 + floor(10^9 * (count + 1) / (N + V))``, and ``f = floor((p - q)^2 / q)``. Part
    ``pair``: ``value`` is ``f`` of the group against the other source, summed over all kept terms. Part ``term``:
    ``f`` against the lang of the terms that the group holds and that have ``p > q``, ranks to ``most_terms``.
    Ranks count from 1 by value descending, then item in UTF-8 order.

    Null text, lang or source are ''. Groups without a term are groups like others; a lang without kept
    terms has pairs of value 0. Rows that repeat count each. An empty table gives an empty result; other
    columns are ignored. The pairs are the only thing that grows with the square of the sources: they are the result.
    """
    key = ["lang", "source"]
    of_term = Window.partitionBy("lang", "term")  # one row per source
    kept = term_counts(collapsed(docs, lang, source, text)).withColumns({"docs": F.sum("docs").over(of_term), "lang_n": F.sum("n").over(of_term), "least": F.min("source").over(of_term)})
    kept = stored(kept.where(F.col("docs") >= least_docs).select(*key, "term", "n", "lang_n", (F.col("source") == F.col("least")).alias("first")), "divergence-kept")

    by_source = kept.groupBy(*key).agg(F.sum("n").alias("total"))
    by_lang = kept.groupBy("lang").agg(F.count_if("first").alias("v"))
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source")))).distinct()
    groups = named.join(by_source, key, "left").join(by_lang, "lang", "left").na.fill(0, ["total", "v"])
    groups = groups.select(*key, "v", F.expr("total + v").alias("size")).withColumn("p0", F.when(F.col("v") > 0, _share("0L", "size")))
    groups = stored(groups, "divergence-groups")
    langs = groups.groupBy("lang").agg(F.expr("sum(size - v) + max(v)").alias("lang_size"))

    with_size = kept.join(groups, key).withColumn("p", _share("n", "size"))
    top = with_size.join(langs, "lang").withColumn("q", _share("lang_n", "lang_size")).where("p > q")
    top = top.select(*key, F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_gap("p", "q")).alias("value"))
    order = Window.partitionBy(*key).orderBy(F.col("value").desc(), "item")
    top = top.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_terms)

    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = groups.join(other, "lang").where("source <> item")
    f00 = _gap("p0", "q0")
    histogram = with_size.groupBy(*key, "p").agg(F.count("*").alias("m"))  # terms of a source by share
    theirs = histogram.withColumnsRenamed({"source": "item", "p": "q"})
    parts = [
        pairs.select(*key, "item", F.expr(f"CASE WHEN v > 0 THEN v * {f00} ELSE 0L END").alias("v")),
        pairs.join(histogram, key).select(*key, "item", F.expr(f"m * ({_gap('p', 'q0')} - {f00})").alias("v")),
        pairs.join(theirs, ["lang", "item"]).select(*key, "item", F.expr(f"m * ({_gap('p0', 'q')} - {f00})").alias("v")),
        shared_terms(with_size),
    ]
    summed = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).groupBy(*key, "item").agg(F.sum("v").alias("value"))
    paired = summed.select(*key, F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return paired.unionByName(top).select(*key, "part", "item", "value", "rank")


ORACLE_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'),
                        lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS terms
  FROM documents
), kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 3
), c AS (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d) SEMI JOIN kept USING (lang, term) GROUP BY ALL
), cl AS (
  SELECT lang, term, sum(n)::BIGINT AS n FROM c GROUP BY ALL
), g AS (SELECT DISTINCT lang, source FROM d
), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL
), gs AS (
  SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0)::BIGINT AS total, coalesce(v.v, 0) AS v FROM g LEFT JOIN v USING (lang)
), p AS (
  SELECT gs.lang, gs.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (gs.total + gs.v) AS p
  FROM gs JOIN kept USING (lang) LEFT JOIN c ON c.lang = gs.lang AND c.source = gs.source AND c.term = kept.term
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang))::HUGEINT AS q FROM cl
), pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
), term AS (
  SELECT p.lang, p.source, p.term AS item, (((p.p - q.q) * (p.p - q.q)) // q.q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q
), u AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
