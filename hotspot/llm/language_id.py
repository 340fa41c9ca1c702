"""Language identification by Bayesian evidence fusion.

Text likelihoods of a byte-trigram model are combined with the declared language, and with a
prior for the host that is smoothed towards its address suffix, which is smoothed towards
the corpus. Priors and the reliability of declarations come from grouped aggregates of the
text posteriors over all rows; a row's own contribution is taken out of its host's prior.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotspot.llm.common import broadcast_by_value, by_value, fresh, sent_value, stored

by_value(__name__)

#: Trigram cells; labelled rows per language that the text model is fitted on (about; chosen by hashed id).
CELLS, TRAIN_ROWS = 1 << 15, 2000
#: A language has at least this share of the labelled rows, so that a model has at most 256 (64 MB to send).
LEAST_SHARE = 1 / 256
#: Text evidence counts as at most so many independent trigrams; smoothing of priors and declarations.
TEXT_CAP, HOST_WEIGHT, SUFFIX_WEIGHT, DECLARED_WEIGHT = 60, 8.0, 20.0, 2.0
LEAST_POSTERIOR = 0.5
# ASCII signs other than letters say nothing about the language
_SPACES = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def trigrams(text: str | None) -> np.ndarray:
    """Cells of the byte trigrams of the lower-cased letters, runs of other signs being one space."""
    data = (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACES)
    a = np.frombuffer(data, np.uint8)
    if len(a):
        a = a[~((a == 32) & np.concatenate(([True], a[:-1] == 32)))]
    if len(a) < 3:
        return np.zeros(0, np.int64)
    x = a.astype(np.uint32)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64)


#: The language of text that is in none: every cell is as likely.
UNKNOWN = "und"


class TextModel(NamedTuple):
    """Languages in order, and the log-probability of every cell in each; ``und`` is the last."""

    languages: list[str]
    logp: np.ndarray


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            counts = total.setdefault(lang, np.zeros(CELLS, np.int64))
            counts += np.bincount(trigrams(text), minlength=CELLS)
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], ["lang", "cell", "n"])


def fit_text_model(labelled: DataFrame, train_rows: int = TRAIN_ROWS, seed: str = "lid") -> TextModel:
    """Trigram model from ``labelled(id, lang, text)``: about ``train_rows`` rows of each language, by
    hashed id; the counts are summed by Spark, and the model's size does not depend on the rows.
    Labels of less than ``LEAST_SHARE`` of the labelled rows, as misspelt ones, are no languages of the
    model; texts that bear them are judged like any other."""
    known = labelled.where("lang is not null and lang <> ''")
    sizes = known.groupBy("lang").count().where(F.col("count") >= F.lit(known.count() * LEAST_SHARE))  # 256 rows at most
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / float(16**12)
    chosen = known.join(F.broadcast(sizes), "lang").where(draw < F.lit(float(train_rows)) / F.col("count"))
    rows = chosen.select("lang", "text").mapInArrow(_counter, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in rows} - {UNKNOWN})
    counts = np.full((CELLS, len(langs)), 0.5)
    for r in rows:
        if r["lang"] == UNKNOWN:
            continue
        counts[r["cell"], langs.index(r["lang"])] += r["n"]
    if not langs:
        return TextModel([], counts)
    logp = np.log(counts / counts.sum(axis=0))
    return TextModel([*langs, UNKNOWN], np.concatenate((logp, np.full((CELLS, 1), -np.log(CELLS))), axis=1))


def _scorer(model, cap: int):
    """Number of trigrams and tempered log-likelihood per language of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp = sent_value(model).logp
        for b in batches:
            n, ll = [], []
            for text in b.column(0).to_pylist():
                t = trigrams(text)
                n.append(len(t))
                s = logp[t].sum(axis=0) * min(1.0, cap / max(1, len(t)))
                ll.append((s - s.max(initial=-np.inf)).tolist())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n, pa.int64()), pa.array(ll, pa.list_(pa.float64()))], [*b.schema.names[1:], "n", "ll"])

    return run


def _normalised(values: list[Column]) -> list[Column]:
    total = sum(values[1:], values[0])
    return [v / total for v in values]


def score_texts(rows: DataFrame, model: TextModel) -> DataFrame:
    """``rows(text, ...)`` with the text's number of trigrams and log-likelihoods in its place; no shuffle."""
    others = [f for f in rows.schema.fields if f.name != "text"]
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in others) + ", n long, ll array<double>"
    return rows.select("text", *(f.name for f in others)).mapInArrow(_scorer(broadcast_by_value(rows.sparkSession, model), TEXT_CAP), out)


def identify(rows: DataFrame, model: TextModel, least: float = LEAST_POSTERIOR, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``rows(id, text, declared, host, suffix)`` to ``(id, lang, posterior, text_lang, accepted, declared, host, suffix)``.

    ``accepted``: the text has letters enough for a trigram, the posterior of the best language is
    at least ``least``, and it is one of ``keep`` (None: any but ``und``, text in no known
    language). A null text counts as empty and has no text evidence, no language and is not
    accepted; a null declaration, host or suffix is a value of its own. Rows without an id and repeated rows are judged each for itself. An empty
    table, or no labelled rows to fit on, gives no language and nothing accepted. Hosts may hold
    any share of the rows: priors are map-side combined sums, joined back.
    """
    return fuse(score_texts(rows.select("text", "id", "declared", "host", "suffix"), model), model, least, keep)


def fuse(scored: DataFrame, model: TextModel, least: float = LEAST_POSTERIOR, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The same from scored texts: ``scored(id, declared, host, suffix, n, ll)``."""
    langs = model.languages
    if not langs:
        null = F.lit(None).cast("string")
        return scored.select("id", null.alias("lang"), F.lit(None).cast("double").alias("posterior"), null.alias("text_lang"), F.lit(False).alias("accepted"), "declared", "host", "suffix")
    scored = scored.withColumns({c: F.coalesce(c, F.lit("")) for c in ("declared", "host", "suffix")})
    soft = _normalised([F.exp(F.col("ll")[k]) for k in range(len(langs))])
    scored = stored(scored.select("id", "declared", "host", "suffix", "n", *(F.when(F.col("n") > 0, s).otherwise(0.0).alias(f"s{k}") for k, s in enumerate(soft))), "text_scores")
    ks = range(len(langs))

    def sums(by: str, tag: str) -> DataFrame:
        return scored.groupBy(by).agg(*(F.sum(f"s{k}").alias(f"{tag}{k}") for k in ks))

    everywhere = scored.agg(*(F.sum(f"s{k}").alias(f"g{k}") for k in ks), F.countDistinct("declared").alias("forms")).first()
    g = np.array([everywhere[f"g{k}"] or 0.0 for k in ks]) + 1.0
    g, mass = (g / g.sum()).tolist(), g.tolist()
    by_suffix = sums("suffix", "x")
    xs = sum((F.col(f"x{k}") for k in ks), F.lit(0.0))
    by_suffix = by_suffix.select("suffix", *((((F.col(f"x{k}") + SUFFIX_WEIGHT * g[k]) / (xs + SUFFIX_WEIGHT))).alias(f"p{k}") for k in ks))
    by_host = scored.groupBy("host").agg(*(F.sum(f"s{k}").alias(f"h{k}") for k in ks))
    by_declared = sums("declared", "d")
    joined = scored.join(by_suffix, "suffix").join(by_host, "host").join(by_declared, "declared")
    hs = sum((F.greatest(F.col(f"h{k}") - F.col(f"s{k}"), F.lit(0.0)) for k in ks), F.lit(0.0))
    weights = []
    for k in ks:
        prior = (F.greatest(F.col(f"h{k}") - F.col(f"s{k}"), F.lit(0.0)) + HOST_WEIGHT * F.col(f"p{k}")) / (hs + HOST_WEIGHT)
        # an empty declaration says nothing
        said = F.when(F.col("declared") == "", F.lit(1.0)).otherwise((F.greatest(F.col(f"d{k}") - F.col(f"s{k}"), F.lit(0.0)) + DECLARED_WEIGHT / max(1, everywhere["forms"])) / (F.lit(mass[k]) + DECLARED_WEIGHT))
        weights.append(F.col(f"s{k}") * prior * said)
    total = sum(weights[1:], weights[0])
    best = F.array_max(F.array(*(F.struct(F.try_divide(w, total).alias("p"), F.lit(-k).alias("k")) for k, w in enumerate(weights))))
    text_best = F.array_max(F.array(*(F.struct(F.col(f"s{k}").alias("p"), F.lit(-k).alias("k")) for k in ks)))
    names = F.array(*(F.lit(x) for x in langs))
    has = F.col("n") > 0
    res = joined.withColumns({"best": best, "text_best": text_best})
    name = lambda c: F.when(has, F.element_at(names, (F.lit(1) - F.col(c)["k"]).cast("int")))
    res = res.select("id", name("best").alias("lang"), F.when(has, F.col("best")["p"]).alias("posterior"), name("text_best").alias("text_lang"), "declared", "host", "suffix")
    wanted = (F.col("lang") != UNKNOWN) if keep is None else F.col("lang").isin(*keep)
    return res.withColumn("accepted", F.coalesce((F.col("posterior") >= least) & wanted, F.lit(False))).select("id", "lang", "posterior", "text_lang", "accepted", "declared", "host", "suffix")


def page_evidence(pages: DataFrame) -> DataFrame:
    """Host, address suffix and markup language of the page of a document, whose number is the second
    part of the URL's path; of several pages the first by page id."""
    url = F.col("url")
    host = F.lower(F.regexp_extract(url, r"://([^/?#:]*)", 1))
    markup = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*?\slang=[\"']?([A-Za-z]{2,3})", 1))
    doc = F.regexp_extract(url, r"://[^/?#]*/[^/?#]*/([0-9]{1,18})", 1)
    p = pages.select(F.when(doc != "", doc.cast("long")).alias("id"), "page_id", host.alias("host"), markup.alias("markup")).where("id is not null")
    p = p.groupBy("id").agg(F.min_by(F.struct("host", "markup"), F.struct("page_id", "host", "markup")).alias("p"))
    return p.select("id", F.col("p.host").alias("page_host"), F.when(F.col("p.markup") != "", F.col("p.markup")).alias("markup"), F.substring_index("p.host", ".", -1).alias("page_suffix"))


def identify_documents(docs: DataFrame, pages: DataFrame, train_rows: int = TRAIN_ROWS, least: float = LEAST_POSTERIOR, keep: tuple[str, ...] | None = None, key_col: str = "doc_id") -> DataFrame:
    """Language of every row of ``docs(doc_id, text, lang, source)``; see ``identify``.

    A document with a page takes the page's markup language, host and suffix as evidence, any
    other its declared language and source. The text model is fitted on the declared languages.
    The result names rows by ``key_col``, where that is not their id.
    """
    key = fresh("key")
    fixed = docs.select(F.col("doc_id").cast("long").alias("id"), "text", "lang", "source", F.col(key_col).cast("long").alias(key))
    model = fit_text_model(fixed.select("id", "lang", "text"), train_rows)
    evidence = stored(page_evidence(pages), "page_evidence")
    # texts are scored where they are read; only their scores meet the evidence
    scored = score_texts(fixed, model).join(evidence, "id", "left")
    scored = scored.select(F.col(key).alias("id"), F.coalesce("markup", F.lower("lang")).alias("declared"), F.coalesce("page_host", "source").alias("host"), F.col("page_suffix").alias("suffix"), "n", "ll")
    return fuse(scored, model, least, keep).withColumnRenamed("id", key_col)
