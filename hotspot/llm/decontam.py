"""Benchmark decontamination: BM25 index of the test items, searched by block-max WAND.

Every training passage is a query. Item impacts are divided by the item's own score, so one
threshold means the same share of any item. Upper bounds per term and per block of items let
most passages and blocks go unsearched; the others are searched item by item with pivots,
and what reaches the threshold is verified by the overlap of question and answer.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotspot.llm.common import broadcast_by_value, by_value, mix, sent_value, word_hashes

by_value(__name__)

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP, WORDS = 0.6, 0.8, 5
#: Shingles below which one changed word may cost a part its overlap; words in order of the whole item then.
SHORT, WHOLE = 25, 0.9
#: Items in an index, items in a block of it, words of an item's part (longer items are cut).
INDEX_ITEMS, BLOCK_ITEMS, PART = 10_000, 4, 256

# ASCII signs other than letters and digits part words
_SPACES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_A_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def words_of(text: str | None) -> np.ndarray:
    """Hashes of the words of a text, lower-cased; ASCII signs other than letters and digits part them."""
    data = (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACES)
    return word_hashes(np.frombuffer(data, np.uint8))


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence or line is the answer; of a single one, the last quarter of its words."""
    ends = [m.end() for m in re.finditer(r"[.!?]+\s+|\n+", text.strip())]
    for at in reversed(ends):
        if text.strip()[at:].strip() and text.strip()[:at].strip():
            return text.strip()[:at], text.strip()[at:]
    w = text.split()
    n = max(1, len(w) // 4)
    return " ".join(w[: len(w) - n]), " ".join(w[len(w) - n :])


def _grams(w: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Hashes of the k-word shingles (of all words together where there are fewer), in order."""
    k = min(k, len(w))
    if not k:
        return w
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i]
    return mix(h)


def words_off(part: np.ndarray, passage: np.ndarray) -> int:
    """Fewest words to change, leave out or put in until the part is a run of words of the passage."""
    at = np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1, np.int64)
    for x in part:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (passage != x))
        row = np.minimum.accumulate(new - at) + at
    return int(row.min())


class BlockMaxIndex:
    """Postings of normalised BM25 impacts with maxima per term and per block of items."""

    def __init__(self, keys: list, texts: list[str], df: dict[int, int], n_items: int, mean_words: float) -> None:
        self.keys = keys
        self.parts = []
        rows = []
        for text in texts:
            w = words_of(text)
            t, tf = np.unique(w, return_counts=True)
            idf = np.array([math.log(1 + (n_items - df[x] + 0.5) / (df[x] + 0.5)) for x in t.tolist()])
            impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean_words))
            rows.append((t, impact / impact.sum()))
            q, a = (words_of(x) for x in question_and_answer(text))
            self.parts.append(((q, np.unique(_grams(q))), (a, np.unique(_grams(a)))))
        self.longest = max(len(words_of(t)) for t in texts)
        item = np.repeat(np.arange(len(rows)), [len(t) for t, _ in rows])
        term = np.concatenate([t for t, _ in rows])
        impact = np.concatenate([x for _, x in rows])
        order = np.lexsort((item, term))
        item, term, impact = item[order], term[order], impact[order]
        self.terms, first = np.unique(term, return_index=True)
        self.ends = np.concatenate((first, [len(term)]))
        self.item, self.impact = item, impact
        self.n_blocks = -(-len(rows) // BLOCK_ITEMS)
        # no passage that has all terms may miss the threshold by rounding
        self.bound = np.maximum.reduceat(impact, first)
        posting_term = np.repeat(np.arange(len(self.terms)), np.diff(self.ends))
        cell = posting_term * self.n_blocks + item // BLOCK_ITEMS
        cells, at = np.unique(cell, return_index=True)
        self.cells, self.cell_bound = cells, np.maximum.reduceat(impact, at)
        self.cell_ends = np.searchsorted(cells, np.arange(len(self.terms) + 1) * self.n_blocks)
        # one bit per 20-bit hash prefix: most words that no item has end there
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.terms >> np.uint64(44)).astype(np.int64)] = True

    def lookup(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words that are terms, and their term numbers."""
        at = np.flatnonzero(self.sieve[(w >> np.uint64(44)).astype(np.int64)])
        t = np.searchsorted(self.terms, w[at])
        ok = self.terms[np.minimum(t, len(self.terms) - 1)] == w[at]
        return at[ok], t[ok]

    def open_blocks(self, t: np.ndarray, threshold: float) -> np.ndarray:
        """Blocks whose maxima over the distinct terms ``t`` reach the threshold."""
        lens = self.cell_ends[t + 1] - self.cell_ends[t]
        at = np.repeat(self.cell_ends[t] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(lens.sum())
        total = np.bincount(self.cells[at] % self.n_blocks, self.cell_bound[at], self.n_blocks)
        return np.flatnonzero(total >= threshold - 1e-9)

    def search(self, t: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """Items whose score on the distinct terms ``t`` reaches the threshold.

        WAND inside the open blocks: cursors lie in order of their items; the pivot is where the
        term bounds first sum to the threshold, and items before it are passed over.
        """
        blocks = self.open_blocks(t, threshold)
        found = []
        if not len(blocks):
            return found
        is_open = np.zeros(self.n_blocks, bool)
        is_open[blocks] = True
        lists = []
        for k in t.tolist():
            lo, hi = self.ends[k], self.ends[k + 1]
            keep = is_open[self.item[lo:hi] // BLOCK_ITEMS]
            if keep.any():
                lists.append([0, self.item[lo:hi][keep].tolist(), self.impact[lo:hi][keep].tolist(), float(self.bound[k])])
        least = threshold - 1e-9
        while lists:
            lists.sort(key=lambda c: c[1][c[0]])
            total, pivot = 0.0, None
            for c in lists:
                total += c[3]
                if total >= least:
                    pivot = c[1][c[0]]
                    break
            if pivot is None:
                break
            if lists[0][1][lists[0][0]] == pivot:
                score = 0.0
                for c in lists:
                    if c[1][c[0]] != pivot:
                        break
                    score += c[2][c[0]]
                    c[0] += 1
                if score >= least:
                    found.append((pivot, score))
            else:
                for c in lists:
                    if c[1][c[0]] >= pivot:
                        break
                    while c[0] < len(c[1]) and c[1][c[0]] < pivot:
                        c[0] += 1
            lists = [c for c in lists if c[0] < len(c[1])]
        return found


def overlaps(question: tuple, answer: tuple, passage: np.ndarray, least: float) -> tuple[float, float] | None:
    """Overlaps of question and answer, each given as its words and shingles, if the passage holds the item.

    A part's overlap is the share of its five-word shingles in the passage. One changed word takes up
    to five of them, so a part of fewer than ``SHORT`` shingles may instead have the share of its words
    that stand in order in one place. Each overlap reaches ``least``; where one changed word alone
    puts a part of a few words below it, ``WHOLE`` of all the item's words in order do as well.
    """
    part, off = [], []
    for w, grams in (question, answer):
        share = float(np.isin(grams, _grams(passage, min(WORDS, len(w)))).mean()) if len(w) else 1.0
        wrong = 0
        if share < least:
            wrong = int((~np.isin(w, passage)).sum())  # at least
            if len(grams) >= SHORT or wrong > max(1, (1 - least) * len(w)):
                return None
            wrong = words_off(w, passage)
            share = max(share, 1 - wrong / len(w))
        part.append(share)
        off.append(wrong)
    if min(part) < least - 1e-9:
        if any(s < least - 1e-9 and n > 1 for s, n in zip(part, off)):
            return None
        whole = np.concatenate((question[0], answer[0]))
        if words_off(whole, passage) > (1 - WHOLE) * len(whole) + 1e-9:
            return None
    return part[0], part[1]


def _searcher(index, threshold: float, overlap: float):
    """Searches the passages of every text: windows of two strides, a stride as long as the longest item."""

    def of_text(ix: BlockMaxIndex, text: str | None) -> dict:
        w = words_of(text)
        at, t = ix.lookup(w)
        best: dict = {}
        if not len(at):
            return best
        stride = max(32, ix.longest)
        n = max(1, -(-len(w) // stride) - 1)
        start = np.arange(n) * stride
        sums = np.concatenate(([0.0], np.cumsum(ix.bound[t])))
        lo, hi = np.searchsorted(at, start), np.searchsorted(at, start + 2 * stride)
        for k in np.flatnonzero(sums[hi] - sums[lo] >= threshold - 1e-6).tolist():
            terms = np.unique(t[lo[k] : hi[k]])
            if ix.bound[terms].sum() < threshold - 1e-9:
                continue
            passage = None
            for item, score in ix.search(terms, threshold):
                passage = w[start[k] : start[k] + 2 * stride] if passage is None else passage
                part = overlaps(*ix.parts[item], passage, overlap)
                if part:
                    row = (float(score), int(start[k]), float(part[0]), float(part[1]))
                    best[ix.keys[item]] = max(best.get(ix.keys[item], row), row)
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = sent_value(index)
        for b in batches:
            out = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out.extend((i, key, row[1], row[0], row[2], row[3]) for key, row in of_text(ix, text).items())
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            names = ["doc_id", "item_id", "start_word", "score", "question_overlap", "answer_overlap"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

    return run


_OUT = "doc_id long, item_id long, start_word long, score double, question_overlap double, answer_overlap double"


def cut_item(text: str) -> list[str]:
    """The text in as few parts of at most ``PART`` words as hold it, of equal numbers of words up to one:
    no part of a long item is a short tail, which any text would hold."""
    starts = [m.start() for m in _A_WORD.finditer(text)]
    n = -(-len(starts) // PART)
    at = [0, *(starts[k * len(starts) // n] for k in range(1, n)), len(text)]
    return [text[i:j] for i, j in zip(at, at[1:])]


def _cut_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items in parts of at most ``PART`` words, with the distinct terms of each."""
    for b in batches:
        rows = []
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for piece in cut_item(text or ""):
                h = words_of(piece)
                if len(h):
                    rows.append((key, piece, len(h), np.unique(h).view(np.int64).tolist()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64())))], ["item_id", "text", "n", "terms"])


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, index_items: int = INDEX_ITEMS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Documents that hold a test item: ``(doc_id, item_id, start_word, score, question_overlap, answer_overlap)``.

    One row per document row and item: the best passage, from ``start_word`` on. ``score`` is the
    share of the item's BM25 self-score that the passage reaches (``threshold`` at least); the
    overlaps are the shares of the item's five-word shingles found in the passage, of its question
    (all but the last sentence) and of its answer, ``overlap`` at least each. A part of fewer than 25
    shingles may have that share of its words in order instead, and a part of under five words one
    word changed if nine tenths of the whole item's words are there in order, so that one changed
    word hides no item of ten words or more. Items without a word
    and null or empty texts match nothing; rows that repeat an item or document are looked at each
    for itself, and a row without an id gives rows without one. Empty tables give an empty result;
    other columns are ignored. Items are held in indexes of about ``index_items`` (one broadcast
    each, bounded by that), with term counts over all items; texts are never shuffled.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).mapInArrow(_cut_items, "item_id long, text string, n long, terms array<long>")
    total = parts.agg(F.count("*").alias("n"), F.avg("n").alias("mean")).first()
    out = spark.createDataFrame([], _OUT)
    if not total["n"]:
        return out
    df = parts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n_indexes = -(-total["n"] // index_items)
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_indexes))
    results = []
    for k in range(n_indexes):
        own = parts.where(shard == k)
        rows = own.select("item_id", "text").collect()  # at most about index_items parts of PART words
        if not rows:
            continue
        mine = own.select(F.explode("terms").alias("term")).distinct()
        counts = {r["term"] & (2**64 - 1): r["df"] for r in df.join(mine, "term", "left_semi").collect()}
        index = BlockMaxIndex([r["item_id"] for r in rows], [r["text"] for r in rows], counts, total["n"], total["mean"])
        results.append(d.mapInArrow(_searcher(broadcast_by_value(spark, index), threshold, overlap), _OUT))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out
