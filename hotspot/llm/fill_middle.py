"""Fill-in-middle: a document becomes a piece table, and arranging it moves descriptors only.

A piece ``(buffer, start, length)`` points into one of two buffers that never change: the text's
UTF-8 bytes (``TEXT``) and the sentinels (``SENTINELS``). Cutting splits pieces, an arrangement
permutes the spans between the cuts and puts sentinel pieces before them, the inverse permutation
over the pieces of an output restores the text, and digests are fed piece by piece.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotspot.llm.common import by_value

by_value(__name__)

TEXT, SENTINEL = 0, 1
#: One buffer for all documents; prefix, suffix and middle are named by their place in it.
SENTINELS = b"<P><S><M>"
_MARK = 3  # bytes of a sentinel
PREFIX, SUFFIX, MIDDLE = 0, 1, 2
#: Spans of the cut text (prefix, middle, suffix by place) in the order in which a form writes them.
FORMS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
_PLACE = (PREFIX, MIDDLE, SUFFIX)

Piece = tuple[int, int, int]


def cut(pieces: list[Piece], *offsets: int) -> list[list[Piece]]:
    """The pieces of the spans between ascending byte offsets; a piece that holds an offset is split."""
    spans, at, left = [], 0, list(reversed(pieces))
    for end in (*offsets, None):
        span: list[Piece] = []
        while left and (end is None or at < end):
            buffer, start, length = left.pop()
            take = length if end is None else min(length, end - at)
            span.append((buffer, start, take))
            if take < length:
                left.append((buffer, start + take, length - take))
            at += take
        spans.append(span)
    return spans


def arrange(spans: list[list[Piece]], form: str) -> list[Piece]:
    """Prefix, middle and suffix in the order of the form, each behind its sentinel."""
    by_role = dict(zip(_PLACE, spans))
    return [p for role in FORMS[form] for p in ((SENTINEL, role * _MARK, _MARK), *by_role[role])]


def restore(output: bytes, form: str) -> list[Piece]:
    """Pieces over the bytes of an output that spell the text it was made from.

    Sentinels are looked for in the output itself, in the order of the form. A text that holds a
    sentinel is never arranged, and as no sentinel ends as another begins, none arises at a seam.
    """
    if form not in FORMS:
        return [(TEXT, 0, len(output))]
    spans, at = {}, _MARK
    if not output.startswith(_sentinel(FORMS[form][0])):
        raise ValueError("the output does not begin with the first sentinel of its form")
    for role, following in zip(FORMS[form], (*FORMS[form][1:], None)):
        end = len(output) if following is None else output.find(_sentinel(following), at)
        if end < 0:
            raise ValueError("a sentinel of the form is missing")
        spans[role] = (TEXT, at, end - at)
        at = end + _MARK
    return [spans[role] for role in _PLACE if spans[role][2]]


def _sentinel(role: int) -> bytes:
    return SENTINELS[role * _MARK : (role + 1) * _MARK]


def stream(pieces: Iterable[Piece], text) -> Iterator[memoryview]:
    """The bytes of the pieces, one view after the other; nothing is copied."""
    buffers = (memoryview(text), memoryview(SENTINELS))
    for buffer, start, length in pieces:
        yield buffers[buffer][start : start + length]


def digest(pieces: Iterable[Piece], text) -> str:
    h = hashlib.sha256()
    for view in stream(pieces, text):
        h.update(view)
    return h.hexdigest()


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit numbers that hang on seed and id alone."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[4 * k : 4 * k + 4], "big") for k in range(4))


def unit_ends(text: np.ndarray, unit: str) -> np.ndarray:
    """Byte ends of the units: lines (with their line feed) or code points."""
    if unit == "line":
        ends = np.flatnonzero(text == 10) + 1
        return ends if not len(text) or text[-1] == 10 else np.append(ends, len(text))
    starts = np.flatnonzero((text & 0xC0) != 0x80)
    return np.append(starts[1:], len(text)) if len(starts) else starts


def _chars(text: np.ndarray) -> int:
    return int(np.count_nonzero((text & 0xC0) != 0x80))


_HOLDS = re.compile(b"|".join(map(re.escape, (_sentinel(k) for k in range(3)))))
_PIECES = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))
_SCHEMA = {
    "doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(),
    "pieces": _PIECES, "output": pa.binary(), "output_sha256": pa.string(), "restored_sha256": pa.string(),
}
_DDL = "doc_id long, n long, form string, prefix_chars long, middle_chars long, pieces array<struct<buffer:int,start:long,length:long>>, output binary, output_sha256 string, restored_sha256 string"


def _one(doc_id: int | None, raw: bytes, seed: int, fim: int, spm: int, unit: str, keep: bool) -> tuple:
    text = np.frombuffer(raw, np.uint8)
    ends = unit_ends(text, unit)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    whole: list[Piece] = [(TEXT, 0, len(raw))] if raw else []
    if not raw or h3 % 100 >= fim or _HOLDS.search(raw):
        form, prefix, middle, pieces = "plain", None, None, whole
    else:
        form = "spm" if h4 % 100 < spm else "psm"
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = (int(ends[k - 1]) if k else 0 for k in (a, b))
        prefix, middle = _chars(text[:a]), _chars(text[a:b])
        pieces = arrange(cut(whole, a, b), form)
    output = b"".join(stream(pieces, raw))
    return doc_id, n, form, prefix, middle, pieces if keep else None, output if keep else None, digest(pieces, raw), digest(restore(output, form), output)


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, seed: int = 7, fim: int = 100, spm: int = 50, unit: str = "line", outputs: bool = True
) -> DataFrame:
    """Every document arranged for fill-in-middle training; no shuffle.

    The text is cut at two places between its units (``line`` or ``char``); places, form and
    whether a document is arranged at all (``fim`` of 100) hang on ``seed`` and id, so reruns
    agree. ``spm`` of 100 arranged documents put the suffix first. Returns ``(doc_id, n, form,
    prefix_chars, middle_chars, pieces, output, output_sha256, restored_sha256)``: ``n`` units,
    ``pieces`` over text and sentinels, and ``restored_sha256`` of the text that is rebuilt from
    output and form alone. ``outputs=False`` leaves ``pieces`` and ``output`` null.

    A null text is empty; an empty text, and one that holds a sentinel, stays plain. A row without
    an id draws as the id of no digits. Rows that repeat an id are decided each by itself, alike. An empty
    table gives an empty result; other columns are ignored. A text of any length is one row's work.
    """
    if unit not in ("line", "char"):
        raise ValueError(f"no such unit: {unit}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            step = 256 if outputs else len(ids) or 1  # whole outputs leave in small batches
            for at in range(0, len(ids), step):
                rows = [_one(i, t.as_buffer().to_pybytes() if t.is_valid else b"", seed, fim, spm, unit, outputs) for i, t in zip(ids[at : at + step], texts.slice(at, step))]
                columns = list(zip(*rows))
                if outputs:
                    columns[5] = [[dict(zip(("buffer", "start", "length"), p)) for p in pieces] for pieces in columns[5]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SCHEMA.values())], list(_SCHEMA))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, _DDL).withColumn("output", F.col("output").cast("string"))


def restored(arranged: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, text)`` rebuilt from ``output`` and ``form``; a null output is empty, a null or unknown
    form is plain. An output that lacks a sentinel of its form is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for out, form in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = (out or "").encode("utf-8", "surrogatepass")
                texts.append(b"".join(stream(restore(raw, form or "plain"), raw)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary())], ["doc_id", "text"])

    rows = arranged.select(F.col(id_col).cast("long").alias("doc_id"), "output", "form")
    return rows.mapInArrow(run, "doc_id long, text binary").withColumn("text", F.col("text").cast("string"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (
  SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units,
         ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM d
), c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), s AS (
  SELECT doc_id, n, form, t, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM c
)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM s
"""
