"""The pipeline on the smallest tables, every stage against brute force on its own input; edge rows."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from hotspot.llm import mixing
from hotspot.llm.queries import ORACLE_SQL, QUERIES
from hotspot.session import new_table_path

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before the first stage and after each."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(cp.STAGES):
        path = new_table_path(spark, "stage")
        stage(spark, docs, SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns[:5] == COLUMNS and (k == 4 or len(docs.columns) == 5)
        out.append(docs.collect())
    return out


def test_language_stage_keeps_clean_documents(stages):
    assert sorted(stages[1]) == sorted(stages[0])  # all are in a known language


def test_one_of_each_class_stays(stages):
    docs = {}
    for r in stages[1]:
        w = r.text.lower().split()
        docs[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    label = {i: i for i in docs}
    ids = sorted(docs)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if docs[a] and len(docs[a] & docs[b]) >= 0.8 * len(docs[a] | docs[b])]
    for _ in ids:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert links and sorted(r.doc_id for r in stages[2]) == sorted(set(label.values()))
    assert set(stages[2]) <= set(stages[1])


def test_documents_with_benchmark_items_go(spark, stages):
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = [r for r in stages[2] if not any(t in r.text for t in items)]
    assert len(clean) < len(stages[2]) and sorted(stages[3]) == sorted(clean)


PRIVATE = r"[\w.]+@[\w.]+\.com|\+\d \(\d{3}\) \d{3}-\d{4}|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])|(?<!\d)\d{16}(?!\d)"


def valid(value):
    """Not a number that only looks like a card or an address."""
    if value.isdigit():
        x = [int(c) for c in value][::-1]
        return (sum(x[0::2]) + sum(sum(divmod(2 * d, 10)) for d in x[1::2])) % 10 == 0
    return not re.fullmatch(r"[\d.]+", value) or all(int(x) < 256 for x in value.split("."))


def test_private_values_give_way_and_nothing_else_changes(stages):
    before, after = ({r.doc_id: r for r in s} for s in stages[3:5])
    assert set(before) == set(after)
    changed = 0
    for i, old in before.items():
        new = after[i]
        assert new.n_chars == (len(new.text) if new.text != old.text else old.n_chars)
        values = [v for v in re.findall(PRIVATE, old.text) if valid(v)]
        changed += bool(values)
        assert not any(v in new.text for v in values)
        pieces = re.split("|".join(map(re.escape, values)) or "(?!)", old.text)
        at = 0
        for p in pieces:  # the text between the values is all there, in order
            at = new.text.index(p, at) + len(p)
        assert values or new.text == old.text
    assert changed


def test_mix_equals_its_sql(stages):
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame([r.asDict() for r in stages[4]]))
    want = {}
    for doc, size, _, _, taken in con.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.ORACLE_SQL}) t").fetchall():
        if taken:
            want[doc] = taken // size
    got = {}
    for r in stages[5]:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
        assert 1 <= r.copy <= 2
    assert {i: n for i, n in got.items() if next(r for r in stages[4] if r.doc_id == i).text.split()} == want


def test_run_equals_the_stages(spark, stages):
    assert sorted(cp.run(spark, SMALL).collect()) == sorted(stages[-1])


def test_stages_take_edge_rows(spark, tmp_path):
    """Nulls, repeated rows, empty texts, a long text and columns with clashing names; an empty table."""
    rows = [(1, "the and of in to " * 30, "en", "s", 5), (1, "the and of in to " * 30, "en", "s", 5), (None, "of the and that in was for on are", "en", None, None), (2, None, None, "s", None), (3, "", "en", "s", 0), (4, "12 345", None, "s", 6), (5, "in the of and " * 20_000 + "10.1.2.3", "en", "t", 1)]
    extra = ["copies", "count", "copy", "pii", "__old", "label", "rows", "size"]
    docs = spark.createDataFrame([(*r, *extra) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra))
    for name in ("pages", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    for _ in range(2):
        out = docs
        for k, (_, stage) in enumerate(cp.STAGES):
            path = new_table_path(spark, "edge")
            stage(spark, out, str(tmp_path)).write.parquet(path)
            out = spark.read.parquet(path)
            assert k == 4 or out.columns == docs.columns
        if docs.isEmpty():
            assert out.isEmpty()
        else:
            ids = [r.doc_id for r in out.select("doc_id").distinct().collect()]
            assert set(ids) <= {1, 5, None} and out.where(F.col("text").contains("10.1.2.3")).isEmpty()
        docs = docs.limit(0)


def test_rows_are_decided_each_by_itself(spark, tmp_path):
    """Rows without an id, and rows that share one, stay or go by their own text in each filtering stage."""
    for name in ("pages", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    clean = "the and of in to that was for on are this with from have were "
    rows = [(None, "of the " + item + " and", "en"), (None, clean * 3, "en"), (7, clean + item, "en"), (7, clean * 2, "en"), (8, clean + "is", "en"), (8, "12 345", "en"), (None, "67 89", "en")]
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").where("lang = 'en'").limit(50)  # for the language model
    docs = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in rows], texts.schema)
    stage = dict(cp.STAGES)
    left = stage["decontamination"](spark, docs, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.text) for r in left) == sorted((str(i), t) for i, t, _ in rows if item not in t)
    mixed = texts.unionByName(docs)
    kept = stage["language_id"](spark, mixed, str(tmp_path)).where("source = 's'").collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted((str(i), t) for i, t, _ in rows if not t[0].isdigit())
    mix = mixing.mix(docs)
    taken = stage["mixing"](spark, docs, str(tmp_path))
    words = taken.select(F.sum(mixing.n_words(F.col("text")))).first()[0]
    assert words == mix.agg(F.sum("taken")).first()[0]


ELSEWHERE = """
import importlib.util, os, sys
spec = importlib.util.spec_from_file_location("entry_by_path", {entry!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from hotspot.session import get_session
spark = get_session("local[4]", 4)
assert not spark.sparkContext.parallelize([0], 1).map(lambda _: __import__("importlib").util.find_spec("hotspot") is not None).first()
for name, query in entry.queries().items():
    if name.startswith("op") or name == "pipeline":
        query(spark, {sf!r}).write.format("noop").mode("overwrite").save()
        print("ran", name, flush=True)
"""


def test_workers_need_no_installed_package(tmp_path):
    """All keys in a session of another folder, whose workers cannot import the package."""
    import os
    import subprocess
    import sys

    from conftest import ROOT

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    code = ELSEWHERE.format(entry=os.path.join(ROOT, "__spark_entry__.py"), sf=SMALL)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    ran = {x.split()[1] for x in done.stdout.splitlines() if x.startswith("ran ")}
    assert done.returncode == 0 and ran == {*QUERIES, "pipeline"}, done.stderr[-2000:]


def test_registered_queries():
    import __spark_entry__ as e

    names = list(e.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_matches_oracle(spark, duck_small, key):
    from compare import compare

    r = compare(spark, duck_small, key, QUERIES[key], ORACLE_SQL[key], SMALL)
    assert r["status"] == "ok", r
