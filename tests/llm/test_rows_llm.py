"""URL rules, licences, decontamination, mixing, languages, pseudonyms and revisits on hand-made rows."""

import datetime as dt
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hotspot.llm.decontam import BlockMaxIndex, contaminated, cut_item, question_and_answer, words_of
from hotspot.llm.language_id import TRAIN_ROWS, fit_text_model, identify, identify_documents, page_evidence
from hotspot.llm.license_scan import PARAGRAPHS, TEMPLATES, Templates, bigrams, dice, normalise, scan_licenses, sentences, units
from hotspot.llm.mixing import mix, mixed_documents, targets
from hotspot.llm.pii import feistel_digits, pseudonymise
from hotspot.llm.url_filter import RULES, Rule, judge_urls, rule_tokens
from hotspot.llm.warc_revisit import canonical_url, in_slices, resolve_revisits, with_payload


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


# URL rules


def test_urls(spark):
    urls = [
        "http://a.org/x", "HTTP://Example.ORG/es/1", "http://m.example.org/es", "http://example.org/en/11?q#f", "http://notexample.org/es/",
        "http://com/fr/", "https://x.com/de/a", "http://x.com", "http://a.org", "http://spam-farm.example.net/", "x.com/fr/", "", None, "://org/", "http://b.io/a/casino/b", "http://x y.org/a b", "http://q.org?/es/",
    ]
    df = spark.createDataFrame([(i, u, "r", "t") for i, u in enumerate(urls)] + [(None, "http://a.org/x", "r", "t")], "page_id long, url string, rule string, token string")
    got = {(r.page_id): (r.host, r.path, r.rule, r.verdict, r.pattern) for r in judge_urls(df, RULES).collect()}
    assert len(got) == len(urls) + 1 and got[None] == got[0] == ("a.org", "/x", "org/", "allow", None)
    assert got[1] == ("example.org", "/es/1", "example.org/es/", "block", None)
    assert got[2][2:] == ("org/", "allow", None) and got[3][2:] == ("example.org/en/1", "block", None)
    assert got[4][2] == "org/" and got[5][2] == "com/fr/" and got[6][2:4] == ("com/de/", "block")
    assert got[7] == ("x.com", "", None, "allow", None) and got[8][2] is None
    assert got[9][2:] == (None, "block", "spam-farm.*") and got[14][2:] == (None, "block", "**/casino/")
    assert got[10] == got[11] == got[12] == ("", "", None, "allow", None) and got[13][:3] == ("org", "/", "org/")
    assert got[15][:4] == ("x y.org", "/a b", "org/", "allow") and got[16][:3] == ("q.org", "", None)
    assert judge_urls(df.limit(0), RULES).collect() == []
    assert {r.verdict for r in judge_urls(df, [], []).collect()} == {"allow"}


def test_rule_tokens_are_whole_words_only():
    assert rule_tokens(Rule("block", "example.org", "/en/1")) == ["h:example", "h:org", "p:en"]
    assert rule_tokens(Rule("block", "*", "*abc*/d/")) == ["p:d"] and rule_tokens(Rule("block", "*", "*x*")) == ["*"]


# licences


def test_licenses(spark):
    text = "Some words here.\nReleased under the MIT License.\n\nLicensed under the Apache License,\nVersion 2.0\n\nend"
    df = spark.createDataFrame([(1, text, 0.0, "u"), (2, None, 0.0, "u"), (3, "", 0.0, "u"), (None, "released UNDER the mit license", 0.0, "u"), (5, "x " * 50_000 + "\nLicensed under CC BY-NC 4.0.", 0.0, "u")], "doc_id long, text string, dice double, unit string")
    got = {(r.doc_id, r.unit, r.first_line, r.n_lines, r.license, round(r.dice, 3)) for r in scan_licenses(df).collect()}
    assert got == {(1, "line", 1, 1, "MIT", 1.0), (1, "paragraph", 3, 2, "Apache-2.0", 1.0), (None, "line", 0, 1, "MIT", 1.0), (5, "line", 1, 1, "CC-BY-NC-4.0", 1.0)}
    assert scan_licenses(df.limit(0)).collect() == []


def test_whole_licences_inside_longer_texts(spark):
    import textwrap

    of = lambda name: [t for n, t in PARAGRAPHS if n == name]
    story = "It rained all day in the valley.\nNobody went out.\n\n"
    mit = story + "The MIT License (MIT)\n\nCopyright (c) 2020 A. Person\n\n" + "\n\n".join(textwrap.fill(t, 70) for t in of("MIT")) + "\n\n" + story
    bsd = of("BSD-2-Clause")
    bsd = "/*\n" + "\n".join(" * " + x for x in textwrap.wrap("Copyright 2021 B. Person. All rights reserved. " + bsd[0] + " 1. " + bsd[1] + " 2. " + bsd[2] + " 3. " + of("BSD-3-Clause")[0] + " " + bsd[3], 60)) + "\n */\nint main;\n"
    gpl = "#!/bin/sh\n" + "\n".join("# " + x for x in textwrap.wrap("Copyright 2022 C. Person. " + of("GPL-3.0")[0] + " " + " ".join(of("GPL")), 72)) + "\necho done\n"
    rows = [(1, mit), (2, bsd), (3, gpl), (4, "Copyright 2020 Acme Corp. Released under the MIT License."), (5, "A long line. " * 2000 + "Licensed under CC BY 4.0. " + "And on it goes. " * 2000), (6, story)]
    got = {}
    for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.unit, r.license))
    assert [x for x in got[1] if x[0] == "paragraph"] == [("paragraph", "MIT")] * 3
    assert {x for x in got[2]} >= {("sentence", "BSD-2-Clause"), ("sentence", "BSD-3-Clause")} and len(got[2]) >= 6
    assert {x for x in got[3]} >= {("sentence", "GPL-3.0"), ("sentence", "GPL")}
    assert got[4] == [("sentence", "MIT")] and got[5] == [("sentence", "CC-BY-4.0")] and 6 not in got


def test_size_bounds_prune_templates():
    known = Templates(TEMPLATES, 0.8)
    w = normalise(PARAGRAPHS[-2][1])
    tried = [r for r in known.rows if r[3] <= len(w) - 1 <= r[4]]
    assert 0 < len(tried) < len(known.rows) / 2 and known.best(w) == ("Unlicense", 1.0)
    assert known.hi > 150 and known.best(w * 20) is None


def test_sentences():
    assert sentences("One. Two v. 2.0 is here: # * Three! \"Four\" e.g. five") == ["One.", "Two v. 2.0 is here:", "Three!", 'Four" e.g. five']
    assert sentences("") == [""] and sentences(". " * 50_000) == [". " * 50_000]
    assert [u[0] for u in units("One here. Two there.")] == ["line", "sentence", "sentence"]
    assert [u[0] for u in units("One here.\nTwo there.")] == ["line", "line", "paragraph"]  # each sentence is a line


def test_template_index_loses_no_match():
    rng = random.Random(1)
    vocabulary = "a b c d e f g".split()
    for _ in range(60):
        ts = [(f"T{k}", " ".join(rng.choices(vocabulary, k=rng.randint(2, 9)))) for k in range(6)]
        known = Templates(ts, 0.8)
        for _ in range(60):
            w = rng.choices(vocabulary, k=rng.randint(1, 12))
            best = max(((dice(bigrams(w), bigrams(normalise(t))), [-ord(c) for c in n], n) for n, t in ts), default=(0, None, None))
            got = known.best(w)
            assert (got is None) == (best[0] < 0.8 - 1e-12) and (got is None or (got == (best[2], best[0]) and known.any.search(" ".join(w))))
            assert got is None or known.may_match(["x", *w, "x"])


def test_units():
    assert [u[:3] for u in units("a\nb\n\nc")] == [("line", 0, 1), ("line", 1, 1), ("line", 2, 1), ("line", 3, 1), ("paragraph", 0, 2), ("text", 0, 4)]
    assert [u[:3] for u in units("a")] == [("line", 0, 1)]


# decontamination


def test_wand_finds_what_a_full_scan_finds():
    rng = random.Random(2)
    texts = [words(rng, rng.randint(5, 40)) for _ in range(60)]
    df = Counter(x for t in texts for x in set(words_of(t).tolist()))
    mean = sum(len(words_of(t)) for t in texts) / len(texts)
    ix = BlockMaxIndex(list(range(60)), texts, df, 60, mean)
    for _ in range(200):
        parts = rng.sample(texts, 2)
        passage = " ".join([words(rng, 20), parts[0][: rng.randint(0, len(parts[0]))], parts[1]])
        _, t = ix.lookup(words_of(passage))
        t = np.unique(t)
        score = np.zeros(60)
        for k in t:
            lo, hi = ix.ends[k], ix.ends[k + 1]
            score[ix.item[lo:hi]] += ix.impact[lo:hi]
        assert {i for i, _ in ix.search(t, 0.6)} == set(np.flatnonzero(score >= 0.6 - 1e-9).tolist())


@pytest.mark.parametrize("index_items", [10_000, 4])
def test_contaminated(spark, index_items):
    rng = random.Random(3)
    items = [(k, words(rng, 30) + ". " + words(rng, 6) + ".") for k in range(20)] + [(20, words(rng, 700)), (21, "short one"), (22, ""), (23, None), (24, "...")]
    docs = [(k, words(rng, 300) + " " + t.upper() + "\n" + words(rng, 200)) for k, t in items[:21]]
    docs += [(100, words(rng, 1000)), (101, ""), (102, None), (103, items[0][1].split(". ")[0]), (104, words(rng, 30_000) + " " + items[5][1]), (None, items[6][1])]
    d = spark.createDataFrame([(i, t, 0.5, 1) for i, t in docs], "doc_id long, text string, score double, item_id int")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n int")
    got = {(r.doc_id, r.item_id) for r in contaminated(d, b, index_items=index_items).collect()}
    want = {(k, k) for k in range(21)} | {(104, 5), (None, 6)}
    assert got == want
    assert contaminated(d.limit(0), b).collect() == [] and contaminated(d, b.limit(0)).collect() == []


def test_long_items_leave_no_short_tail(spark):
    rng = random.Random(10)
    common = "the of and in to "
    for n in (0, 1, 256, 257, 261, 512, 513, 1025):
        text = "".join(f"wörd{k}{rng.choice([' ', '-', '. ', chr(10), ' -- '])}" for k in range(n))
        cut = cut_item(text)
        sizes = [len(words_of(t)) for t in cut]
        assert "".join(cut) == text and sum(sizes) == n and max(sizes) <= 256 and len(cut) == max(1, -(-n // 256)) and max(sizes) - min(sizes) <= 1
    items = [(n, words(rng, 256) + " " + " ".join(common.split()[: n - 256])) for n in range(257, 262)]
    docs = [(n, words(rng, 100) + " " + t + " " + words(rng, 100)) for n, t in items]
    docs += [(k, words(rng, 150) + " " + common + words(rng, 150)) for k in range(20)] + [(100, common), (101, "the")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated(d, b).collect()} == {(n, n) for n, _ in items}


def test_items_with_one_changed_word_are_found(spark):
    rng = random.Random(11)
    shapes = [(9, 1), (12, 2), (14, 4), (6, 6), (20, 5), (28, 6), (29, 1), (45, 14), (4, 12)]
    items = [(k, words(rng, q) + ". " + words(rng, a) + ".") for k, (q, a) in enumerate(shapes)]
    docs = []
    for k, t in items:
        w = t.split()
        for i in range(len(w)):
            end = w[i][-1] if w[i].endswith(".") else ""
            docs.append((len(docs), k, words(rng, 120) + " " + " ".join([*w[:i], "zzz" + end, *w[i + 1 :]]) + " " + words(rng, 120)))
    # the question with another answer of several words, every third word changed, the words in another order
    other = []
    for k, t in items:
        q, a = t.split(". ")
        w = t.replace(".", "").split()
        other += [q + ". " + words(rng, 6)] * (len(a.split()) > 1) + [" ".join("zzz" if i % 3 == 0 else x for i, x in enumerate(w)), " ".join(rng.sample(w, len(w)))]
    d = spark.createDataFrame([(i, t) for i, _, t in docs] + [(10_000 + i, words(rng, 120) + " " + t) for i, t in enumerate(other)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, k) for i, k, _ in docs}


def test_question_and_answer():
    assert question_and_answer("Who is it? It is me.") == ("Who is it? ", "It is me.")
    assert question_and_answer("one two three four") == ("one two three", "four") and question_and_answer("one") == ("", "one")


# mixing


def fill(sizes, weights=(3, 1, 2), share=1.5, limit=2.0):
    """Targets by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, free, t = share * sum(sizes.values()), set(names), {}
    while free:
        left = total - sum(t.values())
        over = [s for s in free if left * w[s] / sum(w[x] for x in free) > limit * sizes[s] + 1e-9]
        if not over:
            return t | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        for s in over:
            t[s] = limit * sizes[s]
            free.discard(s)
    return t


def test_targets_equal_repeated_resharing(spark):
    rng = random.Random(4)
    for n in (1, 2, 5, 40):
        sizes = {f"s{k}": rng.randint(1, 10 ** rng.randint(1, 5)) for k in range(n)} | {None: 50, "É": 7}
        got = {r.source: r.target for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert got == pytest.approx(fill(sizes))


def test_mix(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, rng.randint(0, 40)), "hot" if i % 3 else f"s{i % 4}", 7, "c") for i in range(4000)]
    rows += [(5000, None, "hot", 7, "c"), (None, "a b", None, 7, "c"), (6000, "x " * 5, "empty?", 7, "c"), (7000, "", "none", 7, "c"), (1, rows[1][1], "hot", 7, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, chunk string").repartition(5)
    out = mix(df).collect()
    assert len(out) == len(rows) and sorted(map(str, out)) == sorted(map(str, mix(df.repartition(2)).collect()))
    sizes = Counter()
    for _, t, s, *_ in rows:
        sizes[s] += len((t or "").split())
    want = fill({s: n for s, n in sizes.items()})
    taken = Counter()
    for r in out:
        assert r.taken == r.copies * r.size <= 2 * r.size and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 45, s
    assert mix(df.limit(0)).collect() == []


def test_mixed_documents(spark):
    df = spark.createDataFrame([(i, "a b c", "s", "old") for i in (1, 2, 3, 3)] + [(None, "a", "s", "old")], "doc_id long, text string, source string, copy string")
    out = mixed_documents(df)
    assert out.columns == ["doc_id", "text", "source", "copy"]
    copies = Counter(r.doc_id for r in out.collect())
    want = Counter()
    for r in mix(df).collect():
        want[r.doc_id] += r.copies
    assert copies == want and copies[None] >= 1  # a row without an id counts in the sizes and is taken


def test_rows_that_repeat_an_id_are_mixed_each_for_itself(spark):
    rows = [(i % 7, f"w{i} b c", "s") for i in range(40)] + [(7, "", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter(r.text for r in mixed_documents(df).collect())
    # a rate of 1.5 takes every document once or twice
    assert set(got) - {""} == {t for _, t, _ in rows if t} and set(got.values()) <= {1, 2} and abs(sum(got.values()) - 60) <= 3
    assert got == Counter(r.text for r in mixed_documents(df.repartition(5).orderBy(F.rand(1))).collect())


# languages


def labelled(rng, n):
    sets = {"xx": ["the", "and", "of", "this", "house", "water"], "yy": ["der", "und", "das", "nicht", "wasser", "haus"]}
    return [(i, " ".join(rng.choices(sets[lang], k=30)), lang, f"src{i % 3}") for i, lang in enumerate(["xx", "yy"] * n)]


def test_misspelt_labels_are_no_languages(spark):
    rows = [(i, "en" if i % 2 else "fr", "the cat sat" if i % 2 else "le chat noir") for i in range(1000)] + [(2000 + i, f"bad{i}", "the cat sat") for i in range(300)]
    labelled = spark.createDataFrame(rows, "id long, lang string, text string")
    model = fit_text_model(labelled)
    assert model.languages == ["en", "fr", "und"]
    docs = labelled.select("id", "text", F.col("lang").alias("declared"), F.lit("h").alias("host"), F.lit("s").alias("suffix"))
    assert {r.lang for r in identify(docs, model).where("id >= 2000").collect()} == {"en"}


def test_languages_match_a_plain_fusion(spark):
    """Model, posteriors and decisions against plain Python over all rows, without arrays or joins."""
    rng, tongues = random.Random(12), {"en": "the of and to in is that it was for".split(), "de": "der die und in den von zu das mit sich".split(), "fr": "le de un et la les que dans pour est".split()}
    rows = []
    for i in range(240):
        lang = rng.choice(list(tongues))
        text = " ".join(rng.choice(tongues[rng.choice(list(tongues))] if rng.random() < 0.25 else tongues[lang]) for _ in range(rng.choice([1, 3, 40])))
        rows.append((i, rng.choice([text, text, text + " 12 -- 3!", "", None]) if i % 9 == 0 else text, lang if rng.random() < 0.8 else rng.choice([*tongues, None]), rng.choice(["hot.de", f"{lang}.org", None]), rng.choice(["de", "org", None])))

    def cells(text):
        kept = "".join(c if ord(c) >= 128 or c.isalpha() else " " for c in (text or "").lower())
        while "  " in kept:
            kept = kept.replace("  ", " ")
        b = kept.encode()
        return [(int.from_bytes(b[j : j + 3], "big") * 0x9E3779B1 % 2**32) >> 17 for j in range(len(b) - 2)]

    langs = sorted(tongues)
    counts = {k: [0.5] * 2**15 for k in langs}
    for _, text, lang, *_ in rows:
        for c in cells(text) if lang else ():
            counts[lang][c] += 1
    names, total = [*langs, "und"], {k: sum(v) for k, v in counts.items()}
    soft = {}
    for i, text, *_ in rows:
        t = cells(text)
        ll = [min(1, 60 / max(1, len(t))) * sum(math.log(counts[k][c] / total[k]) for c in t) for k in langs] + [min(1, 60 / max(1, len(t))) * len(t) * -math.log(2**15)]
        e = [math.exp(x - max(ll)) for x in ll]
        soft[i] = [x / sum(e) if t else 0.0 for x in e]
    ks = range(len(names))
    add = lambda at, value: [sum(soft[r[0]][k] for r in rows if (r[at] or "") == value) for k in ks]
    mass = [1 + sum(soft[r[0]][k] for r in rows) for k in ks]
    forms, want = len({r[2] or "" for r in rows}), {}
    for i, text, declared, host, suffix in rows:
        s, x, h, d = soft[i], add(4, suffix or ""), add(3, host or ""), add(2, declared or "")
        h = [max(h[k] - s[k], 0) for k in ks]
        near = [(x[k] + 20 * mass[k] / sum(mass)) / (sum(x) + 20) for k in ks]
        said = [(max(d[k] - s[k], 0) + 2 / forms) / (mass[k] + 2) if declared else 1 for k in ks]
        w = [s[k] * (h[k] + 8 * near[k]) / (sum(h) + 8) * said[k] for k in ks]
        best = max(ks, key=lambda k: w[k])
        want[i] = (names[best], w[best] / sum(w), names[best] != "und" and w[best] / sum(w) >= 0.5) if cells(text) else (None, None, False)
    df = spark.createDataFrame(rows, "id long, text string, declared string, host string, suffix string")
    got = identify(df, fit_text_model(df.withColumnRenamed("declared", "lang"))).collect()
    assert len(got) == len(rows) and len({r.lang for r in got}) >= 4
    for r in got:
        lang, p, accepted = want[r.id]
        assert (r.lang, r.accepted) == (lang, accepted) and (p is None or abs(r.posterior - p) < 1e-9), (r, want[r.id])


def test_languages(spark):
    rng = random.Random(6)
    rows = labelled(rng, 60)
    rows += [(1000, "", "xx", "src0"), (1001, None, "xx", "src0"), (1002, "12345 $$$ 678", None, None), (1003, "".join(rng.choices("qzxvkjw", k=400)), None, "src1"), (None, rows[0][1], "xx", "src0"), (1004, "der und " * 20_000, None, None)]
    docs = spark.createDataFrame([(*r, "h", 0.1) for r in rows], "doc_id long, text string, lang string, source string, host string, posterior double")
    pages = spark.createDataFrame([(1, "http://www.Site.de/yy/1", "<html LANG='yy'>"), (2, "http://site.de/yy/1", "<html>"), (3, None, None), (4, "http://x.de/a/b", "")], "page_id long, url string, html string")
    got = {r.doc_id: r for r in identify_documents(docs, pages).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang == lang and got[i].accepted for i, _, lang, *_ in rows[:120])
    assert got[1].host == "www.site.de" and got[1].suffix == "de" and got[1].declared == "yy"
    for i in (1000, 1001, 1002):
        assert got[i].lang is None and not got[i].accepted
    assert got[1003].lang == "und" and not got[1003].accepted
    assert got[None].accepted and got[1004].lang == "yy"
    assert identify_documents(docs.limit(0), pages).collect() == []
    assert page_evidence(pages.limit(0)).collect() == []


def test_host_and_declaration_decide_on_short_texts(spark):
    rng = random.Random(7)
    rows = labelled(rng, 60)
    model = fit_text_model(spark.createDataFrame([r[:3] for r in rows], "id long, text string, lang string"), TRAIN_ROWS)
    table = [(i, t, lang, "xhost" if lang == "xx" else "yhost", "s") for i, t, lang, _ in rows] + [(900, "qa", "xx", "xhost", "s"), (901, "asd", "xx", "xhost", "s"), (902, "asd", "yy", "yhost", "s"), (903, "asd", None, "yhost", None)]
    got = {r.id: r.lang for r in identify(spark.createDataFrame(table, "id long, text string, declared string, host string, suffix string"), model).collect()}
    assert got[900] is None and got[901] == "xx" and got[902] == "yy" and got[903] == "yy"


# pseudonyms


def luhn(s):
    x = [int(c) for c in s][::-1]
    return (sum(x[0::2]) + sum(sum(divmod(2 * d, 10)) for d in x[1::2])) % 10 == 0


def iban_ok(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def test_feistel_is_a_permutation(spark):
    for n in (2, 3):
        df = spark.range(10**n).select(F.lpad(F.col("id").cast("string"), n, "0").alias("d"))
        out = [r.p for r in df.select(feistel_digits(F.col("d"), F.lit("t"), "k").alias("p")).collect()]
        assert sorted(out) == [str(i).zfill(n) for i in range(10**n)] and out != sorted(out)


def test_pseudonyms_keep_formats_and_links(spark):
    texts = {
        1: "card 4111 1111 1111 1111, again 4111-1111-1111-1111 and 4111111111111112",
        2: "1980-02-29 29.02.1980 29/02/1980 02/29/1980 1981-02-29 1700-01-01",
        3: "ip 42.144.35.254 and 999.1.1.1 and 42.144.35.254.",
        4: "call +1 (988) 555-2485 or 988-555-2485",
        5: "DE89 3704 0044 0532 0130 00 DE89370400440532013000 DE88370400440532013000",
        6: "ssn 123-45-6789, 000-12-3456", 7: "A.b@Mail.example.com a.b@mail.example.com", 8: "", 9: None, 10: "no such 12 thing, 3.14 or v1.2.3", 11: "x " * 60_000 + "4111111111111111",
    }
    df = spark.createDataFrame([(i, t, "pii") for i, t in texts.items()] + [(1, texts[1], "pii")], "doc_id long, text string, pii string")
    rows = pseudonymise(df, keep_values=True).collect()
    assert len(rows) == len(texts) + 1
    got = {r.doc_id: r for r in rows}
    p = {i: [x.pseudonym for x in (r.pii or [])] for i, r in got.items()}
    a, b = p[1]
    assert re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", a) and b == a.replace(" ", "-") and luhn(a.replace(" ", "")) and a != "4111 1111 1111 1111"
    assert "4111111111111112" in got[1].text and p[11] == [a.replace(" ", "")] and got[11].text.startswith("x x ")
    day = dt.date.fromisoformat(p[2][0])
    assert p[2][:2] == [str(day), day.strftime("%d.%m.%Y")] and len(p[2]) == 4 and got[2].text.endswith(" 1981-02-29 1700-01-01") and p[2][3] == day.strftime("%m/%d/%Y")
    assert len(p[3]) == 2 and p[3][0] == p[3][1] and all(0 <= int(x) < 256 for x in p[3][0].split("."))
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", p[4][0]) and re.sub(r"\D", "", p[4][0])[1:] == re.sub(r"\D", "", p[4][1])
    assert len(p[5]) == 2 and iban_ok(p[5][0]) and p[5][0].replace(" ", "") == p[5][1] and p[5][0].startswith("DE")
    assert len(p[6]) == 1 and re.fullmatch(r"\d{3}-\d{2}-\d{4}", p[6][0]) and p[7][0] == p[7][1] and "example.com" not in got[7].text
    assert got[8].text == "" and got[9].text is None and got[10].text == texts[10] and p[10] == []
    other = {r.doc_id: r.text for r in pseudonymise(df, key="another").collect()}
    assert other[1] != got[1].text
    assert "value" not in pseudonymise(df).schema["pii"].dataType.elementType.names
    assert pseudonymise(df.limit(0)).collect() == []


def test_pseudonyms_splice_back_in_place(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        t = [words(rng, 3), f"10.0.{rng.randint(0, 255)}.{rng.randint(0, 255)}", words(rng, 2), f"19{rng.randint(10, 99)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}"]
        rows.append((i, " ".join(t) + rng.choice(["", ".", "\n"])))
    for r in pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), keep_values=True).collect():
        text = r.text
        for x in r.pii:
            assert x.pseudonym in text
        back = text
        for x in r.pii:
            back = back.replace(x.pseudonym, x.value, 1)
        assert back == rows[r.doc_id][1] and len(r.pii) == 2


def test_values_followed_by_other_groups_are_found(spark):
    card, iban = "4111 1111 1111 1111", "BE68 5390 0754 7034"
    texts = {
        1: f"{card} 12/27", 2: "4111111111111111 123", 3: f"{iban} CALL NOW", 4: f"{iban} 2024", 5: f"{iban} {iban} {iban} {iban}", 6: f"{card} 12/27/2024 ok",
        7: f"{card} 123 {card} 456 {card}", 8: f"{card}-99 a@b.org", 9: f"{iban} CALL {iban} CALL", 10: "4111 1111 1111 1112 12", 11: f"\ufdd0{card} 12", 12: f"{iban} {card} 12",
    }
    n = {1: 1, 2: 1, 3: 1, 4: 1, 5: 4, 6: 2, 7: 3, 8: 2, 9: 2, 10: 0, 11: 1, 12: 2}
    for r in pseudonymise(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), keep_values=True).collect():
        assert len(r.pii) == n[r.doc_id] and card not in r.text and iban not in r.text and "4111111111111111" not in r.text, r
        back = r.text
        for x in r.pii:
            back = back.replace(x.pseudonym, x.value, 1)
        assert back == texts[r.doc_id]


# revisits


def record(i, url, ts, kind="response", headers=None, digest=None, status=200):
    return (i, url, ts, kind, status, headers, digest, "x", 1)


LOG = "record_id long, url string, ts long, kind string, status int, headers map<string,string>, digest string, src string, slice int"


def test_revisits(spark):
    full = {"ETag": "A", "Content-Length": "9", "X-Old": "1", "Date": "d0"}
    rows = [
        record(1, "http://www.a.org/p/?utm_source=x", 10, headers=full, digest="D1"),
        record(2, "https://A.org:443/p#f", 20, "revisit", {"etag": 'W/A', "Content-Length": "0", "date": "d1", "Connection": "X-Hop", "X-Hop": "h"}, None, 304),
        record(3, "http://a.org/p", 5, "revisit", {"etag": "A"}, None, 304),
        record(4, "http://a.org/p", 30, headers={"ETag": "B"}, digest="D2"),
        record(5, "http://a.org/p", 40, "revisit", {"etag": "A"}, "own", 304),
        record(6, "http://a.org/p", 30, "revisit", {"etag": "B"}, None, 304),
        record(7, None, 50, "revisit", None, None, 304), record(8, "nowhere", 50, "revisit", {}, None, 304), record(9, "http://a.org/p", None, "revisit", {}, None, 304),
        record(10, "http://b.org/", 1, digest="D3"), record(11, "http://b.org", 2, "revisit", None, None, 304),
        record(12, "http://a.org/p", 35, headers={"ETag": "C"}, digest="D4", status=404), record(13, "http://a.org/p", 36, "revisit", {"etag": "B"}, None, 304),
        record(14, "http://c.org/", 1, headers={"Last-Modified": "m"}, digest="D5"), record(15, "http://c.org/", 2, "revisit", {"Last-Modified": "m"}, None, 304),
    ]
    df = spark.createDataFrame(rows, LOG)
    for slice_rows in (20_000, 1):
        got = {r.record_id: r for r in resolve_revisits(df, slice_rows).collect()}
        assert {i: (r.outcome, r.source_id, r.digest) for i, r in got.items()} == {
            2: ("resolved", 1, "D1"), 3: ("no earlier response", None, None), 5: ("validators differ", 4, "own"), 6: ("resolved", 4, "D2"), 7: ("no earlier response", None, None),
            8: ("no earlier response", None, None), 9: ("no earlier response", None, None), 11: ("resolved", 10, "D3"), 13: ("resolved", 4, "D2"), 15: ("resolved", 14, "D5"),
        }
        assert got[2].headers == {"etag": "W/A", "content-length": "9", "x-old": "1", "date": "d1"}
    bodies = spark.createDataFrame([(1, "body")], "record_id long, payload string")
    assert [(r.record_id, r.payload) for r in with_payload(resolve_revisits(df), bodies).collect()] == [(2, "body")]
    assert resolve_revisits(df.limit(0)).collect() == []


def test_revisits_of_a_crowded_url_match_brute_force(spark):
    rng = random.Random(9)
    rows = [record(i, "http://hot.org/" if rng.random() < 0.7 else f"http://h{rng.randint(0, 9)}.org/", rng.randint(0, 3000), *rng.choice([("response", {"ETag": "E"}, f"D{i}", 200), ("revisit", {"ETag": "E"}, None, 304)])) for i in range(3000)]
    got = {r.record_id: r.source_id for r in resolve_revisits(spark.createDataFrame(rows, LOG), 100).collect()}
    want, last = {}, {}
    for r in sorted(rows, key=lambda r: (r[2], r[3] != "response", r[0])):
        if r[3] == "response":
            last[r[1]] = r[0]
        else:
            want[r[0]] = last.get(r[1])
    assert got == want


def test_bursts_and_early_records_leave_no_large_slice(spark):
    """Two early records and 20,000 in two seconds, a third of them with one id: slices stay small, results right."""
    n = 20_000
    rows = [record(i, "http://hot.org/", 0 if i < 2 else 10**9 + (i > n // 2), *(("response", {"ETag": "E"}, f"D{i}", 200) if i in (0, n - 1) else ("revisit", {"ETag": "E"}, None, 304))) for i in range(n)]
    rows = [(7, *r[1:]) if 2 < i < n // 3 else r for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, LOG).repartition(4)
    log = df.select("record_id", "url", "ts", "headers", "digest", (F.col("kind") == "response").alias("full"), canonical_url(F.col("url")).alias("canonical"), F.col("ts").cast("double").alias("at"))
    sizes = [r["count"] for r in in_slices(log, 1000).groupBy("slice").count().collect()]
    assert sum(sizes) == n and max(sizes) < 4000
    got = resolve_revisits(df, 1000).groupBy("ts", "source_id", "outcome").count().collect()
    assert {(r.ts, r.source_id, r.outcome, r["count"]) for r in got} == {(0, 0, "resolved", 1), (10**9, 0, "resolved", n // 2 - 1), (10**9 + 1, n - 1, "resolved", n // 2 - 2)}


def test_canonical_urls(spark):
    pairs = {"HTTP://WWW.Ex.org:80/A/?b=2&a=1&utm_x=3#z": "ex.org/A?a=1&b=2", "https://u:p@ex.org": "ex.org/", "x": None, "http://ex.org/?ref=1": "ex.org/"}
    df = spark.createDataFrame([(u,) for u in pairs], "u string")
    assert {r.u: r.c for r in df.select("u", canonical_url(F.col("u")).alias("c")).collect()} == pairs


def test_log_helper():
    assert math.isclose(dice(bigrams("a b c".split()), bigrams("a b d".split())), 0.5)
