"""Operators 2, 3, 4, 5, 7 and 10 and the pipeline against plain versions, and their defined cases."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from namemine.llm import components, importance, licenses, packing, passages, simhash, textkit, warc
from namemine.llm.op10_packing import tokenizer_path
from namemine.llm.registry import QUERIES
from namemine.llm.shared import stage_table
from llm import brute
from llm.conftest import SMALL


def near_copies(n, seed=5):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [draw.choice(words) for _ in range(400)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(draw.randrange(0, 6)):
            t[draw.randrange(len(t))] = draw.choice(words)
        out.append(" ".join(t))
    return out


def test_words_and_hashes():
    texts = ["", "a b", " a\tb ", "é x" * 50, "b", "a", "ab", None, "q" * 9000, "a  b"]
    column = pa.array(texts)
    seen = {}
    for first, _, data, bounds in textkit.chunks(column, size=20):
        w = textkit.words_of(data, bounds)
        for d, s, e, h in zip(w.doc, w.start, w.end, textkit.word_hashes(w), strict=True):
            word = data[s:e].tobytes()
            seen.setdefault(first + int(d), []).append(word)
            assert seen.setdefault(word, h) == h
    assert [seen.get(i, []) for i in range(len(texts))] == [(t or "").encode().split() for t in texts]
    assert len({v for k, v in seen.items() if isinstance(k, bytes)}) == len({k for k in seen if isinstance(k, bytes)})


def test_simhash_equals_all_pairs(spark, texts, odd):
    made = {10_000 + i: t for i, t in enumerate(near_copies(150))}
    rows = [*texts.items(), *made.items(), (20_000, None), (20_001, ""), (20_002, " \n"), (20_003, "ÀB one"), (20_003, "ÀB one")]
    got = simhash.near_duplicates(odd(rows)).collect()
    fps = {i: brute.fingerprint(t) for i, t in rows}
    want = brute.components(fps, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (format(f, "016x"), want[i]) for i, f in fps.items()}


def test_simhash_links_random_fingerprints(spark):
    draw = random.Random(2)
    values = {draw.getrandbits(64) for _ in range(150)}
    for v in list(values)[:60]:
        for bits in (1, 3, 4, 5):
            values.add(v ^ sum(1 << b for b in draw.sample(range(64), bits)))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = components.connected_components(simhash.links(stage_table(frame, "fps")))
    got = {r.node: r.component for r in found.collect()}
    want = brute.components(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 4)
    assert {v: got.get(v, v) for v in signed} == want


def test_simhash_never_broadcasts_by_an_estimate(spark, odd, monkeypatch):
    """An exploded table of a small file looks small: whatever a join's sides are taken for, they are sorted."""
    plans = []

    def staged(df, name):
        plans.append((name, df._jdf.queryExecution().sparkPlan().toString()))
        return stage_table(df, name)

    monkeypatch.setattr(simhash, "stage_table", staged)
    monkeypatch.setattr(components, "stage_table", staged)
    docs = odd([(i, f"some words {i % 3} that are alike") for i in range(9)])
    for told in (simhash.near_duplicates(docs), simhash.keep_one(docs)):
        plans.append(("result", told._jdf.queryExecution().sparkPlan().toString()))
    assert {"pivot-table", "apart", "placed", "edges"} <= {name for name, _ in plans}
    assert sum("SortMergeJoin" in plan for _, plan in plans) >= 8
    assert not [name for name, plan in plans if "Broadcast" in plan]


def test_keep_one(spark, odd):
    rows = [(3, "same text here now"), (1, "same text here now"), (1, "same text here now"), (None, "same text here now"), (None, "other"), (7, None), (6, "")]
    docs = odd(rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, "same text here now"), (None, "other"), (6, "")], key=repr)
    assert simhash.keep_one(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 2), (2, 2), (8, 9), (100, 5)], "u long, v long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == {2: 2, 3: 2, 4: 2, 5: 2, 100: 2, 8: 8, 9: 8}
    assert components.connected_components(edges.limit(0)).count() == 0


def notice(name, i=0):
    return licenses.TEMPLATES[name][i].replace("{", "").replace("}", "")


def test_license_scan(spark, odd):
    gpl, long = notice("GPL-3.0"), notice("MIT", 1)
    edited = long.replace("any person", "anyone").replace("free of charge", "at no charge")
    rows = [(1, f"text\n{gpl}\nmore"), (2, None), (3, ""), (4, "word " * 30_000 + edited), (5, "this work is the general public of a version"), (None, f"{gpl} {gpl}"), (6, "RELEASED!! under the (MIT) License"), (6, "RELEASED!! under the (MIT) License")]
    got = licenses.scan_licenses(odd(rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    text = dict(rows)
    assert [(r.license, text[1][r.start : r.end], r.coverage) for r in by[1]] == [("GPL-3.0", gpl.rstrip("."), 1.0)]
    assert [r.license for r in by[None]] == ["GPL-3.0"] * 2 and len(by[6]) == 2 and by[6][0].license == "MIT"
    assert by[4][0].license == "MIT" and 0.8 <= by[4][0].coverage < 1 and text[4][by[4][0].start : by[4][0].end] == edited
    assert not {2, 3, 5} & set(by)
    assert licenses.scan_licenses(odd(rows).limit(0)).count() == 0 and licenses.scan_licenses(odd(rows), {}).count() == 0


@pytest.mark.parametrize("between", [" ", "\n", " and so on\n", " one two three four five six seven "])
def test_repeated_license_notices(between):
    scanner = licenses.Scanner()
    for name, notice in (("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("MIT", "Released under the MIT License.")):
        text = "x " + between.join([notice] * 10) + " y"
        got = scanner.scan(text)
        assert [m.license for m in got] == [name] * 10
        assert [text[m.start : m.end] for m in got] == [notice.rstrip(".")] * 10


GPL = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
BSD = notice("BSD-3-Clause", 1)


@pytest.mark.parametrize("name, text", [
    ("GPL-2.0", GPL.format("General Public License", 2)),
    ("LGPL-3.0", GPL.format("Lesser General Public License", 3)),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    ("BSD-2-Clause", BSD[: BSD.index("3. ")] + "THIS SOFTWARE IS PROVIDED BY THE AUTHORS"),
    ("BSD-3-Clause", BSD + " THIS SOFTWARE IS PROVIDED BY THE AUTHORS"),
    ("MPL-1.1", 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-1.1", "Licensed under the Apache Software License, Version 1.1."),
    ("unknown", "Released under the BSD License."),
    ("unknown", GPL.format("Whole Public License", 3)),
    ("unknown", "Licensed under the Apache License, Version 9.0."),
])
def test_neighbour_licenses(name, text):
    assert [m.license for m in licenses.Scanner().scan(f"x y {text} z")] == [name]


def test_every_notice_is_found_and_told_apart():
    scanner = licenses.Scanner()
    for name, texts in licenses.TEMPLATES.items():
        for i in range(len(texts)):
            text = f"a b {notice(name, i)} c d"
            assert [(m.license, m.template, m.coverage) for m in scanner.scan(text)] == [(name, i, 1.0)]
    alone = licenses.Scanner({"GPL-3.0": licenses.TEMPLATES["GPL-3.0"]})
    assert [m.license for m in alone.scan(GPL.format("General Public License", 2))] == ["unknown"]


def test_many_foreign_words_are_no_match():
    scanner = licenses.Scanner({"T": ("one two three four five six seven eight nine ten",)})
    found = lambda t: [(m.n_matched, m.coverage) for m in scanner.scan(t)]
    assert found("one two three four five x six seven eight nine ten") == [(10, 1.0)]
    assert found("one two three x x four five six x x seven eight nine ten") == []


def test_a_hundred_thousand_notices():
    lines = [notice("MIT"), notice("CC-BY-NC-4.0"), "Licensed under the Apache License, Version 2.0."]
    got = licenses.Scanner().scan("\n".join(lines[i % 3] for i in range(100_000)))
    assert len(got) == 100_000 and all(a.end < b.start for a, b in zip(got[:-1], got[1:], strict=True))


def test_alignment_equals_full_table():
    draw = random.Random(4)
    for _ in range(200):
        template = np.asarray([draw.randrange(1, 5) for _ in range(draw.randrange(1, 9))])
        doc = np.asarray([draw.randrange(1, 5) for _ in range(draw.randrange(1, 9))])
        matched, first, last = licenses.align(doc, template, 0, band=20)
        score = np.zeros((len(template) + 1, len(doc) + 1))
        for i in range(1, len(template) + 1):
            for j in range(1, len(doc) + 1):
                same = template[i - 1] == doc[j - 1]
                score[i, j] = max(0, score[i - 1, j - 1] + (2 if same else -1), score[i - 1, j] - 1, score[i, j - 1] - 1)
        assert 0 <= first <= last <= len(doc) and matched <= min(len(doc), len(template))
        assert (matched > 0) == (score.max() > 0)
        if len(doc) == len(template) and (doc == template).all():
            assert matched == len(template)


def test_compact_windows_are_exact():
    rng = np.random.default_rng(1)
    for trial in range(60):
        span = int(rng.integers(2, 47))
        bounds = np.concatenate(([0], np.cumsum(rng.integers(0, 120, 5))))
        values = rng.integers(1, 60 if trial % 2 else 2**60, bounds[-1]).astype(np.uint64)
        got = set()
        for c, left, right in zip(*(x.tolist() for x in passages.windows(values, bounds, span)), strict=True):
            got |= {(x, c) for x in range(max(c - left, c - span + 1), min(c, c + right - span + 1) + 1)}
        want = {(x, x + int(np.argmin(values[x : x + span]))) for a, b in zip(bounds[:-1], bounds[1:], strict=True) for x in range(a, b - span + 1)}
        assert got == want


def test_passages_against_all_pairs(spark, odd):
    draw = random.Random(8)
    word = lambda: "v" + str(draw.randrange(100_000))
    fresh = lambda n: [word() for _ in range(n)]
    shared, longer = fresh(55), fresh(80)
    edited = list(longer)
    edited[40] = "changed"
    rows = [(i, " ".join(fresh(100) + shared + fresh(60))) for i in range(1, 30)]
    rows += [(40, " ".join(fresh(30) + longer)), (41, " ".join(edited + fresh(30))), (42, " ".join(fresh(200))), (43, " ".join(shared[:48]))]
    rows += [(50, rows[-2][1]), (51, None), (52, ""), (None, rows[0][1]), (60, " ".join(fresh(40))), (61, "")]
    rows += [(70, " ".join(fresh(70_000) + longer))]
    got = passages.near_duplicate_passages(odd(rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    text = {d: t.split() for d, t in rows if t}
    for i in range(1, 30):
        (r,) = by[i]
        assert r.class_id == 1 and r.n_docs == 29 and text[i][r.start_word : r.end_word] == shared
    assert {r.class_id for i in (40, 41, 70) for r in by[i]} == {40} and all(len(by[i]) == 1 for i in (40, 41, 70))
    assert (by[42][0].class_id, by[50][0].class_id, by[42][0].end_word) == (42, 42, 200)
    assert not {43, 51, 52, 60, 61, None} & set(by)
    assert passages.near_duplicate_passages(odd(rows).limit(0)).count() == 0


def test_passages_around_a_common_line(spark, odd):
    """Pairs share 55 words, of which 40 are a line that 300 other texts hold."""
    draw = random.Random(3)
    fresh = lambda n: ["v" + str(draw.randrange(100_000)) for _ in range(n)]
    line, rows = fresh(40), []
    for i in range(300):
        rows.append((i, " ".join(fresh(30) + line + fresh(30))))
    shared = {}
    for i in range(40):
        more = fresh(15)
        passage = line + more if i % 2 else more + line
        for doc in (1000 + 2 * i, 1001 + 2 * i):
            shared[doc] = passage
            rows.append((doc, " ".join(fresh(30) + passage + fresh(30))))
    draw.shuffle(rows)
    got = passages.near_duplicate_passages(odd(rows)).collect()
    text = {d: t.split() for d, t in rows}
    found = {r.doc_id for r in got if r.class_id == r.doc_id // 2 * 2 and r.n_docs == 2 and text[r.doc_id][r.start_word : r.end_word] == shared.get(r.doc_id)}
    assert found == set(shared) and len(got) == len(shared)


def test_passages_at_several_places(spark, odd):
    """One text holds a passage twice, and before that a part of it, whichever of the two texts is first."""
    draw = random.Random(4)
    fresh = lambda n: ["v" + str(draw.randrange(100_000)) for _ in range(n)]
    rows, passage = [], {}
    for i in range(12):
        passage[i] = fresh(70)
        rows.append((2 * i, " ".join(fresh(30) + passage[i][:40] + fresh(30) + passage[i] + fresh(60) + passage[i] + fresh(30))))
        rows.append((2 * i + 1, " ".join(fresh(50) + passage[i] + fresh(20))))
    got = sorted(passages.near_duplicate_passages(odd(rows)).collect())
    assert [(r.doc_id, r.start_word, r.end_word) for r in got] == [x for i in range(12) for x in ((2 * i, 100, 170), (2 * i, 230, 300), (2 * i + 1, 50, 120))]


def test_passages_of_many_words(spark, odd):
    """Runs wider than 8 bits, far down a text."""
    draw = random.Random(6)
    fresh = lambda n: ["v" + str(draw.randrange(100_000)) for _ in range(n)]
    rows, at = [], {}
    for i in range(8):
        passage = fresh(320)
        for doc in (2 * i, 2 * i + 1):
            at[doc] = draw.randrange(400, 900)
            rows.append((doc, " ".join(fresh(at[doc]) + passage + fresh(50))))
    got = sorted(passages.near_duplicate_passages(odd(rows), min_words=300).collect())
    assert [(r.doc_id, r.start_word, r.end_word, r.class_id) for r in got] == [(d, a, a + 320, d // 2 * 2) for d, a in sorted(at.items())]
    for n in (4, 1 << 14):
        with pytest.raises(ValueError):
            passages.near_duplicate_passages(odd(rows), min_words=n)


def plain_shared_passages(a, b, similarity, min_shingles):
    todo, out = [([i for i, x in enumerate(a) if x in set(b)], [i for i, x in enumerate(b) if x in set(a)])], []
    while todo:
        at, bt = todo.pop()
        if min(len(at), len(bt)) < similarity * min_shingles / 2 or min(at[-1] - at[0], bt[-1] - bt[0]) + 1 < min_shingles:
            continue
        x, y = set(a[at[0] : at[-1] + 1]), set(b[bt[0] : bt[-1] + 1])
        if len(x & y) >= similarity * len(x | y):
            out.append((at[0], at[-1] + 1, bt[0], bt[-1] + 1))
            continue
        ga, gb = ([q - p for p, q in zip(z[:-1], z[1:], strict=True)] for z in (at, bt))
        mine, cut = (at, ga.index(max(ga)) + 1) if max(ga) >= max(gb) else (bt, gb.index(max(gb)) + 1)
        for part in (mine[:cut], mine[cut:]):
            todo.append((part, [i for i in bt if b[i] in {a[k] for k in part}]) if mine is at else ([i for i in at if a[i] in {b[k] for k in part}], part))
    return out


def test_verification_equals_sets():
    rng = np.random.default_rng(9)
    for trial in range(300):
        parts = [rng.integers(0, 10**6, int(rng.integers(5, 60))) for _ in range(4)]
        a, b = (np.concatenate([p for p in parts if rng.random() < 0.8] + [rng.integers(0, 40, int(rng.integers(0, 30)))]) for _ in range(2))
        b = a.copy() if trial % 7 == 0 else b
        flip = rng.random(len(b)) < (0.0, 0.02, 0.1)[trial % 3]
        b[flip] = rng.integers(0, 10**6, int(flip.sum()))
        assert passages.shared_passages(a, b, 0.8, 20) == plain_shared_passages(a.tolist(), b.tolist(), 0.8, 20)


def test_links_take_every_window_across_batches():
    rows = [(k, t, w) for k in range(3) for t in range(4) for w in range(t + k + 1)]
    want = set()
    for k in range(3):
        own = [r for r in rows if r[0] == k]
        of = {t: [w for _, x, w in own if x == t] for t in range(4)}
        for t in range(4):
            for w in of[t]:
                want |= {(k, 0, t, 0, w)} if t else set()
                want |= {(k, t - 1, t, of[t - 1][-1], w)} if t else set()
                want |= {(k, t, t + 1, w, of[t + 1][0])} if t < 3 else set()
    for size in (1, 2, 3, 7, 100):
        twice = [r for r in rows for _ in range(2)]
        parts = [twice[i : i + size] for i in range(0, len(twice), size)]
        batches = (pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*[(k, 10 * k + t, 100 * k + w) for k, t, w in part], strict=True)], ["key", "id", "window"]) for part in parts)
        got = [tuple(r.values()) for b in passages._link(batches) for r in b.to_pylist()]
        assert len(got) == len(set(got)) and {(a // 10, a % 10, b % 10, u % 100, v % 100) for a, b, u, v in got} == want


def test_importance_keeps_clean_and_drops_marked(spark, odd):
    draw = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    rows, bad = [], set()
    for i in range(3000):
        t = [draw.choice(words) for _ in range(draw.randrange(30, 120))]
        if i % 8 == 0:
            bad.add(i)
            for _ in range(4):
                t[draw.randrange(len(t))] = draw.choice(["vile", "awful", "nasty"])
        rows.append((i, " ".join(t)))
    rows += [(None, "w1 w2"), (4000, None), (4001, ""), (5, rows[5][1])]
    labels = spark.createDataFrame([(i, 1, int(i in bad)) for i in range(0, 3000, 2)] + [(None, 1, 0), (9, None, None), (99_999, 1, 0)], "doc_id long, quality int, toxic int")
    docs = odd(rows)
    got = importance.sample(docs, labels, bits=16).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id for r in got if r.kept}
    clean = {i for i in range(3000) if i not in bad}
    assert len(kept & bad) <= 0.02 * len(bad) and len(clean - kept) <= 0.01 * len(clean)
    assert {None, 4000, 4001} <= kept
    left = importance.keep_sampled(docs, labels, bits=16)
    assert left.columns == docs.columns and sorted(map(repr, kept)) == sorted({repr(r.doc_id) for r in left.collect()})
    assert all(r.kept for r in importance.sample(docs, labels.limit(0), bits=16).collect())
    assert importance.sample(docs.limit(0), labels, bits=16).count() == 0


def unlike_sources(copies=1):
    """Documents of two sources with words of their own, only the first labelled; each eighth says bad words."""
    draw = random.Random(8)
    rows, labels, bad = [], [], set()
    for i in range(1200):
        source = i % 2
        t = [draw.choice([f"s{source}w{draw.randrange(300)}", f"both{draw.randrange(50)}"]) for _ in range(draw.randrange(20, 150))]
        if draw.random() < 0.125:
            bad.add(i)
            for _ in range(3):
                t[draw.randrange(len(t))] = draw.choice(["vile", "awful", "nasty"])
        rows.append((i, " ".join(t)))
        if not source and draw.random() < 0.6:
            labels.append((i, 0 if i in bad else 1, 0))
    many = range(copies)
    return ([(i + 10_000 * c, t) for c in many for i, t in rows], [(i + 10_000 * c, q, x) for c in many for i, q, x in labels], {i + 10_000 * c for c in many for i in bad})


@pytest.mark.parametrize("copies", [1, 25])
def test_importance_does_not_depend_on_size_or_topic(spark, odd, copies):
    rows, labels, bad = unlike_sources(copies)
    got = importance.sample(odd(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    kept = {r.doc_id for r in got if r.kept}
    for source in (0, 1):
        own = {i for i, _ in rows if i % 2 == source}
        assert len(kept & own - bad) >= 0.97 * len(own - bad), source
        assert len(kept & own & bad) <= 0.05 * len(own & bad), source


def plain_log_ratio(s, n_s, l, n_l, t, n_t, floor=0.001, dead=0.1, margin=2.0):
    e = max(floor, 2 / n_t)
    a, b = (math.log((t / n_t + e) / (x / n + e)) for x, n in ((s, n_s), (l, n_l)))
    if a * b <= 0:
        return 0.0
    error = math.sqrt((t + 1) / (n_t * (t / n_t + e)) ** 2 + (l + 1) / (n_l * (l / n_l + e)) ** 2)
    return math.copysign(max(0.0, min(abs(a), abs(b)) - dead - margin * error), b)


def test_log_ratios_equal_plain_ones(spark):
    draw = random.Random(9)
    rows = [(s, min(s, draw.randrange(500)), 0) for s in (draw.randrange(1, 5000) for _ in range(300))]
    rows = [(s, lab, min(lab, draw.choice([0, 1, lab // 10, lab // 2, lab]))) for s, lab, _ in rows]
    frame = spark.createDataFrame(rows, "n_raw long, n_labelled long, n_target long")
    got = [r.r for r in frame.select(importance.log_ratio(5000, 500, 300).alias("r")).collect()]
    want = [plain_log_ratio(s, 5000, lab, 500, t, 300) for s, lab, t in rows]
    assert np.allclose(got, want) and any(w > 0 for w in want) and any(w < 0 for w in want)


def test_bucket_counts_and_weights_equal_plain_counts(spark, odd):
    rows = [(1, "a b a"), (2, "B c c c"), (3, None), (4, "x x y y"), (None, "a")]
    column = pa.array([t for _, t in rows])
    plain, n = {2: set(range(5))}, [0] * 5
    for first, _, data, bounds in textkit.chunks(column):
        doc, bucket = importance.features(data, bounds, 16)
        for d, b in set(zip(doc.tolist(), bucket.tolist(), strict=True)):
            plain.setdefault(b, set()).add(first + d)
            n[first + d] += 1
    sample = importance.Labels(np.asarray([2, 3, 4]), np.asarray([2, 4]), np.asarray([9]))
    got = {r.bucket: (r.n_raw, r.n_labelled, r.n_target) for r in importance.bucket_counts(odd(rows), sample, 16).collect()}
    assert got == {b: (len(d), len(d & {1, 2, 3}), len(d & {1, 3})) for b, d in plain.items()}
    assert got[0] == (1, 1, 1) and got[1] == (1, 1, 1)  # thrice, in turn
    bucket = sorted(plain)[-1]
    weights = importance.log_weights(column, importance.Model(16, np.asarray([bucket]), np.asarray([-2.0])))
    assert np.allclose(weights, [-2 / math.sqrt(n[i] + 1) if i in plain[bucket] else 0 for i in range(5)])


def test_labels_and_envelope(spark):
    rows = [(i, i % 3 and 1, 0) for i in range(200)] + [(4, 0, 0), (None, 1, 0), (5, None, None), (7, 1, None)]
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)] + [(1000 + i, f"text {i}") for i in range(50)], "doc_id long, text string")
    rows += [(1000 + i, 1, 0) for i in range(50)]  # copies of judged texts
    got = importance.label_sample(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
    good = {i for i in range(200) if i % 3} - {4, 5}
    assert set(got.target) | set(got.held) == good and not set(got.target) & set(got.held)
    assert set(got.labelled) <= set(range(200)) and {*got.labelled} & good == {*got.target} and 0.1 < len(got.held) / len(good) < 0.3
    few = importance.label_sample(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"), max_labels=50)
    assert 30 < len(few.labelled) <= 50
    weights = spark.createDataFrame([(i, float(i)) for i in range(1000)], "doc_id long, log_weight double")
    assert importance.envelope(weights, np.arange(0, 1000, 2), 0.01) == 10.0
    assert importance.envelope(weights, np.zeros(0, np.int64)) == float("-inf")


@pytest.mark.parametrize("k", [0, 1, 7, 500, 999, 1000, 2000])
def test_kth_largest(spark, k):
    values = [math.sin(i) * 10 ** (i % 5) for i in range(990)] + [0.5] * 10
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    got = importance.kth_largest(frame, "x", k)
    want = float("inf") if k == 0 else float("-inf") if k >= 1000 else sorted(values, reverse=True)[k - 1]
    assert got == want


PAGES = [(3, "http://a/\r\nX: y", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "u", None), (4, "u", ""), (None, "u", "<p>é</p>"), (5, "u", "x" * 300_000), (6, "v", "WARC/1.1\r\n\r\n"), (7, "v", "only null ids"), (7, "v", "only null ids")]


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_warc_round_trip(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(warc, "HOT", hot)  # no payload is frequent, some are, all are
    pages = spark.createDataFrame([(*r, 9) for r in PAGES], "page_id long, url string, html string, payload int").repartition(2)
    archives = warc.write_archives(pages, f"file://{tmp_path}/w", archive_bytes=400)
    got = warc.read_archives(archives).collect()
    assert len(got) == len(PAGES)
    first = {}
    for i, _, h in PAGES:
        h = h or ""
        first[h] = min(x for x in (first.get(h), i) if x is not None) if first.get(h) is not None or i is not None else None
    by = {(r.page_id, r.payload_digest): r for r in got}
    for i, url, h in PAGES:
        h = h or ""
        r = by[i, warc.base32_sha1(h.encode())]
        is_first = i == first[h]
        assert (r.record_type, r.refers_to) == (("response", None) if is_first else ("revisit", first[h]))
        assert r.payload_bytes == len(h.encode()) and r.payload == (h.encode() if is_first else None)
        assert r.url == (url and " ".join(url.splitlines()))
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0
    least = warc.read_archives(warc.write_archives(pages, min_bytes=10)).collect()
    wrong = archives.selectExpr("path", "n_records + 1 AS n_records")
    with pytest.raises(Exception, match="records, not"):
        warc.read_archives(wrong).collect()
    assert sum(r.record_type == "revisit" for r in least) == 0


def test_warc_reader_refuses_broken_archives():
    records = [warc.record_bytes(i, "u", b"payload %d " % i * 50, 50 * len(b"payload %d " % i), warc.base32_sha1(b"payload %d " % i * 50), None) for i in range(300)]
    ((count, parts),) = warc.encode_archives(iter(records))
    parts = list(parts)
    data = b"".join(parts)
    assert count == 300 and data[:4] == bytes.fromhex("5d2a4d18") and list(warc.decode_archive(data))[1:] == records
    for broken in (data[:-3], data[:5], data[:200] + b"\0" + data[201:], data + b"junkjunk"):
        with pytest.raises((warc.WarcError, Exception)):
            for r in warc.decode_archive(broken):
                warc.page_record(r)
    for old, new in ((b"Content-Length: ", b"Content-Length: 9"), (b"WARC/1.1", b"HTTP/1.1"), (b"WARC-Date", b"WARC-Late"), (b"sha1:", b"sha1:A")):
        with pytest.raises(warc.WarcError):
            warc.page_record(records[0].replace(old, new, 1))


def check_pieces(rows, ids_of):
    """Pieces cover every document's ids once; windows are gapless and at most 1024 long."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids_of)
    for doc, pieces in by_doc.items():
        ids, at = ids_of[doc], 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    return by_seq


def test_packing(spark, texts, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    made = {10_000: "", 10_001: None, 10_002: "a<|endoftext|>b", 10_003: "日本語 テスト  x y  ", 10_004: "word " * 5000, 10_005: "tab\t\n  it's 12 ½ ²x", 10_006: " lead  trail "}
    rows = [*texts.items(), *made.items()]
    ids_of = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for d, t in rows}
    got = packing.pack(odd(rows).repartition(3), tokenizer_path()).collect()
    windows = check_pieces(got, ids_of)
    assert sum(1024 - sum(r.length for r in w) for w in windows.values()) <= 3 * 1023
    assert all(list(r.ids) == ids_of[r.doc_id][r.start : r.start + r.length] for r in got)
    assert packing.pack(odd(rows).limit(0), tokenizer_path()).count() == 0
    small = packing.pack(odd(rows).coalesce(1), tokenizer_path(), max_open=2, with_ids=False).collect()
    check_pieces(small, ids_of)


def test_packer_takes_the_least_sum_of_squares():
    draw = random.Random(3)
    packer, window = packing.Packer(32), 32
    for i in range(500):
        size = draw.randrange(1, 32)
        before = packer.count.copy()

        def total(level):
            n = before.astype(int)
            if level:
                n[level] -= 1
            if level + size < window:
                n[level + size] += 1
            return int((n[1:window] ** 2).sum())

        choices = [0, *[h for h in range(1, window - size + 1) if before[h]]]
        packer.place((i, 0, np.zeros(size), size), size)
        assert int((packer.count[1:window].astype(int) ** 2).sum()) == min(map(total, choices))


def test_pipeline_equals_plain_stages(spark, documents, texts):
    """Each stage against a plain version on its own input."""
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    docs = documents
    frames = []
    for name, stage in corpus_pipeline.STAGES:
        frames.append(stage_table(stage(spark, docs, SMALL), name))
        docs = frames[-1]
    kept, single, clean, hidden, packed = frames
    assert all(f.columns == documents.columns for f in frames[:4])
    sample = {r.doc_id for r in importance.sample(documents, labels).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == sample and len(sample) > 0.8 * len(texts)
    fps = {i: brute.fingerprint(texts[i]) for i in sample}
    assert {r.doc_id for r in single.collect()} == set(brute.components(fps, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4).values())
    left = {r.doc_id for r in single.collect() if not brute.contamination(r.text, items)[1]}
    assert {r.doc_id for r in clean.collect()} == left
    for r in hidden.collect():
        assert r.n_chars == len(r.text) and not brute.base_spans(r.text)
    assert {r.doc_id for r in hidden.collect()} == left == {r.doc_id for r in packed.collect()}
    final = QUERIES["pipeline"](spark, SMALL).collect()
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, final)) == sorted(map(key, packed.collect()))


def test_pipeline_defined_cases(spark, odd, tmp_path, texts):
    """Null, empty and repeated texts, null ids and columns with clashing names go through all stages; so does nothing."""
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = [*list(texts.items())[:30], (None, "no id here"), (90_001, None), (90_002, ""), (90_003, "twice the same text"), (90_003, "twice the same text")]
    named = odd(rows).selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "CAST(length(text) AS long) AS n_chars", "fp", "log_weight", "words", "1 AS scan", "2 AS own", "3 AS component_id")
    for n, docs in enumerate((named, named.limit(0))):
        folder = str(tmp_path / str(n))
        docs.write.parquet(f"{folder}/documents.parquet")
        (labels if n == 0 else labels.limit(0)).write.parquet(f"{folder}/labels.parquet")
        spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
        at = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            at = stage_table(stage(spark, at, folder), name)
            assert name == "packing" or at.columns == docs.columns
        ids = {r.doc_id for r in at.collect()}
        assert (None in ids and 90_003 in ids) if n == 0 else not ids
        assert QUERIES["pipeline"](spark, folder).count() == at.count()
