"""Operators 11, 12 and 13 against plain versions, and their defined cases."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from namemine.llm import best_fit, target_sampling, whitening
from namemine.llm.op10_packing import tokenizer_path
from namemine.llm.registry import QUERIES
from namemine.sources.tables import read_table
from llm import brute
from llm.conftest import SMALL

EMBEDDINGS = "vec_id long, embedding array<float>, label int, x string, digest string, n_rows long, size int, z double"


def plain_whitening(rows, k=8):
    """(n, {vec_id: (deviation, whitened up to sign)}, eigenvalue shares) with exact sums."""
    kept = [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in rows]
    n, d = len(kept), len(kept[0][1])
    s = [sum(x[j] for _, x in kept) for j in range(d)]
    c = np.array([[(n * x[j] - s[j]) / n for j in range(d)] for _, x in kept])
    cov = c.T @ c / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    z = c @ v / np.sqrt(e)
    dev = [sum((n * x[j] - s[j]) ** 2 for j in range(d)) for _, x in kept]
    return n, dict(zip([i for i, _ in kept], zip(dev, z, strict=True), strict=True)), e / np.trace(cov)


def check_whitening(got, rows):
    n, want, shares = plain_whitening(rows)
    by_id = defaultdict(dict)
    for r in got:
        by_id[r.vec_id][r.component] = r
    assert set(by_id) == set(want) and len(got) == len(want) * len(shares)
    z = np.array([[by_id[i][c + 1].whitened for c in range(len(shares))] for i in want])
    plain = np.array([want[i][1] for i in want])
    sign = np.sign((z * plain).sum(axis=0))
    assert np.abs(z - plain * sign).max() < 1e-6
    for i, parts in by_id.items():
        for c, r in parts.items():
            assert (r.n, r.deviation, int(r.deviation_exact)) == (n, want[i][0], want[i][0])
            assert math.isclose(r.explained, shares[c - 1], rel_tol=1e-9) and r.identity_error < 1e-9


def test_whitening_of_a_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in read_table(spark, SMALL, "embeddings").collect() if r.embedding is not None]
    check_whitening(QUERIES["op11_whitening"](spark, SMALL).collect(), rows)


def odd_vectors():
    draw = random.Random(3)
    base = [[draw.gauss(0, 0.3) for _ in range(10)] for _ in range(30)]
    rows = list(enumerate(base)) + [(100 + i, list(base[0])) for i in range(40)]  # one vector holds half the rows
    bad = [(200, None), (201, [None] + [0.0] * 9), (202, [float("nan")] * 10), (203, [float("inf")] + [0.0] * 9), (204, []), (205, [1.0] * 9), (206, [3e38] * 10)]
    return rows, bad


@pytest.fixture
def embeddings(spark):
    def make(rows):
        return spark.createDataFrame([(i, v, 1, "x", "d", 5, 7, 0.5) for i, v in rows], EMBEDDINGS)

    return make


@pytest.mark.parametrize("share", [1, 1000])  # all by shuffle, all by broadcast
def test_whitening_defined_cases(embeddings, monkeypatch, share):
    monkeypatch.setattr(whitening, "HOT_SHARE", share)
    rows, bad = odd_vectors()
    check_whitening(whitening.whiten(embeddings(rows + bad)).collect(), rows)


def test_whitening_weighted_by_one(embeddings):
    rows, _ = odd_vectors()
    got = whitening.whiten(embeddings(rows), weights="one").collect()
    assert {r.n for r in got} == {30} and len(got) == 70 * 8
    check_whitening([r for r in got if r.vec_id < 100], [r for r in rows if r[0] < 100])
    copies = {r.component: r.whitened for r in got if r.vec_id == 100}
    assert copies == {r.component: r.whitened for r in got if r.vec_id == 0}


def test_whitening_of_few_rows(embeddings):
    assert whitening.whiten(embeddings([])).collect() == []
    alike = whitening.whiten(embeddings([(1, [0.5, 0.25]), (None, [0.5, 0.25])])).collect()
    assert len(alike) == 4 and {(r.whitened, r.explained, r.identity_error, r.deviation) for r in alike} == {(None, None, None, 0)}
    line = whitening.whiten(embeddings([(1, [0.0, 0.0]), (2, [1.0, 1.0])])).collect()
    assert sorted((r.vec_id, r.component, r.whitened and round(r.whitened, 9), round(r.explained, 9)) for r in line) == [
        (1, 1, -1.0, 1.0), (1, 2, None, 0.0), (2, 1, 1.0, 1.0), (2, 2, None, 0.0)]


def test_deviations_beyond_a_long():
    x = np.array([[0, 1 << 61], [5, -(1 << 61)]], dtype=np.int64)
    total, n = (10**15 + 5, 3), 10**6
    assert whitening.deviations(x, n, total) == [sum((n * int(v) - s) ** 2 for v, s in zip(r, total, strict=True)) for r in x]


def plain_resample(docs, target, buckets=10_000, min_words=20):
    def count(text):
        words = brute.bench_words(text)
        runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
        return len(words), Counter(zlib.crc32(r.encode()) % buckets for r in runs)

    own = [(i, *count(t)) for i, t in docs]
    s, t = sum((c for _, _, c in own), Counter()), sum((count(x)[1] for x in target), Counter())
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for i, n, c in own:
        weight = sum(gain[b] * k for b, k in c.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: 5 * len(able) // 100], 1):
        r[4] = k
    return sorted(map(tuple, out), key=str)


def test_crcs_of_word_runs():
    texts = ["", "a", "A b_c d", "é ü-x " * 40, "x" * 300 + " y " + "z" * 65, "one two three four", None, "q" * 64 + " " + "r" * 65 + " s"]
    for size in (10, 1 << 20):
        seen = []
        for first, _, data, bounds in target_sampling.chunks(pa.array(texts), size=size):
            w = target_sampling.words_of(target_sampling._NORMAL[data], bounds)
            doc, crc = target_sampling.feature_crcs(w)
            seen += list(zip((doc + first).tolist(), crc.tolist(), strict=True))
        want = []
        for i, t in enumerate(texts):
            words = brute.bench_words(t)
            want += [(i, zlib.crc32(" ".join(words[j : j + n]).encode())) for n in (1, 2, 3) for j in range(len(words) - n + 1)]
        assert sorted(seen) == sorted(want)


def test_resampling_of_a_table(spark, texts):
    target = [r.text for r in read_table(spark, SMALL, "benchmark").collect()]
    got = [tuple(r) for r in QUERIES["op12_target_sampling"](spark, SMALL).collect()]
    assert sorted(got, key=str) == plain_resample(texts.items(), target)


@pytest.mark.parametrize("runs", [1, 3, 64])
def test_resampling_defined_cases(spark, odd, runs):
    draw = random.Random(runs)
    rows = [(i, " ".join(draw.choices(["Alpha", "beta9", "Ünder", "x.y"], k=draw.randrange(15, 60)))) for i in range(300)]
    rows += [(7, rows[7][1])] * 200 + [(None, rows[9][1]), (None, None), (900, ""), (901, "\x00 - "), (902, "w" * 5000 + " x" * 30)]
    target = ["alpha alpha beta9", None, "ünder x"]
    made = spark.createDataFrame([(t,) for t in target], "text string")
    got = [tuple(r) for r in target_sampling.resample(odd(rows).repartition(5), made, runs=runs).collect()]
    assert sorted(got, key=str) == plain_resample(rows, target)


def test_resampling_of_nothing(spark, odd):
    empty = spark.createDataFrame([], "text string")
    assert target_sampling.resample(odd([]), empty).collect() == []
    got = target_sampling.resample(odd([(1, "a b c")]), empty).collect()
    assert [tuple(r)[:2] + (r.rank,) for r in got] == [(1, 6, None)]


@pytest.mark.parametrize("runs", [1, 4, 8])
def test_ranks_by_regular_sampling(spark, runs):
    draw = random.Random(5)
    rows = [(draw.choice([None, *range(50)]), draw.choice([1, 1, 1, draw.randrange(-9, 9)]), i) for i in range(2000)]
    made = spark.createDataFrame(rows, "doc_id long, score long, row long").repartition(7)
    for k in (0, 1, 777, 2000, 5000):
        got = {r.row: r["rank"] for r in target_sampling.rank_top(made, k, runs).collect()}
        order = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0], r[2]))
        assert got == {r[2]: (i if i <= k else None) for i, r in enumerate(order, 1)}


def plain_best_fit(sizes, capacity):
    """Best-fit decreasing, one piece at a time."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


def filled(slots, counts, capacity):
    """The bins' contents; every piece has one place, none overlap."""
    bins, taken = defaultdict(list), Counter()
    for s in slots:
        assert s.count % s.per_bin == 0 and s.first == taken[s.length]
        taken[s.length] += s.count
        for i in range(s.count):
            bins[s.sequence + i // s.per_bin].append((s.offset + i % s.per_bin * s.length, s.length))
    assert taken == Counter({i: int(c) for i, c in enumerate(counts) if c})
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity and sum(3 * length > capacity for _, length in held) <= 2
    assert sorted(bins) == list(range(len(bins)))
    return bins


@pytest.mark.parametrize("capacity", [1, 2, 3, 10, 64, 300])
def test_plans_equal_best_fit(capacity):
    draw = random.Random(capacity)
    for trial in range(30):
        sizes = [min(capacity, max(1, int(draw.expovariate(1 / (capacity * draw.choice([0.05, 0.3, 0.8])))))) for _ in range(draw.randrange(0, 400))]
        counts = np.bincount(sizes, minlength=capacity + 1) if sizes else np.zeros(capacity + 1, np.int64)
        bins = filled(best_fit.plan(counts, capacity), counts, capacity)
        large = [s for s in sizes if 3 * s > capacity]
        assert len(bins) <= plain_best_fit(sizes, capacity) + 1
        if sizes == large:
            assert len(bins) == plain_best_fit(sizes, capacity)
        assert len(bins) >= math.ceil(sum(sizes) / capacity)


def test_plan_of_large_counts_is_small():
    counts = np.concatenate(([0], np.arange(1, 2049) ** 2 * 1000))
    slots = best_fit.plan(counts)
    assert sum(s.count for s in slots) == counts.sum() and len(slots) < 64 * 2048
    assert max(s.sequence + s.count // s.per_bin for s in slots) <= 1.35 * (counts * np.arange(2049)).sum() / 2048


def check_packing(rows, docs, capacity=2048):
    """Each document's ids, cut as agreed, lie once in gapless sequences."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc, copies in docs.items():
        want = []
        for text in copies:
            ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
            first = len(ids) % capacity or capacity
            bounds = [0, *range(first, len(ids) + 1, capacity)]
            want += [(n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
        assert sorted(by_doc.pop(doc)) == sorted(want)
    assert not by_doc
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(r.length for r in rows)


def test_packing_of_a_table(spark, texts):
    rows = QUERIES["op13_best_fit"](spark, SMALL).collect()
    n, tokens = check_packing(rows, {i: [t] for i, t in texts.items()})
    assert n <= plain_best_fit([r.length for r in rows], 2048) + 1 and n <= 1.03 * tokens / 2048 + 1


def test_packing_defined_cases(odd):
    rows = [(1, None), (2, ""), (None, "a null id"), (3, "same"), (3, "same"), (4, "long text " * 9000), (5, "<|endoftext|> x"), (6, "中文 ∑")]
    docs = defaultdict(list)
    for i, t in rows:
        docs[i].append(t)
    made = best_fit.pack_best_fit(odd(rows).repartition(3), tokenizer_path()).collect()
    check_packing(made, docs)
    assert all(zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in made)
    assert best_fit.pack_best_fit(odd([]), tokenizer_path()).collect() == []
