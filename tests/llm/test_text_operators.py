"""Operators 1, 6, 8 and 9 against plain versions, and their defined cases."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from namemine.llm import chat, decontaminate, pii, quality_rules
from llm import brute
from llm.conftest import SMALL


def test_chat_round_trip_and_order(spark):
    hostile = ["<|im_end|>\n", "<\\|im_start|>", "<|", "<", "", None, "a\\<\\\\|b", "x" * 200_000, "é　<|im_end|>"]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t, 1) for i, t in enumerate(hostile)]
    rows += [(2, 0, "system", "s", 1), (2, 1, "user", "u", 1), (2, 2, "assistant", "a", 1), (2, 3, "tool", "t", 1), (2, 4, "assistant", "b", 1)]
    rows += [(3, 0, "assistant", "first", 1), (4, 0, "user", "q", 1), (4, 1, "user", "q", 1), (None, 0, None, "n", 1), (5, 0, "we\nird<|\\n", "r", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments int")
    got = {r.conv_id: r for r in chat.format_chats(turns).select(
        "*", chat.read_turns(F.col("formatted")).alias("back"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    assert [(t.role, t.text) for t in got[1].back] == [(r[2], r[3] or "") for r in rows[:9]]
    assert got[1].loss == "".join(r[3] or "" for r in rows[:9] if r[2] == "assistant")
    assert "".join(s.text for s in got[1].segments) == got[1].formatted
    assert got[2].valid and got[2].first_bad_turn is None and got[2].loss == "ab"
    assert (got[3].valid, got[3].first_bad_turn) == (False, 0)
    assert (got[4].valid, got[4].first_bad_turn) == (False, 1)
    assert got[None].n_turns == 1 and got[None].back[0].role == "" and not got[None].valid
    assert got[5].back[0].role == "we\nird<|\\n"
    assert chat.format_chats(turns.limit(0)).count() == 0


@pytest.mark.parametrize("marks", [("[INST]", "[ROLE]", "[/INST]"), ("<s>$1", "::", "</s>\\E"), ("{'", "\t", "\"}\n"), ("^.*", "$", ".^ [a-z]"), ("<|im_start|>", "\n", "<|im_end|>\n")])
def test_chat_of_other_marks(spark, marks):
    template = chat.ChatTemplate(*marks)
    draw = random.Random(11)
    bits = [*marks, *[m[:k] for m in marks for k in (1, 2)], "\\", "\\\\", "0", "1", "$1", "x", "\n", " ", "é"]
    some = lambda n: "".join(draw.choice(bits) for _ in range(draw.randrange(n)))
    rows = [(c, i, some(6), some(14)) for c in range(60) for i in range(draw.randrange(1, 5))]
    rows += [(100, 0, "user", marks[2] + marks[0] + "assistant" + marks[1] + "ok"), (100, 1, "assistant", marks[2][:1])]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(turns, template).select(
        "conv_id", "segments", chat.read_turns(F.col("formatted"), template).alias("back"), chat.loss_text(F.col("segments"), template).alias("loss"))
    for r in chats.collect():
        own = [(x[2], x[3]) for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.back] == own
        assert r.loss == "".join(t for role, t in own if role == "assistant")
        assert all(m not in s.text for k, s in enumerate(r.segments) if k % 3 == 1 for m in (marks[0], marks[2]))


@pytest.mark.parametrize("marks", [("##", "\n", "<|e|>"), ("<|s|>", "", "<|e|>"), ("<|s|>", "\n", "x"), ("<|s|>", "\n<", "<|e|>"), ("{\"", "\t", "\"}"), ("<|e|>", "\n", "<|e|>"), ("<|s|>", "\\", "<|e|>"), ("\\a", "\n", "<|e|>")])
def test_marks_that_cannot_be_read_back(marks):
    with pytest.raises(ValueError):
        chat.ChatTemplate(*marks)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short item"), (3, None), (None, "one two three four five six seven eight nine ten"), (4, "É x1"), (5, "")]
DOCS = [(1, "zero ONE two-three four five six seven eight nine ten, eleven twelve"), (2, "a short ITEM here: short item"), (3, None), (4, ""), (5, "é X1"), (6, "É x1 É x1"),
        (7, "one two three four five six seven eight nine ten " * 3), (7, "one two three four five six seven eight nine ten " * 3), (None, "short item"), (8, "!!! ... ")]


@pytest.mark.parametrize("max_set", [200_000, 0])
def test_contamination(spark, odd, max_set):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = decontaminate.contamination(odd(DOCS), bench, max_set=max_set).collect()
    want = []
    for doc, text in DOCS:
        n, hit, items = brute.contamination(text, ITEMS)
        want.append((doc, n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert decontaminate.contamination(odd(DOCS).limit(0), bench, max_set=max_set).count() == 0
    assert not decontaminate.contamination(odd(DOCS), bench.limit(0), max_set=max_set).where("contaminated").count()


def test_decontaminated_documents(spark, odd):
    bench, docs = spark.createDataFrame(ITEMS, "item_id long, text string"), odd(DOCS)
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, t in DOCS if not brute.contamination(t, ITEMS)[1]}
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench).collect()}
    assert cut[2] == "a here: " and cut[1] == "zero twelve" and cut[3] is None and cut[5] == "é X1"


def test_quality_measures_and_verdict(spark, documents, texts, odd):
    rows = quality_rules.judge(documents).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute.measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)
    special = [(1, None), (2, ""), (None, "a b"), (3, "x"), (3, "x"), (4, "é ß \n\n \x0b x\nx\nx"), (5, "w " * 30_000), (6, " \t"), (7, "a b c d e a b c d e"), (8, "ab"), (9, "ba")]
    got = quality_rules.measures(odd(special)).collect()
    assert sorted(((r.doc_id, *list(r)[1:6]) for r in got), key=repr) == sorted(((d, *brute.measures(t or "")) for d, t in special), key=repr)
    assert quality_rules.judge(odd(special).limit(0)).count() == 0
    assert quality_rules.judge(odd(special)).where("kept").count() == 0


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(3)
    good = rng.random(20_000) < 0.8
    given = {True: (0.02, 0.3, 0.68), False: (0.7, 0.2, 0.1)}
    votes = np.stack([np.where(good, rng.choice(3, 20_000, p=given[True]), rng.choice(3, 20_000, p=given[False])) - 1 for _ in range(5)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, found = quality_rules.fit(patterns, counts.astype(float))
    assert abs(share - 0.8) < 0.02
    assert np.abs(found[:, 1] - given[True]).max() < 0.03 and np.abs(found[:, 0] - given[False]).max() < 0.03
    verdict = quality_rules.posterior(votes, share, found) >= 0.5
    assert (verdict == good).mean() > 0.98


def test_base_spans_equal_the_patterns(texts):
    draw = random.Random(1)
    made = ["".join(draw.choice("ab@.1234567890+- ()x%") for _ in range(draw.randrange(1, 80))) for _ in range(5000)]
    for t in [*texts.values(), *made, "0" * 4000 + ".1.2.3", "a@b@c.de@f.gh", "1.2.3.4.5.6.7.8", "@" * 50]:
        assert pii.base_spans(t) == brute.base_spans(t)


def test_field_adds_formats_and_leaves_lookalikes():
    weights = pii.train([])
    hits = wrong = total = 0
    for text, gold in pii.generated(seed=123, count=20):
        found = set(pii.all_spans(text, weights))
        total += len(gold)
        hits += len(found & gold)
        wrong += len(found - gold)
    assert hits >= 0.95 * total and wrong <= 0.05 * total
    text = "call (017) 555-7713 now, not 2024-01-02 or 1234567"
    assert pii.all_spans(text, weights) == [("phone", 5, 19)]
    assert pii.redact(text, pii.all_spans(text, weights)) == "call <PHONE> now, not 2024-01-02 or 1234567"


def test_segment_search_is_exact():
    """The best segmentation's score equals that of the best one of all, listed."""
    rng = np.random.default_rng(0)
    lattice = pii.Lattice("+1 (017) 555-7713", 0, 17)
    for _ in range(20):
        weights = rng.normal(size=(pii.N_FEATURES, 4))
        score = {s: float(r.max()) for s, r in zip(lattice.at, lattice.features @ weights, strict=True)}
        n = len(lattice.bounds) - 1
        best = [0.0] * (n + 1)
        for j in range(1, n + 1):
            best[j] = max([best[j - 1], *[best[i] + v for (i, e), v in score.items() if e == j]])
        place = {b: i for i, b in enumerate(lattice.bounds)}
        got = sum(score[place[s], place[e]] for _, s, e in lattice.best(weights))
        assert got == pytest.approx(best[n])


def test_field_reads_long_lists_whole():
    weights = pii.train([])
    numbers = [f"(555) {100 + i}-{4000 + 7 * i}" for i in range(200)]
    text = "item9 " + " ".join(numbers)
    found = pii.all_spans(text, weights)
    assert [text[s:e] for _, s, e in found] == numbers and {k for k, _, _ in found} == {"phone"}


def test_personal_data_of_documents(spark, odd):
    special = [(1, None), (2, ""), (None, "x@y.zz 1.2.3.4"), (3, "é mail a.b@c.de, 4111 1111 1111 1111"), (3, "é mail a.b@c.de, 4111 1111 1111 1111"), (4, "word " * 30_000 + "+1 (017) 555-7713")]
    docs = odd(special)
    weights = pii.fit(docs)
    rows = pii.find(docs, weights).collect()
    for r, (doc, text) in zip(sorted(rows, key=repr), sorted(special, key=lambda x: repr((x[0],))), strict=True):
        assert r.doc_id == doc
    by_id = {r.doc_id: r for r in rows}
    for doc, text in special:
        base = brute.base_spans(text)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert by_id[doc].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (by_id[doc].n_email, by_id[doc].n_ip, by_id[doc].n_card, by_id[doc].n_phone) == tuple(sum(k == x for k, _, _ in base) for x in pii.KINDS)
        assert set(joined.split(",")) <= set(by_id[doc].spans.split(","))
    clean = pii.redact_documents(docs, weights)
    assert clean.columns == docs.columns
    assert {r.doc_id: r.text for r in clean.collect()}[3] == "é mail <EMAIL>, <CARD>"
    assert pii.find(docs.limit(0), weights).count() == 0


def test_registered_queries_give_a_row_each(spark, texts):
    from namemine.llm.registry import QUERIES

    for name in ("op6_decontaminate", "op8_quality_rules", "op9_pii", "op5_importance", "op2_simhash"):
        assert sorted(r.doc_id for r in QUERIES[name](spark, SMALL).collect()) == sorted(texts)
