"""Quality rules by weak supervision (operator 8).

One pass measures every text. Rules turn the measures into votes (+1 good, -1 bad, 0 abstain); the
counts of vote patterns, at most ``3 ** rules`` rows over all documents, are all that
expectation-maximisation needs: it estimates each rule's accuracy and the share of good documents
without labels, the rules being independent given the class. A document's posterior probability of
being good replaces "all rules must pass".

Defined cases: a null or empty text has no words and fails the base rule; repeated rows are judged
each; a null ``doc_id`` is carried; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namemine.llm.shared import only, stage_table
from namemine.llm.textkit import chunks, shingle_hashes, word_hashes, words_of

MIN_WORDS = 10
WINDOW = 5
#: base: more than this share (percent) of words in repeated windows fails
MAX_REPEAT_PERCENT = 20
ROUNDS = 50
KEEP_AT = 0.5

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[97:123] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_distinct")


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """(lines with a word, those of them equal to an earlier line)."""
    lines = [x for x in text.split(b"\n") if x.split()]
    return len(lines), len(lines) - len(set(lines))


def measure(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of the texts of one chunk."""
    n = len(bounds) - 1
    w = words_of(data, bounds)
    out = {"n_words": w.counts()}
    h = word_hashes(w)

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[bounds[1:]] - total[bounds[:-1]]

    within = np.zeros(len(data) + 1, dtype=np.int8)
    within[w.start] += 1
    within[w.end] -= 1  # a word may start where another text's ends
    inside = np.cumsum(within[:-1], dtype=np.int8).astype(bool)
    touching = w.start[np.isin(w.start, w.end)]
    inside[touching] = True
    out["word_chars"] = per_text(inside & ((data & 0xC0) != 0x80))
    out["n_symbols"] = per_text(_SYMBOL[data])
    out["n_upper"] = per_text(_UPPER[data])
    out["n_letters"] = out["n_upper"] + per_text(_LOWER[data])
    out["n_marks"] = per_text(data == ord("!"))
    text = data.tobytes()
    lines = [duplicate_lines(text[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    out["n_lines"] = np.asarray([x for x, _ in lines], dtype=np.int64)
    out["n_dup_lines"] = np.asarray([x for _, x in lines], dtype=np.int64)
    salt = (w.doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    distinct = np.unique(h ^ salt, return_index=True)[1]
    out["n_distinct"] = np.bincount(w.doc[distinct], minlength=n)
    run, first = shingle_hashes(h, w.doc, WINDOW)
    _, inverse, count = np.unique(run ^ salt[first], return_inverse=True, return_counts=True)
    again = first[count[inverse] > 1]
    steps = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(steps, again, 1)
    np.add.at(steps, again + WINDOW, -1)
    covered = np.cumsum(steps[:-1]) > 0
    out["n_repeat_words"] = np.bincount(w.doc[covered], minlength=n)
    return out


def measures(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the measures of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, bounds in chunks(batch.column(1)):
                got = measure(data, bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), *[pa.array(got[m].astype(np.int64)) for m in MEASURES]], ["doc_id", *MEASURES])

    slim = only(docs, doc_id="long", text="string")
    return slim.mapInArrow(run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("byte")


def votes() -> dict[str, Column]:
    """The rules; each abstains between its two bounds (and on texts too short for it)."""
    c = {m: F.col(m).cast("double") for m in MEASURES}
    words, chars = F.greatest(c["n_words"], F.lit(1.0)), F.greatest(c["word_chars"], F.lit(1.0))
    enough = F.col("n_words") >= MIN_WORDS
    return {
        "length": _vote(~enough, F.col("n_words") >= 30),
        "repeats": _vote(c["n_repeat_words"] > 0.2 * words, c["n_repeat_words"] < 0.05 * words),
        "symbols": _vote(c["n_symbols"] > 0.1 * words, c["n_symbols"] < 0.02 * words),
        "symbol_chars": _vote(c["n_symbols"] > 0.02 * chars, c["n_symbols"] < 0.005 * chars),
        "marks": _vote(c["n_marks"] > 0.2 * words, c["n_marks"] < 0.05 * words),
        "capitals": _vote(enough & (c["n_upper"] > 0.5 * c["n_letters"]), enough & (c["n_upper"] < 0.2 * c["n_letters"])),
        "lines": _vote(c["n_dup_lines"] > 0.3 * c["n_lines"], (c["n_dup_lines"] < 0.1 * c["n_lines"]) & (F.col("n_lines") >= 3)),
        "variety": _vote((F.col("n_words") < 500) & (F.col("n_words") >= 20) & (c["n_distinct"] < 0.25 * words), c["n_distinct"] > 0.4 * words),
        "word_length": _vote((chars / words > 14) | (chars / words < 2), (chars / words).between(3, 10)),
    }


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """Share of good documents and, per rule, P(vote | class) as ``[rule, class, vote + 1]``
    (class 1: good). Starts from what rules are made for: one rarely fires on a good document and
    may well pass a bad one. The start is also the prior, worth one document of either class."""
    n_rules = patterns.shape[1]
    index = patterns + 1
    start = np.empty((n_rules, 2, 3))
    start[:, 1] = (0.02, 0.28, 0.70)
    start[:, 0] = (0.40, 0.20, 0.40)
    share, given = 0.8, start.copy()
    for _ in range(rounds if len(counts) else 0):
        good = posterior(patterns, share, given)
        share = float(((counts * good).sum() + 0.8) / (counts.sum() + 1.0))
        for label, weight in ((1, counts * good), (0, counts * (1 - good))):
            for r in range(n_rules):
                mass = np.bincount(index[:, r], weights=weight, minlength=3) + start[r, label]
                given[r, label] = mass / mass.sum()
    return share, given


def posterior(patterns: np.ndarray, share: float, given: np.ndarray) -> np.ndarray:
    """P(good | votes); an abstention is evidence too, as far as the classes abstain unlike."""
    rules = np.arange(patterns.shape[1])
    log = np.log(given)
    score = np.log(share) - np.log1p(-share) + (log[rules, 1, patterns + 1] - log[rules, 0, patterns + 1]).sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(score, -700, 700)))


def judge(docs: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """``doc_id``, the measures, the votes (``vote_*``), ``base_failed``, ``posterior``, ``kept``."""
    rules = votes()
    names = [f"vote_{r}" for r in rules]
    rows = stage_table(measures(docs).select("doc_id", *MEASURES, *[v.alias(f"vote_{r}") for r, v in rules.items()]), "measures")
    found = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).orderBy(*names).collect()  # at most 3 ** rules rows
    patterns = np.asarray([[r[n] for n in names] for r in found], dtype=np.int64).reshape(len(found), len(names))
    share, given = fit(patterns, np.asarray([r["n"] for r in found], dtype=float))
    table = [(*map(int, p), float(q)) for p, q in zip(patterns, posterior(patterns, share, given), strict=True)]
    schema = ", ".join(f"{n} tinyint" for n in names) + ", posterior double"
    told = rows.join(F.broadcast(rows.sparkSession.createDataFrame(table, schema)), names)
    return told.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_at))
