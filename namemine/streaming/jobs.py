"""Structured Streaming forms of the incremental state.

The reference keeps counts and feedback state up to date in place; here a change log / event
log is a file stream, each row of it a change, and the state is the merge of all changes, kept in folders
(``runner.run_updates``). Merging is order-free, so the result equals the batch form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namemine.operators import feedback, lm
from namemine.sources.bindings import TOKEN_PATTERN
from namemine.streaming.runner import run_updates


def ngram_changes(changes: DataFrame, order: int = lm.ORDER, pattern: str = TOKEN_PATTERN) -> DataFrame:
    """Change log ``(file_id, text, sign)`` (+1 learn, -1 forget) -> ``(n, ngram, cnt)`` changes,
    whose sum is the current model (``runner.run_updates`` adds them up batch by batch).

    Each file is one row: its n-grams come from array functions in the row (no window, which a
    stream could not run). The stream holds no state.
    """
    toks = changes.select(
        "sign", F.regexp_extract_all("text", F.lit(pattern), 0).alias("tokens")
    )
    t = F.col("tokens")
    windows = F.transform(
        F.sequence(F.lit(1), F.size(t)),
        lambda i: F.slice(t, F.greatest(F.lit(1), i - order + 1), F.least(i, F.lit(order))),
    )
    win = toks.where(F.size(t) > 0).select("sign", F.explode(windows).alias("win"))
    grams = win.select("sign", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("win")), lambda n: lm.suffix(F.col("win"), n))).alias("ngram"))
    return grams.select(F.size("ngram").alias("n"), "ngram", F.col("sign").cast("bigint").alias("cnt"))


def merge_counts(changes: DataFrame) -> DataFrame:
    """Sums of ``cnt`` by all other columns; what adds up to nothing goes."""
    keys = [c for c in changes.columns if c != "cnt"]
    return changes.groupBy(*keys).agg(F.sum("cnt").alias("cnt")).where("cnt <> 0")


def stream_ngram_counts(changes: DataFrame, root: str, order: int = lm.ORDER, pattern: str = TOKEN_PATTERN) -> DataFrame:
    """The current model ``(n, ngram, cnt)`` over a change log ``(file_id, text, sign)``."""
    return run_updates(ngram_changes(changes, order, pattern), root, merge_counts)


def stream_rename_stats(events: DataFrame, root: str, applied: str = "applied", ignored: str = "ignored") -> DataFrame:
    """R2: F1 over an event stream."""
    return run_updates(feedback.rename_scores(events, applied, ignored), root, merge_counts)


def stream_latest_state(events: DataFrame, root: str, key: str = "element") -> DataFrame:
    """F2 per element over an event stream. Event-time order comes from the (ts, event_id)
    comparison inside the merge, so a late event lands in its place without a watermark; a batch
    writes one row for each element that its events name."""
    changes = feedback.state_changes(events, key)
    return feedback.current_state(run_updates(changes, root, lambda c: feedback.merge_states(c, key)), key)
