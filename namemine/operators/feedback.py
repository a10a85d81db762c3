"""Suggestion state and feedback as commutative aggregations, so the
same code runs on a batch and on a stream (section 2.12).

Events ``feedback(ts, event_id, element, action, value)`` with action in
put / recalculate / ignore / applied / ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rename_scores(events: DataFrame, applied: str = "applied", ignored: str = "ignored") -> DataFrame:
    """A row ``(action, score, cnt = 1)`` for each score of a rename, see :func:`rename_stats`."""
    rows = events.where(F.col("action").isin(applied, ignored))
    if isinstance(events.schema["value"].dataType, T.ArrayType):
        rows = rows.withColumn("value", F.explode("value"))
    name = F.when(F.col("action") == applied, F.lit("applied")).otherwise(F.lit("ignored"))
    return rows.select(name.alias("action"), F.col("value").alias("score"), F.lit(1).cast("bigint").alias("cnt"))


def rename_stats(events: DataFrame, applied: str = "applied", ignored: str = "ignored") -> DataFrame:
    """F1: applied / ignored renames by score -> ``(action, score, cnt)``, action being applied or
    ignored. ``value`` is a score or an array of them (an ignore carries a list); a sorted list of the rows is
    the score list. Rows instead of two lists keep every row and every stream state small. How many renames
    there were, with any number of scores each, is :func:`rename_counters`."""
    return rename_scores(events, applied, ignored).groupBy("action", "score").agg(F.sum("cnt").alias("cnt"))


def rename_counters(events: DataFrame, applied: str = "applied", ignored: str = "ignored") -> DataFrame:
    """F1: ``(action, n_renames, n_scores)``: an event counts once, whether its ``value`` is a score, a list of
    scores, an empty list or null."""
    rows = events.where(F.col("action").isin(applied, ignored))
    if isinstance(events.schema["value"].dataType, T.ArrayType):
        scores = F.coalesce(F.size("value"), F.lit(0))
    else:
        scores = F.col("value").isNotNull().cast("int")
    name = F.when(F.col("action") == applied, F.lit("applied")).otherwise(F.lit("ignored"))
    return rows.groupBy(name.alias("action")).agg(F.count("*").alias("n_renames"), F.sum(F.greatest(scores, F.lit(0)).cast("long")).alias("n_scores"))


def state_changes(events: DataFrame, key: str = "element") -> DataFrame:
    """Each event as a state of its own: ``key, last_put, value, last_recalc, last_ignore`` (null: no such event)."""
    order, act = F.struct("ts", "event_id"), F.col("action")
    return events.select(
        key, F.when(act == "put", order).alias("last_put"), F.when(act == "put", F.col("value")).alias("value"),
        F.when(act == "recalculate", order).alias("last_recalc"), F.when(act == "ignore", order).alias("last_ignore"))


def merge_states(states: DataFrame, key: str = "element") -> DataFrame:
    """States of any events -> one a key: the latest put with its value, the latest of the other events."""
    return states.groupBy(key).agg(
        F.max("last_put").alias("last_put"), F.max_by("value", "last_put").alias("value"),
        F.max("last_recalc").alias("last_recalc"), F.max("last_ignore").alias("last_ignore"))


def current_state(states: DataFrame, key: str = "element") -> DataFrame:
    """Merged states -> ``key, value, need_recalc, ignore`` of the keys that were put."""
    return states.where(F.col("last_put").isNotNull()).select(
        key, "value",
        F.coalesce(F.col("last_recalc") > F.col("last_put"), F.lit(False)).alias("need_recalc"),
        F.coalesce(F.col("last_ignore") > F.col("last_put"), F.lit(False)).alias("ignore"),
    )


def latest_state(events: DataFrame, key: str = "element") -> DataFrame:
    """keyed store: ``put`` replaces the value and clears both flags; ``recalculate`` /
    ``ignore`` only act on an existing key. Per key: value of the latest put by (ts, event_id),
    a flag is set when its latest event is newer than the latest put; no put -> no row.

    Order-free (max over (ts, event_id)), so arrival order and micro-batches do not matter.
    """
    return current_state(merge_states(state_changes(events, key), key), key)


def suggestion_edit(suggestions: DataFrame, additions: DataFrame, removals: DataFrame,
                    key: str = "element") -> DataFrame:
    """add names with score -1.0, remove names; ``contains`` is a semi-join on the result."""
    added = additions.select(key, "name", F.lit(-1.0).alias("score"))
    u = suggestions.select(key, "name", "score").unionByName(added)
    return u.join(removals.select(key, "name").distinct(), [key, "name"], "left_anti")
