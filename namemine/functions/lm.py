"""Column expressions for the interpolated (Jelinek-Mercer) n-gram model.

All folds run inside a row with SQL higher-order functions, so they stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the model: order 6, lambda 0.5, 10 candidates, display threshold 0.001,
# softmax temperature 6.
ORDER = 6
LAMBDA = 0.5
TOP_K = 10
MIN_PROBABILITY = 0.001
TEMPERATURE = 6.0
UNKNOWN = "<unknown>"


def suffix(seq: Column, k: Column | int) -> Column:
    """The last ``k`` elements of ``seq``."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.slice(seq, F.size(seq) - k + 1, k)


def prefix_drop_last(seq: Column) -> Column:
    """All elements but the last (the context of an n-gram); empty for a unigram."""
    return F.slice(seq, 1, F.size(seq) - 1)


def jm_fold(terms: Column, vocab_size: Column, lam: float = LAMBDA) -> Column:
    """Interpolated probability from ``terms`` = array<struct<k,c,x>> sorted by k ascending.

    ``p_0 = 0; p_k = (1-lam) p_{k-1} + lam c_k / x_k`` while ``x_k > 0`` (stop at the first
    unseen context, H = last k used); ``P = p_H + (1-lam)^H / V``.
    """
    init = F.struct(F.lit(0.0).alias("p"), F.lit(0).alias("h"), F.lit(True).alias("alive"))

    def step(acc, t):
        use = acc["alive"] & (t["x"] > 0)
        return F.struct(
            F.when(use, (1 - lam) * acc["p"] + lam * t["c"] / t["x"]).otherwise(acc["p"]).alias("p"),
            F.when(use, acc["h"] + 1).otherwise(acc["h"]).alias("h"),
            use.alias("alive"),
        )

    # The fold yields (p_H, H); the back-stop term is added outside the lambda because a scalar
    # subquery (V) may not appear inside a higher-order function.
    folded = F.aggregate(terms, init, step)
    return folded["p"] + F.pow(F.lit(1 - lam), folded["h"]) / vocab_size


def usage_priority(context_counts: Column) -> Column:
    """Context weight: contexts shortest to longest, ``prio = prio div 2 + x``; once a context
    is unseen every longer one counts 0; at least 1.

    ``context_counts`` = array<bigint> of context counts for context lengths 1..L-1.
    """
    folded = F.aggregate(
        context_counts,
        F.struct(F.lit(0).cast("bigint").alias("prio"), F.lit(True).alias("alive")),
        lambda acc, x: F.struct(
            (F.shiftright(acc["prio"], 1) + F.when(acc["alive"] & (x > 0), x).otherwise(F.lit(0)))
            .cast("bigint").alias("prio"),
            (acc["alive"] & (x > 0)).alias("alive"),
        ),
        lambda acc: acc["prio"],
    )
    return F.greatest(F.lit(1).cast("bigint"), folded)
