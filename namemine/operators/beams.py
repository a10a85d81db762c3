"""Beam decoding of a scorer's output table.

Input ``beams(item, step, beam, token_id, logp)``: one row per cell of a [step][beam] output,
and a ``dictionary(token_id, subtoken)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Beams kept per item, the padding / unknown sub-tokens.
BEAMS = 10
PAD = "<PAD>"
UNK = "<UNK>"


def beam_transpose(beams: DataFrame, n_beams: int = BEAMS) -> DataFrame:
    """B1: per (item, beam) the token ids and scores over the steps, first ``n_beams`` beams."""
    b = beams.where(F.col("beam") < n_beams)
    g = b.groupBy("item", "beam").agg(F.sort_array(F.collect_list(F.struct("step", "token_id", "logp"))).alias("s"))
    return g.select(
        "item", "beam",
        F.transform("s", lambda e: e["token_id"]).alias("token_ids"),
        F.transform("s", lambda e: e["logp"]).alias("logps"),
    )


def beam_score(transposed: DataFrame, dictionary: DataFrame) -> DataFrame:
    """B2: ``score = exp(sum of log scores)``; name = first sub-token (missing -> empty) followed
    by the others capitalised, skipping missing / <PAD> / <UNK> ones.

    The dictionary is joined per cell (an equi-join on token id), then the name is folded in
    step order inside the row.
    """
    cells = transposed.select("item", "beam", F.posexplode("token_ids").alias("i", "token_id"))
    named = cells.join(dictionary, "token_id", "left")
    g = named.groupBy("item", "beam").agg(F.sort_array(F.collect_list(F.struct("i", "subtoken"))).alias("s"))
    first = F.coalesce(F.element_at("s", 1)["subtoken"], F.lit(""))
    rest = F.filter(F.slice("s", F.lit(2), F.size("s")), lambda e: e["subtoken"].isNotNull() & ~e["subtoken"].isin(PAD, UNK))
    caps = F.transform(rest, lambda e: F.concat(F.upper(F.substring(e["subtoken"], 1, 1)), F.substr(e["subtoken"], F.lit(2))))
    names = g.select("item", "beam", F.concat(first, F.array_join(caps, "")).alias("name"))
    scores = transposed.select("item", "beam", F.exp(F.aggregate("logps", F.lit(0.0), lambda a, x: a + x)).alias("score"))
    return names.join(scores, ["item", "beam"])


def beam_filter(scored: DataFrame) -> DataFrame:
    """Keep names that are not empty, hold an upper-case letter and are not <UNK> / <PAD>."""
    n = F.col("name")
    return scored.where((F.length(n) > 0) & (n != F.lower(n)) & ~n.isin(UNK, PAD))
