"""Tokens and vocabulary."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from namemine.functions.masks import mask_literal, mask_target
from namemine.session import ensure_checkpoint_dir


def tokenize(files: DataFrame, pattern: str, text_col: str = "text",
             keep: Sequence[str] = ("project", "file_id")) -> DataFrame:
    """File rows -> ordered token rows ``(keep…, pos, token)``; codegen only, no UDF.

    Each file is one row, so tokenizing needs no shuffle.
    """
    return files.select(
        *keep, F.posexplode(F.regexp_extract_all(text_col, F.lit(pattern), 0)).alias("pos", "token")
    ).withColumn("pos", F.col("pos").cast("int"))


def known_names(tokens: DataFrame) -> DataFrame:
    """Names that occur as a declaration, per kind -> ``(kind, token)`` distinct."""
    return tokens.where(F.col("is_decl")).select("kind", "token").distinct()


def supported_parents(parents: Mapping[str, str | None], supported: Collection[str]) -> dict[str, str]:
    """Each kind of a hierarchy (kind -> its parent, null at a root) with the nearest supported kind on its way
    up, itself included; kinds without one are left out. A hierarchy that turns back on itself is refused."""
    out = {}
    for kind in {*parents, *supported}:
        at, seen = kind, set()
        while at is not None and at not in supported:
            if at in seen:
                raise ValueError(f"{kind} is its own ancestor")
            seen.add(at)
            at = parents.get(at)
        if at is not None:
            out[kind] = at
    return out


def kind_filter(candidates: DataFrame, known: DataFrame, parents: Mapping[str, str],
                kind_col: str = "kind", name_col: str = "name") -> DataFrame:
    """Keep candidates whose name is known for the supported parent kind of the target.

    ``parents`` maps a target kind to its supported parent kind (a small fixed map, joined by
    broadcast); a kind without a supported parent lets nothing pass.
    """
    spark = candidates.sparkSession
    pmap = spark.createDataFrame(list(parents.items()), "kind string, parent string")
    with_parent = candidates.join(F.broadcast(pmap.withColumnRenamed("kind", kind_col)), kind_col)
    k = known.select(F.col("kind").alias("parent"), F.col("token").alias(name_col))
    return with_parent.join(k, ["parent", name_col], "left_semi").drop("parent")


def mask_literals(tokens: DataFrame, target_col: str = "target") -> DataFrame:
    """T4 applied to token rows that carry the target variable in ``target_col``."""
    return tokens.withColumn(
        "masked", mask_literal(F.col("token"), F.col("lit_type"), F.col("decl_id"), F.col(target_col))
    )


def mask_targets(tokens: DataFrame, target_col: str = "target") -> DataFrame:
    """T5 applied to token rows that carry the target variable in ``target_col``."""
    return tokens.withColumn("masked", mask_target(F.col("token"), F.col("decl_id"), F.col(target_col)))


def dense_index(df: DataFrame, order: list, out: str = "idx", buckets: int | None = None) -> DataFrame:
    """Add a 1-based dense row number ``out`` in ``order`` without one global sort task.

    Rows are range-partitioned on the sort key; each range is numbered locally and shifted by
    the sizes of the ranges before it (a table with one row per range, broadcast). The ranged
    rows are checkpointed to the shared checkpoint dir, so the range ids stay fixed when a lost
    executor forces a recompute and both uses below see the same ranges.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).withColumn("_bucket", F.spark_partition_id()).checkpoint()
    local = ranged.withColumn("_local", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)))
    sizes = ranged.groupBy("_bucket").agg(F.count("*").alias("_size"))
    offsets = sizes.select(
        "_bucket",
        F.sum("_size").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("_start"),
    ).fillna(0, ["_start"])
    # one row per range partition: a proven size bound for the broadcast
    return local.join(F.broadcast(offsets), "_bucket").withColumn(
        out, (F.col("_start") + F.col("_local")).cast("bigint")
    ).drop("_bucket", "_local", "_start")


def build_vocab(tokens: DataFrame, token_col: str = "token", buckets: int | None = None) -> DataFrame:
    """``(idx, token, cnt)``; idx by rank of (cnt desc, token), 1-based (0 = unknown)."""
    counts = tokens.groupBy(F.col(token_col).alias("token")).agg(F.count("*").alias("cnt"))
    return dense_index(counts, [F.col("cnt").desc(), F.col("token")], "idx", buckets).select("idx", "token", "cnt")


def encode(tokens: DataFrame, vocab: DataFrame, token_col: str = "token") -> DataFrame:
    """Tokens -> indices (unknown -> 0) by a left equi-join on the vocabulary."""
    v = vocab.select(F.col("token").alias(token_col), "idx")
    return tokens.join(v, token_col, "left").withColumn("idx", F.coalesce("idx", F.lit(0)))


def decode(indexed: DataFrame, vocab: DataFrame, idx_col: str = "idx", unknown: str = "<unknown>") -> DataFrame:
    """Indices -> words (index 0 or a missing index -> the unknown word)."""
    v = vocab.select(F.col("idx").alias(idx_col), F.col("token").alias("word"))
    return indexed.join(v, idx_col, "left").withColumn("word", F.coalesce("word", F.lit(unknown)))


def vocab_cutoff(vocab: DataFrame, min_count: int) -> DataFrame:
    """Keep tokens with at least ``min_count`` occurrences."""
    return vocab.where(F.col("cnt") >= min_count)


def model_priority(tokens: DataFrame, scope: Sequence[str] | str = ("project",),
                   token_col: str = "token") -> DataFrame:
    """Model weight of each model scope = its vocabulary size."""
    scope = [scope] if isinstance(scope, str) else list(scope)
    return tokens.groupBy(*scope).agg(F.countDistinct(token_col).alias("priority"))
