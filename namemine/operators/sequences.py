"""Positions and bounded windows over sequences that may be very long (a hot file / user).

A window partitioned by the file alone puts a whole file into one task; when one file can hold
a large share of all rows, that task is the job. Both helpers here bound the work per task:

* :func:`group_positions` numbers rows inside their group from range partitions: every range
  is numbered locally and shifted by the sizes of the group's earlier ranges.
* :func:`chunked` cuts each file into chunks of ``chunk`` positions and copies the few rows a
  bounded frame needs from the neighbouring chunks (a halo), so a window partitioned by
  (file, chunk) sees exactly the rows the file-wide window would.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namemine.session import ensure_checkpoint_dir, never_broadcast

# Positions per chunk of a file for bounded windows.
CHUNK = 65536


def group_positions(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], out: str = "pos",
                    buckets: int | None = None, coarse: Column | None = None) -> DataFrame:
    """0-based position of each row in its group by ``order`` (ties must not exist).

    With ``coarse`` (a column that never decreases along ``order`` inside a group, e.g. the hour
    of a timestamp or ``pos div chunk``): rows are numbered inside (group, coarse) and shifted by
    the sizes of the group's earlier coarse buckets; deterministic, no checkpoint.
    Without it: rows are range-partitioned on (group, order) and checkpointed to the shared
    checkpoint dir (fixed ranges on recompute), then numbered the same way per range.
    Either way a hot group is numbered by many tasks.
    """
    group, order = list(group), list(order)
    spark = df.sparkSession
    if coarse is not None:
        ranged = df.withColumn("_b", coarse)
    else:
        ensure_checkpoint_dir(spark)
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        ranged = df.repartitionByRange(n, *group, *order).withColumn("_b", F.spark_partition_id()).checkpoint()
    local = ranged.withColumn("_l", F.row_number().over(Window.partitionBy(*group, "_b").orderBy(*order)))
    counts = ranged.groupBy(*group, "_b").agg(F.count("*").alias("_c"))
    offsets = counts.select(
        *group, "_b",
        F.coalesce(
            F.sum("_c").over(Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_o"),
    )
    return local.join(never_broadcast(offsets), [*group, "_b"]).withColumn(
        out, (F.col("_o") + F.col("_l") - 1).cast("bigint")
    ).drop("_b", "_l", "_o")


def latest_flagged(df: DataFrame, keys: Sequence[str], flag: Column, out: str, inclusive: bool = False,
                   pos: str = "pos", chunk: int = CHUNK) -> DataFrame:
    """Adds ``out`` = the latest position with ``flag`` in the row's group before it (or at it, if
    ``inclusive``); null if there is none.

    A scan with carries: a window takes it inside each (group, chunk of positions), so at most
    ``chunk`` rows meet in one window; what earlier chunks hold comes from a small per-chunk summary."""
    keys = list(keys)
    end = Window.currentRow if inclusive else -1
    marked = F.when(flag, F.col(pos))
    v = df.withColumn("_c", F.floor(F.col(pos) / chunk))
    local = v.withColumn("_in", F.max(marked).over(Window.partitionBy(*keys, "_c").orderBy(pos).rowsBetween(Window.unboundedPreceding, end)))
    summary = v.groupBy(*keys, "_c").agg(F.max(marked).alias("_m"))
    earlier = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*keys, "_c", F.max("_m").over(earlier).alias("_carry"))
    return local.join(never_broadcast(carry), [*keys, "_c"]).withColumn(out, F.coalesce("_in", "_carry")).drop("_c", "_in", "_carry")


def chunked(df: DataFrame, before: int, after: int, chunk: int = CHUNK, pos: str = "pos") -> DataFrame:
    """Rows tagged with ``_chunk`` (= pos div chunk) plus halo copies (``_halo`` true) of the
    ``before`` last rows of the previous chunk and the ``after`` first rows of the next chunk.
    Window over (file, ``_chunk``) then drop the halo rows."""
    p = F.col(pos)
    c = F.floor(p / chunk).cast("long")
    own = df.withColumn("_chunk", c).withColumn("_halo", F.lit(False))
    parts = [own]
    for j in range(1, -(-before // chunk) + 1):  # one chunk on, unless the frame is wider than a chunk
        parts.append(df.where(p >= (c + j) * chunk - before).withColumn("_chunk", c + j).withColumn("_halo", F.lit(True)))
    for j in range(1, -(-after // chunk) + 1):
        parts.append(df.where(p < (c - j + 1) * chunk + after).withColumn("_chunk", c - j).withColumn("_halo", F.lit(True)))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def framed_window(file_cols: Sequence[str], before: int, after: int, pos: str = "pos"):
    """Window over (file, chunk) ordered by position with a ``[-before, after]`` row frame."""
    return Window.partitionBy(*file_cols, "_chunk").orderBy(pos).rowsBetween(-before, after)


def unchunk(df: DataFrame) -> DataFrame:
    return df.where(~F.col("_halo")).drop("_chunk", "_halo")
