"""A table of additive changes as folders that are merged in levels (log-structured).

Batch e of a stream is the folder of level 0 with number e. When ``FANOUT`` folders of a level stand side by
side, they are merged into one folder of the next level, so n batches are read from at most
``(FANOUT - 1) * log(n)`` folders, and a row is rewritten once a level. Names follow from the batch numbers: folder
k of level l holds the batches from ``k * FANOUT ** l`` on, before ``(k + 1) * FANOUT ** l``.

The list of live folders is the files themselves: a folder counts once Spark has marked it as written
(``_SUCCESS``), and not at all if a complete folder of a higher level holds its batches. A run that dies at
any point leaves a readable table: a half-written merge has no mark, and the folders it was made of are deleted
only when the next merge of their level is complete (a reader that has listed them can finish).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FANOUT = 16

Merge = Callable[[DataFrame], DataFrame]


def _name(level: int, number: int) -> str:
    return f"L{level}-{number}"


def _file_system(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def complete_folders(spark: SparkSession, root: str) -> set[tuple[int, int]]:
    """(level, number) of every folder that is written in full."""
    marks = _file_system(spark, root).globStatus(_path(spark, f"{root}/L*-*/_SUCCESS")) or []
    names = (m.getPath().getParent().getName() for m in marks)
    return {(int(level[1:]), int(number)) for level, number in (n.split("-") for n in names)}


def live_folders(complete: set[tuple[int, int]], fanout: int = FANOUT) -> list[tuple[int, int]]:
    """The complete folders that no complete folder of a higher level holds."""
    top = max((level for level, _ in complete), default=0)
    return sorted((level, n) for level, n in complete
                  if not any((up, n // fanout ** (up - level)) in complete for up in range(level + 1, top + 1)))


def read_folders(spark: SparkSession, root: str, schema: T.StructType, merge: Merge, fanout: int = FANOUT) -> DataFrame:
    """The table: one row per key over all live folders."""
    paths = [f"{root}/{_name(*f)}" for f in live_folders(complete_folders(spark, root), fanout)]
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return merge(rows)


def add_batch(batch: DataFrame, number: int, root: str, merge: Merge, fanout: int = FANOUT) -> None:
    """Write a batch's changes as a folder (again, if the batch is run again), and merge full levels."""
    spark = batch.sparkSession
    level, complete = 0, complete_folders(spark, root)
    if not any((up, number // fanout**up) in complete for up in range(1, 64)):  # else merged before the stream's commit
        merge(batch).write.mode("overwrite").parquet(f"{root}/{_name(0, number)}")
        complete.add((0, number))
    while (number + 1) % fanout ** (level + 1) == 0:
        level += 1
        this = (number + 1) // fanout**level - 1
        _merge_level(spark, root, level, this, batch.schema, merge, complete, fanout)
        complete.add((level, this))


def _merge_level(spark: SparkSession, root: str, level: int, this: int, schema: T.StructType, merge: Merge,
                 complete: set[tuple[int, int]], fanout: int) -> None:
    below = [(lv, n) for lv, n in live_folders({f for f in complete if f[0] < level}, fanout) if n // fanout ** (level - lv) == this]
    if (level, this) not in complete and below:
        rows = spark.read.schema(schema).parquet(*[f"{root}/{_name(*f)}" for f in below])
        merge(rows).write.mode("overwrite").parquet(f"{root}/{_name(level, this)}")
    files = _file_system(spark, root)
    for lv, n in sorted(complete):  # what the merge before this one was made of
        if lv < level and n // fanout ** (level - lv) == this - 1:
            files.delete(_path(spark, f"{root}/{_name(lv, n)}"), True)
            complete.discard((lv, n))
