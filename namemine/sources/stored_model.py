"""A stored n-gram model that probability lookups join in place.

Counts and context counts are written in buckets by the hash of their n-gram, so a join on the
n-gram shuffles the asked sequences alone and reads the model where it lies. ``buckets`` should be no
fewer than the session's shuffle partitions (Spark deals both sides anew for a wider join), and such that a
bucket fits a task: a model of 1 TB asks for some thousands.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namemine.operators.lm import context_counts

COUNTS = "n INT, ngram ARRAY<STRING>, cnt BIGINT"
CONTEXTS = "ctx ARRAY<STRING>, cnt BIGINT"
PARTS = (("counts", "ngram", COUNTS), ("contexts", "ctx", CONTEXTS))


def _table(spark: SparkSession, path: str, part: str, key: str, schema: str, buckets: int) -> str:
    """Name the folder of a part in the session's catalog (an external table: dropping it leaves the files)."""
    name = f"namemine_{part}_{hashlib.md5(path.encode()).hexdigest()}"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}/{part}'")
    return name


def write_buckets(ngrams: DataFrame, path: str, buckets: int | None = None) -> None:
    """Write ``ngrams(n, ngram, cnt)`` and their contexts, a file a bucket. An earlier model there is replaced."""
    spark = ngrams.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = ngrams.select(F.col("n").cast("int").alias("n"), "ngram", F.col("cnt").cast("bigint").alias("cnt"))
    contexts = context_counts(counts).select("ctx", F.col("cnt").cast("bigint").alias("cnt"))
    for (part, key, schema), rows in zip(PARTS, (counts, contexts), strict=True):
        name = _table(spark, path, part, key, schema, buckets)
        rows.repartition(buckets, key).write.insertInto(name, overwrite=True)
    spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")


def read_buckets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(counts, contexts) of a model that any session wrote."""
    buckets = spark.read.parquet(f"{path}/layout").first()["buckets"]
    counts, contexts = (spark.table(_table(spark, path, part, key, schema, buckets)) for part, key, schema in PARTS)
    return counts, contexts
