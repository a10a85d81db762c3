"""Helpers shared by the operators: tables in the cluster's shared folder, column selection."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namemine.session import ensure_checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names (all executors see it)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts lineage: a lost executor costs a re-read of files, not a recomputation, and no
    later job runs the Python work again.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns, cast to the given types; other columns (whatever their names)
    never meet the columns that an operator adds."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in columns.items()])
