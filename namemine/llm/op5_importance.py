"""Query of operator 5: importance weights and the Gumbel top-k sample of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from namemine.llm.importance import sample
from namemine.sources.tables import read_table


def op5_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
