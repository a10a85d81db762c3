"""Query of operator 12: draw 5 % of all documents towards the benchmark's word distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from namemine.llm.target_sampling import resample
from namemine.sources.tables import read_table


def op12_target_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
