"""Query of operator 2: fingerprints and near-duplicate components of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from namemine.llm.simhash import near_duplicates
from namemine.sources.tables import read_table


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
