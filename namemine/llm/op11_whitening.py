"""Query of operator 11: the first eight whitened components of all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from namemine.llm.whitening import whiten
from namemine.sources.tables import read_table


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))
