"""Query of operator 9: personal data in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from namemine.llm.pii import find, fit
from namemine.sources.tables import read_table


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return find(docs, fit(docs))
