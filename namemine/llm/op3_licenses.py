"""Query of operator 3: license notices in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from namemine.llm.licenses import scan_licenses
from namemine.sources.tables import read_table


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))
