"""Query of operator 13: pack all documents into few sequences of at most 2048 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from namemine.llm.best_fit import pack_best_fit
from namemine.llm.op10_packing import tokenizer_path
from namemine.sources.tables import read_table


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(read_table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)
