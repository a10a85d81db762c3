"""Query of operator 10: pack all documents into windows of 1024 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from namemine.llm.packing import pack
from namemine.sources.tables import read_table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)
