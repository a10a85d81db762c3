"""The corpus pipeline: from raw documents to packed training sequences.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; all but the
last return the columns of ``documents``. ``run`` writes each stage's result as Parquet to the shared
folder and reads it back for the next, so a lost executor never costs more than its stage.

1. quality classifier: documents outside the importance sample go
2. SimHash near-dedup: of each component of near copies the document with the smallest doc_id stays
3. benchmark decontamination: documents that hold a benchmark window go
4. personal data: spans are replaced by their kind, ``n_chars`` follows
5. packing: pieces of windows of 1024 tokens, with their ids

Defined cases (nulls, empty and long texts, repeated rows, empty tables, other columns) are those of the
operators, see their docstrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from namemine.llm import decontaminate, importance, packing, pii, simhash
from namemine.llm.op10_packing import tokenizer_path
from namemine.llm.shared import stage_table
from namemine.llm.shipping import ship_package
from namemine.sources.tables import read_table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return importance.keep_sampled(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return pii.redact_documents(docs, pii.fit(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("packing", pack_sequences),
]

#: SQL expresses neither the sample, the components, the field nor the packing; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that all stages leave of ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return docs
