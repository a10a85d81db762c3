"""Corpus scan and file guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Clamp to the first 64 Ki chars; skip files over 128 KiB (graphs) / from 125 KiB (evaluation).
MAX_CHARS = 64 * 1024
MAX_GRAPH_BYTES = 128 * 1024
MAX_EVAL_BYTES = 125 * 1024


def read_corpus(spark: SparkSession, root: str, glob: str = "*.java", project_depth: int = 1) -> DataFrame:
    """Every file matching ``glob`` below ``root`` -> ``files(project, file_id, path, text, n_chars)``.

    One row per file (``wholetext``); the project is the path part ``project_depth`` levels
    below ``root`` (the data-set directories are projects).
    """
    raw = (
        spark.read.option("wholetext", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob).text(root)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )
    # the whole root, quoted, whatever scheme stands before it
    below = root.rstrip("/").split("://", 1)[-1].removeprefix("file:")
    rel = F.regexp_replace("path", "^.*?\\Q" + below + "\\E/", "")
    return raw.select(
        F.split(rel, "/").getItem(project_depth - 1).alias("project"),
        F.sha2("path", 256).alias("file_id"),
        "path", "text", F.length("text").cast("bigint").alias("n_chars"),
    )


def clamp(files: DataFrame, max_chars: int = MAX_CHARS, text_col: str = "text") -> DataFrame:
    """Keep the first ``max_chars`` characters of every file."""
    return files.withColumn(text_col, F.substring(text_col, 1, max_chars))


def skip_larger(files: DataFrame, max_bytes: int = MAX_GRAPH_BYTES, text_col: str = "text",
                inclusive: bool = True) -> DataFrame:
    """Drop files larger than ``max_bytes`` (UTF-8); ``inclusive=False`` drops from the limit on."""
    size = F.octet_length(text_col)
    return files.where(size <= max_bytes if inclusive else size < max_bytes)


def project_split(files: DataFrame, train: Sequence[str], test: Sequence[str],
                  project_col: str = "project") -> DataFrame:
    """S3: train / test split by project-name lists (never a random row split) -> adds ``split``.

    The lists are small literals, evaluated as an ``IN`` predicate that reaches the scan.
    """
    return files.where(F.col(project_col).isin(*train, *test)).withColumn(
        "split", F.when(F.col(project_col).isin(*test), F.lit("test")).otherwise(F.lit("train"))
    )


def file_stats(files: DataFrame) -> DataFrame:
    """``{path: text length}`` per file."""
    return files.select("path", F.length("text").alias("n_chars"))
