"""Query of operator 7: write all pages to WARC archives and read the archives back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from namemine.llm.warc import read_archives, write_archives
from namemine.sources.tables import read_table


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(read_table(spark, sf_dir, "pages"), min_bytes=0)
    return read_archives(archives, payloads=False).drop("url")


#: DuckDB's sha1() gives hex; its base32 is built from five-bit groups of the digest's bits.
ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS hex,
         min(page_id) OVER (PARTITION BY sha1(h)) AS first FROM p
), b AS (
  SELECT *, list_aggregate(list_transform(range(0, 40), lambda i: printf('%04b', ('0x' || substr(hex, i::INT + 1, 1))::INT)), 'string_agg', '') AS bits FROM d
)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                (16 * (substr(bits, (5 * i)::INT + 1, 1)::INT) + 8 * (substr(bits, (5 * i)::INT + 2, 1)::INT)
                 + 4 * (substr(bits, (5 * i)::INT + 3, 1)::INT) + 2 * (substr(bits, (5 * i)::INT + 4, 1)::INT)
                 + (substr(bits, (5 * i)::INT + 5, 1)::INT)) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""
