"""Query of operator 6: benchmark passages in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from namemine.llm.decontaminate import contamination
from namemine.sources.tables import read_table


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS n, array_to_string(words[i + 1 : i + least(10, len(words))], ' ') AS win
  FROM (SELECT *, unnest(range(0, greatest(len(words) - 9, 1))) AS i FROM b WHERE len(words) > 0)
), dw AS (
  SELECT doc_id, n, i, array_to_string(words[i + 1 : i + n], ' ') AS win
  FROM (SELECT doc_id, words, n, unnest(range(0, len(words) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(words) >= n)
), hit AS (
  SELECT DISTINCT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, win)
), places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS joined
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""
