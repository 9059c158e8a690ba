"""Query op11: line dedup over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.llm.line_dedup import kept_text, whole_text, with_keep
from catalogspark.sources.shared import table


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_keep(table(spark, sf_dir, "documents").select("doc_id", whole_text().alias("text")))
    total = lambda of: F.aggregate(of, F.lit(0).cast("bigint"), lambda a, x: a + x)
    dropped = total(F.filter("keep", lambda _, i: i % 2 == 1))
    left = F.when(F.size("keep") > 1, kept_text(F.col("text"), F.col("keep"))).otherwise(F.col("text"))
    return docs.select("doc_id", total(F.col("keep")).alias("n_lines"), dropped.alias("n_dropped"), F.sha2(left, 256).alias("kept_sha256"), "keep")


SQL = r"""
WITH l AS (
  SELECT doc_id, text, i AS pos, t[i] AS line,
         translate(trim(t[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS t, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i
        FROM (SELECT DISTINCT doc_id, text FROM documents))
), k AS (
  SELECT key, max(doc_id) AS largest FROM l WHERE length(key) >= 20 GROUP BY key
  HAVING count(DISTINCT doc_id) + CASE WHEN count(*) > count(doc_id) THEN 1 ELSE 0 END >= 3
), j AS (
  SELECT l.*, coalesce(k.key IS NOT NULL AND (doc_id IS NULL OR doc_id < largest), false) AS gone FROM l LEFT JOIN k ON l.key = k.key
), s AS (
  SELECT doc_id, text, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
         sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256, list(gone ORDER BY pos) AS flags
  FROM j GROUP BY doc_id, text
), r AS (
  SELECT *, list_filter(range(1, len(flags) + 1), lambda i: i = 1 AND flags[1] OR i > 1 AND flags[i] <> flags[greatest(i - 1, 1)]) AS turns FROM s
)
SELECT d.doc_id, n_lines, n_dropped, kept_sha256,
       list_transform(list_zip(list_concat([1], turns), list_concat(turns, [n_lines + 1])), lambda x: CAST(x[2] - x[1] AS INTEGER))
       || CASE WHEN len(turns) % 2 = 1 THEN [0] ELSE [] END AS keep
FROM documents d JOIN r ON d.doc_id IS NOT DISTINCT FROM r.doc_id AND d.text IS NOT DISTINCT FROM r.text
"""

QUERIES = {"op11_line_dedup": op11_line_dedup}
ORACLES = {"op11_line_dedup": SQL}
