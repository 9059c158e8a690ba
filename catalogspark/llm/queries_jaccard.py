"""Query op10: near-copy components of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalogspark.llm.jaccard import jaccard_components
from catalogspark.sources.shared import table


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(1, len(t) - 4) + 1), lambda i: array_to_string(t[i:i + 4], ' ')))) AS g FROM w WHERE len(t) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 80 * (a.n + b.n - i)),
c AS (SELECT doc_id AS id, doc_id AS root FROM w UNION SELECT e.y, c.root FROM c JOIN e ON e.x = c.id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(root) FROM c WHERE c.id = w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id)
"""

QUERIES = {"op10_ngram_jaccard": op10_ngram_jaccard}
ORACLES = {"op10_ngram_jaccard": SQL}
