"""Query op4: all pages through WARC archives and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.llm.warc import assemble, read_warc, write_warc
from catalogspark.sources.shared import new_path, table, written


def op4_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    c = assemble(written(read_warc(spark, path, payload_of=("metadata",)), "records"))
    again = F.col("response.type") == "revisit"
    return c.select(
        F.regexp_extract(F.col("metadata")[0]["payload"].cast("string"), r"page_id: (-?\d+)", 1).try_cast("bigint").alias("page_id"),
        F.when(again, F.regexp_extract("response.http", r"Content-Length: (\d+)", 1).cast("bigint")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(again, F.substring_index("response.payload_digest", ":", -1)).otherwise(F.col("response.payload_sha256")).alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.regexp_extract("response.refers_to", r"urn:page:(-?\d+):", 1).try_cast("bigint").alias("refers_to"),
    )


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS size FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN size >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN size >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

QUERIES = {"op4_warc_captures": op4_warc_captures}
ORACLES = {"op4_warc_captures": SQL}
