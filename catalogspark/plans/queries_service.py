"""Catalog-wide reports on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogspark.operators import bm25, observe, search, service, stats, views
from catalogspark.plans.queries_observe import profiles
from catalogspark.plans.queries_search import _ASKED, _PASSAGES, _asked, _bm25_sql, _passages
from catalogspark.sources.shared import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT count(*) AS listings, count(*) FILTER (lang = 'en') AS files, count(*) FILTER (lang = 'en' AND quality = 1) AS observed FROM documents d LEFT JOIN labels l USING (doc_id)")
def service_counts(spark, d):
    cov = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "AVAILABLE").otherwise("COLLECTION_FAILED").alias("coverage"))
    return service.service_counts(table(spark, d, "documents"), cov, "doc_id", "lang", "en")


@query("SELECT o_orderkey, CAST(greatest(0, date_diff('day', date_trunc('month', CAST(o_orderdate AS DATE)), DATE '1996-01-15')) AS INTEGER) AS lag_days FROM orders")
def snapshot_lag(spark, d):
    return table(spark, d, "orders").select("o_orderkey", service.lag_days(F.date_format("o_orderdate", "yyyy-MM"), F.lit("1996-01-15").cast("date")).alias("lag_days"))


_NAMED = "CASE role WHEN 'user' THEN '전화 ' || role WHEN 'assistant' THEN '민원 ' || role ELSE role END"


@query(f"""
WITH c AS (SELECT conv_id, turn, {_NAMED} AS name, role FROM conversations WHERE (conv_id + turn) % 8 NOT IN (1, 2, 3, 4) AND NOT (turn = 1 AND conv_id % 5 = 0) AND (conv_id % 5 <> 0 OR conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING max(turn) <= 1)))
SELECT sha256(sha256('k' || conv_id || '|FILE|' || CASE WHEN conv_id % 3 = 0 THEN 'box' ELSE '' END || '|f' || conv_id)[1:16] || '||0')[1:16] AS table_id, CAST(turn + 1 AS INTEGER) AS ordinal, name, CASE role WHEN 'user' THEN 'WITHHELD' ELSE 'REVIEW_REQUIRED' END AS safety_status, CASE role WHEN 'user' THEN 'column-name:전화' ELSE 'column-name:민원' END AS safety_reason
FROM c WHERE role IN ('user', 'assistant') ORDER BY table_id, ordinal LIMIT 100""")
def safety_review(spark, d):
    """The sample for people to look at, from an ingest of column profiles."""
    named = F.when(F.col("name") == "user", F.concat(F.lit("전화 "), "name")).when(F.col("name") == "assistant", F.concat(F.lit("민원 "), "name")).otherwise(F.col("name"))
    p = profiles(spark, d).withColumn("name", named)
    return service.safety_review_sample(observe.ingest(p, p.select("list_key", F.lit(True).alias("open")).distinct())["columns"])


@query(f"""WITH r AS ({_bm25_sql(_ASKED, 20)}), rel AS ({_PASSAGES}) SELECT r.query_id, rank, r.doc, rel.doc IS NOT NULL AS auto FROM r LEFT JOIN rel ON r.query_id = rel.query_id AND r.doc = rel.doc""")
def golden_export(spark, d):
    ranked = bm25.bm25(_asked(spark, d), table(spark, d, "documents"), "doc_id", {"text": 1.0}, 20)
    return service.golden_candidates(ranked, _passages(spark, d))



@query("""
SELECT 'status' AS axis, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 'brand', p_brand, count(*) FROM part GROUP BY p_brand
UNION ALL SELECT 'segment', c_mktsegment, count(*) FROM customer GROUP BY c_mktsegment""")
def catalog_stats(spark, d):
    out = None
    for axis, name, col in (("status", "orders", "o_orderstatus"), ("brand", "part", "p_brand"), ("segment", "customer", "c_mktsegment")):
        part = stats.by_axis(table(spark, d, name), F.col(col)).select(F.lit(axis).alias("axis"), "value", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("""
WITH l AS (SELECT o_orderkey AS record_id, o_custkey AS list_key FROM orders), a AS (SELECT DISTINCT CAST(c_custkey * 2 AS VARCHAR) AS id FROM customer),
f AS (SELECT id, id IN (SELECT CAST(record_id AS VARCHAR) FROM l) AS found FROM a)
SELECT id, found, CASE WHEN NOT found THEN (SELECT string_agg(CAST(record_id AS VARCHAR), ',' ORDER BY CAST(record_id AS VARCHAR)) FROM l WHERE CAST(list_key AS VARCHAR) = id) END AS alternatives FROM f""")
def record_lookup(spark, d):
    listings = table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("list_key"))
    out = views.lookup(table(spark, d, "customer").select((F.col("c_custkey") * 2).alias("id")), listings)
    return out.select("id", "found", F.array_join("alternatives", ",").alias("alternatives"))


@query("""
WITH r AS (SELECT p_partkey, p_brand AS profile, CAST(p_size % 7 AS BIGINT) AS filled FROM part), g AS (SELECT profile, filled, count(*) AS n FROM r GROUP BY ALL),
w AS (SELECT profile, filled, CAST(sum(n) OVER (PARTITION BY profile) AS BIGINT) AS rows, CAST(coalesce(sum(n) OVER (PARTITION BY profile ORDER BY filled DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS higher,
             filled = first_value(filled) OVER (PARTITION BY profile ORDER BY n DESC, filled) AS typical FROM g)
SELECT p_partkey, rows, higher, typical FROM r JOIN w USING (profile, filled)""")
def top_percent(spark, d):
    rated = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("profile"), (F.col("p_size") % 7).cast("bigint").alias("filled"), F.lit(7).cast("bigint").alias("total"))
    return views.with_top_percent(rated).select("p_partkey", "rows", "higher", "typical")


@query("SELECT doc_id, coalesce(l.ok, false) AS structure_available FROM documents LEFT JOIN (SELECT DISTINCT doc_id, true AS ok FROM labels WHERE quality = 1) l USING (doc_id)")
def structure_flag(spark, d):
    cov = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "PARTIAL").otherwise("COLLECTION_FAILED").alias("coverage"))
    return views.with_structure_flag(table(spark, d, "documents").select("doc_id"), cov, "doc_id").select("doc_id", "structure_available")
