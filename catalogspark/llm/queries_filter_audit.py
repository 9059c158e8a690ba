"""Query op13: five filters over all documents, in every order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalogspark.llm.filter_audit import audit
from catalogspark.sources.shared import table


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), least_id AS (
  SELECT text, min(doc_id) AS m FROM d GROUP BY text
), f AS (
  SELECT d.doc_id, d.part, {'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w),
         'C': 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 10 * length(d.text), 'D': regexp_matches(d.text, '[#$%&*|]'),
         'E': coalesce(least_id.m < d.doc_id, false)} AS x
  FROM d JOIN least_id USING (text)
), l AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
), rows AS (
  SELECT part, unnest([{'k': 'A', 'v': x.A}, {'k': 'B', 'v': x.B}, {'k': 'C', 'v': x.C}, {'k': 'D', 'v': x.D}, {'k': 'E', 'v': x.E}]) AS e,
         list_filter(['A', 'B', 'C', 'D', 'E'], lambda k: CASE k WHEN 'A' THEN x.A WHEN 'B' THEN x.B WHEN 'C' THEN x.C WHEN 'D' THEN x.D ELSE x.E END) AS fails,
         coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
  FROM f LEFT JOIN l ON f.doc_id = l.doc_id
), orders AS (
  SELECT '' AS o UNION ALL SELECT o || k FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k) WHERE NOT contains(o, k)
), steps AS (
  SELECT o AS filter_order, CAST(i AS INTEGER) AS step, o[i:i] AS k, o[1:i - 1] AS before FROM orders, range(1, 6) r(i) WHERE length(o) = 5
), done AS (
  SELECT part, filter_order, step, k,
         count(*) FILTER (NOT e.v AND NOT list_has_any(fails, string_split(before, ''))) AS kept,
         count(*) FILTER (e.v AND NOT list_has_any(fails, string_split(before, ''))) AS removed,
         count(*) FILTER (e.v AND list_has_any(fails, string_split(before, ''))) AS redundant,
         count(*) FILTER (e.v AND len(fails) = 1) AS unique_fails,
         count(*) FILTER (e.v AND good AND NOT list_has_any(fails, string_split(before, ''))) AS good_lost,
         count(*) FILTER (e.v AND toxic AND NOT list_has_any(fails, string_split(before, ''))) AS toxic_lost
  FROM rows JOIN steps ON rows.e.k = steps.k GROUP BY part, filter_order, step, k
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley
FROM done
"""

QUERIES = {"op13_filter_audit": op13_filter_audit}
ORACLES = {"op13_filter_audit": SQL}
