"""Change feed, families and components on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogspark.operators import families as fam
from catalogspark.operators.diff import snapshot_diff
from catalogspark.operators.graph import connected_components
from catalogspark.operators.stats import page
from catalogspark.sources.shared import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _feed(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("price"), F.col("o_orderstatus").alias("title"), F.col("o_orderpriority").alias("org_name"))
    k = F.col("o_orderkey")
    prev = o.where(k % 10 != 0)
    both = k % 13 == 0
    cur = o.where(k % 7 != 0).withColumns({"price": F.when(k % 11 == 0, F.col("price") + 1).otherwise(F.col("price")), "title": F.when(both, "X").otherwise(F.col("title")), "org_name": F.when(both, "Y").otherwise(F.col("org_name"))})
    ids = lambda n: o.where(k % n == 0).select(k.alias("record_id"))
    return snapshot_diff(prev, cur, "o_orderkey", ["title", "org_name", "price"], prev_missing=ids(20), withdrawn=ids(21))


_FEED = """
WITH feed AS (SELECT o_orderkey AS record_id, CASE
    WHEN o_orderkey % 10 = 0 AND o_orderkey % 7 = 0 THEN NULL
    WHEN o_orderkey % 10 = 0 THEN CASE WHEN o_orderkey % 20 = 0 THEN 'REAPPEARED' ELSE 'ADDED' END
    WHEN o_orderkey % 7 = 0 THEN CASE WHEN o_orderkey % 21 = 0 THEN 'OFFICIALLY_WITHDRAWN' ELSE 'MISSING_FROM_SNAPSHOT' END
    WHEN o_orderkey % 13 = 0 THEN 'POSSIBLE_IDENTITY_CHANGE' WHEN o_orderkey % 11 = 0 THEN 'MODIFIED' END AS status,
  CASE WHEN o_orderkey % 10 = 0 OR o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 143 = 0 THEN 'title,org_name,price' WHEN o_orderkey % 13 = 0 THEN 'title,org_name' WHEN o_orderkey % 11 = 0 THEN 'price' END AS changed
  FROM orders)
"""


@query(_FEED + "SELECT record_id, status, changed FROM feed WHERE status IS NOT NULL")
def snapshot_diff_orders(spark, d):
    return _feed(spark, d).select("record_id", "status", F.array_join("changed_fields", ",").alias("changed"))


@query(_FEED + "SELECT status, count(*) AS n FROM feed WHERE status IS NOT NULL GROUP BY status")
def diff_summary(spark, d):
    return _feed(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query(_FEED + "SELECT status, record_id, row_no, n > 60 AS has_more FROM (SELECT status, record_id, row_number() OVER (PARTITION BY status ORDER BY record_id) AS row_no, count(*) OVER (PARTITION BY status) AS n FROM feed WHERE status IS NOT NULL) WHERE row_no BETWEEN 41 AND 60")
def change_feed_page(spark, d):
    return page(_feed(spark, d), [F.col("record_id")], 40, 20, ["status"]).select("status", "record_id", "row_no", "has_more")


_FAMILY = """
WITH RECURSIVE r AS (SELECT p_partkey AS id, p_brand AS org, p_brand || '_' || p_type || '_' || p_name AS title, sha256(p_type || '|' || p_size) AS h FROM part),
n AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(title, '[\\(\\[].*?[\\)\\]]', ' ', 'g'), '[0-9]+', ' ', 'g'), '[\\s_\\-·.,~년월일차회호기''"]+', '', 'g') AS t,
             list_filter(regexp_split_to_array(title, '[_\\s·\\-]+'), lambda x: x <> '') AS k FROM r),
pat AS (SELECT org, k[1] AS a, k[-1] AS b, len(k) AS n FROM n WHERE len(k) >= 3 AND length(k[-1]) >= 3 GROUP BY ALL
        HAVING count(*) >= 3 AND count(DISTINCT array_to_string(k[2:-2], '~')) >= greatest(3, floor(0.8 * count(*)))),
m AS (SELECT 'T' AS s, org || '~' || t AS g, id FROM n WHERE length(t) >= 3 UNION ALL SELECT 'S', org || '~' || h, id FROM n
      UNION ALL SELECT 'P', n.org || '~' || a || '~' || b || '~' || pat.n, id FROM n JOIN pat ON n.org = pat.org AND k[1] = a AND k[-1] = b AND len(k) = pat.n),
e AS (SELECT DISTINCT id AS u, min(id) OVER (PARTITION BY s, g) AS v FROM m), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
c AS (SELECT u AS id, u AS root FROM b UNION SELECT b.v, c.root FROM c JOIN b ON b.u = c.id WHERE c.root < b.v),
f AS (SELECT id, min(root) AS root FROM c GROUP BY id HAVING true), z AS (SELECT root, count(*) AS n_members FROM f GROUP BY root HAVING count(*) > 1)
SELECT root AS first_id, n_members FROM z"""


def _families(spark, d):
    p = table(spark, d, "part")
    records = p.select(F.col("p_partkey").alias("record_id"), F.col("p_partkey").alias("list_key"), F.concat_ws("_", "p_brand", "p_type", "p_name").alias("title"), F.col("p_brand").alias("org"), F.array().cast("array<string>").alias("regions"))
    structures = p.select(F.col("p_partkey").alias("list_key"), F.sha2(F.concat_ws("|", "p_type", F.col("p_size").cast("string")), 256).alias("structure_hash"), F.lit(5).alias("column_count"))
    return fam.detect_families(records, structures)


@query(_FAMILY)
def families(spark, d):
    f, m = _families(spark, d)
    return m.groupBy("family_id").agg(F.min("record_id").alias("first_id"), F.count("*").alias("n_members")).select("first_id", "n_members")


@query(_FAMILY.rsplit("SELECT root AS first_id", 1)[0] + """, s AS (SELECT root, count(*) AS n_members, CASE WHEN count(DISTINCT h) = 1 THEN 'PLUS_STRUCTURE' ELSE 'CATALOG_ONLY' END AS evidence FROM f JOIN r USING (id) GROUP BY root HAVING count(*) > 1)
SELECT evidence, 'NUMBERED' AS relation, 'UNREVIEWED' AS review, count(*) AS n_families, CAST(sum(n_members) AS BIGINT) AS n_members FROM s GROUP BY evidence""")
def family_stats(spark, d):
    f, _ = _families(spark, d)
    return f.groupBy("evidence", "relation", "review").agg(F.count("*").alias("n_families"), F.sum("n_members").alias("n_members"))


@query("""
WITH j AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'PLUS_STRUCTURE' ELSE 'CATALOG_ONLY' END AS evidence, CASE WHEN toxic = 1 THEN 'NOT_A_FAMILY' WHEN quality = 1 THEN 'CONFIRMED_FAMILY' ELSE 'LEGITIMATE_SPLIT' END AS review FROM labels)
SELECT evidence, count(*) AS judged, count(*) FILTER (review <> 'NOT_A_FAMILY') AS good FROM j GROUP BY evidence UNION ALL SELECT 'ALL', count(*), count(*) FILTER (review <> 'NOT_A_FAMILY') FROM j""")
def family_precision(spark, d):
    j = table(spark, d, "labels").select(F.when(F.col("doc_id") % 2 == 0, "PLUS_STRUCTURE").otherwise("CATALOG_ONLY").alias("evidence"), F.when(F.col("toxic") == 1, "NOT_A_FAMILY").when(F.col("quality") == 1, "CONFIRMED_FAMILY").otherwise("LEGITIMATE_SPLIT").alias("review"))
    return fam.precision(j)


@query("""
WITH RECURSIVE g AS (SELECT c_custkey AS id, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment, floor(c_acctbal / 100)) AS a, min(c_custkey) OVER (PARTITION BY c_mktsegment, floor(c_acctbal)) AS b FROM customer),
e AS (SELECT id AS u, a AS v FROM g UNION SELECT id, b FROM g UNION SELECT a, id FROM g UNION SELECT b, id FROM g),
c AS (SELECT id, id AS root FROM g UNION SELECT e.v, c.root FROM c JOIN e ON e.u = c.id)
SELECT id AS vertex, min(root) AS component FROM c GROUP BY id HAVING count(*) > 1""")
def connected_components_customers(spark, d):
    c = table(spark, d, "customer")
    edges = None
    for keys in (["c_nationkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 100).alias("k")], ["c_mktsegment", F.floor("c_acctbal").alias("k")]):
        g = c.select("c_custkey", F.struct(*keys).alias("g"))
        star = g.join(g.groupBy("g").agg(F.min("c_custkey").alias("dst")), "g").select(F.col("c_custkey").alias("src"), "dst")
        edges = star if edges is None else edges.unionByName(star)
    return connected_components(edges)
