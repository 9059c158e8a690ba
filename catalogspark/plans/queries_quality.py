"""Normalization and quality rules on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogspark.functions.text import coded, split_first, tokens
from catalogspark.operators import quality, stats
from catalogspark.operators.normalize import duplicate_issues, identify
from catalogspark.operators.regions import match_gazetteer
from catalogspark.sources.shared import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT 'source' AS axis, source AS value, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority")
def stats_by_axis(spark, d):
    a = stats.by_axis(table(spark, d, "documents"), F.col("source")).select(F.lit("source").alias("axis"), "*")
    return a.unionByName(stats.by_axis(table(spark, d, "orders"), F.col("o_orderpriority")).select(F.lit("priority").alias("axis"), "*"))


@query("SELECT t AS value, count(*) AS n FROM (SELECT unnest(list_distinct(string_split(upper(p_name), ' '))) AS t FROM part) WHERE t <> '' GROUP BY t ORDER BY n DESC, value LIMIT 20")
def stats_by_token(spark, d):
    return stats.by_token(table(spark, d, "part"), tokens(F.col("p_name"), " ", upper=True), 20)


@query("""
WITH k AS (SELECT o_custkey, o_orderstatus, count(*) OVER (PARTITION BY o_custkey) AS copies FROM orders),
r AS (SELECT *, CASE WHEN copies = 1 THEN CAST(o_custkey AS VARCHAR) ELSE o_custkey || '-' || o_orderstatus END AS record_id FROM k)
SELECT record_id, count(*) AS n_rows, CAST(max(copies) AS BIGINT) AS copies, CAST(sum(CASE WHEN copies > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_issues FROM r GROUP BY record_id""")
def identity_duplicates(spark, d):
    rows = identify(table(spark, d, "orders").select("o_custkey", "o_orderstatus"), "o_custkey", "o_orderstatus")
    found = duplicate_issues(rows, "o_custkey").groupBy("record_id").agg(F.count("*").alias("n_issues"))
    ids = rows.groupBy("record_id").agg(F.count("*").alias("n_rows"), F.max("copies").alias("copies"))
    return ids.join(found, "record_id", "left").select("record_id", "n_rows", "copies", F.coalesce("n_issues", F.lit(0)).cast("bigint").alias("n_issues"))


PRIORITY = {"1-URGENT": "DAILY", "2-HIGH": "WEEKLY", "3-MEDIUM": "MONTHLY", "4-NOT SPECIFIED": "UNSPECIFIED", "": "UNSPECIFIED"}
_CYCLE = "CASE trim(o_orderpriority) WHEN '1-URGENT' THEN 'DAILY' WHEN '2-HIGH' THEN 'WEEKLY' WHEN '3-MEDIUM' THEN 'MONTHLY' WHEN '4-NOT SPECIFIED' THEN 'UNSPECIFIED' ELSE 'OTHER' END"


@query(f"SELECT {_CYCLE} AS code, o_orderstatus = 'F' AS is_final, count(*) AS n FROM orders GROUP BY ALL")
def code_dictionary(spark, d):
    return table(spark, d, "orders").groupBy(coded(F.col("o_orderpriority"), PRIORITY).alias("code"), (F.trim("o_orderstatus") == "Y").alias("y"), (F.trim("o_orderstatus") == "F").alias("is_final")).agg(F.count("*").alias("n")).select("code", "is_final", "n")


@query("""
SELECT p_partkey, list_distinct_ordered AS words, n_words, top, sub FROM (
  SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS list_distinct_ordered,
         CAST(len(list_filter(l, lambda x, i: list_position(l, x) = i)) AS BIGINT) AS n_words,
         string_split(p_brand || ' - ' || p_type || ' - x', ' - ')[1] AS top, p_type || ' - x' AS sub
  FROM (SELECT *, list_filter(string_split(upper(p_name || ' ' || p_type || ' ' || p_name), ' '), lambda x: x <> '') AS l FROM part))""")
def list_tokens_distinct(spark, d):
    top, sub = split_first(F.concat(F.col("p_brand"), F.lit(" - "), F.col("p_type"), F.lit(" - x")))
    words = tokens(F.concat_ws(" ", "p_name", "p_type", "p_name"), " ", upper=True)
    return table(spark, d, "part").select("p_partkey", F.array_join(words, "|").alias("words"), F.size(words).cast("bigint").alias("n_words"), top.alias("top"), sub.alias("sub"))


METALS = [("M-1", "copper", ["copper", "COPPER"], []), ("M-2", "steel", ["STEEL", "steel"], []), ("M-3", "brass", ["BRASS"], ["brass", "o"]), ("M-4", "tin", ["TIN"], ["in"])]


def _gazetteer_sql() -> str:
    parts = []
    fields = [("EXPLICIT", "p_type", 95), ("NAME", "p_name", 80), ("BRAND", "p_brand", 60)]
    for code, _, plain, unsure in METALS:
        whens = []
        for e, f, c in fields:
            whens.append(f"WHEN {' OR '.join(f'contains({f}, {chr(39)}{a}{chr(39)})' for a in plain)} THEN '{e}:{c}'")
            if unsure:
                whens.append(f"WHEN {' OR '.join(f'contains({f}, {chr(39)}{a}{chr(39)})' for a in unsure)} THEN '{e}:{c - 30}'")
        parts.append(f"SELECT p_partkey, '{code}' AS code, CASE {' '.join(whens)} END AS hit FROM part")
    return "SELECT p_partkey, code, split_part(hit, ':', 1) AS evidence, CAST(split_part(hit, ':', 2) AS BIGINT) AS confidence_pct FROM (" + " UNION ALL ".join(parts) + ") WHERE hit IS NOT NULL"


@query(_gazetteer_sql())
def gazetteer_match(spark, d):
    found = match_gazetteer({"EXPLICIT": (F.col("p_type"), 0.95), "NAME": (F.col("p_name"), 0.8), "BRAND": (F.col("p_brand"), 0.6)}, METALS)
    rows = table(spark, d, "part").select("p_partkey", F.inline(found))
    return rows.select("p_partkey", "code", "evidence", F.round(F.col("confidence") * 100).cast("bigint").alias("confidence_pct"))


PROFILES = {"en": ["lang", "source", "quality", "toxic", "text"], "fr": ["lang", "quality", "text"], "de": ["source", "toxic"]}


def _document_completeness(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    checks = {k: F.col(k).isNotNull() for k in ("lang", "source", "quality", "toxic")} | {"text": F.col("n_chars") > 500}
    return quality.completeness(docs, checks, F.col("lang"), PROFILES, "de")


_COMPLETE = """
WITH j AS (SELECT d.doc_id, d.lang, d.source, (d.lang IS NOT NULL)::INT AS a, (d.source IS NOT NULL)::INT AS b, (l.quality IS NOT NULL)::INT AS c, (l.toxic IS NOT NULL)::INT AS e, (d.n_chars > 500)::INT AS t
           FROM documents d LEFT JOIN labels l USING (doc_id)),
cp AS (SELECT doc_id, source, CASE WHEN lang IN ('en', 'fr', 'de') THEN lang ELSE 'de' END AS profile,
             CAST(CASE WHEN lang = 'en' THEN a + b + c + e + t WHEN lang = 'fr' THEN a + c + t ELSE b + e END AS BIGINT) AS filled,
             CAST(CASE WHEN lang = 'en' THEN 5 WHEN lang = 'fr' THEN 3 ELSE 2 END AS BIGINT) AS total FROM j)
"""


@query(_COMPLETE + "SELECT doc_id, profile, filled, total FROM cp")
def completeness_profile(spark, d):
    return _document_completeness(spark, d).select("doc_id", "profile", "filled", "total")


@query(_COMPLETE + "SELECT source, count(*) AS n_docs, CAST(sum(filled) AS BIGINT) AS filled, CAST(sum(total) AS BIGINT) AS total FROM cp GROUP BY source")
def completeness_by_source(spark, d):
    return _document_completeness(spark, d).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("filled").alias("filled"), F.sum("total").alias("total"))


@query(_COMPLETE + """, g AS (SELECT profile, filled, total, count(*) AS n FROM cp GROUP BY ALL)
SELECT profile, filled, total, n, CAST(sum(n) OVER (PARTITION BY profile) AS BIGINT) AS rows,
       first_value(filled) OVER (PARTITION BY profile ORDER BY n DESC, filled) AS mode_filled, max(n) OVER (PARTITION BY profile) AS mode_n,
       CAST(coalesce(sum(n) OVER (PARTITION BY profile ORDER BY filled DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS higher FROM g""")
def completeness_distribution(spark, d):
    return quality.distribution(_document_completeness(spark, d))


@query(_COMPLETE + "SELECT profile, CAST(least(9, floor(filled * 10 / total)) AS INTEGER) AS bin, count(*) AS n FROM cp GROUP BY ALL")
def completeness_histogram(spark, d):
    return quality.histogram(_document_completeness(spark, d))


@query(f"""
WITH f AS (SELECT o_orderkey, {_CYCLE} AS cycle, date_diff('day', CAST(o_orderdate AS DATE), DATE '1997-06-30') AS age FROM orders)
SELECT o_orderkey, cycle, CASE cycle WHEN 'DAILY' THEN CASE WHEN age <= 7 THEN 'FRESH' ELSE 'POSSIBLY_STALE' END WHEN 'WEEKLY' THEN CASE WHEN age <= 30 THEN 'FRESH' ELSE 'POSSIBLY_STALE' END
  WHEN 'MONTHLY' THEN CASE WHEN age <= 60 THEN 'FRESH' ELSE 'POSSIBLY_STALE' END ELSE 'UNKNOWN' END AS freshness FROM f""")
def freshness(spark, d):
    cycle = coded(F.col("o_orderpriority"), PRIORITY)
    return table(spark, d, "orders").select("o_orderkey", cycle.alias("cycle"), quality.freshness(cycle, F.to_date("o_orderdate"), F.lit("1997-06-30").cast("date")).alias("freshness"))


@query("""
WITH i AS (
  SELECT CAST(page_id AS VARCHAR) AS record_id, 'INVALID_URL_FORMAT' AS issue_type, 'url' AS field, url AS source_value FROM pages WHERE NOT regexp_matches(url, '^https://')
  UNION ALL SELECT CAST(page_id AS VARCHAR), 'HAS_MARKUP', 'html', 'x' FROM pages WHERE contains(html, '<')
  UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'NEGATIVE_COUNT', 'c_acctbal', c_name FROM customer WHERE c_acctbal < 0),
s AS (SELECT issue_type, field, count(*) AS n FROM i GROUP BY ALL HAVING count(*) > (SELECT count(*) // 2 FROM pages))
SELECT i.* FROM i ANTI JOIN s USING (issue_type, field) UNION ALL SELECT '@catalog', issue_type, field, CAST(n AS VARCHAR) FROM s""")
def issue_detect(spark, d):
    pages = table(spark, d, "pages")
    found = quality.detect_issues(pages, "page_id", [("INVALID_URL_FORMAT", "url", ~F.col("url").rlike("^https://"), F.col("url"), 0.9), ("HAS_MARKUP", "html", F.contains("html", F.lit("<")), F.lit("x"), 0.5)])
    found = found.unionByName(quality.detect_issues(table(spark, d, "customer"), "c_custkey", [("NEGATIVE_COUNT", "c_acctbal", F.col("c_acctbal") < 0, F.col("c_name"), 0.9)]))
    return quality.collapse_systemic(found, pages.count()).drop("confidence")


@query("""
SELECT 'dummy:p_size' AS field, count(p_size) AS n_all, count(*) FILTER (p_size IN (1, 50)) AS n_hit FROM part
UNION ALL SELECT 'unique:text', count(*), count(DISTINCT text) FROM documents
UNION ALL SELECT 'url:https', count(*), count(*) FILTER (url LIKE 'https://%') FROM pages""")
def url_validity_indices(spark, d):
    dummies = quality.dummy_counts(table(spark, d, "part"), ["p_size"], (1, 50)).select(F.concat(F.lit("dummy:"), "field").alias("field"), F.col("n_values").alias("n_all"), F.col("n_dummies").alias("n_hit"))
    unique = table(spark, d, "documents").agg(F.count("*").alias("n_all"), F.count_distinct("text").alias("n_hit")).select(F.lit("unique:text").alias("field"), "n_all", "n_hit")
    urls = quality.systemic_rate(table(spark, d, "pages"), {"https": F.col("url").like("https://%")}).select(F.lit("url:https").alias("field"), F.col("n_rows").alias("n_all"), F.col("n_present").alias("n_hit"))
    return dummies.unionByName(unique).unionByName(urls)


@query("""
SELECT 'ROW_COUNT' AS check_name, true AS passed UNION ALL SELECT 'NO_DUPLICATE_ID', count(*) = count(DISTINCT o_custkey) FROM orders
UNION ALL SELECT 'URL_COUNT', count(o_orderpriority) = count(*) FROM orders UNION ALL SELECT 'RULE_PRESENT', count(*) FILTER (o_orderstatus IS NULL) = 0 FROM orders""")
def acceptance_checks(spark, d):
    orders = table(spark, d, "orders")
    n = orders.count()
    return quality.acceptance(orders, "o_custkey", F.col("o_orderpriority"), n, n, F.col("o_orderstatus"))


@query("""
SELECT CAST(doc_id AS VARCHAR) AS record_id, 'text' AS field, 'minLength' AS "constraint", 'Violation' AS severity FROM documents WHERE n_chars < 200
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'lang', 'in', 'Warning' FROM documents WHERE lang NOT IN ('en', 'fr', 'de')
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'source', 'pattern', 'Warning' FROM documents WHERE NOT regexp_matches(source, '^src[0-9]$')""")
def constraint_report(spark, d):
    shapes = [("text", "minLength", "Violation", F.col("n_chars") >= 200), ("lang", "in", "Warning", F.col("lang").isin("en", "fr", "de")), ("source", "pattern", "Warning", F.col("source").rlike("^src[0-9]$"))]
    return quality.constraints(table(spark, d, "documents"), "doc_id", shapes)
