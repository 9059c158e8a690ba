"""Structure observation, plans, exports and usage on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from catalogspark.functions.text import short_id
from catalogspark.operators import bm25, observe, plan, search, views
from catalogspark.plans.queries_search import _ASKED, _asked, _bm25_sql
from catalogspark.sources.export import as_json, json_object, stamped, uri
from catalogspark.sources.shared import new_path, table
from catalogspark.streaming import usage

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(r"""
WITH v AS (SELECT 'part' AS t, p_partkey AS k, CAST(p_size AS VARCHAR) AS a, p_name AS b FROM part UNION ALL SELECT 'customer', c_custkey, CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR), c_name FROM customer
           UNION ALL SELECT 'event', event_id, strftime(ts, '%Y-%m-%d'), event_type FROM events),
s AS (SELECT t, k % 50 AS g, 'a' AS c, a AS v FROM v UNION ALL SELECT t, k % 50, 'b', b FROM v)
SELECT t AS table_name, g AS grp, c AS column_name, CASE WHEN bool_and(regexp_full_match(v, '-?[0-9]+')) THEN 'INTEGER' WHEN bool_and(regexp_full_match(v, '-?[0-9]+([.,][0-9]+)?')) THEN 'NUMBER'
  WHEN bool_and(regexp_full_match(v, '[0-9]{4}([-./][0-9]{1,2}){2}|[0-9]{8}')) THEN 'DATE_LIKE' ELSE 'STRING' END AS observed_type FROM s GROUP BY ALL""")
def type_observation(spark, d):
    part = table(spark, d, "part").select(F.lit("part").alias("t"), F.col("p_partkey").alias("k"), F.col("p_size").cast("string").alias("a"), F.col("p_name").alias("b"))
    cust = table(spark, d, "customer").select(F.lit("customer").alias("t"), F.col("c_custkey").alias("k"), F.round("c_acctbal").cast("bigint").cast("string").alias("a"), F.col("c_name").alias("b"))
    ev = table(spark, d, "events").select(F.lit("event").alias("t"), F.col("event_id").alias("k"), F.date_format("ts", "yyyy-MM-dd").alias("a"), F.col("event_type").alias("b"))
    rows = part.unionByName(cust).unionByName(ev).select("t", (F.col("k") % 50).alias("grp"), F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in "ab"])))
    return observe.observe_types(rows, ["t", "grp", "c"], "v").withColumnsRenamed({"t": "table_name", "c": "column_name"})


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "phone": r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "token": 'token = "'}


@query("""
WITH h AS (SELECT source, CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') THEN 'value-pattern:email' WHEN regexp_matches(text, '\\+1 \\([0-9]{3}\\) [0-9]{3}-[0-9]{4}') THEN 'value-pattern:phone'
   WHEN regexp_matches(text, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}') THEN 'value-pattern:ip' WHEN contains(text, 'token = "') THEN 'value-pattern:token' WHEN length(text) > 80 THEN 'free-text-heuristic' END AS reason FROM documents)
SELECT source, coalesce(reason, 'clear') AS reason, count(*) AS n FROM h GROUP BY ALL""".replace("\\\\", "\\"))
def pii_screen(spark, d):
    s = observe.screen(F.lit("text"), F.array("text"), PII)
    return table(spark, d, "documents").select("source", F.coalesce(s["reason"], F.lit("clear")).alias("reason")).groupBy("source", "reason").agg(F.count("*").alias("n"))


@query("""
WITH l AS (SELECT DISTINCT source AS k, source IN ('src1', 'src2', 'src3') AS open FROM documents WHERE source <> 'src3')
SELECT doc_id, CASE WHEN n_chars < 300 THEN 'WITHHELD_BY_SAFETY' WHEN coalesce(open, false) THEN 'AVAILABLE' ELSE 'WITHHELD_BY_LICENSE' END AS example_status,
       CASE WHEN n_chars >= 300 AND coalesce(open, false) THEN lang END AS example FROM documents LEFT JOIN l ON l.k = source""")
def licence_gate(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    lic = docs.where("source <> 'src3'").select("source", F.col("source").isin("src1", "src2", "src3").alias("open")).distinct()
    r = observe.release(F.lit(True), F.array("lang"), F.when(F.col("n_chars") < 300, "WITHHELD").otherwise("CLEAR"), F.col("open"))
    return docs.join(lic, "source", "left").select("doc_id", r.alias("r")).select("doc_id", "r.example_status", F.get("r.examples", F.lit(0)).alias("example"))


def profiles(spark, d):
    """A column for each turn; where the second turn of a conversation is left out, its ordinals break. Samples are a list, blank, broken, a tuple or an empty list."""
    c = table(spark, d, "conversations").where("not (turn = 1 and conv_id % 5 = 0)")
    key = F.col("conv_id")
    kind = (key + F.col("turn")) % 8
    samples = F.when(kind == 1, " ").when(kind == 2, "[1,").when(kind == 3, "('a', 'b')").when(kind == 4, "[]").when(kind == 5, "[None]").otherwise(F.concat(F.lit("['"), F.col("role"), F.lit("', 5, None]")))
    line = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    return c.select((key * 1000 + line).alias("row_no"), F.concat(F.lit("k"), key.cast("string")).alias("list_key"), F.concat(F.lit("f"), key.cast("string")).alias("file_name"), F.lit("").alias("sheet"),
                    (F.col("turn") + 1).cast("int").alias("ordinal"), F.col("role").alias("name"), samples.alias("samples"), F.length("text").cast("string").alias("distinct"), F.when(F.col("turn") % 2 == 0, "Y").alias("distinct_approx"), F.concat(F.lit(" "), F.when(F.col("turn") > 1, F.col("role"))).alias("note"), (key * 10).cast("string").alias("rows"), F.when(key % 3 == 0, "box").alias("container"))


def _ingested(spark, d):
    p = profiles(spark, d)
    lic = p.select("list_key", (F.substring("list_key", 2, 9).cast("int") % 2 == 0).alias("open")).distinct()
    return observe.stored(observe.ingest(p, lic))


_INGEST = """
WITH c AS (SELECT conv_id, turn, role FROM conversations WHERE NOT (turn = 1 AND conv_id % 5 = 0)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 = turn AS ok FROM c),
a AS (SELECT conv_id, 'k' || conv_id AS list_key, 'f' || conv_id AS file_name, bool_and(ok) AS ok, count(*) AS n, string_agg((turn + 1) || ':' || role, chr(30) ORDER BY turn) AS cols FROM o GROUP BY conv_id),
s AS (SELECT list_key, file_name, CASE WHEN ok THEN 'AVAILABLE' ELSE 'COLLECTION_FAILED' END AS status, CAST(ok::INT AS BIGINT) AS n_tables, CAST(CASE WHEN ok THEN n ELSE 0 END AS BIGINT) AS n_columns,
      CASE WHEN ok THEN sha256(cols) END AS structure_hash, sha256(list_key || '|FILE|' || CASE WHEN conv_id % 3 = 0 THEN 'box' ELSE '' END || '|' || file_name)[1:16] AS asset_id FROM a)
"""


@query(_INGEST + "SELECT * FROM s")
def structure_ingest(spark, d):
    return _ingested(spark, d)["assets"].select("list_key", "file_name", "status", "n_tables", "n_columns", "structure_hash", "asset_id")


@query(_INGEST + "SELECT list_key, count(*) AS assets, count(*) FILTER (status = 'AVAILABLE') AS available, CASE WHEN bool_and(status = 'AVAILABLE') THEN 'AVAILABLE' WHEN bool_or(status = 'AVAILABLE') THEN 'PARTIAL' ELSE max(status) END AS coverage FROM s GROUP BY list_key")
def record_coverage(spark, d):
    return observe.coverage(_ingested(spark, d)["assets"])


#: What a column's samples lead to, by the kind of their text.
_FACTS_SQL = """
SELECT conv_id, turn, role, open, kind, CASE WHEN kind = 1 THEN 'NOT_COLLECTED' WHEN kind IN (2, 3) THEN 'COLLECTION_FAILED' WHEN kind = 4 THEN 'NO_NON_NULL_VALUES' WHEN open THEN 'AVAILABLE' ELSE 'WITHHELD_BY_LICENSE' END AS example_status,
       CASE WHEN kind IN (1, 2, 3, 4) THEN 'NOT_ASSESSED' ELSE 'CLEAR' END AS safety_status, CASE WHEN kind IN (2, 3) THEN 'sample-parse-failed' END AS safety_reason,
       CASE WHEN kind IN (1, 2, 3, 4) THEN NULL ELSE 'STRING' END AS observed_type, CASE WHEN kind = 5 THEN ['None'] WHEN kind IN (0, 6, 7) THEN [role, '5', 'None'] END AS vals,
       length(text) AS n_distinct, turn % 2 = 0 AS distinct_approx, CASE WHEN turn > 1 THEN role END AS note
FROM (SELECT *, conv_id % 2 = 0 AS open, (conv_id + turn) % 8 AS kind FROM conversations WHERE NOT (turn = 1 AND conv_id % 5 = 0))"""


@query(_INGEST + f""", fx AS ({_FACTS_SQL}), col AS (SELECT conv_id, turn, '{{"ordinal":' || (turn + 1) || ',"name":"' || role || '"' || coalesce(',"observed_type":"' || observed_type || '"', '') || coalesce(',"n_distinct":' || n_distinct, '')
  || ',"distinct_approx":' || distinct_approx || ',"safety_status":"' || safety_status || '"' || coalesce(',"safety_reason":"' || safety_reason || '"', '') || ',"example_status":"' || example_status || '"'
  || CASE WHEN example_status = 'AVAILABLE' THEN ',"examples":["' || array_to_string(vals, '","') || '"]' ELSE '' END || coalesce(',"note":"' || note || '"', '') || '}}' AS j FROM fx),
t AS (SELECT conv_id, string_agg(j, ',' ORDER BY turn) AS cols FROM col GROUP BY conv_id)
SELECT s.list_key, '{{"list_key":"' || s.list_key || '","assets":[{{"file_name":"' || s.file_name || '","asset_id":"' || s.asset_id || '","status":"' || s.status || '"'
  || CASE WHEN s.n_tables > 0 THEN ',"structure_hash":"' || s.structure_hash || '","tables":[{{"table_order":0,"sheet":"","rows_scanned":' || (t.conv_id * 10) || ',"column_count":' || s.n_columns || ',"columns":[' || t.cols || ']}}]' ELSE '' END || '}}]}}' AS document FROM s JOIN a USING (list_key, file_name) JOIN t USING (conv_id)""")
def structure_document(spark, d):
    return observe.documents(_ingested(spark, d))


def _sheets(spark, d):
    """Two columns a sheet; where the first row is left out, the first sheet lacks its first column."""
    c = table(spark, d, "conversations").where("not (turn = 0 and conv_id % 5 = 0)")
    line = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    return c.select((F.col("conv_id") * 1000 + line).alias("row_no"), F.concat(F.lit("k"), F.col("conv_id").cast("string")).alias("list_key"), F.lit("f").alias("file_name"), F.concat(F.lit("s"), F.floor(F.col("turn") / 2).cast("string")).alias("sheet"),
                    (F.col("turn") % 2 + 1).cast("int").alias("ordinal"), F.col("role").alias("name"), F.lit("[1, 2]").alias("samples"))


_SHEETS = """
WITH c AS (SELECT 'k' || conv_id AS list_key, 's' || turn // 2 AS sheet, turn, turn % 2 + 1 AS ordinal, role FROM conversations WHERE NOT (turn = 0 AND conv_id % 5 = 0)),
o AS (SELECT *, row_number() OVER (PARTITION BY list_key, sheet ORDER BY turn) = ordinal AS ok FROM c),
s AS (SELECT list_key, sheet, bool_and(ok) AS valid, count(*) AS n, min(turn) AS first FROM o GROUP BY ALL),
v AS (SELECT *, row_number() OVER (PARTITION BY list_key ORDER BY first) - 1 AS table_order FROM s WHERE valid)
"""


@query(_SHEETS + "SELECT list_key, sheet, table_order, n AS column_count FROM v")
def structure_sheets(spark, d):
    """Tables in order of their sheets' first rows, broken sheets left out."""
    none = spark.createDataFrame([], "list_key string, open boolean")
    return observe.ingest(_sheets(spark, d), none)["tables"].select("list_key", "sheet", "table_order", "column_count")


@query(_SHEETS + """SELECT CASE WHEN bool_and(valid) THEN 'AVAILABLE' WHEN bool_or(valid) THEN 'PARTIAL' ELSE 'COLLECTION_FAILED' END AS status, list_key FROM s GROUP BY list_key""")
def structure_statuses(spark, d):
    none = spark.createDataFrame([], "list_key string, open boolean")
    return observe.ingest(_sheets(spark, d), none)["assets"].select("status", "list_key")


@query(_SHEETS + """, st AS (SELECT list_key, CASE WHEN bool_and(valid) THEN 'AVAILABLE' WHEN bool_or(valid) THEN 'PARTIAL' ELSE 'COLLECTION_FAILED' END AS status FROM s GROUP BY list_key)
SELECT count(*) FILTER (status = 'AVAILABLE') AS available, count(*) FILTER (status = 'PARTIAL') AS partial, count(*) FILTER (status = 'COLLECTION_FAILED') AS failed, (SELECT count(*) FROM v) AS tables,
       (SELECT CAST(sum(n) AS BIGINT) FROM v) AS withheld, (SELECT count(*) FROM conversations WHERE turn = 3) AS no_key FROM st""")
def ingest_report(spark, d):
    """Counters of an ingest in which some rows lack their key, without breaking the runs that they lie in."""
    p = _sheets(spark, d)
    bad = table(spark, d, "conversations").where("turn = 3").select((F.col("conv_id") * 1000 + 500).alias("row_no"), F.lit(" ").alias("list_key"), F.lit("f").alias("file_name"), F.lit("s").alias("sheet"), F.lit(1).alias("ordinal"), F.lit("x").alias("name"), F.lit(None).cast("string").alias("samples"))
    r = views.ingest_report(observe.stored(observe.ingest(p.unionByName(bad), spark.createDataFrame([], "list_key string, open boolean"))))
    of = lambda m, k, n: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0)).alias(n)
    return r.select(of("assets", "AVAILABLE", "available"), of("assets", "PARTIAL", "partial"), of("assets", "COLLECTION_FAILED", "failed"), "tables", of("columns", "WITHHELD_BY_LICENSE", "withheld"), of("rejected", "NO_KEY", "no_key"))


@query(_SHEETS + "SELECT DISTINCT list_key, role AS column_name FROM c JOIN v USING (list_key, sheet)")
def column_index(spark, d):
    return observe.column_index(observe.ingest(_sheets(spark, d), spark.createDataFrame([], "list_key string, open boolean")))


@query("SELECT list_key, file_name, CAST(place AS INTEGER) AS place, assets_total FROM (SELECT conv_id // 25 AS list_key, 'f' || conv_id AS file_name, row_number() OVER (PARTITION BY conv_id // 25 ORDER BY 'f' || conv_id) AS place, count(*) OVER (PARTITION BY conv_id // 25) AS assets_total FROM (SELECT DISTINCT conv_id FROM conversations)) WHERE place <= 20")
def asset_page(spark, d):
    """The first twenty assets of each key by file name."""
    ids = table(spark, d, "conversations").select("conv_id").distinct()
    assets = ids.select(F.floor(F.col("conv_id") / 25).alias("list_key"), F.concat(F.lit("f"), F.col("conv_id").cast("string")).alias("file_name"), F.col("conv_id").alias("asset_id"))
    return observe.asset_page(assets).select("list_key", "file_name", "place", "assets_total")


@query(f"""
SELECT 'k' || conv_id AS list_key, sha256(sha256('k' || conv_id || '|FILE|' || CASE WHEN conv_id % 3 = 0 THEN 'box' ELSE '' END || '|f' || conv_id)[1:16] || '||0')[1:16] AS table_id, CAST(turn + 1 AS INTEGER) AS ordinal, role AS name, observed_type, safety_status,
       safety_reason, example_status, CASE WHEN example_status = 'AVAILABLE' THEN array_to_string(vals, ',') END AS examples, n_distinct, distinct_approx, note
FROM ({_FACTS_SQL}) WHERE conv_id % 5 <> 0 OR conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING max(turn) <= 1)""")
def structure_columns(spark, d):
    return _ingested(spark, d)["columns"].select("list_key", "table_id", "ordinal", "name", "observed_type", "safety_status", "safety_reason", "example_status", F.array_join("examples", ",").alias("examples"), "n_distinct", "distinct_approx", "note")


@query("""
SELECT 'p_name' AS "column", count(*) AS n_rows, count(p_name) AS n_values, count(DISTINCT p_name) AS n_distinct, false AS distinct_approx FROM part UNION ALL SELECT 'p_brand', count(*), count(p_brand), count(DISTINCT p_brand), false FROM part
UNION ALL SELECT 'p_size', count(*), count(p_size), count(DISTINCT p_size), false FROM part""")
def column_profile(spark, d):
    return observe.profile(table(spark, d, "part"), ["p_name", "p_brand", "p_size"])


@query("""
WITH v AS (SELECT DISTINCT 'p_name' AS c, p_name AS v FROM part UNION SELECT DISTINCT 'p_type', p_type FROM part)
SELECT c AS "column", CAST(r AS INTEGER) AS rank, v AS value FROM (SELECT c, v, row_number() OVER (PARTITION BY c ORDER BY sha256('part|' || c || '|' || v)) AS r FROM v) WHERE r <= 10""")
def column_examples(spark, d):
    return observe.bottom_k(table(spark, d, "part"), ["p_name", "p_type"], 10, "part").select("column", "rank", "value")


_CAND = f"WITH r AS ({_bm25_sql(_ASKED, 8)}), c AS (SELECT query_id, doc, rank, lang, source, n_chars, text AS title FROM r JOIN documents ON doc = doc_id)"

ROLES = {"DEMAND": "(?i)der|und", "SUPPLY": "(?i)the|of", "REFERENCE": "(?i)que"}


def _candidates(spark, d):
    q = _asked(spark, d)
    top = bm25.bm25(q, table(spark, d, "documents"), "doc_id", {"text": 1.0}, 8)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("title"), "lang", "source", "n_chars")
    rows = top.join(docs, "doc").select(F.col("query_id").alias("plan_id"), F.col("doc").alias("record_id"), "rank", "title", F.array("lang", "source").alias("columns"), (F.col("n_chars") > 1000).alias("spatial_listed"), F.lit(True).alias("temporal_listed"))
    return q, rows.withColumn("roles", plan.assign_roles(F.col("title"), F.col("columns"), F.col("rank"), ROLES, {"SPATIAL": "src1", "TEMPORAL": "^de|^fr"}))


@query(_CAND + """,
g AS (SELECT b.item_id AS plan_id, count(*) FILTER (rank <= 2) AS p, count(*) FILTER (contains(source, 'src1')) AS s, count(*) FILTER (lang IN ('de', 'fr')) AS t, count(*) FILTER (n_chars > 1000) AS sl, count(doc) AS tl,
             count(*) FILTER (contains(lower(title), 'que')) AS rf FROM benchmark b LEFT JOIN c ON c.query_id = b.item_id GROUP BY 1)
SELECT plan_id, 'PRIMARY' AS role, CASE WHEN p > 0 THEN 'SATISFIED' ELSE 'UNSATISFIED' END AS status, p AS n_matched FROM g
UNION ALL SELECT plan_id, 'SPATIAL', CASE WHEN s > 0 THEN 'SATISFIED' WHEN sl > 0 THEN 'PARTIAL' ELSE 'UNSATISFIED' END, CASE WHEN s > 0 THEN s ELSE sl END FROM g
UNION ALL SELECT plan_id, 'TEMPORAL', CASE WHEN t > 0 THEN 'SATISFIED' WHEN tl > 0 THEN 'PARTIAL' ELSE 'UNSATISFIED' END, CASE WHEN t > 0 THEN t ELSE tl END FROM g
UNION ALL SELECT plan_id, 'REFERENCE', 'SATISFIED', rf FROM g WHERE rf > 0""")
def plan_batch(spark, d):
    return _needs(*_candidates(spark, d))



def _needs(q, rows):
    need = plan.needs(rows, q.select(F.col("query_id").alias("plan_id"), F.col("text").alias("purpose")))
    return need.select("plan_id", "role", "status", F.size("matched").cast("bigint").alias("n_matched"))


@query(_CAND + """
SELECT query_id AS plan_id, 'language' AS key, string_agg(CAST(doc AS VARCHAR), ',' ORDER BY doc) AS observed_in, 'CANDIDATE_ONLY' AS status FROM c WHERE lang IN ('en', 'fr') GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT query_id, 'both', string_agg(CAST(doc AS VARCHAR), ',' ORDER BY doc), 'CANDIDATE_ONLY' FROM c WHERE lang = 'de' AND source LIKE 'src1%' GROUP BY 1 HAVING count(*) > 1""")
def plan_join_keys(spark, d):
    return _join_keys(*_candidates(spark, d))



def _join_keys(_, rows):
    return plan.join_keys(rows, {"language": ["^(en|fr)$"], "both": ["^de$", "^src1"]}).select("plan_id", "key", F.array_join("observed_in", ",").alias("observed_in"), "status")


@query("SELECT item_id AS plan_id, array_to_string(searched[1:6], ' ') AS terms FROM (SELECT item_id, list_filter(w, lambda x: length(x) >= 2) AS searched FROM (SELECT item_id, list_transform(regexp_split_to_array(trim(text), '[\\s,·]+'), lambda x: regexp_replace(x, '[^\\p{L}\\p{N}_\\p{M}]', '', 'g')) AS w FROM benchmark))")
def plan_terms(spark, d):
    terms, _ = plan.extract_terms(F.col("text"))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("plan_id"), F.array_join(terms, " ").alias("terms"))


@query("SELECT doc_id AS record_id, 'https://catalog.example/dataset/' || doc_id AS uri, lang, n_chars, 'b' AS last_null FROM documents")
def export_documents(spark, d):
    docs = stamped(table(spark, d, "documents"), "2024-06", "1.8.0", ["b", "a", "b"])
    body = json_object({"@id": as_json(uri("https://catalog.example", "dataset", F.col("doc_id"))), "language": as_json(F.col("lang")), "size": as_json(F.col("n_chars")), "conformsTo": F.lit("null")})
    read = F.from_json(body, "struct<`@id`:string,language:string,size:bigint,conformsTo:string>")
    return docs.select(F.col("doc_id").alias("record_id"), read.alias("r"), "rules").select("record_id", F.col("r.@id").alias("uri"), F.col("r.language").alias("lang"), F.col("r.size").alias("n_chars"), F.element_at("rules", -1).alias("last_null"))


def _events(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("/api/"), "event_type").alias("path"), F.when(F.col("event_id") % 17 == 0, 500).otherwise(200).alias("status"), F.floor(F.abs("value") * 10).alias("ms"),
        F.col("user_id").cast("string").alias("address"), F.col("event_type").alias("agent"), F.col("props").alias("q"), (F.col("event_id") % 5 == 0).alias("zero"), (F.col("user_id") % 7 == 0).alias("opt_out"), "event_id",
    )


def _hmac_sql(key: str, value: str) -> str:
    pad = key.encode().ljust(64, b"\0")
    inner, outer = (bytes(x ^ m for x in pad).hex() for m in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({value}))))"


@query(f"SELECT {_hmac_sql('secret', 'CAST(user_id AS VARCHAR)')}[1:12] AS anon, count(*) AS n, CAST(sum(CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero FROM events WHERE user_id % 7 <> 0 GROUP BY 1")
def usage_anonymize(spark, d):
    log = usage.anonymized(_events(spark, d), b"secret")
    return log.groupBy("anon").agg(F.count("*").alias("n"), F.count_if("zero").alias("zero"))


@query("""
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS hour, '/api/' || event_type AS path, count(*) AS n, count(*) FILTER (event_id % 5 = 0) AS zero, count(*) FILTER (event_id % 17 = 0) AS errors FROM events WHERE user_id % 7 <> 0 GROUP BY ALL""")
def usage_windows(spark, d):
    out = usage.hourly_quality(usage.anonymized(_events(spark, d), b"secret"))
    return out.select(F.date_format("hour", "yyyy-MM-dd HH:00").alias("hour"), "path", "n", "zero", "errors")


@query("""
WITH h AS (SELECT user_id, date_trunc('hour', ts) - to_hours(CAST(k AS INTEGER)) AS start FROM events, range(6) r(k))
SELECT strftime(start, '%Y-%m-%d %H:00') AS start, CAST(user_id AS VARCHAR) AS address, count(*) AS n FROM h GROUP BY ALL HAVING count(*) > 3""")
def rate_limit_windows(spark, d):
    out = usage.window_counts(_events(spark, d), "address", "6 hours", "1 hour").where("n > 3")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:00").alias("start"), "address", "n")


@query("""
WITH t AS (SELECT CAST(user_id AS VARCHAR) AS anon, list(epoch_us(ts) ORDER BY ts) AS ts FROM events WHERE ts IS NOT NULL GROUP BY user_id),
a AS (SELECT anon, ts, list_reduce(list_prepend([]::BIGINT[], list_transform(ts, lambda x: [x])), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y >= x[1] - 21600000000)) < 2 THEN list_concat(acc, x) ELSE acc END) AS ok FROM t)
SELECT anon, us, count(*) FILTER (k = 0) AS n, count(*) FILTER (k = 1) AS n_allowed FROM (SELECT anon, unnest(ts) AS us, 0 AS k FROM a UNION ALL SELECT anon, unnest(ok), 1 FROM a) GROUP BY ALL""")
def rate_limit_stream(spark, d):
    """All events as a stream of files in any order: at most two accepted requests of a user in six hours. A closing row of another key, later than all, has the rest judged."""
    log = table(spark, d, "events").select(F.col("user_id").cast("string").alias("anon"), "ts")
    ends = log.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).head()
    if ends["a"] is None:
        return spark.createDataFrame([], "anon string, us bigint, n bigint, n_allowed bigint")
    span = int((ends["b"] - ends["a"]).total_seconds()) + 1
    path = new_path(spark, "log")
    log.repartition(4, F.xxhash64("ts")).write.parquet(path)
    log.limit(1).select(F.lit("").alias("anon"), (F.lit(ends["b"]) + F.make_interval(secs=F.lit(span + 1))).alias("ts")).write.mode("append").parquet(path)
    key, was = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(key, usage.STATE_STORE)
    try:
        limited = usage.rate_limited(spark.readStream.schema("anon string, ts timestamp").option("maxFilesPerTrigger", 2).parquet(path), 2, 6 * 3600, f"{span} seconds")
        run = limited.writeStream.format("parquet").option("path", f"{path}-out").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(key, was) if was else spark.conf.unset(key)
    out = spark.read.schema("anon string, ts timestamp, allowed boolean").parquet(f"{path}-out")
    return out.groupBy("anon", F.unix_micros("ts").alias("us")).agg(F.count("*").alias("n"), F.count_if("allowed").alias("n_allowed"))


@query("SELECT event_id FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-30' - 7")
def retention(spark, d):
    return usage.retained(_events(spark, d).withColumn("day", F.to_date("ts")), F.lit("2024-01-30").cast("date"), 7).select("event_id")


@query("SELECT l_orderkey, CAST(arg_min(l_partkey, (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END) * 100 + l_linenumber) AS BIGINT) AS l_partkey, sha256(CAST(l_orderkey AS VARCHAR) || '|x')[1:16] AS short_id FROM lineitem GROUP BY l_orderkey")
def representative_rows(spark, d):
    """Of rows that rank alike, the first of the table stands for the order; rows without a part or a rank stand for none, as arg_min has it."""
    rank = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2) * 100 + F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.when(F.col("l_partkey").isNotNull(), rank).alias("rank"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    first = F.row_number().over(W.partitionBy("l_orderkey").orderBy(F.asc_nulls_last("rank"), "file", "row"))
    short = F.when(F.col("l_orderkey").isNotNull(), short_id(F.col("l_orderkey").cast("string"), F.lit("x")))
    return rows.withColumn("first", first).where("first = 1").select("l_orderkey", F.when(F.col("rank").isNotNull(), F.col("l_partkey")).alias("l_partkey"), short.alias("short_id"))
