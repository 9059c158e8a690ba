"""Search, comparison and evaluation on the document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogspark.operators import compare as cmp
from catalogspark.operators import bm25, columns, evaluate, search, views
from catalogspark.sources.shared import new_path, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_T = "list_filter(regexp_split_to_array(strip_accents(lower(coalesce({}, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_POST = f"p AS (SELECT doc_id, len(t) AS len, u AS term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS u FROM (SELECT doc_id, {_T.format('text')} AS t FROM documents)) GROUP BY ALL)"


@query(f"WITH {_POST} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY term")
def postings_stats(spark, d):
    posted = bm25.postings(table(spark, d, "documents"), "doc_id", {"text": 1.0})
    return posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("bigint").alias("n"))


def scored_sql(rows: str, fields: list[tuple[str, float]], asked: str) -> str:
    """CTEs up to s(query_id, n_units, doc, hit, score). rows: a SELECT with doc and the fields; asked: one with query_id and text.

    Each token between white space is a phrase: its words at successive positions of one field.
    """
    words = " UNION ALL ".join(f"SELECT doc, {n} AS f, {w}::DOUBLE AS w, generate_subscripts(t, 1) AS place, unnest(t) AS term FROM (SELECT doc, {_T.format(c)} AS t FROM dr)" for n, (c, w) in enumerate(fields))
    return f"""dr AS ({rows}), oc AS ({words}),
ln AS (SELECT doc, (SELECT count(*) FROM oc WHERE oc.doc = dr.doc) AS len FROM dr), st AS (SELECT count(*) AS n, sum(len) / count(*) AS av FROM ln),
qu AS (SELECT query_id, u, count(*) AS times FROM (SELECT query_id, {_T.format('tok')} AS u FROM (SELECT query_id, unnest(regexp_split_to_array(text, '\\s+')) AS tok FROM ({asked}))) WHERE len(u) > 0 GROUP BY ALL),
qn AS (SELECT query_id, count(*) AS n_units FROM qu GROUP BY 1),
uw AS (SELECT u, generate_subscripts(u, 1) AS i, unnest(u) AS term FROM (SELECT DISTINCT u FROM qu)),
ph AS (SELECT doc, u, sum(w) AS tf FROM (SELECT doc, u, f, place - i AS start, any_value(w) AS w FROM oc JOIN uw USING (term) GROUP BY doc, u, f, place - i HAVING count(*) = len(u)) GROUP BY doc, u),
pf AS (SELECT u, count(*) AS df FROM ph GROUP BY u),
s AS (SELECT query_id, n_units, doc, count(*) AS hit, round(sum(times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / av))), 6) AS score
      FROM qu JOIN qn USING (query_id) JOIN ph USING (u) JOIN pf USING (u) JOIN ln USING (doc), st GROUP BY ALL)"""


def _bm25_sql(queries: str, k: int) -> str:
    return f"""
WITH {scored_sql("SELECT doc_id AS doc, text FROM documents", [("text", 1)], queries)},
k AS (SELECT *, bool_or(hit = n_units) OVER (PARTITION BY query_id) AS exact FROM s),
r AS (SELECT query_id, CASE WHEN exact THEN 'AND' ELSE 'OR' END AS mode, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS INTEGER) AS rank, doc FROM k WHERE hit = n_units OR NOT exact)
SELECT query_id, mode, rank, doc FROM r WHERE rank <= {k}"""


_ASKED = "SELECT item_id AS query_id, text FROM benchmark"


def _asked(spark, d):
    """Every benchmark text, whole, as a query."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _ranked(spark, d):
    return bm25.bm25(_asked(spark, d), table(spark, d, "documents"), "doc_id", {"text": 1.0})


@query(_bm25_sql(_ASKED, 10))
def bm25_topk(spark, d):
    return _ranked(spark, d).drop("score")



_MIXED = "SELECT n_nationkey AS query_id, CASE n_nationkey % 3 WHEN 0 THEN 'the of' WHEN 1 THEN 'the ' || lower(n_name) || ' de' ELSE lower(n_name) END AS text FROM nation"


@query(_bm25_sql(_MIXED, 5))
def bm25_and_or_fallback(spark, d):
    n = table(spark, d, "nation")
    key = F.col("n_nationkey")
    q = n.select(key.alias("query_id"), F.when(key % 3 == 0, "the of").when(key % 3 == 1, F.concat(F.lit("the "), F.lower("n_name"), F.lit(" de"))).otherwise(F.lower("n_name")).alias("text"))
    return bm25.bm25(q, table(spark, d, "documents"), "doc_id", {"text": 1.0}, 5).drop("score")


_PAIRED = "SELECT item_id AS query_id, regexp_replace(text, '(\\S+)\\s+(\\S+)\\s*', '\\1-\\2 ', 'g') AS text FROM benchmark"


def _paired(spark, d):
    """Every benchmark text with its words in pairs: each pair is a phrase."""
    return _asked(spark, d).withColumn("text", F.regexp_replace("text", r"(\S+)\s+(\S+)\s*", "$1-$2 "))


@query(_bm25_sql(_PAIRED, 10))
def bm25_phrases(spark, d):
    """Pairs of words that must stand side by side."""
    return bm25.bm25(_paired(spark, d), table(spark, d, "documents"), "doc_id", {"text": 1.0}).drop("score")


@query(_bm25_sql(_PAIRED, 10))
def bm25_stored_index(spark, d):
    """The same phrases from an index in the shared folder: no text is read by the search."""
    path = new_path(spark, "index")
    bm25.write_index(table(spark, d, "documents"), "doc_id", {"text": 1.0}, path)
    return bm25.bm25(_paired(spark, d), None, "doc_id", {"text": 1.0}, index=bm25.read_index(spark, path)).drop("score")


@query("""
SELECT doc_id, row_no FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS row_no FROM documents
WHERE lang = 'en' AND contains(lower(source), 'rc1') AND n_chars >= 500) WHERE row_no BETWEEN 11 AND 30""")
def search_filtered(spark, d):
    from catalogspark.operators.stats import page

    docs = table(spark, d, "documents").where((F.col("lang") == "en") & search.contains_literal(F.col("source"), "RC1") & (F.col("n_chars") >= 500))
    return page(docs.select("doc_id", "n_chars"), [F.desc_nulls_last("n_chars"), F.asc("doc_id")], 10, 20).select("doc_id", "row_no")


@query("""
WITH q AS (SELECT doc_id AS query_id, regexp_split_to_array(lang || ' ' || source || ' en ' || coalesce(text, '') || ' src1', '\\s+') AS t FROM documents),
x AS (SELECT query_id, list_filter(t, lambda w: w <> '') AS t FROM q),
y AS (SELECT query_id, t, list_position(list_transform(t, lambda w: w IN ('en', 'fr', 'de')), true) AS a, list_position(list_transform(t, lambda w: upper(w) IN ('SRC1', 'SRC2', 'SRC3')), true) AS b FROM x)
SELECT query_id, upper(t[a]) AS lang, upper(t[b]) AS source, array_to_string(list_filter(t, lambda w, i: i IS DISTINCT FROM a AND i IS DISTINCT FROM b), ' ') AS rest FROM y""")
def query_interpret(spark, d):
    docs = table(spark, d, "documents")
    q = docs.select(F.col("doc_id").alias("query_id"), F.concat_ws(" ", "lang", "source", F.lit("en"), F.coalesce("text", F.lit("")), F.lit("src1")).alias("text"), F.lit(None).cast("array<string>").alias("skip"))
    axes = {"lang": ({x: x.upper() for x in ("en", "fr", "de")}, False), "source": ({x: x for x in ("SRC1", "SRC2", "SRC3")}, True)}
    return search.interpret(q, axes).select("query_id", "lang", "source", "rest")


@query("SELECT doc_id, concat_ws(',', CASE WHEN contains(lower(text), 'the') OR contains(lower(text), 'src7') THEN 'text' END, CASE WHEN contains(source, 'src7') THEN 'source' END) AS matched FROM documents WHERE contains(lower(text), 'the') OR contains(lower(text), 'src7') OR contains(source, 'src7')")
def matched_fields(spark, d):
    m = search.matched_fields(["text", "source"], F.array(F.lit("The"), F.lit("SRC7")))
    return table(spark, d, "documents").select("doc_id", F.array_join(m, ",").alias("matched")).where("matched <> ''")


_LINE = "' ' || array_to_string({}, ' ') || ' '"
_PASSAGES = f"""SELECT b.query_id, d.doc FROM (SELECT item_id AS query_id, {_LINE.format(_T.format('text'))} AS p FROM benchmark) b
  JOIN (SELECT doc_id AS doc, {_LINE.format(_T.format('text'))} AS t FROM documents) d ON contains(t, p) WHERE trim(p) <> ''"""


def _passages(spark, d):
    """Each document that holds a benchmark text, whole, is relevant to it."""
    return evaluate.relevant_by_passage(_asked(spark, d), table(spark, d, "documents"), "doc_id", "text")


_METRICS = f"""
WITH r AS ({_bm25_sql(_ASKED, 10)}), rel AS ({_PASSAGES}),
g AS (SELECT query_id, count(*) AS relevant FROM rel GROUP BY query_id),
h AS (SELECT r.query_id, count(*) AS retrieved, count(rel.doc) AS hits, sum(CASE WHEN rel.doc IS NULL THEN 0 ELSE 1 / log2(rank + 1) END) AS dcg FROM r LEFT JOIN rel ON r.query_id = rel.query_id AND r.doc = rel.doc GROUP BY r.query_id),
e AS (SELECT g.query_id, relevant, coalesce(retrieved, 0) AS retrieved, coalesce(hits, 0) AS hits, coalesce(dcg, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) x(i) WHERE i <= least(relevant, 10)) AS ndcg FROM g LEFT JOIN h USING (query_id))
"""


@query(_METRICS + "SELECT query_id, relevant, retrieved, hits, CAST(round(ndcg, 6) AS DECIMAL(12, 6)) AS ndcg FROM e")
def ranking_eval(spark, d):
    m = evaluate.rank_metrics(_ranked(spark, d), _passages(spark, d))
    return m.where("relevant > 0").select("query_id", "relevant", "retrieved", "hits", F.round("ndcg", 6).cast("decimal(12,6)").alias("ndcg"))



@query(_METRICS + "SELECT (SELECT count(*) FROM benchmark) AS queries, count(*) AS judged, CAST(round(avg(hits / 10), 6) AS DECIMAL(12, 6)) AS precision, CAST(round(avg(hits / least(relevant, 10)), 6) AS DECIMAL(12, 6)) AS recall, CAST(round(avg(ndcg), 6) AS DECIMAL(12, 6)) AS ndcg, CAST(round(avg((hits > 0)::INT), 6) AS DECIMAL(12, 6)) AS success_rate FROM e")
def ranking_means(spark, d):
    """Means over queries with relevant documents, and the share of them with a hit."""
    m = evaluate.mean_metrics(evaluate.rank_metrics(_ranked(spark, d), _passages(spark, d)), _asked(spark, d))
    return m.select("queries", "judged", *[F.round(c, 6).cast("decimal(12,6)").alias(c) for c in ("precision", "recall", "ndcg", "success_rate")])


@query(_METRICS + "SELECT query_id, relevant, hits FROM e ORDER BY round(ndcg, 9), query_id LIMIT 5")
def ranking_worst(spark, d):
    """The five queries that the search serves worst."""
    m = evaluate.rank_metrics(_ranked(spark, d), _passages(spark, d)).withColumn("ndcg", F.round("ndcg", 9))
    return views.worst(m).select("query_id", "relevant", "hits")


@query("SELECT q AS query_id, doc_id AS doc FROM documents, (VALUES ('A', '^[A-D]'), ('B', '(?i)[ ,]de [a-z]+ la[ ,.]'), ('C', '[0-9]{3}-[0-9]{4}')) t(q, p) WHERE regexp_matches(text, p)")
def regex_relevance(spark, d):
    q = spark.createDataFrame([("A", "^[A-D]"), ("B", "(?i)[ ,]de [a-z]+ la[ ,.]"), ("C", "[0-9]{3}-[0-9]{4}")], "query_id string, pattern string")
    return evaluate.relevant_by_pattern(q, table(spark, d, "documents"), "doc_id", "text")


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def found_sql(index: str, asked: str) -> str:
    """CTEs up to f(query_id, list_key, matched): index has list_key and column_name, asked query_id, at and keyword."""
    return f"""i AS (SELECT DISTINCT * FROM ({index})), kw AS (SELECT query_id, min(place) AS place, trim(keyword) AS keyword FROM ({asked}) WHERE trim(keyword) <> '' GROUP BY ALL),
ks AS (SELECT query_id, count(*) AS need, max(length(keyword)) AS longest FROM kw GROUP BY 1), said AS (SELECT query_id, count(*) FILTER (trim(keyword) <> '') AS n FROM ({asked}) GROUP BY 1),
bad AS (SELECT query_id, CASE WHEN n = 0 THEN 'no keywords' WHEN n > 5 THEN 'more than 5 keywords' WHEN longest > 50 THEN 'a keyword of over 50 characters' END AS error FROM said LEFT JOIN ks USING (query_id)),
hk AS (SELECT query_id, list_key, place, keyword, list_sort(list(column_name))[1:5] AS c FROM i JOIN kw ON contains({_LOW.format('column_name')}, {_LOW.format('keyword')}) GROUP BY ALL),
f AS (SELECT query_id, list_key, string_agg(keyword || '=' || array_to_string(c, ','), ';' ORDER BY place) AS matched FROM hk JOIN ks USING (query_id) JOIN bad USING (query_id) WHERE error IS NULL GROUP BY query_id, list_key, need HAVING count(*) = need)"""


def _said(m):
    return F.array_join(F.transform(m, lambda x: F.concat(x["keyword"], F.lit("="), F.array_join(x["columns"], ","))), ";")


_KEYWORDS = [
    *[("q1", k) for k in ("al", " E ", "", "e")], *[("q2", k) for k in ("ROSE", "%")], *[("q3", k) for k in ("o", "r")], *[("q4", k) for k in ("gi", "hot")], ("q5", "widget"), ("q6", "izmo"), ("q6", "IZM"), ("q7", "Wid"), ("q7", "idge"),
    ("none", "  "), *[("many", k) for k in "abcdef"], ("long", "x" * 51),
]
_KEYWORDS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{q}', {n}, '{k}')" for n, (q, k) in enumerate(_KEYWORDS)) + ") t(query_id, place, keyword)"
_PART_WORDS = "SELECT p_brand AS list_key, unnest(string_split(p_name, ' ')) AS column_name FROM part"


def _part_words(spark, d):
    return table(spark, d, "part").select(F.col("p_brand").alias("list_key"), F.explode(F.split("p_name", " ")).alias("column_name")).distinct()


def _keywords(spark):
    return spark.createDataFrame(_KEYWORDS, "query_id string, keyword string").coalesce(1)


@query(f"WITH {found_sql(_PART_WORDS, _KEYWORDS_SQL)} SELECT * FROM f")
def column_search(spark, d):
    return columns.column_search(_keywords(spark), _part_words(spark, d)).withColumn("matched", _said("matched"))


@query(f"""WITH {found_sql(_PART_WORDS, _KEYWORDS_SQL)}, n AS (SELECT query_id, count(*) AS n FROM f GROUP BY 1)
SELECT query_id, error, CASE WHEN error IS NULL THEN coalesce(n, 0) END AS total, CASE WHEN error IS NULL THEN coalesce(n, 0) > 20 END AS has_more,
       CASE WHEN error IS NULL THEN (SELECT count(DISTINCT p_brand) FROM part) END AS searched, CASE WHEN error IS NULL THEN (SELECT count(*) FROM part WHERE p_size > 9) END AS file_listings
FROM bad LEFT JOIN n USING (query_id)""")
def column_search_totals(spark, d):
    """Errors, totals and coverage of the same searches."""
    index = _part_words(spark, d)
    listings = table(spark, d, "part").select(F.col("p_brand").alias("list_key"), F.col("p_partkey").alias("record_id"), F.when(F.col("p_size") > 9, "FILE").otherwise("API").alias("list_type"))
    asked = _keywords(spark)
    return columns.column_totals(asked, columns.column_search(asked, index), index, listings)


_DOC_WORDS = f"SELECT doc_id AS list_key, unnest({_T.format('text')}) AS column_name FROM documents"
_CUT = "SELECT n_nationkey AS query_id, 0 AS place, substr(n_name, 1, 3) AS keyword FROM nation UNION ALL SELECT n_nationkey, 1, substr(n_name, 3, 2) FROM nation UNION ALL SELECT n_nationkey, 2, lower(n_name) FROM nation WHERE n_nationkey % 5 = 0"


@query(f"""WITH {found_sql(_DOC_WORDS, _CUT)}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY list_key) AS INTEGER) AS place FROM f)
SELECT query_id, place, list_key, list_key AS record_id, matched FROM r WHERE place <= 20""")
def column_search_stored(spark, d):
    """Parts of names sought among the words of all documents, from postings in the shared folder; a page of each search."""
    docs = table(spark, d, "documents")
    path = new_path(spark, "names")
    columns.write_names(docs.select(F.col("doc_id").alias("list_key"), F.array_distinct(bm25.terms_of(F.col("text"))).alias("names")), f"{path}/names")
    index = columns.read_names(spark, f"{path}/names")
    columns.write_grams(index, f"{path}/grams")
    n = table(spark, d, "nation")
    name, key = F.col("n_name"), F.col("n_nationkey").alias("query_id")
    asked = n.select(key, F.explode(F.array_compact(F.array(F.substring(name, 1, 3), F.substring(name, 3, 2), F.when(F.col("n_nationkey") % 5 == 0, F.lower(name))))).alias("keyword"))
    listings = docs.select(F.col("doc_id").alias("list_key"), F.col("doc_id").alias("record_id"), F.lit("FILE").alias("list_type"))
    return columns.column_pages(asked, index, columns.read_grams(spark, f"{path}/grams"), listings).withColumn("matched", _said("matched"))


@query("""
WITH m AS (SELECT CAST(floor(p_partkey / 3) AS BIGINT) AS g, * FROM part)
SELECT g AS group_id, field, n_values, n_values = 1 AS shared FROM (
  SELECT g, 'p_brand' AS field, count(DISTINCT p_brand) AS n_values FROM m GROUP BY g UNION ALL SELECT g, 'p_type', count(DISTINCT p_type) FROM m GROUP BY g UNION ALL SELECT g, 'p_size', count(DISTINCT p_size) FROM m GROUP BY g)""")
def compare_groups(spark, d):
    m = table(spark, d, "part").withColumn("group_id", F.floor(F.col("p_partkey") / 3))
    return cmp.compare(m, ["p_brand", "p_type", "p_size"])


@query("""
WITH m AS (SELECT CAST(floor(p_partkey / 3) AS BIGINT) AS g, p_partkey AS r, unnest(list_distinct(string_split(p_name, ' '))) AS c FROM part WHERE p_size > 2),
s AS (SELECT CAST(floor(p_partkey / 3) AS BIGINT) AS g, count(*) AS size FROM part GROUP BY 1), o AS (SELECT g, count(DISTINCT r) AS seen FROM m GROUP BY g),
e AS (SELECT g, c, count(*) AS n, min(r) AS r FROM m GROUP BY g, c)
SELECT s.g AS group_id, coalesce(seen = size, false) AS all_observed,
       CASE WHEN seen = size THEN coalesce((SELECT string_agg(c, ',' ORDER BY c) FROM e WHERE e.g = s.g AND n = size), '') END AS common,
       CASE WHEN seen = size THEN coalesce((SELECT CAST(sum(n) AS BIGINT) FROM e WHERE e.g = s.g AND n < size), 0) END AS n_only FROM s LEFT JOIN o USING (g)""")
def compare_structures(spark, d):
    p = table(spark, d, "part")
    members = p.select(F.floor(F.col("p_partkey") / 3).alias("group_id"), F.col("p_partkey").alias("record_id"))
    cols = p.where("p_size > 2").select(F.col("p_partkey").alias("record_id"), F.explode(F.array_distinct(F.split("p_name", " "))).alias("column_name"))
    return cmp.common_columns(cols, members).select("group_id", "all_observed", F.array_join("common", ",").alias("common"), F.when(F.col("all_observed"), F.size("only_in").cast("bigint")).alias("n_only"))


@query("""
WITH c AS (SELECT n_nationkey AS case_id, CASE WHEN n_nationkey % 2 = 0 THEN '2024-06' ELSE '2024-05' END AS snap FROM nation), r AS (SELECT case_id, snap, k AS pos, case_id * 37 + k * 113 AS id FROM c, range(4) t(k))
SELECT case_id, CAST(pos AS INTEGER) AS pos, id, lang, lang IS NOT NULL AS present, snap <> '2024-06' AS stale FROM r LEFT JOIN documents d ON d.doc_id = r.id""")
def case_enrichment(spark, d):
    n = F.col("n_nationkey")
    cand = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct((n * 37 + k * 113).cast("bigint").alias("id"), F.lit("PRIMARY").alias("role")))
    cases = table(spark, d, "nation").select(n.alias("case_id"), F.when(n % 2 == 0, "2024-06").otherwise("2024-05").alias("case_snapshot"), cand.alias("candidates"))
    return evaluate.enriched_cases(cases, table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "2024-06").select("case_id", F.col("at").alias("pos"), "id", "lang", "present", "stale")


@query("""
WITH r AS (SELECT doc_id % 10 AS query_id, doc_id AS doc FROM labels WHERE CASE WHEN toxic = 1 THEN false WHEN doc_id % 4 = 0 THEN true ELSE quality = 1 END UNION SELECT doc_id % 10, doc_id + 100000000 FROM labels WHERE quality = 0)
SELECT query_id, doc FROM r ANTI JOIN (SELECT doc_id AS doc FROM documents WHERE doc_id % 3 <> 0) USING (doc)""")
def golden_drift(spark, d):
    lab = table(spark, d, "labels")
    cand = lab.select((F.col("doc_id") % 10).alias("query_id"), F.col("doc_id").alias("doc"), (F.col("quality") == 1).alias("auto"), F.when(F.col("toxic") == 1, "N").when(F.col("doc_id") % 4 == 0, "R").alias("verdict"))
    more = lab.where("quality = 0").select((F.col("doc_id") % 10).alias("query_id"), (F.col("doc_id") + 100000000).alias("doc"))
    return evaluate.drifted(evaluate.resolve_verdicts(cand, more), table(spark, d, "documents").where("doc_id % 3 <> 0"), "doc_id").select("query_id", "doc")


_REVIEW = """
WITH c AS (SELECT doc_id // 20 AS q, doc_id AS doc, quality = 1 AS auto, CASE WHEN toxic = 1 THEN 'N' WHEN doc_id % 4 = 0 THEN 'R' WHEN doc_id % 4 = 1 THEN '' END AS v FROM labels),
j AS (SELECT *, CASE WHEN coalesce(v, '') <> '' THEN v = 'R' ELSE coalesce(auto, false) END AS rel FROM c),
m AS (SELECT doc_id // 20 AS q, doc_id + 100000000 AS doc FROM labels WHERE quality = 0 AND doc_id % 3 = 0 UNION SELECT doc_id // 20, doc_id FROM labels WHERE doc_id % 5 = 0),
n AS (SELECT q, doc FROM m WHERE (q, doc) NOT IN (SELECT (q, doc) FROM j WHERE rel)),
r AS (SELECT q, doc, 0 AS turn FROM j WHERE rel UNION ALL SELECT q, doc, 1 FROM n),
g AS (SELECT q AS query_id, (SELECT string_agg(doc, ',' ORDER BY turn, doc) FROM r WHERE r.q = a.q) AS relevant, (SELECT string_agg(doc, ',' ORDER BY doc) FROM j WHERE j.q = a.q AND NOT rel) AS excluded,
             (SELECT count(v) FROM j WHERE j.q = a.q) + (SELECT count(*) FROM n WHERE n.q = a.q) AS reviewed, (SELECT string_agg(doc, ',' ORDER BY turn, doc) FROM r WHERE r.q = a.q AND doc NOT IN (SELECT doc_id FROM documents)) AS missing FROM (SELECT DISTINCT q FROM c) a)
"""


def _promoted(spark, d):
    """Every twenty labelled documents are a query's candidates; some verdicts are blank, some additions are candidates already or no longer there."""
    lab, k = table(spark, d, "labels"), F.col("doc_id")
    q = F.floor(k / 20).alias("query_id")
    cand = lab.select(q, k.alias("rank"), k.alias("doc"), (F.col("quality") == 1).alias("auto"), F.when(F.col("toxic") == 1, "N").when(k % 4 == 0, "R").when(k % 4 == 1, "").alias("verdict"))
    gone = lab.where("quality = 0 and doc_id % 3 = 0").select(q, (k + 100000000).alias("place"), (k + 100000000).alias("doc"))
    more = gone.unionByName(lab.where("doc_id % 5 = 0").select(q, k.alias("place"), k.alias("doc")))
    return evaluate.promoted(cand, more, table(spark, d, "documents"), "doc_id")


@query(_REVIEW + "SELECT query_id, coalesce(relevant, '') AS relevant, coalesce(excluded, '') AS excluded, reviewed, coalesce(missing, '') AS missing FROM g")
def golden_promotion(spark, d):
    return _promoted(spark, d).select("query_id", *[F.array_join(c, ",").alias(c) for c in ("relevant", "excluded", "missing")], "reviewed")


@query(_REVIEW + """SELECT 'v1' AS version, '2026-06' AS snapshot, count(*) AS queries, (SELECT count(*) FROM r) AS relevant, CAST(sum(reviewed) AS BIGINT) AS reviewed_verdicts, sum(reviewed) > 0 AS human_reviewed,
  (SELECT count(*) FROM r WHERE doc NOT IN (SELECT doc_id FROM documents)) AS missing FROM g""")
def golden_promotion_summary(spark, d):
    return evaluate.promotion_summary(_promoted(spark, d), "2026-06")
