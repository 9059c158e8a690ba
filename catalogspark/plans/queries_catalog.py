"""The catalog's own rules, from raw listings to documents, on listings that are derived from the parts.

The raw columns are expressions that Spark and DuckDB read alike; everything after them is the library's on one side and SQL on the other.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogspark.functions import vocabulary as V
from catalogspark.operators import bm25, columns, diff, evaluate, plan, quality, search, views
from catalogspark.operators import families as fam
from catalogspark.operators.compare import FACTS, compare_listings, compare_requests
from catalogspark.operators.normalize import catalog_completeness, catalog_issues, duplicate_issues, identify, normalize
from catalogspark.operators.stats import page
from catalogspark.plans.build import catalog_findings, shapes
from catalogspark.plans.queries_search import found_sql, scored_sql
from catalogspark.sources import export
from catalogspark.sources.shared import table, written

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


BASE, MONTH = "https://catalog.example", "2026-06"

#: internal name -> expression over part
RAW = {
    "list_key": "concat(' ', case when p_partkey % 11 = 0 then p_partkey - 1 else p_partkey end, ' ')",
    "list_type": "case p_partkey % 3 when 0 then 'file' when 1 then 'API ' else ' Std' end",
    "title": "concat(' ', p_brand, '_', p_type, '_', p_name, case when p_size % 2 = 0 then ' 2023' else '' end)",
    "file_data_name": "case when p_size % 4 = 0 then '없음' else p_name end",
    "theme_raw": "case when p_size % 5 = 0 then p_type else concat(p_type, ' - ', p_brand, ' - x') end",
    "org_code": "concat('B', p_size)",
    "org_name": "case p_size % 7 when 0 then '' when 1 then '서울특별시' when 2 then '광주시 동구' else p_brand end",
    "dept_name": "case when p_size % 3 = 0 then '-' else concat(' ', p_type, ' ') end",
    "dept_phone_raw": "case when p_size % 6 = 0 then concat('`', chr(39), '02-', p_size) else concat('02-', p_size) end",
    "retention_basis": "'-'",
    "collection_method": "case when p_size % 9 = 0 then 'null' else 'hand' end",
    "update_cycle_raw": "case p_size % 8 when 0 then '수시' when 1 then '일간' when 2 then ' 주간' when 3 then '월간' when 4 then '분기' when 5 then '연간' when 6 then '-' else '격월' end",
    "next_registration_date": "case when p_size % 2 = 0 then '2027-01-01' else '-' end",
    "media_type": "'텍스트'",
    "row_count_raw": "case p_size % 5 when 0 then concat(p_partkey % 9 + 1, ',000') when 1 then '9999' when 2 then 'many' when 3 then '-5' else '-' end",
    "format_raw": "case p_size % 4 when 0 then 'csv+ XLSX' when 1 then 'json/xml,JSON' when 2 then '-' else 'CSV' end",
    "keywords_raw": "concat(p_brand, ', ', p_type, ',', p_brand, ', ,', p_name)",
    "download_count_raw": "concat(p_size)",
    "created_date": "case when p_size % 10 = 0 then '' else '2020-01-02' end",
    "modified_date": "case when p_size % 12 = 0 then '-' else concat('202', p_size % 6, '-0', p_size % 9 + 1, '-15') end",
    "data_limits": "case when p_size % 3 = 1 then 'partial' else '-' end",
    "provision_type": "'download'",
    "description": "case when p_size % 6 = 1 then '-' else concat(p_name, ' of \"', p_brand, '\"') end",
    "notes": "'-'",
    "spatial_raw": "case p_size % 6 when 0 then '부산 전역' when 1 then '광주' else '-' end",
    "temporal_raw": "case when p_size % 4 = 1 then '2020~2023' else '' end",
    "fee_raw": "case p_size % 3 when 0 then '무료' when 1 then '유료' else '-' end",
    "fee_basis": "case when p_size % 3 = 1 then '건당 10원' else '' end",
    "license_raw": "case p_size % 4 when 0 then '공공저작물_출처표시' when 1 then '이용허락범위 제한 없음' when 2 then '-' else 'own' end",
    "api_type_raw": "case when p_partkey % 3 = 1 then 'rest' else '-' end",
    "traffic": "case p_partkey % 9 when 1 then ' 1000 ' when 4 then 'on request' else '' end",
    "review_type": "'-'",
    "view_count_raw": "case when p_size % 13 = 0 then '99999999' else concat(p_size * 3) end",
    "list_url": "case when p_size % 14 = 0 then 'ftp.example' when p_size % 15 = 0 then '' else concat('https://x.example/', p_partkey) end",
    "national_core_raw": "case when p_size % 2 = 0 then 'Y' else 'N' end",
    "standard_raw": "' Y '",
}


def _raw(spark, d):
    return table(spark, d, "part").selectExpr(*[f"{RAW[n]} as `{h}`" for h, n in V.SNAPSHOT_COLUMNS.items()], "p_partkey + 1 as row_no")


def _listings(spark, d):
    return catalog_completeness(identify(normalize(_raw(spark, d)), "list_key", "list_type"))


# ---- the same in SQL


def _t(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _e(x: str) -> str:
    return f"CASE WHEN {_t(x)} NOT IN ('', '-', 'null', '없음') THEN {_t(x)} END"


def _b(x: str) -> str:
    return f"nullif({_t(x)}, '')"


def _int(x: str) -> str:
    return f"TRY_CAST(replace({_e(x)}, ',', '') AS BIGINT)"


def _list(x: str, pattern: str, upper: bool = False) -> str:
    parts = f"list_filter(list_transform(regexp_split_to_array(coalesce({_e(x)}, ''), '{pattern}'), lambda w: {'upper' if upper else ''}({_t('w')})), lambda w: w <> '')"
    return f"list_reduce(list_prepend([]::VARCHAR[], list_transform({parts}, lambda w: [w])), lambda a, w: CASE WHEN list_contains(a, w[1]) THEN a ELSE list_concat(a, w) END)"


def _code(x: str, codes: dict) -> str:
    return f"CASE {_t(x)} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in codes.items()) + " ELSE 'OTHER' END"


_STATED = ["file_data_name", "dept_name", "retention_basis", "collection_method", "next_registration_date", "media_type", "created_date", "modified_date", "data_limits", "provision_type", "description", "notes", "spatial_raw", "temporal_raw", "fee_basis", "traffic", "review_type"]
_NORM = {
    "list_key": _t("list_key"),
    "list_type": f"upper({_t('list_type')})",
    "title": _t("title"),
    "theme_raw": _b("theme_raw"),
    "theme_top": _b(f"split_part({_t('theme_raw')}, ' - ', 1)"),
    "theme_sub": f"CASE WHEN contains({_t('theme_raw')}, ' - ') THEN {_t('theme_raw')}[strpos(" + _t("theme_raw") + ", ' - ') + 3:] END",
    "org_code": _b("org_code"),
    "org_name": _b("org_name"),
    "dept_phone": "nullif(regexp_replace(dept_phone_raw, '^[`'']+', ''), '')",
    "update_cycle_raw": _b("update_cycle_raw"),
    "update_cycle": _code("update_cycle_raw", V.CYCLES),
    "row_count": _int("row_count_raw"),
    "formats": _list("format_raw", "[+,/]", True),
    "keywords": _list("keywords_raw", ","),
    "download_count": _int("download_count_raw"),
    "view_count": _int("view_count_raw"),
    "fee": _code("fee_raw", V.FEES),
    "license_raw": _b("license_raw"),
    "license_code": _code("license_raw", V.LICENSES),
    "api_type": f"upper({_e('api_type_raw')})",
    "list_url": _b("list_url"),
    "is_national_core": f"{_t('national_core_raw')} = 'Y'",
    "is_standard": f"{_t('standard_raw')} = 'Y'",
    **{c: _e(c) for c in _STATED},
    "dept_phone_raw": "dept_phone_raw",
    "row_count_raw": "row_count_raw",
    "source_row_no": "CAST(row_no AS BIGINT)",
}
_CHECKS = {
    **{k: f"{k} IS NOT NULL" for k in ("org_name", "description", "created_date", "modified_date", "list_url", "data_limits", "row_count", "file_data_name", "api_type", "traffic")},
    "title": "title <> ''", "theme": "theme_raw IS NOT NULL", "spatial": "spatial_raw IS NOT NULL", "temporal": "temporal_raw IS NOT NULL",
    "update_cycle": "update_cycle <> 'UNSPECIFIED'", "license": "license_code <> 'UNSPECIFIED'", "keywords": "len(keywords) > 0", "format": "len(formats) > 0",
}


def _filled() -> str:
    of = " ".join(f"WHEN '{p}' THEN " + " + ".join(f"({_CHECKS[f]})::INT" for f in fields) for p, fields in V.COMPLETENESS.items())
    return f"CASE list_type {of} END"


_CATALOG = f"""
WITH raw AS (SELECT {', '.join(f'{e} AS {n}' for n, e in RAW.items())}, p_partkey + 1 AS row_no, p_size FROM part),
plain AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _NORM.items())},
  list_filter([CASE p_size % 6 WHEN 0 THEN 'KR-26|EXPLICIT_SPATIAL|0.95' WHEN 1 THEN 'KR-29|EXPLICIT_SPATIAL|0.65' END,
               CASE p_size % 7 WHEN 1 THEN 'KR-11|INFERRED_FROM_PUBLISHER|0.6' WHEN 2 THEN CASE WHEN p_size % 6 <> 1 THEN 'KR-29|INFERRED_FROM_PUBLISHER|0.3' END END], lambda x: x IS NOT NULL) AS regions FROM raw),
named AS (SELECT *, count(*) OVER (PARTITION BY list_key) AS copies FROM plain),
rated AS (SELECT *, CASE WHEN copies = 1 THEN list_key ELSE list_key || '-' || list_type END AS record_id, list_type AS profile, CAST({_filled()} AS BIGINT) AS filled,
          CAST(CASE list_type {' '.join(f"WHEN '{p}' THEN {len(f)}" for p, f in V.COMPLETENESS.items())} END AS BIGINT) AS total FROM named),
c AS (SELECT *, round(filled / total, 4) AS score FROM rated)
"""


@query(_CATALOG + """
SELECT record_id, list_key, list_type, title, theme_raw, theme_top, theme_sub, org_code, org_name, dept_phone, update_cycle, CAST(row_count AS VARCHAR) AS row_count, array_to_string(formats, '|') AS formats, array_to_string(keywords, '|') AS keywords,
       download_count, view_count, fee, license_code, api_type, list_url, is_national_core, is_standard, file_data_name, dept_name, collection_method, modified_date, temporal_raw, array_to_string(regions, ';') AS regions, source_row_no, copies FROM c""")
def catalog_normalized(spark, d):
    regions = F.array_join(F.transform("regions", lambda r: F.concat_ws("|", r["code"], r["evidence"], r["confidence"].cast("string"))), ";")
    return _listings(spark, d).select(
        "record_id", "list_key", "list_type", "title", "theme_raw", "theme_top", "theme_sub", "org_code", "org_name", "dept_phone", "update_cycle", F.col("row_count").cast("string").alias("row_count"), F.array_join("formats", "|").alias("formats"), F.array_join("keywords", "|").alias("keywords"),
        "download_count", "view_count", "fee", "license_code", "api_type", "list_url", "is_national_core", "is_standard", "file_data_name", "dept_name", "collection_method", "modified_date", "temporal_raw", regions.alias("regions"), "source_row_no", "copies",
    )


@query(_CATALOG.split("named AS")[0].rstrip().rstrip(",") + f" SELECT CAST(row_no AS BIGINT) AS source_row_no, {', '.join(f'{n} AS {n}' for n in RAW)} FROM raw")
def catalog_source_view(spark, d):
    """The source rows as they were, from what the normalized listings keep of them."""
    seen = views.source_view(normalize(_raw(spark, d)).withColumn("record_id", F.col("source_row_no")))
    return seen.select(F.col("record_id").alias("source_row_no"), *[F.col(f"`{h}`").alias(n) for h, n in V.SNAPSHOT_COLUMNS.items()])


def _checklist() -> str:
    of = " ".join(f"WHEN '{p}' THEN array_to_string([" + ", ".join(f"'{f}=' || ({_CHECKS[f]})" for f in sorted(fields)) + "], ',')" for p, fields in V.COMPLETENESS.items())
    return f"CASE list_type {of} END"


_FRESH = "CASE update_cycle " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.FRESH_DAYS.items()) + " END"


@query(_CATALOG + f"""
SELECT record_id, theme_top, array_to_string(list_transform(regions, lambda r: split_part(r, '|', 1)), ',') AS regions, profile, filled, total, CAST(round(score, 4) AS DECIMAL(6, 4)) AS score, {_checklist()} AS checklist,
       CASE WHEN {_FRESH} IS NULL OR TRY_CAST(modified_date AS DATE) IS NULL THEN 'UNKNOWN' WHEN date_diff('day', CAST(modified_date AS DATE), DATE '2024-08-01') <= {_FRESH} THEN 'FRESH' ELSE 'POSSIBLY_STALE' END AS freshness,
       license_code, fee, data_limits, dept_phone, spatial_raw IS NOT NULL AS has_spatial, temporal_raw IS NOT NULL AS has_temporal, data_limits IS NOT NULL AS has_limits FROM c""")
def catalog_cards(spark, d):
    cards = views.card(_listings(spark, d), F.lit("2024-08-01").cast("date"))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("checklist")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    rated = [F.col(f"completeness.{n}").alias(n) for n in ("profile", "filled", "total")]
    return cards.select("record_id", "theme_top", F.array_join("regions", ",").alias("regions"), *rated, F.col("completeness.score").cast("decimal(6,4)").alias("score"), listed.alias("checklist"), "freshness", "license_code", "fee", "data_limits", "dept_phone", "has_spatial", "has_temporal", "has_limits")


_ISSUES = """, i AS (
  SELECT record_id, 'LEADING_QUOTE_ARTIFACT' AS issue_type, '관리부서 전화번호' AS field, dept_phone_raw AS source_value, 0.95 AS confidence FROM c WHERE dept_phone_raw LIKE '`%'
  UNION ALL SELECT record_id, 'INVALID_URL_FORMAT', '목록 URL', list_url, 0.9 FROM c WHERE NOT regexp_matches(list_url, '^https?://')
  UNION ALL SELECT record_id, 'NEGATIVE_OR_NONNUMERIC_COUNT', '전체행', row_count_raw, CASE WHEN row_count IS NULL THEN 0.8 ELSE 0.9 END FROM c WHERE (row_count IS NULL AND row_count_raw <> '-') OR row_count < 0
  UNION ALL SELECT record_id, 'DUPLICATE_LIST_KEY', 'list_key', list_key, 1.0 FROM c WHERE copies > 1)
"""


def _issues(listings):
    return catalog_issues(listings).unionByName(duplicate_issues(listings, "list_key"))


@query(_CATALOG + _ISSUES + "SELECT record_id, issue_type, field, source_value, CAST(confidence AS DOUBLE) AS confidence FROM i")
def catalog_issue_rows(spark, d):
    return _issues(_listings(spark, d))


_CASES = [
    ("theme_top", "theme_top = 'MEDIUM' OR theme_raw = 'MEDIUM'", {"theme": "MEDIUM"}),
    ("org", "contains(lower(org_name), 'brand#1')", {"org": "BRAND#1"}),
    ("org_percent", "contains(org_name, '%')", {"org": "%"}),
    ("format", "list_contains(formats, 'XLSX')", {"fmt": "xlsx"}),
    ("codes", "update_cycle = 'DAILY' AND license_code = 'NO_RESTRICTION'", {"cycle": "daily", "licence": "no_restriction"}),
    ("type_since", "list_type = 'API' AND modified_date >= '2023-01-01'", {"kind": "api", "since": "2023-01-01"}),
    ("region", "len(list_filter(regions, lambda r: starts_with(r, 'KR-29'))) > 0", {"region": "KR-29"}),
    ("region_explicit", "len(list_filter(regions, lambda r: starts_with(r, 'KR-29|EXPLICIT'))) > 0", {"region": "KR-29", "inferred": False}),
]


@query(_CATALOG + " UNION ALL ".join(f"SELECT '{n}' AS case_id, record_id FROM c WHERE {sql}" for n, sql, _ in _CASES))
def catalog_filters(spark, d):
    listings, out = _listings(spark, d), None
    for name, _, asked in _CASES:
        part = search.filtered(listings, **asked).select(F.lit(name).alias("case_id"), "record_id")
        out = part if out is None else out.unionByName(part)
    return out


_WEIGHTS = {"title": 4.0, "keyword_text": 3.0, "description": 1.0, "org_name": 2.0}
_ASKED = "SELECT DISTINCT p_brand || ' ' || p_type || ' ' || p_name AS text, p_brand || p_type || p_name AS query_id FROM part WHERE p_size = 1"
def _weighed(where: str, asked: str) -> str:
    fields = [("title", 4), ("keyword_text", 3), ("description", 1), ("org_name", 2)]
    rows = f"SELECT record_id AS doc, title, array_to_string(keywords, ' ') AS keyword_text, description, org_name FROM c {where}"
    return f", f AS (SELECT record_id AS doc, modified_date FROM c {where}), {scored_sql(rows, fields, asked)}"


_WEIGHED = _weighed("WHERE list_type = 'FILE'", _ASKED) + """,
k AS (SELECT *, bool_or(hit = n_units) OVER (PARTITION BY query_id) AS exact FROM s),
m AS (SELECT query_id, CASE WHEN exact THEN 'AND' ELSE 'OR' END AS mode, doc, score FROM k WHERE hit = n_units OR NOT exact)
"""


def _search(spark, d):
    asked = table(spark, d, "part").where("p_size = 1").select(F.concat("p_brand", "p_type", "p_name").alias("query_id"), F.concat_ws(" ", "p_brand", "p_type", "p_name").alias("text")).distinct()
    files = search.filtered(_listings(spark, d), kind="FILE").withColumn("keyword_text", F.array_join("keywords", " "))
    return asked, files


@query(_CATALOG + _WEIGHED + "SELECT query_id, mode, rank, doc FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS INTEGER) AS rank FROM m) WHERE rank <= 10")
def catalog_search(spark, d):
    """Weighed fields behind a filter, best first."""
    asked, files = _search(spark, d)
    return bm25.bm25(asked, files, "record_id", _WEIGHTS).drop("score")


@query(_CATALOG + _WEIGHED + """SELECT query_id, rank, doc, modified_date FROM (SELECT query_id, doc, f.modified_date, CAST(row_number() OVER (PARTITION BY query_id ORDER BY f.modified_date DESC NULLS LAST, doc) AS INTEGER) AS rank FROM m JOIN f USING (doc)) WHERE rank <= 10""")
def catalog_search_by_date(spark, d):
    """The same matches, newest first."""
    asked, files = _search(spark, d)
    return bm25.newest(asked, files, "record_id", _WEIGHTS, "modified_date")


def _json(x: str) -> str:
    return f"to_json({x})"


def _members(items: list[tuple[str, str]]) -> str:
    """name, SQL of JSON text (null: left out)"""
    return "'{' || array_to_string(list_filter([" + ", ".join(f"'\"{k}\":' || {v}" for k, v in items) + "], lambda x: x IS NOT NULL), ',') || '}'"


def _maybe(cond: str, value: str) -> str:
    return f"CASE WHEN {cond} THEN {value} END"


def _kept(items: list[tuple[str, str]]) -> str:
    return _members([(k, f"CAST({_json(v)} AS VARCHAR)") for k, v in items])


_DOC = [
    ("@context", f"'\"{BASE}/context/catalog/1.0\"'"),
    ("@id", f"'\"{BASE}/dataset/' || list_key || '\"'"),
    ("@type", "CASE WHEN list_type = 'API' THEN '[\"dcat:Dataset\",\"dcat:DataService\"]' ELSE '\"dcat:Dataset\"' END"),
    ("identifier", _json("list_key")), ("dct:language", "'\"ko\"'"), ("title", _json("title")), ("description", _json("description")),
    ("keyword", _json("keywords")), ("theme", _json("theme_raw")), ("issued", _json("created_date")), ("modified", _json("modified_date")), ("landingPage", _json("list_url")),
    ("publisher", "'{\"@type\":\"foaf:Agent\",\"foaf:name\":' || coalesce(to_json(org_name), 'null') || ',\"kdp:orgCode\":' || to_json(org_code) || '}'"),
    ("accrualPeriodicity", "CASE WHEN update_cycle IN ('OTHER', 'UNSPECIFIED') THEN to_json(update_cycle_raw) ELSE '[' || to_json(update_cycle_raw) || ',{\"@id\":\"http://publications.europa.eu/resource/authority/frequency/' || CASE update_cycle WHEN 'SEMIANNUAL' THEN 'ANNUAL_2' WHEN 'IRREGULAR' THEN 'IRREG' ELSE update_cycle END || '\"}]' END"),
    ("license", _json("license_raw")), ("spatial", _json("spatial_raw")), ("temporal", _json("temporal_raw")), ("kdp:listType", _json("list_type")), ("kdp:listKey", _json("list_key")), ("kdp:recordId", _json("record_id")),
    ("kdp:evidenceLevel", "'\"CATALOG_METADATA_ONLY\"'"), ("kdp:qualityTier", "'null'"), ("kdp:diagnosticMaturity", "'null'"),
    ("kdp:catalogMetadataCompleteness", "'{\"kdp:score\":' || score || ',\"kdp:profile\":\"' || profile || '\",\"kdp:rule\":\"catalog-completeness-' || lower(profile) || '-v1.0\"}'"),
    ("kdp:sourceSnapshot", f"'\"{MONTH}\"'"), ("kdp:catalogRecord", f"'\"{BASE}/catalog/{MONTH}/record/' || record_id || '\"'"),
    ("dcatkr:numberOfRow", "row_count::VARCHAR"), ("dcatkr:numberOfView", "view_count::VARCHAR"), ("dcatkr:legalBasis", _json("retention_basis")), ("dcatkr:nextRegistrationDate", _json("next_registration_date")),
    ("dcatkr:derivedSystem", _json("collection_method")), ("dcatkr:mediaType", _json("media_type")), ("dcatkr:provisionType", _json("provision_type")), ("dcatkr:notes", _json("notes")), ("dcatkr:reviewType", _json("review_type")),
    ("dcatkr:isNationalCore", "is_national_core::VARCHAR"), ("dcatkr:isStandardData", "is_standard::VARCHAR"),
    ("dcatkr:maintainer", "'{\"@type\":\"foaf:Agent\",\"foaf:name\":' || to_json(dept_name) || '}'"),
    ("dcatkr:fee", "CASE fee WHEN 'PAID' THEN 'true' WHEN 'FREE' THEN 'false' END"), ("kdp:feeCode", _json("fee")), ("schema:offer", "'{\"@type\":\"schema:Offer\",\"schema:description\":' || to_json(fee_basis) || '}'"),
    ("dqv:hasQualityAnnotation", "'{\"@type\":\"dqv:QualityAnnotation\",\"oa:bodyValue\":' || to_json(data_limits) || ',\"kdp:assertedBy\":\"provider\"}'"),
    ("dcat:distribution", _maybe("list_type = 'FILE' AND (file_data_name IS NOT NULL OR len(formats) > 0)", _members([("@type", "'\"dcat:Distribution\"'"), ("dct:title", _json("file_data_name")), ("dct:format", _maybe("len(formats) > 0", _json("formats"))), ("dcatkr:numberOfDownload", "download_count::VARCHAR"), ("dcat:accessURL", "'{\"@id\":' || to_json(list_url) || '}'")]))),
    ("dcatkr:numberOfRequest", _maybe("list_type = 'API'", "download_count::VARCHAR")), ("dcatkr:apiType", _maybe("list_type = 'API'", _json("api_type"))),
    ("dcatkr:numberOfRequestLimit", _maybe("list_type = 'API'", "TRY_CAST(traffic AS BIGINT)::VARCHAR")), ("dcatkr:requestLimitNote", _maybe("list_type = 'API' AND TRY_CAST(traffic AS BIGINT) IS NULL", _json("traffic"))),
]


@query(_CATALOG + f"SELECT record_id, {_members(_DOC)} AS document FROM c")
def catalog_documents(spark, d):
    return _listings(spark, d).select("record_id", export.dataset_document(BASE, MONTH).alias("document"))


@query(_CATALOG + f"""SELECT record_id, '{{"@context":"{BASE}/context/catalog/1.0","@id":"{BASE}/catalog/{MONTH}/record/' || record_id || '","@type":"dcat:CatalogRecord","foaf:primaryTopic":{{"@id":"{BASE}/dataset/' || list_key || '"}},"modified":' || coalesce(to_json(modified_date), 'null')
  || ',"kdp:listType":"' || list_type || '","kdp:sourceSnapshot":"{MONTH}","kdp:sourceRowNo":' || source_row_no || '}}' AS document FROM c""")
def catalog_record_documents(spark, d):
    return _listings(spark, d).select("record_id", export.record_document(BASE, MONTH).alias("document"))


@query(_CATALOG + _ISSUES + f""", z AS (SELECT *, sha256(record_id || '|' || issue_type || '|' || field || '|' || coalesce(source_value, ''))[1:16] AS issue_id FROM i)
SELECT issue_id, '{{"@id":"{BASE}/catalog/{MONTH}/annotation/' || issue_id || '","@type":"dqv:QualityAnnotation","oa:hasTarget":{{"kdp:field":"' || field || '","@id":"{BASE}/dataset/' || c.list_key || '"}},"oa:hasBody":{{"kdp:issueType":"' || issue_type || '","kdp:sourceValue":' || to_json(source_value)
  || ',"kdp:confidence":' || confidence::DOUBLE || '}},"oa:motivatedBy":"dqv:qualityAssessment","prov:wasGeneratedBy":{{"@type":"prov:Activity","kdp:detectionRule":"issue-detect-v1.0","prov:endedAtTime":"2026-06-01T00:00:00Z"}},"kdp:reviewStatus":"UNREVIEWED","kdp:resolutionStatus":"OPEN","kdp:sourceSnapshot":"{MONTH}"}}' AS document FROM z JOIN c USING (record_id)""")
def catalog_issue_documents(spark, d):
    listings = _listings(spark, d)
    issues = export.numbered_issues(_issues(listings), "issue-detect-v1.0", "2026-06-01T00:00:00Z")
    return issues.join(listings.select("record_id", "list_key"), "record_id", "left").select("issue_id", export.issue_document(BASE, MONTH).alias("document"))


_PRESENT = {"identifierPresence": "list_key <> ''", "titlePresence": "title <> ''", "descriptionPresence": "description IS NOT NULL", "publisherPresence": "org_name IS NOT NULL", "licensePresence": "license_code <> 'UNSPECIFIED'", "keywordPresence": "len(keywords) > 0", "datePresence": "modified_date IS NOT NULL AND created_date IS NOT NULL", "urlFormatValidity": "coalesce(regexp_matches(list_url, '^https?://'), false)"}
_SHARES = ", ".join(f'round(avg(({v})::INT), 4) AS "{k}"' for k, v in _PRESENT.items())
_MEAN = "round((" + " + ".join(f'"{k}"' for k in _PRESENT) + ") / 8, 4)"


@query(_CATALOG + f", s AS (SELECT {_SHARES} FROM c) SELECT {', '.join(f'CAST("{k}" AS DECIMAL(6, 4)) AS "{k}"' for k in _PRESENT)}, CAST({_MEAN} AS DECIMAL(6, 4)) AS readiness FROM s")
def catalog_discoverability(spark, d):
    found = quality.discoverability(_listings(spark, d))
    return found.select(*[F.col(f"indicators.{k}").cast("decimal(6,4)").alias(k) for k in _PRESENT], F.col("readiness").cast("decimal(6,4)").alias("readiness"))


_INDEX = """, x AS (SELECT count(*) AS n, count(DISTINCT list_key) AS keys, count(row_count) + count(download_count) + count(view_count) AS v,
  count(*) FILTER (row_count IN (999999, 99999999, 9999, -1, -9)) + count(*) FILTER (download_count IN (999999, 99999999, 9999, -1, -9)) + count(*) FILTER (view_count IN (999999, 99999999, 9999, -1, -9)) AS dums FROM c),
y AS (SELECT n, round(1 - dums / v, 4) AS d5, round(keys / n, 4) AS d6, round(1 - {failures} / n, 4) AS d7 FROM x), w AS (SELECT *, round((d5 + d6 + 1 + d7) / 4, 4) AS idx FROM y)
"""


@query(_CATALOG + _INDEX.format(failures=7) + "SELECT n AS rows, CAST(round(d5, 6) AS DECIMAL(8, 6)) AS d5_03, CAST(round(d6, 6) AS DECIMAL(8, 6)) AS d6_01, CAST(d7 AS DECIMAL(8, 6)) AS d7_02, CAST(round(idx, 6) AS DECIMAL(8, 6)) AS quality_index, CASE WHEN idx >= 0.7 THEN 'DM-0' ELSE 'BELOW' END AS level FROM w")
def catalog_quality_index(spark, d):
    """The indices of a month in which seven records couldn't be parsed."""
    r = quality.quality_indices(_listings(spark, d), "list_key", ["row_count", "download_count", "view_count"], parse_failures=7)
    six = lambda c, n: F.round(c, 6).cast("decimal(8,6)").alias(n)
    return r.select("rows", six("d5_03", "d5_03"), six("d6_01", "d6_01"), six("d7_02", "d7_02"), six("index", "quality_index"), "level")


@query(_CATALOG + _INDEX.format(failures=0) + f""", s AS (SELECT {_SHARES} FROM c)
SELECT '{{"@context":"{BASE}/context/catalog/1.0","@id":"{BASE}/catalog/{MONTH}","@type":"dcat:Catalog","dct:language":"ko","issued":"2026-06-01","kdp:processedAt":"2026-06-01T00:00:00Z","kdp:datasetCount":' || n || ',"kdp:evidenceLevel":"CATALOG_METADATA_ONLY","kdp:airdAssessment":{{"@id":"{BASE}/catalog/{MONTH}/assessment"}}'
  || CASE WHEN idx >= 0.7 THEN ',"aird:diagnosticMaturity":"DM-0","aird:dataType":"STRUCT","kdp:airdState":"Discoverable"' ELSE '' END || '}}' AS document FROM w, s""")
def catalog_whole_document(spark, d):
    """The catalog's document; shares and the index are compared by catalog_discoverability and catalog_quality_index, so they are left out here."""
    listings = _listings(spark, d)
    found = quality.discoverability(listings)
    totals = quality.quality_indices(listings, "list_key", ["row_count", "download_count", "view_count"]).join(found, F.lit(True))
    totals = totals.select(F.col("rows").alias("n_datasets"), "level", F.col("index").alias("quality_index"), F.col("readiness").alias("discoverability"), "indicators")
    doc = export.catalog_document(totals, BASE, MONTH, "2026-06-01T00:00:00Z")
    return doc.select(F.regexp_replace(F.regexp_replace("document", r',"kdp:catalogDiscoverability":\{.*?\}"\}', ""), r',"aird:qualityIndexMMI":[0-9.]+', "").alias("document"))


@query(_CATALOG + """
SELECT record_id, 'title' AS field, 'minLength' AS constraint, 'Violation' AS severity FROM c WHERE title = '' UNION ALL SELECT record_id, 'description', 'minCount', 'Warning' FROM c WHERE description IS NULL
UNION ALL SELECT record_id, 'keyword', 'minCount', 'Warning' FROM c WHERE len(keywords) = 0""")
def catalog_shape_findings(spark, d):
    """The dataset shapes over all listings, and the two catalog shapes, which hold."""
    listings = _listings(spark, d)
    whole = catalog_findings(listings.agg(F.count("*").alias("n_datasets")), "catalog")
    return quality.constraints(listings, "record_id", shapes()).unionByName(whole)


_FAMILY_CTE = _CATALOG.replace("WITH raw", "WITH RECURSIVE raw") + """
, r AS (SELECT record_id AS id, list_key, title, coalesce(org_name, '') AS org, list_transform(regions, lambda x: split_part(x, '|', 1)) AS areas, CASE WHEN CAST(list_key AS BIGINT) % 2 = 0 THEN theme_top ELSE theme_raw END AS h FROM c WHERE list_type = 'FILE'),
wide AS (SELECT h FROM (SELECT h, CASE WHEN starts_with(h, 'S') THEN 3 ELSE 6 END AS n FROM r) GROUP BY h HAVING max(n) >= 4), hs AS (SELECT list_key, h FROM r JOIN wide USING (h)),
n AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(title, '[\\(\\[].*?[\\)\\]]', ' ', 'g'), '[0-9]+', ' ', 'g'), '[\\s_\\-·.,~년월일차회호기''"]+', '', 'g') AS t, list_filter(regexp_split_to_array(title, '[_\\s·\\-]+'), lambda x: x <> '') AS k FROM r),
pat AS (SELECT org, k[1] AS a, k[-1] AS b, len(k) AS n FROM n WHERE len(k) >= 3 AND length(k[-1]) >= 3 GROUP BY ALL HAVING count(*) >= 3 AND count(DISTINCT array_to_string(k[2:-2], '~')) >= greatest(3, floor(0.8 * count(*)))),
m AS (SELECT 'TITLE' AS s, org || '~' || t AS g, id FROM n WHERE length(t) >= 3 UNION SELECT 'STRUCTURE', org || '~' || hs.h, id FROM n JOIN hs USING (list_key)
      UNION SELECT 'PATTERN', n.org || '~' || a || '~' || b || '~' || pat.n, id FROM n JOIN pat ON n.org = pat.org AND k[1] = a AND k[-1] = b AND len(k) = pat.n),
e AS (SELECT DISTINCT s, id AS u, min(id) OVER (PARTITION BY s, g) AS v, count(*) OVER (PARTITION BY s, g) AS sz FROM m), e2 AS (SELECT s, u, v FROM e WHERE sz > 1), b2 AS (SELECT u, v FROM e2 UNION SELECT v, u FROM e2),
cc AS (SELECT u AS id, u AS root FROM b2 UNION SELECT b2.v, cc.root FROM cc JOIN b2 ON b2.u = cc.id WHERE cc.root < b2.v),
mem AS (SELECT f.id, f.root, r.list_key, r.title, r.areas FROM (SELECT id, min(root) AS root FROM cc GROUP BY id) f JOIN r USING (id)), big AS (SELECT root FROM mem GROUP BY root HAVING count(*) > 1),
mem2 AS (SELECT * FROM mem JOIN big USING (root)),
ev AS (SELECT root, h, count(DISTINCT id) AS m FROM mem2 JOIN (SELECT DISTINCT * FROM hs) USING (list_key) GROUP BY ALL), hv AS (SELECT root, count(DISTINCT id) AS having_ FROM mem2 JOIN hs USING (list_key) GROUP BY root),
agg AS (SELECT root, count(*) AS n_members, 'fam-' || sha256(string_agg(id, '|' ORDER BY id))[1:12] AS family_id, avg(regexp_matches(title, '(19|20)\\d{2}')::INT) AS y, avg(regexp_matches(title, '[0-9]')::INT) AS dg,
        count(CASE WHEN len(areas) > 0 THEN 1 END) AS na, count(DISTINCT CASE WHEN len(areas) > 0 THEN array_to_string(list_sort(areas), '~') END) AS da FROM mem2 GROUP BY root),
fin AS (SELECT agg.*, (SELECT string_agg(DISTINCT s, ',' ORDER BY s) FROM e2 JOIN mem2 ON e2.u = mem2.id WHERE mem2.root = agg.root) AS signals,
        CASE WHEN y >= 0.7 THEN 'TIME_LIKE' WHEN na >= 0.7 * n_members AND da >= 0.7 * na THEN 'REGION_LIKE' WHEN dg >= 0.7 THEN 'NUMBERED' ELSE 'NAME_PARTITION' END AS relation,
        CASE WHEN coalesce(having_, 0) >= 2 AND (SELECT max(m) FROM ev WHERE ev.root = agg.root) = having_ THEN 'PLUS_STRUCTURE' ELSE 'CATALOG_ONLY' END AS evidence FROM agg LEFT JOIN hv USING (root))
"""


def _families(spark, d, reviews=None):
    files = _listings(spark, d).where("list_type = 'FILE'").withColumn("h", F.when(F.col("list_key").cast("bigint") % 2 == 0, F.col("theme_top")).otherwise(F.col("theme_raw")))
    records = files.select("record_id", "list_key", "title", F.col("org_name").alias("org"), F.transform("regions", lambda r: r["code"]).alias("regions"))
    structures = files.select("list_key", F.col("h").alias("structure_hash"), F.when(F.startswith("h", F.lit("S")), 3).otherwise(6).alias("column_count"))
    return fam.detect_families(records, structures, reviews)


@query(_FAMILY_CTE + "SELECT family_id, n_members, signals, relation, evidence, 'UNREVIEWED' AS review FROM fin")
def catalog_families(spark, d):
    f, _ = _families(spark, d)
    return f.select("family_id", "n_members", F.array_join("signals", ",").alias("signals"), "relation", "evidence", "review")


@query(_FAMILY_CTE + """SELECT true AS available, count(*) AS families, CAST(sum(n_members) AS BIGINT) AS member_records, (SELECT count(*) FROM c WHERE list_type = 'FILE') AS files_total,
  count(*) FILTER (evidence = 'PLUS_STRUCTURE') AS plus_structure, count(*) FILTER (evidence = 'CATALOG_ONLY') AS catalog_only, count(*) AS unreviewed FROM fin""")
def catalog_family_totals(spark, d):
    f, _ = _families(spark, d)
    files = table(spark, d, "part").where("p_partkey % 3 = 0").count()
    of = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0)).alias(k.lower())
    return fam.family_totals(f, F.lit(files).cast("bigint")).select("available", "families", "member_records", "files_total", of("by_evidence", "PLUS_STRUCTURE"), of("by_evidence", "CATALOG_ONLY"), of("by_review", "UNREVIEWED"))


@query(_FAMILY_CTE + """, o AS (SELECT root, id, title, row_number() OVER (PARTITION BY root ORDER BY id) AS k FROM mem2)
SELECT a.id AS record_id, family_id, (SELECT string_agg(o.id, ',' ORDER BY o.k) FROM o WHERE o.root = a.root AND o.k <= 10) AS members, n_members > 10 AS truncated FROM mem2 a JOIN fin USING (root) WHERE TRY_CAST(a.list_key AS BIGINT) % 5 = 0""")
def catalog_family_candidates(spark, d):
    f, m = _families(spark, d)
    asked = m.where("cast(list_key as bigint) % 5 = 0").select("record_id")
    out = views.family_candidates(asked, f, m, _listings(spark, d))
    return out.select("record_id", "family_id", F.array_join("members.record_id", ",").alias("members"), "truncated")


@query(_CATALOG + """, p AS (SELECT * FROM c WHERE CAST(list_key AS BIGINT) % 7 <> 0 AND copies = 1), q AS (SELECT record_id, list_key, CASE WHEN CAST(list_key AS BIGINT) % 5 = 0 THEN title || '!' ELSE title END AS title, org_name FROM c WHERE CAST(list_key AS BIGINT) % 4 <> 0 AND copies = 1),
z AS (SELECT coalesce(q.record_id, p.record_id) AS record_id, CASE WHEN p.record_id IS NULL THEN 'ADDED' WHEN q.record_id IS NULL THEN 'MISSING_FROM_SNAPSHOT' ELSE 'MODIFIED' END AS status, coalesce(q.list_key, p.list_key) AS list_key, coalesce(q.title, p.title) AS title, CASE WHEN q.record_id IS NULL THEN p.org_name ELSE q.org_name END AS org_name
      FROM p FULL JOIN q ON p.record_id = q.record_id WHERE p.record_id IS NULL OR q.record_id IS NULL OR p.title <> q.title)
SELECT row_no, record_id, status, list_key, title, org_name, '2026-05' AS base_snapshot, true AS has_more FROM (SELECT *, row_number() OVER (ORDER BY status, record_id) AS row_no FROM z) WHERE row_no BETWEEN 21 AND 60""")
def catalog_change_page(spark, d):
    """The second page of the feed as users read it, by status and id."""
    c, k = _listings(spark, d).where("copies = 1"), F.col("list_key").cast("bigint")
    prev, cur = c.where(k % 7 != 0), c.where(k % 4 != 0).withColumn("title", F.when(k % 5 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")))
    feed = diff.described(diff.snapshot_diff(prev, cur, "record_id", ["title", "org_name"]), prev, cur, "2026-05")
    shown = page(feed, [F.col("status"), F.col("record_id")], 20, 40)
    return shown.select("row_no", "record_id", "status", "list_key", "title", "org_name", "base_snapshot", "has_more")


_FACT_NAMES = "SELECT list_key, unnest([theme_top, fee, update_cycle]) AS column_name FROM c"
_FACT_WORDS = "SELECT * FROM (VALUES ('1', 0, 'free'), ('1', 1, 'LY'), ('2', 2, 'dai')) t(query_id, place, keyword)"


@query(_CATALOG + f""", {found_sql(_FACT_NAMES, _FACT_WORDS)}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY list_key) AS INTEGER) AS place FROM f)
SELECT query_id, place, list_key, record_id, matched FROM r JOIN (SELECT list_key, min(record_id) AS record_id FROM c WHERE list_type = 'FILE' GROUP BY 1) USING (list_key) WHERE place <= 100""")
def catalog_column_search(spark, d):
    """Keyword search over column names, answered with one file listing a key."""
    listings = written(_listings(spark, d), "listings")
    index = listings.select("list_key", F.explode(F.array("theme_top", "fee", "update_cycle")).alias("column_name")).where("column_name is not null")
    asked = spark.createDataFrame([("1", "free"), ("1", "LY"), ("2", "dai")], "query_id string, keyword string").coalesce(1)
    page = columns.column_page(columns.column_search(asked, index), listings, 100)
    said = F.array_join(F.transform("matched", lambda x: F.concat(x["keyword"], F.lit("="), F.array_join(x["columns"], ","))), ";")
    return page.withColumn("matched", said)


_FACTS = " UNION ALL ".join(f"SELECT g AS group_id, '{n}' AS field, count(DISTINCT coalesce(CAST({c} AS VARCHAR), '~')) AS n_values FROM m GROUP BY g" for n, c in FACTS.items())


@query(_CATALOG + f", m AS (SELECT CAST(floor(CAST(list_key AS BIGINT) / 4) AS BIGINT) AS g, * FROM c) SELECT *, n_values = 1 AS shared FROM ({_FACTS})")
def catalog_compare(spark, d):
    """Fifteen facts of groups of up to four neighbouring keys."""
    members = _listings(spark, d).withColumn("group_id", F.floor(F.col("list_key").cast("bigint") / 4))
    return compare_listings(members)


def _purposes(spark, d):
    """A plan for each brand and type: a third names its region, a third has it as an argument; promotions ask for a region that isn't."""
    b = table(spark, d, "part").select("p_brand", "p_type").distinct().withColumn("n", F.substring("p_brand", 7, 1).cast("int") % 3)
    return b.select(
        F.concat("p_brand", "p_type").alias("plan_id"),
        F.concat(F.when(F.col("n") == 1, "서울 ").otherwise(""), "p_brand", F.lit(" "), "p_type").alias("purpose"),
        F.when(F.col("p_type") == "PROMO", "nowhere").when(F.col("n") == 0, "KR-26").alias("region"),
    )


_PLANS = _CATALOG + _weighed("", "SELECT DISTINCT p_brand || p_type AS query_id, replace(p_brand, '#', '') || ' ' || p_type AS text FROM part WHERE p_type <> 'PROMO'") + """,
pl AS (SELECT DISTINCT p_brand || p_type AS plan_id, CASE WHEN p_type = 'PROMO' THEN 'unknown region: nowhere' END AS error, CASE WHEN p_type <> 'PROMO' THEN CASE CAST(p_brand[7:7] AS INTEGER) % 3 WHEN 0 THEN 'KR-26' WHEN 1 THEN 'KR-11' END END AS region,
         CASE WHEN p_type <> 'PROMO' THEN CASE CAST(p_brand[7:7] AS INTEGER) % 3 WHEN 0 THEN 'PARAMETER' WHEN 1 THEN 'PURPOSE_TEXT' END END AS region_source FROM part),
sr AS (SELECT s.*, pl.region, c.list_type, c.spatial_raw, c.modified_date AS dated, pl.region IS NULL OR len(list_filter(c.regions, lambda r: starts_with(r, pl.region))) > 0 AS here FROM s JOIN pl ON pl.plan_id = s.query_id JOIN c ON c.record_id = s.doc),
ok AS (SELECT *, bool_or(here) OVER (PARTITION BY query_id) AS found FROM sr), ky AS (SELECT * FROM ok WHERE here OR NOT found), kx AS (SELECT *, bool_or(hit = n_units) OVER (PARTITION BY query_id) AS exact FROM ky),
tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM kx WHERE hit = n_units OR NOT exact) WHERE rank <= 5),
g AS (SELECT query_id, string_agg(doc, ',' ORDER BY rank) AS candidates, bool_or(NOT found) AS twice, bool_or(spatial_raw IS NOT NULL) AS sp, bool_or(dated IS NOT NULL) AS tm, bool_or(list_type = 'STD') AS ref,
             string_agg(CASE WHEN rank <= 2 THEN CASE WHEN list_type = 'STD' THEN 'PRIMARY+REFERENCE' ELSE 'PRIMARY' END WHEN list_type = 'STD' THEN 'REFERENCE' ELSE 'RELATED' END, ',' ORDER BY rank) AS roles FROM tp GROUP BY query_id)
"""


@query(_PLANS + """SELECT plan_id, error, region, region_source, CASE WHEN error IS NULL THEN CASE WHEN twice THEN '2' ELSE '1' END END AS searches, candidates, roles,
  CASE WHEN error IS NULL THEN 'PRIMARY=SATISFIED,' || CASE WHEN ref THEN 'REFERENCE=SATISFIED,' ELSE '' END || 'SPATIAL=' || CASE WHEN sp THEN 'PARTIAL' ELSE 'UNSATISFIED' END || ',TEMPORAL=' || CASE WHEN tm THEN 'PARTIAL' ELSE 'UNSATISFIED' END END AS needs FROM pl LEFT JOIN g ON query_id = plan_id""")
def catalog_plans(spark, d):
    """Draft plans for a batch of purposes."""
    listings = views.with_top_percent(_listings(spark, d))
    none = spark.createDataFrame([], "record_id string, columns array<string>")
    out = plan.build_plans(_purposes(spark, d), listings, none)
    joined = lambda c, f: F.when(F.col(c).isNotNull(), F.array_join(F.transform(c, f), ","))
    return out.select(
        "plan_id", "error", "region", "region_source", F.col("searches").cast("string").alias("searches"), joined("candidates", lambda x: x["record_id"]).alias("candidates"),
        joined("candidates", lambda x: F.array_join(x["roles"], "+")).alias("roles"), joined("needs", lambda n: F.concat_ws("=", n["role"], n["status"])).alias("needs"),
    )


_FACT_JSON = ", ".join(f"coalesce(CAST(to_json({c}) AS VARCHAR), 'null')" for c in FACTS.values())


@query(_CATALOG + f""", k AS (SELECT *, CAST(list_key AS BIGINT) AS key, CAST(floor(CAST(list_key AS BIGINT) / 4) AS BIGINT) AS g FROM c),
a AS (SELECT g, record_id FROM k WHERE g % 7 <> 3 OR key % 4 = 0 UNION ALL SELECT g, record_id FROM k WHERE g % 9 = 4 UNION ALL SELECT g, 'nobody' FROM k WHERE key % 40 = 0),
n AS (SELECT g, CASE WHEN count(*) < 2 THEN 'TOO_FEW' WHEN count(*) > 5 THEN 'TOO_MANY' WHEN bool_or(record_id = 'nobody') THEN 'NOT_FOUND' END AS error FROM a GROUP BY g),
mem AS (SELECT DISTINCT a.g, k.* EXCLUDE (g) FROM a JOIN n ON a.g = n.g AND error IS NULL JOIN k USING (record_id)),
fa AS (SELECT g, record_id, generate_subscripts([{_FACT_JSON}], 1) AS i, unnest({list(FACTS)}) AS field, unnest([{_FACT_JSON}]) AS v FROM mem),
pf AS (SELECT g, i, field, count(DISTINCT v) > 1 AS differs, string_agg(record_id || '=' || v, '&' ORDER BY record_id) AS vs, min(v) AS v FROM fa GROUP BY ALL),
pg AS (SELECT g, string_agg(field || ':' || vs, ';' ORDER BY i) FILTER (differs) AS differing, string_agg(field || '=' || v, ';' ORDER BY i) FILTER (NOT differs) AS same FROM pf GROUP BY g),
co AS (SELECT DISTINCT list_key, unnest([theme_top, fee, update_cycle]) AS name FROM c WHERE CAST(list_key AS BIGINT) % 13 <> 0),
ow AS (SELECT g, record_id, name FROM mem JOIN co USING (list_key) WHERE name IS NOT NULL),
sz AS (SELECT g, count(*) AS m, (SELECT count(DISTINCT record_id) FROM ow WHERE ow.g = mem.g) AS o FROM mem GROUP BY g),
cm AS (SELECT g, name FROM ow JOIN sz USING (g) GROUP BY g, name, m HAVING count(*) = m),
st AS (SELECT g, coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM cm WHERE cm.g = sz.g), '') AS common, coalesce((SELECT string_agg(record_id || ':' || name, ',' ORDER BY record_id, name) FROM ow WHERE ow.g = sz.g AND (ow.g, name) NOT IN (SELECT (g, name) FROM cm)), '') AS only_in,
       (SELECT string_agg(record_id || '=' || t, ',' ORDER BY record_id) FROM (SELECT g, record_id, count(*) AS t FROM ow GROUP BY ALL) w WHERE w.g = sz.g) AS counts FROM sz WHERE m = o)
SELECT n.g AS group_id, error, CASE WHEN error IS NULL THEN coalesce(differing, '') END AS differing, CASE WHEN error IS NULL THEN coalesce(same, '') END AS same, common, only_in, counts, CASE WHEN o > 0 AND o < m THEN 'STRUCTURE_OF_SOME_ONLY' END AS warning
FROM n LEFT JOIN pg USING (g) LEFT JOIN sz USING (g) LEFT JOIN st USING (g)""")
def catalog_comparisons(spark, d):
    """Comparisons asked for by groups of neighbouring keys: some ask for one record, some for too many, some for one that isn't there; every thirteenth key's columns weren't observed."""
    listings = written(_listings(spark, d), "listings")
    key = F.col("list_key").cast("bigint")
    k = listings.withColumns({"key": key, "group_id": F.floor(key / 4)})
    asked = k.where("group_id % 7 <> 3 or key % 4 = 0").select("group_id", "record_id")
    asked = asked.unionByName(k.where("group_id % 9 = 4").select("group_id", "record_id")).unionByName(k.where("key % 40 = 0").select("group_id", F.lit("nobody").alias("record_id")))
    columns = k.where("key % 13 <> 0").select("list_key", F.explode(F.array("theme_top", "fee", "update_cycle")).alias("column_name")).where("column_name is not null").distinct()
    out = compare_requests(asked, listings, columns)
    pairs = lambda m, mark: F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(mark), e["value"].cast("string")))
    own = F.flatten(F.transform(F.map_entries("structure.only_in"), lambda e: F.transform(e["value"], lambda c: F.concat(e["key"], F.lit(":"), c))))
    return out.select(
        "group_id", "error", F.array_join(F.transform("differences", lambda f: F.concat(f["field"], F.lit(":"), F.array_join(pairs(f["values"], "="), "&"))), ";").alias("differing"),
        F.array_join(F.transform("shared_fields", lambda f: F.concat(f["field"], F.lit("="), f["value"])), ";").alias("same"), F.array_join("structure.common", ",").alias("common"),
        F.array_join(own, ",").alias("only_in"), F.array_join(pairs("structure.counts", "="), ",").alias("counts"), "warning",
    )


_GOLDEN_ASKED = "SELECT DISTINCT p_brand || p_type AS query_id, replace(p_brand, '#', '') || ' ' || p_type AS text, '(?i)' || p_brand || '_(' || lower(p_type[1:4]) || '|none)' AS pattern, CASE CAST(p_brand[7:7] AS INTEGER) % 3 WHEN 0 THEN 'KR-26' WHEN 1 THEN 'KR-11' END AS region FROM part"
_GOLDEN = _CATALOG + _weighed("", f"SELECT query_id, text FROM ({_GOLDEN_ASKED})") + f""",
ga AS ({_GOLDEN_ASKED}), gl AS (SELECT query_id, record_id AS doc FROM ga JOIN c ON regexp_matches(title, pattern) AND (region IS NULL OR len(list_filter(regions, lambda r: starts_with(r, region || '|'))) > 0)),
gs AS (SELECT s.*, ga.region FROM s JOIN ga USING (query_id) JOIN c ON c.record_id = s.doc WHERE region IS NULL OR len(list_filter(regions, lambda r: starts_with(r, region || '|'))) > 0),
gk AS (SELECT *, bool_or(hit = n_units) OVER (PARTITION BY query_id) AS exact FROM gs),
gr AS (SELECT * FROM (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM gk WHERE hit = n_units OR NOT exact) WHERE rank <= 10),
gm AS (SELECT query_id, (SELECT count(*) FROM gl WHERE gl.query_id = ga.query_id) AS relevant, (SELECT count(*) FROM gr WHERE gr.query_id = ga.query_id) AS retrieved, (SELECT count(*) FROM gr JOIN gl USING (query_id, doc) WHERE query_id = ga.query_id) AS hits FROM ga)
"""


def _golden(spark, d):
    """A golden query for each brand and type, two thirds of them in a region."""
    b = table(spark, d, "part").select("p_brand", "p_type").distinct()
    n = F.substring("p_brand", 7, 1).cast("int") % 3
    asked = b.select(
        F.concat("p_brand", "p_type").alias("query_id"), F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(" "), "p_type").alias("text"),
        F.concat(F.lit("(?i)"), "p_brand", F.lit("_("), F.lower(F.substring("p_type", 1, 4)), F.lit("|none)")).alias("pattern"), F.when(n == 0, "KR-26").when(n == 1, "KR-11").alias("region"),
    )
    listings = written(_listings(spark, d).withColumns({"keyword_text": F.array_join("keywords", " "), "codes": F.transform("regions", lambda r: r["code"])}), "listings")
    relevant = evaluate.relevant_by_pattern(asked, listings, "record_id", "title", "codes")
    return asked, evaluate.rank_metrics(evaluate.ranked_in_region(asked, listings, _WEIGHTS), relevant)


@query(_GOLDEN + "SELECT query_id, relevant, retrieved, hits FROM gm WHERE relevant > 0 OR retrieved > 0")
def catalog_golden(spark, d):
    """Regular expressions over titles and regions against a search in the region."""
    return _golden(spark, d)[1].select("query_id", "relevant", "retrieved", "hits")


@query(_GOLDEN + """SELECT count(*) AS queries, count(*) FILTER (relevant > 0) AS judged, CAST(round(avg((hits > 0)::INT) FILTER (relevant > 0), 6) AS DECIMAL(12, 6)) AS success_rate, CAST(round(avg((retrieved = 0)::INT), 6) AS DECIMAL(12, 6)) AS zero_rate,
  CAST(round(avg(hits / 10) FILTER (relevant > 0), 6) AS DECIMAL(12, 6)) AS precision FROM gm""")
def catalog_golden_means(spark, d):
    asked, metrics = _golden(spark, d)
    return evaluate.mean_metrics(metrics, asked).select("queries", "judged", *[F.round(c, 6).cast("decimal(12,6)").alias(c) for c in ("success_rate", "zero_rate", "precision")])
