"""The monthly snapshot as a normalized catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from catalogspark.functions import vocabulary as V
from catalogspark.functions.text import blank_to_null, coded, empty_to_null, safe_int, split_first, tokens, ttrim
from catalogspark.operators.quality import completeness, detect_issues
from catalogspark.operators.regions import match_gazetteer


def normalize(raw: DataFrame) -> DataFrame:
    """Raw snapshot (header names, row_no) -> normalized listing; the source row is kept as JSON."""
    kept = F.to_json(F.struct(*[F.col(f"`{c}`") for c in raw.columns if c != "row_no"]), {"ignoreNullFields": "false"})
    s = raw.withColumn("source_json", kept).withColumnsRenamed(V.SNAPSHOT_COLUMNS)
    s = s.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in V.SNAPSHOT_COLUMNS.values()})
    c = F.col
    top, sub = split_first(ttrim(c("theme_raw")))
    sentinel = ["file_data_name", "dept_name", "retention_basis", "collection_method", "next_registration_date", "media_type", "created_date", "modified_date", "data_limits", "provision_type", "description", "notes", "spatial_raw", "temporal_raw", "fee_basis", "traffic", "review_type"]
    out = s.select(
        ttrim(c("list_key")).alias("list_key"),
        F.upper(ttrim(c("list_type"))).alias("list_type"),
        ttrim(c("title")).alias("title"),
        blank_to_null(c("theme_raw")).alias("theme_raw"),
        top.alias("theme_top"),
        sub.alias("theme_sub"),
        blank_to_null(c("org_code")).alias("org_code"),
        blank_to_null(c("org_name")).alias("org_name"),
        blank_to_null(F.regexp_replace(ttrim(c("dept_phone_raw")), "^[`']+", "")).alias("dept_phone"),
        blank_to_null(c("update_cycle_raw")).alias("update_cycle_raw"),
        coded(c("update_cycle_raw"), V.CYCLES).alias("update_cycle"),
        safe_int(c("row_count_raw")).alias("row_count"),
        blank_to_null(c("format_raw")).alias("format_raw"),
        tokens(c("format_raw"), "[+,/]", upper=True).alias("formats"),
        tokens(c("keywords_raw"), ",").alias("keywords"),
        safe_int(c("download_count_raw")).alias("download_count"),
        safe_int(c("view_count_raw")).alias("view_count"),
        coded(c("fee_raw"), V.FEES).alias("fee"),
        blank_to_null(c("license_raw")).alias("license_raw"),
        coded(c("license_raw"), V.LICENSES).alias("license_code"),
        F.upper(empty_to_null(c("api_type_raw"))).alias("api_type"),
        blank_to_null(c("list_url")).alias("list_url"),
        (ttrim(c("national_core_raw")) == "Y").alias("is_national_core"),
        (ttrim(c("standard_raw")) == "Y").alias("is_standard"),
        *[empty_to_null(c(x)).alias(x) for x in sentinel],
        c("dept_phone_raw"),
        c("row_count_raw"),
        c("download_count_raw"),
        c("view_count_raw"),
        c("row_no").alias("source_row_no"),
        "source_json",
    )
    evidence = {e: (F.col(x), V.EVIDENCE[e]) for e, x in zip(V.EVIDENCE, ("spatial_raw", "title", "org_name", "description"), strict=True)}
    return out.withColumn("regions", match_gazetteer(evidence))


def identify(df: DataFrame, key: str, kind: str, into: str = "record_id") -> DataFrame:
    """Add record id and copies: the key where it is unique, else key-kind."""
    n = F.count("*").over(W.partitionBy(key))
    return df.withColumn("copies", n).withColumn(into, F.when(F.col("copies") == 1, F.col(key).cast("string")).otherwise(F.concat_ws("-", F.col(key).cast("string"), F.col(kind))))


def duplicate_issues(df: DataFrame, key: str) -> DataFrame:
    return detect_issues(df, "record_id", [("DUPLICATE_LIST_KEY", key, F.col("copies") > 1, F.col(key), 1.0)])


def catalog_completeness(df: DataFrame) -> DataFrame:
    has = lambda x: F.col(x).isNotNull() & (F.col(x).cast("string") != "")
    checks = {k: has(k) for k in ("title", "org_name", "description", "created_date", "modified_date", "list_url", "data_limits", "row_count", "file_data_name", "api_type", "traffic")}
    checks |= {"theme": has("theme_raw"), "spatial": has("spatial_raw"), "temporal": has("temporal_raw"), "update_cycle": F.col("update_cycle") != "UNSPECIFIED", "license": F.col("license_code") != "UNSPECIFIED", "keywords": F.size("keywords") > 0, "format": F.size("formats") > 0}
    out = completeness(df, checks, F.col("list_type"), V.COMPLETENESS, "FILE")
    return out.withColumn("rule", F.concat(F.lit("catalog-completeness-"), F.lower("profile"), F.lit("-v1.0")))


def catalog_issues(df: DataFrame) -> DataFrame:
    """The four row rules on normalized listings."""
    rules = [
        ("LEADING_QUOTE_ARTIFACT", "관리부서 전화번호", F.col("dept_phone_raw").rlike(r"(?U)^\s*[`']"), F.col("dept_phone_raw"), 0.95),
        ("INVALID_URL_FORMAT", "목록 URL", F.col("list_url").isNotNull() & ~F.col("list_url").rlike("(?i)^https?://"), F.col("list_url"), 0.9),
    ]
    for field, name in (("전체행", "row_count"), ("다운로드_활용신청건수", "download_count"), ("조회수", "view_count")):
        raw = F.col(f"{name}_raw")
        rules.append(("NEGATIVE_OR_NONNUMERIC_COUNT", field, empty_to_null(raw).isNotNull() & F.col(name).isNull(), raw, 0.8))
        rules.append(("NEGATIVE_OR_NONNUMERIC_COUNT", field, F.col(name) < 0, raw, 0.9))
    return detect_issues(df, "record_id", rules)
