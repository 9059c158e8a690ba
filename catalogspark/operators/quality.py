"""Quality rules: completeness, freshness, issues, indices, constraints and acceptance, generic over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from catalogspark.functions import vocabulary as V


def completeness(df: DataFrame, checks: dict[str, Column], profile: Column, profiles: dict[str, list[str]], default: str) -> DataFrame:
    """Add profile, filled, total, score and fields (map of check -> filled) by the row's profile."""
    table = F.create_map(*[x for k, f in profiles.items() for x in (F.lit(k), F.array(*map(F.lit, f)))])
    known = F.when(profile.isin(*profiles), profile).otherwise(F.lit(default))
    every = F.create_map(*[x for k, c in checks.items() for x in (F.lit(k), F.coalesce(c, F.lit(False)))])
    df = df.withColumn("profile", known).withColumn("fields", F.map_filter(every, lambda k, v: F.array_contains(F.element_at(table, F.col("profile")), k)))
    filled = F.size(F.filter(F.map_values("fields"), lambda x: x))
    total = F.size("fields")
    return df.withColumns({"filled": filled.cast("bigint"), "total": total.cast("bigint"), "score": F.round(filled / total, 4)})


def distribution(df: DataFrame) -> DataFrame:
    """Per profile and score: n, total, mode of the profile (ties to the lower score) and higher: rows of a better score."""
    counts = df.groupBy("profile", "filled", "total").agg(F.count("*").alias("n"))
    by = W.partitionBy("profile")
    better = by.orderBy(F.desc("filled")).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumns(
        {
            "rows": F.sum("n").over(by),
            "mode_filled": F.max_by("filled", F.struct("n", -F.col("filled"))).over(by),
            "mode_n": F.max("n").over(by),
            "higher": F.coalesce(F.sum("n").over(better), F.lit(0)).cast("bigint"),
        }
    )


def histogram(df: DataFrame, bins: int = 10) -> DataFrame:
    """Rows by profile and bin of filled / total; the full score is in the last bin."""
    at = F.least(F.lit(bins - 1), F.floor(F.col("filled") * bins / F.col("total"))).cast("int")
    return df.groupBy("profile", at.alias("bin")).agg(F.count("*").alias("n"))


def freshness(cycle: Column, modified: Column, ref: Column, days: dict = V.FRESH_DAYS) -> Column:
    """FRESH, POSSIBLY_STALE or UNKNOWN; a date in the future is fresh."""
    limit = F.try_element_at(F.create_map(*[F.lit(x) for kv in days.items() for x in kv]), cycle)
    age = F.datediff(ref, modified)
    return F.when(limit.isNull() | age.isNull(), "UNKNOWN").when(age <= limit, "FRESH").otherwise("POSSIBLY_STALE")


def detect_issues(df: DataFrame, record: str, rules: list[tuple[str, str, Column, Column, float]]) -> DataFrame:
    """rules: (issue_type, field, condition, shown value, confidence) -> one row a finding."""
    found = F.array(*[F.when(cond, F.struct(F.lit(t).alias("issue_type"), F.lit(f).alias("field"), v.cast("string").alias("source_value"), F.lit(c).alias("confidence"))) for t, f, cond, v, c in rules])
    return df.select(F.col(record).cast("string").alias("record_id"), F.inline(F.array_compact(found)))


def collapse_systemic(issues: DataFrame, total: int, confidence: float = 0.99) -> DataFrame:
    """(type, field) found in more than half of all rows becomes one finding on the catalog."""
    often = issues.groupBy("issue_type", "field").agg(F.count("*").alias("n")).where(F.col("n") > total // 2)
    whole = often.select(F.lit("@catalog").alias("record_id"), "issue_type", "field", F.col("n").cast("string").alias("source_value"), F.lit(confidence).alias("confidence"))
    return issues.join(often, ["issue_type", "field"], "left_anti").select(*whole.columns).unionByName(whole)


def dummy_counts(df: DataFrame, columns: list[str], dummies=V.DUMMIES) -> DataFrame:
    """Per column: values and dummy values among them; one scan."""
    aggs = [x for c in columns for x in (F.count(c).alias(f"{c}_n"), F.count_if(F.col(c).isin(*dummies)).alias(f"{c}_d"))]
    rows = ", ".join(f"'{c}', {c}_n, {c}_d" for c in columns)
    return df.agg(*aggs).selectExpr(f"stack({len(columns)}, {rows}) as (field, n_values, n_dummies)")


def quality_indices(df: DataFrame, key: str, numeric: list[str], encoding_ok: bool = True, parse_failures: int = 0) -> DataFrame:
    """One row: D5-03, D6-01, D7-01, D7-02, each to four places, the mean of these, and the level; no rows is SCHEMA_ONLY."""
    dummies = sum(F.count_if(F.col(c).isin(*V.DUMMIES)) for c in numeric)
    values = sum(F.count(c) for c in numeric)
    r = df.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), values.alias("vals"), dummies.alias("dums"))
    four = lambda c: F.round(c, 4)
    r = r.withColumns(
        {
            "d5_03": F.when(F.col("vals") > 0, four(1 - F.col("dums") / F.col("vals"))).otherwise(F.lit(1.0)),
            "d6_01": four(F.try_divide("keys", "rows")),
            "d7_01": F.lit(1.0 if encoding_ok else 0.0),
            "d7_02": four(1 - F.try_divide(F.lit(parse_failures), "rows")) if parse_failures else F.lit(1.0),
        }
    )
    r = r.withColumn("index", four((F.col("d5_03") + F.col("d6_01") + F.col("d7_01") + F.col("d7_02")) / 4))
    return r.withColumn("level", F.when(F.col("rows") == 0, "SCHEMA_ONLY").when(F.col("index") >= 0.7, "DM-0").otherwise("BELOW"))


def constraints(df: DataFrame, record: str, shapes: list[tuple[str, str, str, Column]]) -> DataFrame:
    """shapes: (field, constraint, severity, what must hold; null counts as broken) -> findings over all rows."""
    found = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(f).alias("field"), F.lit(k).alias("constraint"), F.lit(s).alias("severity"))) for f, k, s, ok in shapes])
    return df.select(F.col(record).cast("string").alias("record_id"), F.inline(F.array_compact(found)))


def acceptance(df: DataFrame, key: str, url: Column, source_rows: int, source_urls: int, rule: Column | None = None) -> DataFrame:
    """check, passed: row count kept, no duplicate ids, addresses kept, every row has its rule."""
    r = df.agg(F.count("*").alias("n"), F.count_distinct(key).alias("k"), F.count_if(url.isNotNull()).alias("u"), F.count_if(rule.isNull() if rule is not None else F.lit(False)).alias("r"))
    return r.selectExpr("stack(4, 'ROW_COUNT', n = %d, 'NO_DUPLICATE_ID', n = k, 'URL_COUNT', u = %d, 'RULE_PRESENT', r = 0) as (check_name, passed)" % (source_rows, source_urls))


def discoverability(df: DataFrame) -> DataFrame:
    """One row: indicators (struct of eight shares, to four places), readiness (their mean); no rows is an error."""
    c, url = F.col, F.coalesce(F.col("list_url").rlike("(?i)^https?://"), F.lit(False))
    presence = {
        "identifierPresence": F.coalesce(c("list_key"), F.lit("")) != "",
        "titlePresence": F.coalesce(c("title"), F.lit("")) != "",
        "descriptionPresence": c("description").isNotNull(),
        "publisherPresence": c("org_name").isNotNull(),
        "licensePresence": c("license_code") != "UNSPECIFIED",
        "keywordPresence": F.size("keywords") > 0,
        "datePresence": c("modified_date").isNotNull() & c("created_date").isNotNull(),
        "urlFormatValidity": url,
    }
    share = [F.round(F.count_if(x) / F.count("*"), 4).alias(k) for k, x in presence.items()]
    some = F.when(F.count("*") > 0, F.struct(*share)).otherwise(F.raise_error(F.lit("an empty catalog has no discoverability")))
    out = df.agg(some.alias("indicators"))
    mean = sum((c(f"indicators.{k}") for k in presence), F.lit(0.0)) / len(presence)
    return out.withColumn("readiness", F.round(mean, 4))


def averages(df: DataFrame) -> DataFrame:
    """profile, n, average: mean completeness score of each profile."""
    return df.groupBy("profile").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("average"))


def systemic_rate(df: DataFrame, presence: dict[str, Column]) -> DataFrame:
    """Discoverability: present and all rows per field."""
    aggs = [F.count_if(c).alias(k) for k, c in presence.items()]
    rows = ", ".join(f"'{k}', {k}" for k in presence)
    return df.agg(F.count("*").alias("n_rows"), *aggs).selectExpr(f"stack({len(presence)}, {rows}) as (field, n_present)", "n_rows")
