"""Draft data-use plans for a batch of purposes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from catalogspark.functions import vocabulary as V
from catalogspark.functions.text import ttrim
from catalogspark.operators.bm25 import decided, scored
from catalogspark.sources.shared import written


def _strip_particle(t: Column) -> Column:
    whens = [F.when((F.length(t) > len(p) + 1) & F.endswith(t, F.lit(p)), t.substr(F.lit(1), F.length(t) - len(p))) for p in V.PARTICLES]
    return F.coalesce(*whens, t)


def extract_terms(purpose: Column, most: int = 6) -> tuple[Column, Column]:
    """(search terms, code of the first region named) of a purpose sentence."""
    raw = F.split(ttrim(F.coalesce(purpose, F.lit(""))), r"(?U)[\s,·]+")
    clean = F.filter(F.transform(raw, lambda t: _strip_particle(F.regexp_replace(t, r"(?U)[^\w가-힣]", ""))), lambda t: F.length(t) >= 2)
    codes = F.create_map(*[F.lit(x) for kv in V.REGION_TOKENS.items() for x in kv])
    region = F.get(F.array_compact(F.transform(clean, lambda t: F.try_element_at(codes, t))), F.lit(0))
    terms = F.filter(clean, lambda t: ~F.array_contains(F.map_keys(codes), t) & ~t.isin(*V.STOPWORDS))
    return F.slice(terms, 1, most), region


def resolve_region(region: Column) -> Column:
    """struct<code, error>: a code or a name; anything else is an error."""
    codes = F.create_map(*[F.lit(x) for kv in V.REGION_TOKENS.items() for x in kv])
    t = ttrim(region)
    code = F.when(t.isin(*[r[0] for r in V.REGIONS]), t).otherwise(F.try_element_at(codes, t))
    return F.struct(code.alias("code"), F.when(t.isNotNull() & (t != "") & code.isNull(), F.concat(F.lit("unknown region: "), t)).alias("error"))


def assign_roles(title: Column, columns: Column, rank: Column, patterns=V.ROLE_PATTERNS, column_patterns=V.COLUMN_ROLE_PATTERNS, kind: Column | None = None) -> Column:
    """Roles of a candidate at 1-based rank by its title and observed columns; a listing of kind STD is a reference; RELATED if none fits."""
    cols = F.coalesce(columns, F.array().cast("array<string>"))
    found = [F.when(rank <= 2, "PRIMARY")]
    standard = F.lit(False) if kind is None else F.coalesce(kind == "STD", F.lit(False))
    found += [F.when(F.coalesce(title, F.lit("")).rlike(p) | (standard & F.lit(r == "REFERENCE")), r) for r, p in patterns.items()]
    found += [F.when(F.array_join(cols, " ").rlike(p), r) for r, p in column_patterns.items()]
    roles = F.array_compact(F.array(*found))
    return F.when(F.size(roles) > 0, roles).otherwise(F.array(F.lit("RELATED")))


def relevance(rank: Column) -> Column:
    return F.when(rank <= 3, "HIGH").when(rank <= 6, "MEDIUM").otherwise("LOW")


def join_keys(candidates: DataFrame, patterns: dict[str, list[str]] = V.JOIN_KEYS) -> DataFrame:
    """candidates(plan_id, record_id, columns) -> plan_id, key, observed_in: keys seen in two or more candidates, never a verdict."""
    cols = F.coalesce("columns", F.array().cast("array<string>"))

    def seen(p: str) -> Column:
        return F.exists(cols, lambda c: c.rlike(p))

    hits = []
    for label, needed in patterns.items():
        every = F.lit(True)
        for p in needed:
            every = every & seen(p)
        hits.append(F.when(every, F.lit(label)))
    rows = candidates.select("plan_id", "record_id", F.explode(F.array_compact(F.array(*hits))).alias("key"))
    keys = rows.groupBy("plan_id", "key").agg(F.array_sort(F.collect_set("record_id")).alias("observed_in"))
    return keys.where(F.size("observed_in") >= 2).withColumn("status", F.lit("CANDIDATE_ONLY"))


def needs(candidates: DataFrame, plans: DataFrame) -> DataFrame:
    """candidates(plan_id, record_id, roles, spatial_listed, temporal_listed), plans(plan_id, purpose) -> plan_id, role, status, matched.

    SPATIAL and TEMPORAL fall back to what listings state, as PARTIAL; demand and supply are asked for only where the purpose hints at them.
    """
    ids = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("record_id"))))
    has = lambda r: F.array_contains("roles", r)
    per = candidates.groupBy("plan_id").agg(*[ids(has(r)).alias(r) for r in ("PRIMARY", "SPATIAL", "TEMPORAL", "DEMAND", "SUPPLY", "REFERENCE")], ids(F.col("spatial_listed")).alias("sl"), ids(F.col("temporal_listed")).alias("tl"))
    empty = F.array().cast(candidates.select(F.array("record_id").alias("a")).schema["a"].dataType)
    per = plans.join(per, "plan_id", "left")
    g = lambda c: F.coalesce(F.col(c), empty)
    hint = F.col("purpose").rlike(V.ANALYSIS_HINT)

    def need(role: str, listed: str | None = None, asked: Column = F.lit(True)) -> Column:  # noqa: B008
        own = g(role)
        other = g(listed) if listed else empty
        status = F.when(F.size(own) > 0, "SATISFIED").when(F.size(other) > 0, "PARTIAL").otherwise("UNSATISFIED")
        return F.when(asked, F.struct(F.lit(role).alias("role"), status.alias("status"), F.when(F.size(own) > 0, own).otherwise(other).alias("matched")))

    rows = F.array_compact(F.array(need("PRIMARY"), need("SPATIAL", "sl"), need("TEMPORAL", "tl"), need("DEMAND", asked=hint), need("SUPPLY", asked=hint), need("REFERENCE", asked=F.size(g("REFERENCE")) > 0)))
    return per.select("plan_id", F.inline(rows))


def explain(terms: Column, title: Column, columns: Column, rank: Column, spatial_listed: Column) -> Column:
    """Reasons why a candidate was selected."""
    hit = F.slice(F.filter(terms, lambda t: F.contains(title, t)), 1, 3)
    n = F.size(F.coalesce(columns, F.array().cast("array<string>")))
    return F.array_compact(
        F.array(
            F.concat(F.lit("rank "), rank.cast("string"), F.lit(" (bm25)")),
            F.when(F.size(hit) > 0, F.concat(F.lit("title matches "), F.array_join(hit, "·"))),
            F.when(n > 0, F.concat(F.lit("structure observed: "), n.cast("string"), F.lit(" columns"))),
            F.when(spatial_listed, F.lit("listing states its area")),
        )
    )


def limitations(kind: Column, columns: Column) -> Column:
    n = F.size(F.coalesce(columns, F.array().cast("array<string>")))
    return F.array(F.lit("NOT_ASSESSED"), F.when(n > 0, "SAMPLE_BASED_STRUCTURE").when(kind == "FILE", "STRUCTURE_NOT_COLLECTED").otherwise("NOT_APPLICABLE"))


def fit_signals(rank: Column, kind: Column, columns: Column, modified: Column, typical: Column, top_percent: Column) -> Column:
    """struct<relevance, structure, freshness, completeness>: what speaks for a candidate, never a verdict on its quality."""
    n = F.size(F.coalesce(columns, F.array().cast("array<string>")))
    return F.struct(
        relevance(rank).alias("relevance"),
        F.when(n > 0, "FILE_OBSERVATION").when(kind == "FILE", "STRUCTURE_NOT_COLLECTED").otherwise("NOT_APPLICABLE").alias("structure"),
        F.when(modified.isNotNull(), "LISTED").otherwise("UNKNOWN").alias("freshness"),
        F.when(typical, "TYPICAL").when(top_percent.isNotNull(), F.concat(F.lit("TOP_"), top_percent.cast("string"))).otherwise("UNKNOWN").alias("completeness"),
    )


#: What a plan is searched by: the weights of a listing's texts.
SEARCHED = {"title": 4.0, "keyword_text": 3.0, "description": 1.0, "org_name": 2.0}


def build_plans(purposes: DataFrame, listings: DataFrame, columns: DataFrame, most: int = 5) -> DataFrame:
    """purposes(plan_id, purpose, region), listings (normalized and rated, with rows, higher, typical), columns(record_id, columns) -> a draft plan a row.

    Each purpose is searched in its region (named by the argument or else in the sentence) and, where that finds nothing, without. A purpose of
    fewer than 2 or more than 200 characters and an unknown region give a row with an error and nothing else.
    """
    terms, named = extract_terms(F.col("purpose"))
    p = purposes.withColumns({"purpose": ttrim(F.coalesce("purpose", F.lit(""))), "asked": resolve_region(F.col("region"))}).withColumns({"terms": terms, "named": named})
    short = F.when(~F.length("purpose").between(2, 200), "purpose must have 2 to 200 characters")
    p = p.withColumns({"error": F.coalesce(short, "asked.error"), "code": F.coalesce("asked.code", "named")})
    p = written(p.withColumn("query", F.when(F.size("terms") > 0, F.array_join("terms", " ")).otherwise(F.col("purpose"))), "purposes")
    good = p.where("error is null")
    texts = listings.withColumn("keyword_text", F.array_join("keywords", " "))
    found = written(scored(good.select(F.col("plan_id").alias("query_id"), F.col("query").alias("text")), texts, "record_id", SEARCHED), "plan-scores").withColumnsRenamed({"query_id": "plan_id", "doc": "record_id"})
    areas = listings.select("record_id", F.explode(F.transform("regions", lambda r: r["code"])).alias("code"))
    near = found.join(good.where("code is not null").select("plan_id", "code"), "plan_id").join(areas, ["record_id", "code"], "left_semi").drop("code")
    first = near.unionByName(found.join(good.where("code is null").select("plan_id"), "plan_id", "left_semi"))
    again = good.where("code is not null").select("plan_id").join(near.select("plan_id").distinct(), "plan_id", "left_anti")
    every = first.withColumn("turn", F.lit(1)).unionByName(found.join(again, "plan_id", "left_semi").withColumn("turn", F.lit(2)))
    kept = decided(every.select(F.col("plan_id").alias("query_id"), "n_units", F.struct("record_id", "turn").alias("doc"), "hit", "score"))
    rank = F.row_number().over(W.partitionBy("plan_id").orderBy(F.desc("score"), "record_id"))
    top = kept.select(F.col("query_id").alias("plan_id"), "doc.record_id", "doc.turn", "mode", "score").withColumn("rank", rank).where(F.col("rank") <= most)
    fields = listings.select("record_id", "title", "org_name", "list_type", "list_url", "theme_top", "modified_date", F.col("spatial_raw").isNotNull().alias("spatial_listed"), F.col("modified_date").isNotNull().alias("temporal_listed"), "typical", F.round(100 * F.col("higher") / F.col("rows"), 1).alias("top_percent"))
    rows = top.join(fields, "record_id").join(columns.select("record_id", "columns"), "record_id", "left").join(good.select("plan_id", "terms"), "plan_id")
    c = F.col
    rows = rows.withColumn("roles", assign_roles(F.concat_ws(" ", "title", "theme_top"), c("columns"), c("rank"), kind=c("list_type")))
    rows = written(rows, "plan-candidates")
    shown = F.struct(
        "rank", "record_id", "title", "org_name", "list_type", "list_url", F.lit("CANDIDATE_DATASET").alias("status"), "roles",
        fit_signals(c("rank"), c("list_type"), c("columns"), c("modified_date"), c("typical"), c("top_percent")).alias("signals"),
        explain(c("terms"), c("title"), c("columns"), c("rank"), c("spatial_listed")).alias("reasons"),
        limitations(c("list_type"), c("columns")).alias("limitations"),
    )
    candidates = rows.groupBy("plan_id").agg(F.array_sort(F.collect_list(shown)).alias("candidates"), F.max("turn").alias("turn"), F.max("mode").alias("mode"))  # at most ``most`` a plan
    wanted = needs(rows, good.select("plan_id", "purpose")).groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("role", "status", "matched"))).alias("needs"))
    keys = join_keys(rows).groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("key", "status", "observed_in"))).alias("join_keys"))
    out = p.join(candidates, "plan_id", "left").join(wanted, "plan_id", "left").join(keys, "plan_id", "left")
    missing = F.transform(F.filter("needs", lambda n: n["status"] == "UNSATISFIED"), lambda n: n["role"])
    checks = F.array_compact(
        F.array(
            F.lit("CHECK_SOURCE_DATES"),
            F.when(F.col("join_keys").isNull() & (F.size("candidates") > 1), "CHECK_COMMON_COLUMNS"),
            F.lit("COMPARE_KEY_FORMATS"),
            F.lit("CHECK_VALUES"),
            F.when(F.size("missing") > 0, "SEARCH_MISSING_NEEDS_ANEW"),
        )
    )
    ok = c("error").isNull()
    return out.withColumn("missing", missing).select(
        "plan_id", "purpose", "error", F.when(ok, "DRAFT").alias("status"), F.when(ok, c("terms")).alias("terms"), F.when(ok, c("code")).alias("region"),
        F.when(ok & c("asked.code").isNotNull(), "PARAMETER").when(ok & c("named").isNotNull(), "PURPOSE_TEXT").alias("region_source"),
        F.when(ok, F.when(c("turn") == 2, 2).when(c("candidates").isNull() & c("code").isNotNull(), 2).otherwise(1)).alias("searches"), "mode",
        "candidates", "needs", "join_keys", "missing", F.when(ok, "NOT_ASSESSED").alias("quality"), F.when(ok, checks).alias("next_checks"),
    )
