"""Structure observation: types, safety and licence gates, ingest of column profiles, coverage and documents."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from catalogspark.functions import vocabulary as V
from catalogspark.functions.text import blank_to_null, safe_int, short_id, ttrim
from catalogspark.sources.shared import written

MAX_EXAMPLES = 10
INTEGER, NUMBER, DATE_LIKE = r"(?U)^-?\d+$", r"(?U)^-?\d+([.,]\d+)?$", r"(?U)^\d{4}([-./]\d{1,2}){2}$|^\d{8}$"


def observe_type(examples: Column) -> Column:
    """Type of sample values: null for none, EMPTY for blank ones; whole numbers are tried before dates."""
    v = F.filter(F.transform(examples, ttrim), lambda x: x != "")
    every = lambda p: F.forall(v, lambda x: x.rlike(p))
    return (
        F.when(examples.isNull() | (F.size(examples) == 0), F.lit(None).cast("string"))
        .when(F.size(v) == 0, "EMPTY")
        .when(every(INTEGER), "INTEGER")
        .when(every(NUMBER), "NUMBER")
        .when(every(DATE_LIKE), "DATE_LIKE")
        .when(F.forall(v, lambda x: F.lower(x).isin(*V.BOOL_WORDS)), "BOOL_LIKE")
        .otherwise("STRING")
    )


def observe_types(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, observed_type over all rows of a group: the same tests as observe_type, as aggregates that gather no values."""
    v = F.nullif(ttrim(F.col(value)), F.lit(""))
    every = lambda c: F.bool_and(F.coalesce(c, F.lit(True)))
    kind = (
        F.when(F.count(value) == 0, F.lit(None).cast("string"))
        .when(F.count(v) == 0, "EMPTY")
        .when(every(v.rlike(INTEGER)), "INTEGER")
        .when(every(v.rlike(NUMBER)), "NUMBER")
        .when(every(v.rlike(DATE_LIKE)), "DATE_LIKE")
        .when(every(F.lower(v).isin(*V.BOOL_WORDS)), "BOOL_LIKE")
        .otherwise("STRING")
    )
    return df.groupBy(*by).agg(kind.alias("observed_type"))


def screen(name: Column, examples: Column, patterns: dict[str, str] = V.VALUE_PATTERNS) -> Column:
    """struct<status, reason>: names, then values one by one, then words to review, then free text."""
    n = F.lower(ttrim(F.coalesce(name, F.lit(""))))
    say = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    held = [F.when(F.contains(n, F.lit(w)), say("WITHHELD", f"column-name:{w}")) for w in V.NAME_WITHHELD]
    held += [F.when(F.endswith(n, F.lit(w)), say("WITHHELD", f"column-name-suffix:{w}")) for w in V.NAME_WITHHELD_SUFFIX]
    held += [F.when(n == w, say("WITHHELD", f"column-name-exact:{w}")) for w in V.NAME_WITHHELD_EXACT]

    def first_pattern(v: Column) -> Column:
        return F.coalesce(*[F.when(v.rlike(p), F.lit(k)) for k, p in patterns.items()])

    ex = F.coalesce(examples, F.array().cast("array<string>"))
    hit = F.get(F.array_compact(F.transform(ex, first_pattern)), F.lit(0))
    values = F.when(hit.isNotNull(), F.struct(F.lit("WITHHELD").alias("status"), F.concat(F.lit("value-pattern:"), hit).alias("reason")))
    review = [F.when(F.contains(n, F.lit(w)), say("REVIEW_REQUIRED", f"column-name:{w}")) for w in V.NAME_REVIEW]
    total = F.aggregate(ex, F.lit(0), lambda a, v: a + F.length(v))
    free = F.when(total > V.FREE_TEXT_LENGTH * F.size(ex), say("REVIEW_REQUIRED", "free-text-heuristic"))
    return F.coalesce(*held, values, *review, free, F.struct(F.lit("CLEAR").alias("status"), F.lit(None).cast("string").alias("reason")))


@F.pandas_udf(T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("values", T.ArrayType(T.StringType()))]))
def _literal_lists(raw: pd.Series) -> pd.DataFrame:
    def parse(s):
        if s is None or not s.strip():
            return (None, None)
        try:
            v = ast.literal_eval(s)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return (False, None)
        return (True, [str(x) for x in v][:MAX_EXAMPLES]) if isinstance(v, list) else (False, None)

    return pd.DataFrame([parse(s) for s in raw], columns=["ok", "values"])


def parse_samples(raw: Column) -> Column:
    """struct<ok, values>: Python-literal list text as at most ten strings, nulls as their text; ok is null for blank text and false for broken
    text and for what isn't a list."""
    return _literal_lists(raw)


def assessed(name: Column, parsed_ok: Column, values: Column) -> Column:
    """struct<status, reason>: screened where the samples gave values; else NOT_ASSESSED, for nobody has looked, with the reason of broken samples."""
    none = F.struct(F.lit("NOT_ASSESSED").alias("status"), F.when(~parsed_ok, "sample-parse-failed").alias("reason"))
    return F.when(F.coalesce(parsed_ok, F.lit(False)) & (F.size(values) > 0), screen(name, values)).otherwise(none)


def release(parsed_ok: Column, values: Column, safety: Column, licence_open: Column) -> Column:
    """struct<example_status, examples>: safety before licence; values stay only where AVAILABLE."""
    status = (
        F.when(parsed_ok.isNull(), "NOT_COLLECTED")
        .when(~parsed_ok, "COLLECTION_FAILED")
        .when(F.size(values) == 0, "NO_NON_NULL_VALUES")
        .when(safety != "CLEAR", "WITHHELD_BY_SAFETY")
        .when(~F.coalesce(licence_open, F.lit(False)), "WITHHELD_BY_LICENSE")
        .otherwise("AVAILABLE")
    )
    return F.struct(status.alias("example_status"), F.when(status == "AVAILABLE", values).alias("examples"))


def _numbered_without(df: DataFrame, number: str, left_out: Column, into: str, slice_rows: int = 100_000) -> DataFrame:
    """The rows that aren't left out, with ``into``: number less the rows left out before it. Slices of numbers are counted first, so no task holds more than one."""
    part = df.withColumns({"_slice": F.floor(F.col(number) / slice_rows), "_out": left_out.cast("int")})
    outs = part.groupBy("_slice").agg(F.sum("_out").alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a slice
    before = F.sum("_out").over(W.partitionBy("_slice").orderBy(number))
    kept = part.withColumn("_here", before).where("_out = 0").join(outs.select("_slice", earlier.alias("_before")), "_slice")
    return kept.withColumn(into, F.col(number) - F.col("_here") - F.col("_before")).drop("_slice", "_out", "_here", "_before")


def column_index(ingested: dict[str, DataFrame]) -> DataFrame:
    """list_key, column_name: the distinct names of observed columns, as they stand."""
    return ingested["columns"].select("list_key", F.col("name").alias("column_name")).distinct()


def asset_page(assets: DataFrame, most: int = 20) -> DataFrame:
    """The first assets of each key by file name, with how many the key has."""
    by = W.partitionBy("list_key")
    return assets.withColumns({"place": F.row_number().over(by.orderBy("file_name", "asset_id")), "assets_total": F.count("*").over(by)}).where(F.col("place") <= most)


def ingest(profile: DataFrame, licences: DataFrame) -> dict[str, DataFrame]:
    """profile(row_no, list_key, file_name, sheet, ordinal, name, samples), licences(list_key, open) -> assets, tables, columns, rejected.

    The profile may also have container, rows, distinct, distinct_approx and note: the container is part of an asset's id, a table has the rows that
    its first column states, and columns keep their distinct count, whether it is approximate (Y), and their note.

    Of an asset (list_key, file_name) the first run of adjacent rows counts; later runs are rejected row by row. Rows without key or file
    are rejected and don't end a run. A
    sheet is valid if its ordinals are 1..n; an asset is AVAILABLE with all sheets valid, PARTIAL with some, else COLLECTION_FAILED.
    """
    optional = {"container": "string", "rows": "string", "distinct": "string", "distinct_approx": "string", "note": "string"}
    profile = profile.withColumns({c: F.lit(None).cast(t) for c, t in optional.items() if c not in profile.columns})
    p = profile.withColumn("bad", F.when(F.coalesce(ttrim("list_key"), F.lit("")) == "", "NO_KEY").when(F.coalesce(ttrim("file_name"), F.lit("")) == "", "NO_FILE"))
    rejected = p.where("bad is not null").groupBy(F.col("bad").alias("reason")).agg(F.count("*").alias("n"))
    asset = ["list_key", "file_name"]
    good = _numbered_without(p, "row_no", F.col("bad").isNotNull(), "good_no").drop("bad")
    # a row starts a run when the good row before it in the file is not of its asset
    near = F.lag("good_no").over(W.partitionBy(*asset).orderBy("row_no"))
    runs = good.withColumn("run", F.sum(F.coalesce(F.col("good_no") - near > 1, F.lit(False)).cast("int")).over(W.partitionBy(*asset).orderBy("row_no"))).drop("good_no")
    late = runs.where("run > 0").agg(F.count("*").alias("n")).select(F.lit("NON_CONTIGUOUS").alias("reason"), "n").where("n > 0")
    rows = runs.where("run = 0").withColumn("sheet", F.coalesce("sheet", F.lit("")))
    place = F.row_number().over(W.partitionBy(*asset, "sheet").orderBy("ordinal", "row_no"))
    sheets = rows.withColumn("ok", F.coalesce(F.col("ordinal") == place, F.lit(False))).groupBy(*asset, "sheet").agg(
        F.bool_and("ok").alias("valid"), F.min("row_no").alias("first"), F.count("*").alias("column_count"), F.min_by("rows", "row_no").alias("rows"), F.min_by("container", "row_no").alias("container"), F.array_sort(F.collect_list(F.struct("row_no", "ordinal", "name"))).alias("cols")
    )
    # the parts of an asset's name that are published; the container is the first row's
    contained = F.first("container").over(W.partitionBy(*asset).orderBy("first"))
    sheets = sheets.withColumn("container", F.coalesce(ttrim(contained), F.lit("")))
    asset_id = short_id(F.col("list_key"), F.lit("FILE"), F.col("container"), F.col("file_name"))
    order = F.dense_rank().over(W.partitionBy(*asset).orderBy("first")) - 1
    valid = sheets.where("valid").withColumns({"table_order": order.cast("bigint"), "asset_id": asset_id})
    text = lambda s: F.array_join(F.transform(s["cols"], lambda c: F.concat_ws(":", c["ordinal"], c["name"])), "\x1e")
    structure = valid.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("table_order", "sheet", "cols"))).alias("s")).select("asset_id", F.sha2(F.array_join(F.transform("s", text), "\x1d"), 256).alias("structure_hash"))
    status = F.when(F.bool_and("valid"), "AVAILABLE").when(F.bool_or("valid"), "PARTIAL").otherwise("COLLECTION_FAILED")
    assets = sheets.groupBy(*asset, "container").agg(status.alias("status"), F.count_if("valid").alias("n_tables"), F.sum(F.when(F.col("valid"), F.col("column_count")).otherwise(0)).alias("n_columns"))
    assets = assets.withColumn("asset_id", asset_id).join(structure, "asset_id", "left").join(licences.select("list_key", F.col("open").alias("licence_open")), "list_key", "left")
    assets = assets.withColumns({"licence_open": F.coalesce("licence_open", F.lit(False)), "observation_id": short_id(F.col("asset_id"), F.coalesce("structure_hash", F.lit("")))})
    table_id = short_id(F.col("asset_id"), F.col("sheet"), F.col("table_order").cast("string"))
    tables = valid.select("asset_id", *asset, "sheet", "table_order", "column_count", safe_int(F.col("rows")).alias("rows_scanned"), table_id.alias("table_id"))
    held = rows.join(tables.select("asset_id", "table_id", *asset, "sheet"), [*asset, "sheet"]).join(assets.select("asset_id", "licence_open"), "asset_id")
    held = held.withColumn("parsed", parse_samples(F.col("samples")))
    values = F.coalesce("parsed.values", F.array().cast("array<string>"))
    held = held.withColumn("safety", assessed(F.col("name"), F.col("parsed.ok"), values))
    held = held.withColumns({"type": observe_type(F.col("parsed.values")), "rel": release(F.col("parsed.ok"), values, F.col("safety.status"), F.col("licence_open"))})
    columns = held.select("asset_id", "table_id", "list_key", "ordinal", "name", F.col("type").alias("observed_type"), F.col("safety.status").alias("safety_status"), F.col("safety.reason").alias("safety_reason"), "rel.example_status", "rel.examples",
                          safe_int(F.col("distinct")).alias("n_distinct"), (F.coalesce(ttrim("distinct_approx"), F.lit("")) == "Y").alias("distinct_approx"), blank_to_null(F.col("note")).alias("note"))
    return {"assets": assets, "tables": tables, "columns": columns, "rejected": rejected.unionByName(late)}


def coverage(assets: DataFrame) -> DataFrame:
    """list_key, coverage: all AVAILABLE; else PARTIAL where any is; else the lexically greatest status."""
    available = F.count_if(F.col("status") == "AVAILABLE")
    return assets.groupBy("list_key").agg(F.count("*").alias("assets"), available.alias("available"), F.when(available == F.count("*"), "AVAILABLE").when(available > 0, "PARTIAL").otherwise(F.max("status")).alias("coverage"))


def documents(ingested: dict[str, DataFrame], with_examples: bool = True, most: int = 3) -> DataFrame:
    """list_key, document: nested JSON of assets, tables and columns, built bottom-up."""
    shown = F.slice("examples", 1, most) if with_examples else F.lit(None).cast("array<string>")
    cols = ingested["columns"].groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "name", "observed_type", "n_distinct", "distinct_approx", "safety_status", "safety_reason", "example_status", shown.alias("examples"), "note"))).alias("columns"))
    tabs = ingested["tables"].join(cols, "table_id", "left").groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("table_order", "sheet", "rows_scanned", "column_count", "columns"))).alias("tables"))
    assets = ingested["assets"].join(tabs, "asset_id", "left")
    whole = assets.groupBy("list_key").agg(F.array_sort(F.collect_list(F.struct("file_name", "asset_id", "status", "structure_hash", "tables"))).alias("assets"))
    return whole.select("list_key", F.to_json(F.struct("list_key", "assets")).alias("document"))


def bottom_k(df: DataFrame, columns: list[str], k: int = 10, salt: str = "") -> DataFrame:
    """column, rank, value: per column the k distinct values of smallest SHA-256 of (salt, column, value)."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))).where("value is not null").distinct()
    h = F.sha2(F.concat_ws("|", F.lit(salt), "column", "value"), 256)
    return long.withColumn("rank", F.row_number().over(W.partitionBy("column").orderBy(h))).where(F.col("rank") <= k)


def profile(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """column, n_rows, n_values, n_distinct, distinct_approx: a table's column profile in one scan."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    aggs = [x for c in columns for x in (F.count(c).alias(f"{c}_n"), distinct(c).alias(f"{c}_d"))]
    rows = ", ".join(f"'{c}', {c}_n, {c}_d" for c in columns)
    return df.agg(F.count("*").alias("n_rows"), *aggs).selectExpr(f"stack({len(columns)}, {rows}) as (column, n_values, n_distinct)", "n_rows", f"{str(not exact).lower()} as distinct_approx")


def stored(ingested: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The ingest's tables written once, for the several reads of coverage, documents and search."""
    return {k: written(v, f"observe-{k}") for k, v in ingested.items()}
