"""Fact comparison of groups of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


# The facts that listings are compared by -> their columns.
FACTS = {
    "listType": "list_type", "orgName": "org_name", "theme": "theme_raw", "formats": "formats", "updateCycle": "update_cycle", "license": "license_code", "modifiedDate": "modified_date", "createdDate": "created_date",
    "rowCount": "row_count", "spatial": "spatial_raw", "temporal": "temporal_raw", "completenessScore": "score", "keywords": "keywords", "fee": "fee", "apiType": "api_type",
}

# How many records are compared at once; how many columns are shown of all records and of one.
LEAST, MOST = 2, 5
COMMON, OWN = 50, 20


def compare_listings(members: DataFrame) -> DataFrame:
    """members(group_id and a listing's columns) -> group_id, field, n_values, shared of the fifteen facts."""
    return compare(members.select("group_id", *[F.col(c).alias(n) for n, c in FACTS.items()]), list(FACTS))


def compare(members: DataFrame, fields: list[str]) -> DataFrame:
    """members(group_id, fields...) -> group_id, field, n_values, shared: equality is of JSON text, so order in lists matters."""
    long = members.select("group_id", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.to_json(F.struct(F.col(f).alias("v"))), F.lit("{}")).alias("v")) for f in fields])))
    return long.groupBy("group_id", "field").agg(F.count_distinct("v").alias("n_values")).withColumn("shared", F.col("n_values") == 1)


def _json(c: Column) -> Column:
    """A value's JSON text; null is null there, too."""
    whole = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(len('{"v":') + 1), F.length(whole) - len('{"v":}'))


def compare_requests(asked: DataFrame, listings: DataFrame, columns: DataFrame) -> DataFrame:
    """asked(group_id, record_id), listings, columns(list_key, column_name) -> a row a group: group_id, error, differences, shared_fields, structure, warning.

    differences holds each fact that differs with every record's value, shared_fields the others with theirs, both as JSON text, which
    decides on equality. structure (common columns, those that a record has beside them, counts) is there where all records were observed; where only
    some were, it is left out with a warning. A group of fewer than two or more than five asked rows, repeats included, or
    with an id that no listing has, gets an error and nothing else. Rows without a group take no part. Only groups within the
    bounds are gathered, so that a group of any size costs a count.
    """
    asked = asked.select("group_id", "record_id").where(F.col("group_id").isNotNull())
    sizes = asked.groupBy("group_id").agg(F.count("*").alias("n"))
    fit = asked.join(sizes.where(F.col("n").between(LEAST, MOST)), "group_id", "left_semi").distinct()
    facts = listings.select("record_id", "list_key", F.array(*[_json(F.col(c)) for c in FACTS.values()]).alias("facts"))
    met = fit.join(facts, "record_id", "left")
    wanted = columns.select("list_key", "column_name").join(met.select("list_key").distinct(), "list_key", "left_semi")
    met = met.join(wanted.groupBy("list_key").agg(F.array_sort(F.collect_set("column_name")).alias("own")), "list_key", "left")
    group = met.groupBy("group_id").agg(F.count_if(F.col("facts").isNull()).alias("unknown"), F.array_sort(F.collect_list(F.struct("record_id", "facts", "own"))).alias("m"))

    ids = F.col("m.record_id")
    fact = []
    for i, name in enumerate(FACTS):
        values = F.transform("m", lambda r: r["facts"][i])  # noqa: B023
        fact.append(F.struct(F.lit(name).alias("field"), values.alias("values"), (F.size(F.array_distinct(values)) > 1).alias("differs")))
    facts = F.array(*fact)
    differences = F.transform(F.filter(facts, lambda f: f["differs"]), lambda f: F.struct(f["field"].alias("field"), F.map_from_arrays(ids, f["values"]).alias("values")))
    shared = F.transform(F.filter(facts, lambda f: ~f["differs"]), lambda f: F.struct(f["field"].alias("field"), f["values"][0].alias("value")))

    common = F.aggregate(F.slice("m", 2, MOST), F.col("m")[0]["own"], lambda a, r: F.array_intersect(a, r["own"]))
    group = group.where("unknown = 0").withColumn("observed", F.size(F.filter("m", lambda r: r["own"].isNotNull()))).withColumn("common", F.when(F.col("observed") == F.size("m"), common)).select(
        "group_id", "unknown", differences.alias("differences"), shared.alias("shared_fields"),
        F.when(F.col("common").isNotNull(), F.struct(
            F.slice("common", 1, COMMON).alias("common"),
            F.map_from_arrays(ids, F.transform("m", lambda r: F.slice(F.array_except(r["own"], F.col("common")), 1, OWN))).alias("only_in"),
            F.map_from_arrays(ids, F.transform("m", lambda r: F.size(r["own"]))).alias("counts"),
        )).alias("structure"),
        F.when((F.col("observed") > 0) & (F.col("observed") < F.size("m")), "STRUCTURE_OF_SOME_ONLY").alias("warning"),
    )
    error = F.when(F.col("n") < LEAST, "TOO_FEW").when(F.col("n") > MOST, "TOO_MANY").when(F.col("unknown").isNull(), "NOT_FOUND")
    return sizes.join(group, "group_id", "left").select("group_id", error.alias("error"), "differences", "shared_fields", "structure", "warning")


def common_columns(columns: DataFrame, members: DataFrame) -> DataFrame:
    """columns(record_id, column_name), members(group_id, record_id) -> group_id, all_observed, common, only_in map<record, columns>.

    Common and own columns are given only where every member was observed; a member's own columns are those that aren't common to all.
    """
    size = members.groupBy("group_id").agg(F.count_distinct("record_id").alias("size"))
    own = members.join(columns.distinct(), "record_id")
    seen = own.groupBy("group_id").agg(F.count_distinct("record_id").alias("seen"))
    each = own.withColumn("n", F.count("*").over(W.partitionBy("group_id", "column_name"))).join(size, "group_id")
    both = each.groupBy("group_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("n") == F.col("size"), F.col("column_name")))).alias("common"),
        F.array_sort(F.collect_list(F.when(F.col("n") < F.col("size"), F.concat_ws(":", "record_id", "column_name")))).alias("only_in"),
    )
    out = size.join(seen, "group_id", "left").join(both, "group_id", "left").withColumn("all_observed", F.coalesce(F.col("seen") == F.col("size"), F.lit(False)))
    return out.select("group_id", "all_observed", F.when(F.col("all_observed"), F.col("common")).alias("common"), F.when(F.col("all_observed"), F.col("only_in")).alias("only_in"))
