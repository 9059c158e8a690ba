"""Dataset families: clusters by title, structure and name pattern, united by connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.functions import vocabulary as V
from catalogspark.functions.text import norm_title, title_tokens
from catalogspark.operators.graph import connected_components
from catalogspark.sources.shared import written


def eligible_hashes(structures: DataFrame, least_columns: int = 4) -> DataFrame:
    """list_key, structure_hash of structures(list_key, structure_hash, column_count) with enough columns."""
    wide = structures.groupBy("structure_hash").agg(F.max("column_count").alias("m")).where(F.col("m") >= least_columns)
    return structures.join(wide.select("structure_hash"), "structure_hash", "left_semi").select("list_key", "structure_hash").distinct()


def cluster_edges(records: DataFrame, hashes: DataFrame) -> DataFrame:
    """records(record_id, list_key, title, org), hashes(list_key, structure_hash) -> src, dst, signal: each cluster's
    members, the first included, to its smallest id."""
    r = records.select("record_id", "list_key", "title", F.coalesce("org", F.lit("")).alias("org"))
    norm = norm_title(F.col("title"))
    title = r.where(F.length(norm) >= 3).select(F.lit("TITLE").alias("signal"), F.struct("org", norm.alias("a"), F.lit("").alias("b"), F.lit(0).alias("n")).alias("g"), "record_id")
    same = r.join(hashes, "list_key").select(F.lit("STRUCTURE").alias("signal"), F.struct("org", F.col("structure_hash").alias("a"), F.lit("").alias("b"), F.lit(0).alias("n")).alias("g"), "record_id")
    t = r.withColumn("t", title_tokens(F.col("title"))).where("size(t) >= 3 and length(element_at(t, -1)) >= 3")
    named = t.select("record_id", F.struct("org", F.col("t")[0].alias("a"), F.element_at("t", -1).alias("b"), F.size("t").alias("n")).alias("g"), F.array_join(F.slice("t", 2, F.size("t") - 2), "\x1f").alias("middle"))
    fit = named.groupBy("g").agg(F.count("*").alias("m"), F.count_distinct("middle").alias("d")).where((F.col("m") >= 3) & (F.col("d") >= F.greatest(F.lit(3), F.floor(0.8 * F.col("m")))))
    pattern = named.join(fit.select("g"), "g", "left_semi").select(F.lit("PATTERN").alias("signal"), "g", "record_id")
    members = title.unionByName(same).unionByName(pattern).distinct()
    least = members.groupBy("signal", "g").agg(F.min("record_id").alias("dst"), F.count("*").alias("m")).where("m > 1")
    return members.join(least, ["signal", "g"]).select(F.col("record_id").alias("src"), "dst", "signal").distinct()


def relation_type(title: Column, regions: Column) -> Column:
    """Aggregate over a family: TIME_LIKE, REGION_LIKE, NUMBERED or NAME_PARTITION."""
    share = lambda c: F.avg(c.cast("int"))
    shown = F.when(F.size(regions) > 0, F.to_json(F.array_sort(regions)))
    areas = F.count(shown)
    return (
        F.when(share(F.coalesce(title, F.lit("")).rlike(V.YEAR)) >= 0.7, "TIME_LIKE")
        .when((areas >= 0.7 * F.count("*")) & (F.count_distinct(shown) >= 0.7 * areas), "REGION_LIKE")
        .when(share(F.coalesce(title, F.lit("")).rlike(V.TITLE_DIGITS)) >= 0.7, "NUMBERED")
        .otherwise("NAME_PARTITION")
    )


def detect_families(records: DataFrame, structures: DataFrame, reviews: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(families, members): records(record_id, list_key, title, org, regions array<string>) of FILE listings.

    A family's id depends on its members alone, so a review holds for these members only.
    """
    hashes = eligible_hashes(structures)
    edges = written(cluster_edges(records, hashes), "family-edges")
    parts = connected_components(edges, "src", "dst").withColumnsRenamed({"vertex": "record_id"})
    members = written(parts.join(records.select("record_id", "list_key", "title", "org", "regions"), "record_id"), "family-members")
    signals = edges.select(F.explode(F.array("src", "dst")).alias("record_id"), "signal").distinct().join(parts, "record_id").groupBy("component").agg(F.array_sort(F.collect_set("signal")).alias("signals"))
    # evidence: two or more members with structures, all of which share one
    seen = members.join(hashes, "list_key").select("component", "record_id", "structure_hash").distinct()
    having = seen.groupBy("component").agg(F.count_distinct("record_id").alias("h"))
    top = seen.groupBy("component", "structure_hash").agg(F.count("*").alias("m")).groupBy("component").agg(F.max("m").alias("top"))
    ids = members.groupBy("component").agg(
        F.array_sort(F.collect_list(F.col("record_id").cast("string"))).alias("ids"),
        F.count("*").alias("n_members"),
        relation_type(F.col("title"), F.col("regions")).alias("relation"),
    )
    fam = ids.join(signals, "component").join(having, "component", "left").join(top, "component", "left")
    fam = fam.select(
        "component",
        F.concat(F.lit("fam-"), F.substring(F.sha2(F.array_join("ids", "|"), 256), 1, 12)).alias("family_id"),
        "n_members",
        "relation",
        "signals",
        F.when((F.col("h") >= 2) & (F.col("top") == F.col("h")), "PLUS_STRUCTURE").otherwise("CATALOG_ONLY").alias("evidence"),
    )
    if reviews is None:
        fam = fam.withColumn("review", F.lit("UNREVIEWED"))
    else:
        fam = fam.join(reviews.select("family_id", "review"), "family_id", "left").withColumn("review", F.coalesce("review", F.lit("UNREVIEWED")))
    return fam.drop("component"), members.join(fam.select("component", "family_id"), "component").select("family_id", "record_id", "list_key")


def family_totals(families: DataFrame | None, files_total, spark=None) -> DataFrame:
    """One row: available, families, member_records, files_total, by_evidence, by_review. families None: a release without the table, which isn't 0."""
    if families is None:
        return spark.createDataFrame([(False,)], "available boolean").select("available", *[F.lit(None).cast("bigint").alias(c) for c in ("families", "member_records", "files_total")], *[F.lit(None).cast("map<string,bigint>").alias(c) for c in ("by_evidence", "by_review")])
    counts = families.groupBy("evidence", "review").agg(F.count("*").alias("n"), F.sum("n_members").alias("m"))  # a row for each pair of words
    by = lambda c: counts.groupBy(F.col(c).alias("k")).agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))))
    row = counts.agg(F.lit(True).alias("available"), F.coalesce(F.sum("n"), F.lit(0)).alias("families"), F.coalesce(F.sum("m"), F.lit(0)).alias("member_records")).withColumn("files_total", files_total)
    return row.join(by("evidence").toDF("by_evidence"), F.lit(True)).join(by("review").toDF("by_review"), F.lit(True))


def merge_reviews(existing: DataFrame, sheet: DataFrame) -> DataFrame:
    """Sheet rows win; blank verdicts are skipped; an unknown verdict stops the merge."""
    allowed = ("CONFIRMED_FAMILY", "LEGITIMATE_SPLIT", "NOT_A_FAMILY")
    new = sheet.where(F.coalesce(F.trim("review"), F.lit("")) != "").select("family_id", F.trim("review").alias("review"))
    if bad := [r["review"] for r in new.where(~F.col("review").isin(*allowed)).limit(5).collect()]:
        raise ValueError(f"unknown verdicts: {bad}")
    return existing.select("family_id", "review").join(new, "family_id", "left_anti").unionByName(new)


def precision(judged: DataFrame) -> DataFrame:
    """judged(evidence, review) -> evidence (and ALL): judged and good counts."""
    good = F.count_if(F.col("review").isin("CONFIRMED_FAMILY", "LEGITIMATE_SPLIT")).alias("good")
    j = judged.where("review <> 'UNREVIEWED'")
    return j.groupBy("evidence").agg(F.count("*").alias("judged"), good).unionByName(j.agg(F.count("*").alias("judged"), good).select(F.lit("ALL").alias("evidence"), "judged", "good"))
