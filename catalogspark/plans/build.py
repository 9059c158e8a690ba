"""The monthly job: from a raw snapshot to a published release, behind the acceptance gate."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.operators import quality
from catalogspark.operators.diff import carried_forward, described, snapshot_diff
from catalogspark.operators.families import detect_families, family_totals
from catalogspark.operators.service import build_report
from catalogspark.operators.normalize import catalog_completeness, catalog_issues, duplicate_issues, identify, normalize
from catalogspark.sources import catalog as src
from catalogspark.sources import export
from catalogspark.sources.shared import written

BASE = "https://catalog.example"


class GateError(RuntimeError):
    """A check that must pass before publishing did not."""


def shapes():
    """The dataset shapes: violations stop a release, warnings are reported."""
    c = F.col
    return [
        ("title", "minLength", "Violation", c("title") != ""),
        ("identifier", "minCount", "Violation", c("list_key") != ""),
        ("listType", "in", "Violation", c("list_type").isin("FILE", "API", "STD")),
        ("evidenceLevel", "hasValue", "Violation", F.lit(True)),  # documents state the one value
        ("landingPage", "nodeKind", "Violation", c("list_url").isNull() | ~c("list_url").rlike(r"(?U)[\s<>\"{}|\\^`]")),
        ("description", "minCount", "Warning", c("description").isNotNull()),
        ("keyword", "minCount", "Warning", F.size("keywords") > 0),
    ]


def catalog_findings(totals: DataFrame, title: str) -> DataFrame:
    """The two catalog shapes on totals(n_datasets): a title and a count."""
    return quality.constraints(totals.withColumn("id", F.lit("@catalog")), "id", [("title", "minCount", "Violation", F.lit(title) != ""), ("datasetCount", "minCount", "Violation", F.col("n_datasets").isNotNull())])


def change_feed(spark: SparkSession, listings: DataFrame, snapshot: str, out: str, previous: str | None, withdrawn: DataFrame | None) -> DataFrame | None:
    """The stored feed on a rebuild of the snapshot, else the difference from the previous release; None without any."""
    stored = export.read_published(spark, out, "changes", snapshot)
    if stored is not None:
        if not previous or previous == snapshot:
            return stored
    before = export.read_published(spark, out, "listings", previous) if previous and previous != snapshot else None
    if before is None:
        return stored
    feed = export.read_published(spark, out, "changes", previous)
    missing = None if feed is None else feed.where("status = 'MISSING_FROM_SNAPSHOT'").select("record_id")
    named = described(snapshot_diff(before, listings, "record_id", prev_missing=missing, withdrawn=withdrawn), before, listings, previous)
    return named if stored is None else carried_forward(named, stored)


def build(spark: SparkSession, csv: str, snapshot: str, out: str, previous: str | None = None, structures: DataFrame | None = None, reviews: DataFrame | None = None, withdrawn: DataFrame | None = None, min_rows: int = 1, stored_manifest: DataFrame | None = None) -> dict[str, DataFrame]:
    """Build a snapshot and publish it under ``out``; readers (export.read_published) see nothing of it unless every check passes and every
    table is written. A rebuild replaces the snapshot's release and keeps its change feed.

    With the stored manifest of an earlier run, a raw file of another hash stops the build.
    """
    raw_files = written(src.manifest(spark, csv), "raw_files")
    if stored_manifest is not None and not src.changed_files(raw_files, stored_manifest).isEmpty():
        raise src.SourceError("the raw file differs from the stored manifest")
    encoding = src.detect_encodings(spark, csv).head()["encoding"]
    if encoding is None:
        raise src.SourceError("neither UTF-8 nor CP949")
    raw = src.read_snapshot(spark, csv, encoding, min_rows)
    rows = written(identify(normalize(raw), "list_key", "list_type"), "normalized")
    listings = written(catalog_completeness(rows), "listings")
    issues = catalog_issues(listings).unionByName(duplicate_issues(listings, "list_key"))
    total = listings.count()
    now = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")).head()[0]
    issues = written(export.numbered_issues(quality.collapse_systemic(issues, total), "issue-detect-v1.0", now), "issues")
    indices = quality.quality_indices(listings, "list_key", ["row_count", "download_count", "view_count"], True)
    found = quality.discoverability(listings)
    totals = indices.join(found, F.lit(True)).select(F.col("rows").alias("n_datasets"), "level", F.col("index").alias("quality_index"), F.col("readiness").alias("discoverability"), "indicators")
    findings = written(quality.constraints(listings, "record_id", shapes()).unionByName(catalog_findings(totals, f"catalog {snapshot}")), "findings")
    url_column = next(k for k, v in src.V.SNAPSHOT_COLUMNS.items() if v == "list_url")
    urls = raw.where(F.trim(F.coalesce(F.col(f"`{url_column}`"), F.lit(""))) != "").count()
    checks = quality.acceptance(listings, "record_id", F.col("list_url"), raw.count(), urls, F.col("rule"))
    failed = [r["check_name"] for r in checks.where("not passed").collect()]
    if failed or not findings.where("severity = 'Violation'").isEmpty():
        raise GateError(f"not published: {failed or 'constraint violations'}")
    folder = f"{out}/builds/{snapshot}-{uuid.uuid4().hex}"
    changes = change_feed(spark, listings, snapshot, out, previous, withdrawn)
    files = listings.where("list_type = 'FILE'").select("record_id", "list_key", "title", F.col("org_name").alias("org"), F.transform("regions", lambda r: r["code"]).alias("regions"))
    none = spark.createDataFrame([], "list_key string, structure_hash string, column_count int")
    fams, members = detect_families(files, structures if structures is not None else none, reviews)
    tables = {"listings": listings, "issues": issues, "findings": findings, "indices": indices, "families": fams, "members": members, "checks": checks}
    if changes is not None:
        tables["changes"] = changes
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
        tables[name] = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
    keyed = tables["issues"].join(tables["listings"].select("record_id", "list_key"), "record_id", "left")
    bulk = {n: f"{folder}/bulk/{n}" for n in ("datasets", "records", "issues")}
    export.write_bulk(tables["listings"], "record_id", export.dataset_document(BASE, snapshot), bulk["datasets"])
    export.write_bulk(tables["listings"], "record_id", export.record_document(BASE, snapshot), bulk["records"])
    export.write_bulk(keyed, "issue_id", export.issue_document(BASE, snapshot), bulk["issues"])
    export.catalog_document(totals, BASE, snapshot, now).coalesce(1).write.text(f"{folder}/catalog")
    tables["raw_files"] = raw_files
    tables["manifest"] = export.bulk_manifest(spark, bulk)
    parts = {"raw_files": raw_files, "checks": checks, "indices": indices, "discoverability": found, "completeness": quality.averages(listings), "families": family_totals(fams, F.lit(None).cast("bigint")), "exports": tables["manifest"]}
    if changes is not None:
        parts["changes"] = tables["changes"].groupBy("status").agg(F.count("*").alias("n"))
    tables["report"] = build_report(parts)
    tables["report"].write.json(f"{folder}/report")
    export.publish(spark, out, snapshot, folder)
    return tables
