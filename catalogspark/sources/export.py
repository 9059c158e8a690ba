"""Sinks: release tables, linked-data documents and bulk exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.functions.text import short_id, ttrim


def write_release(df: DataFrame, path: str, snapshot: str) -> None:
    """Replace the snapshot's partition only."""
    df.withColumn("snapshot", F.lit(snapshot)).write.partitionBy("snapshot").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def publish(spark: SparkSession, out: str, snapshot: str, folder: str) -> None:
    """Make a finished build the snapshot's release: one small file, whose commit is what readers wait for."""
    spark.range(1).select(F.lit(snapshot).alias("snapshot"), F.lit(folder).alias("folder"), F.current_timestamp().alias("published_at")).coalesce(1).write.mode("append").json(f"{out}/published")


def published(spark: SparkSession, out: str) -> DataFrame:
    """snapshot, folder: the last published build of each snapshot; none before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/published")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "snapshot string, folder string")
    marks = spark.read.schema("snapshot string, folder string, published_at timestamp").json(f"{out}/published")
    return marks.groupBy("snapshot").agg(F.max_by("folder", F.struct("published_at", "folder")).alias("folder"))


def read_published(spark: SparkSession, out: str, name: str, snapshot: str) -> DataFrame | None:
    """A table of a snapshot's release; None if the snapshot isn't published or its release has no such table."""
    row = published(spark, out).where(F.col("snapshot") == snapshot).head()
    if row is None:
        return None
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{row['folder']}/{name}")
    return spark.read.parquet(f"{row['folder']}/{name}") if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None


def read_release(spark: SparkSession, path: str, snapshot: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("snapshot") == snapshot)


# Update cycle -> the publications office's frequency.
FREQUENCY = "http://publications.europa.eu/resource/authority/frequency/"
FREQUENCIES = {"DAILY": "DAILY", "WEEKLY": "WEEKLY", "MONTHLY": "MONTHLY", "QUARTERLY": "QUARTERLY", "SEMIANNUAL": "ANNUAL_2", "ANNUAL": "ANNUAL", "IRREGULAR": "IRREG"}


def uri(base: str, kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{base.rstrip('/')}/{kind}/"), key.cast("string"))


def catalog_uri(base: str, snapshot: str) -> str:
    return f"{base.rstrip('/')}/catalog/{snapshot}"


def record_uri(base: str, snapshot: str, key: Column) -> Column:
    return F.concat(F.lit(f"{catalog_uri(base, snapshot)}/record/"), key.cast("string"))


def as_json(value: Column, nulls: bool = False) -> Column:
    """JSON text of any value; null for null. nulls: null properties of a struct are written too."""
    text = F.to_json(F.array(value), {"ignoreNullFields": str(not nulls).lower()})
    return F.when(value.isNotNull(), F.substring(text, F.lit(2), F.length(text) - 2))


def json_object(members: dict[str, Column]) -> Column:
    """name -> JSON text, null to leave it out: the object's text, in order."""
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*[F.concat(F.lit(f'"{k}":'), v) for k, v in members.items()])), ","), F.lit("}"))


def _typed(kind: str, **fields: Column) -> Column:
    return F.struct(F.lit(kind).alias("@type"), *[v.alias(k) for k, v in fields.items()])


def _extension() -> dict[str, Column]:
    """Portal metadata that the core vocabulary has no term for; what isn't stated is left out."""
    c, api = F.col, F.col("list_type") == "API"
    full = lambda x: F.coalesce(x, F.lit("")) != ""
    formats = F.when(F.size("formats") > 0, c("formats"))
    file = _typed("dcat:Distribution", **{"dct:title": c("file_data_name"), "dct:format": formats, "dcatkr:numberOfDownload": c("download_count"), "dcat:accessURL": F.when(full(c("list_url")), F.struct(c("list_url").alias("@id")))})
    limit = ttrim("traffic").try_cast("bigint")
    values = {
        "dcatkr:numberOfRow": c("row_count"),
        "dcatkr:numberOfView": c("view_count"),
        "dcatkr:legalBasis": c("retention_basis"),
        "dcatkr:nextRegistrationDate": c("next_registration_date"),
        "dcatkr:derivedSystem": c("collection_method"),
        "dcatkr:mediaType": c("media_type"),
        "dcatkr:provisionType": c("provision_type"),
        "dcatkr:notes": c("notes"),
        "dcatkr:reviewType": c("review_type"),
        "dcatkr:isNationalCore": F.coalesce("is_national_core", F.lit(False)),
        "dcatkr:isStandardData": F.coalesce("is_standard", F.lit(False)),
        "dcatkr:maintainer": F.when(full(c("dept_name")), _typed("foaf:Agent", **{"foaf:name": c("dept_name")})),
        "dcatkr:fee": F.when(c("fee").isin("FREE", "PAID"), c("fee") == "PAID"),
        "kdp:feeCode": c("fee"),
        "schema:offer": F.when(full(c("fee_basis")), _typed("schema:Offer", **{"schema:description": c("fee_basis")})),
        "dqv:hasQualityAnnotation": F.when(full(c("data_limits")), _typed("dqv:QualityAnnotation", **{"oa:bodyValue": c("data_limits"), "kdp:assertedBy": F.lit("provider")})),
        "dcat:distribution": F.when((c("list_type") == "FILE") & (full(c("file_data_name")) | (F.size("formats") > 0)), file),
        "dcatkr:numberOfRequest": F.when(api, c("download_count")),
        "dcatkr:apiType": F.when(api, c("api_type")),
        "dcatkr:numberOfRequestLimit": F.when(api, limit),
        "dcatkr:requestLimitNote": F.when(api & limit.isNull() & full(c("traffic")), c("traffic")),
    }
    return {k: as_json(v) for k, v in values.items()}


def dataset_document(base: str, snapshot: str) -> Column:
    """A listing as a linked-data object: what isn't stated is left out, but for two properties that are null on purpose."""
    c, api = F.col, F.col("list_type") == "API"
    of_cycle = F.try_element_at(F.create_map(*[F.lit(x) for k, v in FREQUENCIES.items() for x in (k, FREQUENCY + v)]), F.col("update_cycle"))
    raw_cycle = as_json(c("update_cycle_raw"))
    values = {
        "@context": as_json(F.lit(f"{base.rstrip('/')}/context/catalog/1.0")),
        "@id": as_json(uri(base, "dataset", c("list_key"))),
        "@type": F.when(api, F.lit('["dcat:Dataset","dcat:DataService"]')).otherwise(F.lit('"dcat:Dataset"')),
        "identifier": as_json(c("list_key")),
        "dct:language": F.lit('"ko"'),
        "title": as_json(c("title")),
        "description": as_json(c("description")),
        "keyword": as_json(F.when(F.size("keywords") > 0, c("keywords"))),
        "theme": as_json(c("theme_raw")),
        "issued": as_json(c("created_date")),
        "modified": as_json(c("modified_date")),
        "landingPage": as_json(c("list_url")),
        "publisher": as_json(_typed("foaf:Agent", **{"foaf:name": c("org_name"), "kdp:orgCode": c("org_code")}), nulls=True),
        "accrualPeriodicity": F.coalesce(F.concat(F.lit("["), raw_cycle, F.lit(","), as_json(F.when(of_cycle.isNotNull(), F.struct(of_cycle.alias("@id")))), F.lit("]")), raw_cycle),
        "license": as_json(c("license_raw")),
        "spatial": as_json(c("spatial_raw")),
        "temporal": as_json(c("temporal_raw")),
        "kdp:listType": as_json(c("list_type")),
        "kdp:listKey": as_json(c("list_key")),
        "kdp:recordId": as_json(c("record_id")),
        "kdp:evidenceLevel": F.lit('"CATALOG_METADATA_ONLY"'),
        "kdp:qualityTier": F.lit("null"),
        "kdp:diagnosticMaturity": F.lit("null"),
        "kdp:catalogMetadataCompleteness": as_json(F.struct(c("score").alias("kdp:score"), c("profile").alias("kdp:profile"), c("rule").alias("kdp:rule"))),
        "kdp:sourceSnapshot": as_json(F.lit(snapshot)),
        "kdp:catalogRecord": as_json(record_uri(base, snapshot, c("record_id"))),
    }
    return json_object(values | _extension())


def record_document(base: str, snapshot: str) -> Column:
    """A listing's entry in the catalog of a month, apart from the dataset itself."""
    c = F.col
    fields = {
        "@context": F.lit(f"{base.rstrip('/')}/context/catalog/1.0"),
        "@id": record_uri(base, snapshot, c("record_id")),
        "@type": F.lit("dcat:CatalogRecord"),
        "foaf:primaryTopic": F.struct(uri(base, "dataset", c("list_key")).alias("@id")),
        "modified": c("modified_date"),
        "kdp:listType": c("list_type"),
        "kdp:sourceSnapshot": F.lit(snapshot),
        "kdp:sourceRowNo": c("source_row_no"),
    }
    return as_json(F.struct(*[v.alias(k) for k, v in fields.items()]), nulls=True)


def issue_document(base: str, snapshot: str) -> Column:
    """An issue as an annotation of its dataset, or of the catalog where it is found throughout (null list_key)."""
    c, catalog = F.col, catalog_uri(base, snapshot)
    fields = {
        "@id": F.concat(F.lit(f"{catalog}/annotation/"), c("issue_id").cast("string")),
        "@type": F.lit("dqv:QualityAnnotation"),
        "oa:hasTarget": F.struct(c("field").alias("kdp:field"), F.coalesce(uri(base, "dataset", c("list_key")), F.lit(catalog)).alias("@id")),
        "oa:hasBody": F.struct(c("issue_type").alias("kdp:issueType"), c("source_value").alias("kdp:sourceValue"), c("confidence").alias("kdp:confidence")),
        "oa:motivatedBy": F.lit("dqv:qualityAssessment"),
        "prov:wasGeneratedBy": _typed("prov:Activity", **{"kdp:detectionRule": c("detection_rule"), "prov:endedAtTime": c("detected_at")}),
        "kdp:reviewStatus": c("review_status"),
        "kdp:resolutionStatus": c("resolution_status"),
        "kdp:sourceSnapshot": F.lit(snapshot),
    }
    return as_json(F.struct(*[v.alias(k) for k, v in fields.items()]), nulls=True)


def numbered_issues(issues: DataFrame, rule: str, detected_at: str) -> DataFrame:
    """Issues with an id of their content and the provenance that documents and exports state; none is reviewed yet."""
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("record_id", "issue_type", "field", "source_value")]
    return issues.select(short_id(*key).alias("issue_id"), "*", F.lit(rule).alias("detection_rule"), F.lit(detected_at).alias("detected_at"), F.lit("UNREVIEWED").alias("review_status"), F.lit("OPEN").alias("resolution_status"))


def catalog_document(totals: DataFrame, base: str, snapshot: str, processed_at: str) -> DataFrame:
    """totals: one row with n_datasets, level, quality_index, discoverability, indicators (struct) -> one row: the catalog as a linked-data object.

    Maturity and index are stated only where the level is DM-0.
    """
    c, catalog, stated = F.col, catalog_uri(base, snapshot), F.col("level") == "DM-0"
    found = F.struct(F.lit("catalog-discoverability-v1.0").alias("kdp:rule"), c("discoverability").alias("kdp:catalogMetadataReadinessScore"), F.to_json("indicators").alias("kdp:indicatorsJson"))
    values = {
        "@context": F.lit(f"{base.rstrip('/')}/context/catalog/1.0"),
        "@id": F.lit(catalog),
        "@type": F.lit("dcat:Catalog"),
        "dct:language": F.lit("ko"),
        "issued": F.lit(processed_at[:10]),
        "kdp:processedAt": F.lit(processed_at),
        "kdp:datasetCount": c("n_datasets"),
        "kdp:evidenceLevel": F.lit("CATALOG_METADATA_ONLY"),
        "kdp:airdAssessment": F.struct(F.lit(f"{catalog}/assessment").alias("@id")),
        "kdp:catalogDiscoverability": found,
        "aird:diagnosticMaturity": F.when(stated, c("level")),
        "aird:qualityIndexMMI": F.when(stated, c("quality_index")),
        "aird:dataType": F.when(stated, F.lit("STRUCT")),
        "kdp:airdState": F.when(stated, F.lit("Discoverable")),
    }
    return totals.select(json_object({k: as_json(v) for k, v in values.items()}).alias("document"))


def write_bulk(df: DataFrame, key: str, document: Column, path: str) -> None:
    """Gzipped lines in key order: files follow each other in order of their names."""
    df.select(F.col(key), document.alias("value")).orderBy(key).select("value").write.mode("overwrite").option("compression", "gzip").text(path)


def bulk_manifest(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """file, lines, bytes of each export."""
    out = None
    for name, path in paths.items():
        size = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
        lines = spark.read.text(path).agg(F.count("*").alias("lines"))
        row = size.join(lines, F.lit(True)).select(F.lit(name).alias("file"), "lines", "bytes")
        out = row if out is None else out.unionByName(row)
    return out


def stamped(df: DataFrame, snapshot: str, schema_version: str, rules: list[str]) -> DataFrame:
    """Provenance on every row: snapshot, schema version and sorted distinct rules."""
    return df.withColumns({"snapshot": F.lit(snapshot), "schema_version": F.lit(schema_version), "rules": F.array(*[F.lit(r) for r in sorted(set(rules))])})
