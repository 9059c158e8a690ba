"""Catalog-wide reports: service counts, snapshot lag, safety-review sample, golden candidates and the build report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def service_counts(listings: DataFrame, coverage: DataFrame, key: str = "list_key", kind: str = "list_type", file_kind: str = "FILE") -> DataFrame:
    """One row: listings, file listings, and file listings with observed structure; shares have their denominators beside them."""
    seen = coverage.where(F.col("coverage").isin("AVAILABLE", "PARTIAL")).select(key).distinct().withColumn("seen", F.lit(True))
    rows = listings.select(key, kind).join(seen, key, "left")
    files = F.col(kind) == file_kind
    return rows.agg(F.count("*").alias("listings"), F.count_if(files).alias("files"), F.count_if(files & F.col("seen")).alias("observed"))


def lag_days(snapshot: Column, deployed: Column) -> Column:
    """Days from the first of the snapshot's month to deployment, at least 0."""
    return F.greatest(F.lit(0), F.datediff(deployed, F.to_date(F.concat(snapshot, F.lit("-01")))))


def safety_review_sample(columns: DataFrame, size: int = 100) -> DataFrame:
    """The first columns by table that were screened and aren't CLEAR, for people to look at: names and reasons, never values."""
    return columns.where("safety_status not in ('CLEAR', 'NOT_ASSESSED')").select("table_id", "ordinal", "name", "safety_status", "safety_reason").orderBy("table_id", "ordinal").limit(size)


def golden_candidates(ranked: DataFrame, relevant: DataFrame, most: int = 20) -> DataFrame:
    """query_id, rank, doc, auto: the top of each query with the automatic relevance flag, for review."""
    auto = relevant.select("query_id", "doc").distinct().withColumn("auto", F.lit(True))
    return ranked.where(F.col("rank") <= most).join(auto, ["query_id", "doc"], "left").select("query_id", "rank", "doc", F.coalesce("auto", F.lit(False)).alias("auto"))


def build_report(parts: dict[str, DataFrame]) -> DataFrame:
    """One row with a struct array for each stage's small result table."""
    out = None
    for name, df in parts.items():
        row = df.agg(F.sort_array(F.collect_list(F.to_json(F.struct(*df.columns)))).alias(name))
        out = row if out is None else out.join(row, F.lit(True))
    return out
