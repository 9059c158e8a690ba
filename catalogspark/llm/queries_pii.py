"""Query op6: personal data in all documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.llm.pii import BASE, find_pii
from catalogspark.sources.shared import table


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op6_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    of = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    return docs.select("doc_id", *[of(k) for k in BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"), F.size("pii").cast("bigint").alias("n_spans"))


QUERIES = {"op6_pii_anchors": op6_pii_anchors}
ORACLES: dict = {}
