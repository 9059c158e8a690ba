"""Query op3: all documents as a mixed stream: each use of a document with its epoch, block and position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalogspark.llm.mixing import mix_sources
from catalogspark.sources.shared import table


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "source", "tokens", "epoch", "block", "position")


QUERIES = {"op3_source_mixing": op3_source_mixing}
ORACLES: dict = {}
