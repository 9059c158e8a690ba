"""Query pipeline: the stages of corpus_pipeline.py over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpus_pipeline import run


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)


QUERIES = {"pipeline": pipeline}
ORACLES: dict = {}
