"""Query op5: toxicity scores of all documents, learnt from the labels that are not held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.llm.toxicity import Machine, score, train
from catalogspark.sources.shared import table


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trained(spark: SparkSession, sf_dir: str) -> Machine:
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    return train(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)


def op5_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = score(table(spark, sf_dir, "documents").select("doc_id", "text"), trained(spark, sf_dir)).drop("text")
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op5_toxicity_fm": op5_toxicity_fm}
ORACLES: dict = {}
