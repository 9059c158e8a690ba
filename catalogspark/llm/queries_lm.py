"""Query op2: language-model scores of all documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.llm.kneser_ney import score, train
from catalogspark.sources.shared import table


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def op2_lm_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    out = score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lm")
    return out.select("doc_id", "held_out", "lm.n_tokens", "lm.n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "lm.base_score", "lm.score")


QUERIES = {"op2_lm_kneser_ney": op2_lm_kneser_ney}
ORACLES: dict = {}
