"""Query op9: ids of all documents by the lattice, decoded again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.llm.sentencepiece import decode, encode, load_pieces
from catalogspark.sources.shared import table


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = load_pieces(spark)
    docs = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces), pieces)
    return docs.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "ids", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))


QUERIES = {"op9_sentencepiece": op9_sentencepiece}
ORACLES: dict = {}
