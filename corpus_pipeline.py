"""The training-data pipeline: documents that pass, cleaned, mixed and encoded.

Each stage takes all that its predecessor kept and returns the columns of documents; the last adds the ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.llm.jaccard import jaccard_components
from catalogspark.llm.mixing import mix_sources
from catalogspark.llm.pii import redact_found
from catalogspark.llm.queries_toxicity import trained
from catalogspark.llm.sentencepiece import encode, load_pieces
from catalogspark.llm.toxicity import score
from catalogspark.sources.shared import drop_written, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't predict as toxic.

    Null and empty texts score as the model's bias does, the (low) share of label 1, and stay; repeated rows score equal and share their
    fate; null ids stay; an empty table gives none; texts are scored whole; extra columns go.
    """
    return score(docs, trained(spark, sf_dir), into="toxicity_score").where(F.col("toxicity_score") < 0.5).select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one document: the smallest doc_id (null ids last), then the smallest hash of the text.

    A document is an id with a text: rows with one id and unlike texts are documents of their own, rows alike in both are one (the least
    row of them stays, by its columns in order), null ids take part as others do. Null, empty and blank texts have no copies but rows with
    the same id and text. An empty table gives none; texts are compared whole; extra columns go.
    """
    row = F.xxhash64("doc_id", "text")  # two documents of one hash stay both, or at worst leave one copy more
    keyed = docs.select(*COLUMNS, row.alias("_row"))
    groups = written(jaccard_components(keyed.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id"), "groups")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    named = groups.distinct().join(keyed.select("_row", "doc_id").distinct(), "_row")
    kept = named.groupBy("component_id").agg(F.min(rank)["_row"].alias("_row")).select("_row").distinct()
    lost = written(groups.select("_row").distinct().join(kept, "_row", "left_anti"), "copies")
    twice = written(keyed.groupBy("_row").count().where("count > 1").select("_row"), "repeated")
    left = keyed.join(lost, "_row", "left_anti")
    if twice.isEmpty():
        return left.select(*COLUMNS)
    again = left.join(twice, "_row", "left_semi").groupBy("_row").agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*")
    return left.join(twice, "_row", "left_anti").select(*COLUMNS).unionByName(again)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data replaced by its kind; n_chars follows the text.

    Every row stays, with a null n_chars where the text is null; repeated rows stay alike; an empty table gives none; texts are searched
    whole; extra columns go, one named pii among them.
    """
    return redact_found(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source as often as its weight asks: a row for each use of a document, none left out.

    A null source is a source; null and empty texts count as one token; repeated rows are used together; an empty table gives none; extra
    columns go.
    """
    return mix_sources(docs.select(*COLUMNS)).select(*COLUMNS)


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The likeliest pieces of each whole text, as ids: none for null and empty texts; every row stays; an empty table gives none; extra columns go."""
    return encode(docs.select(*COLUMNS), load_pieces(spark)).select(*COLUMNS, "ids")


STAGES = [
    ("toxicity", keep_civil),
    ("near_copies", keep_one_of_near_copies),
    ("personal_data", redact_personal_data),
    ("mixing", mix),
    ("sentencepiece", to_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_written(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
