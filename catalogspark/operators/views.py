"""Views of listings: summaries, cards, lookups, family members and ingest reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from catalogspark.functions import vocabulary as V
from catalogspark.operators.quality import distribution, freshness


#: Fields that a card says are stated or not.
KEY_FIELDS = {"spatial_raw": "has_spatial", "temporal_raw": "has_temporal", "data_limits": "has_limits"}


def with_structure_flag(listings: DataFrame, coverage: DataFrame, key: str = "list_key") -> DataFrame:
    """Add structure_available: the key is covered, wholly or in part."""
    seen = coverage.where(F.col("coverage").isin("AVAILABLE", "PARTIAL")).select(key).distinct().withColumn("structure_available", F.lit(True))
    return listings.join(seen, key, "left").withColumn("structure_available", F.coalesce("structure_available", F.lit(False)))


def with_top_percent(rated: DataFrame) -> DataFrame:
    """rated(profile, filled, total, ...) with higher and rows: how many of its profile score better, of how many; typical: it has the mode."""
    d = distribution(rated).select("profile", "filled", "rows", "higher", (F.col("filled") == F.col("mode_filled")).alias("typical"))
    # one row for each profile and score; the planner broadcasts it where it is small
    return rated.join(d, ["profile", "filled"])


def _short() -> list[Column]:
    plain = [F.col(c) for c in ("record_id", "list_key", "list_type", "title", "theme_top", "org_name", "formats", "update_cycle", "modified_date")]
    return [*plain, F.transform("regions", lambda r: r["code"]).alias("regions"), F.struct("profile", "filled", "total", "score").alias("completeness"), F.col("list_url")]


def summary(listings: DataFrame) -> DataFrame:
    """The short form that search shows."""
    return listings.select(*_short())


def card(listings: DataFrame, ref_date: Column) -> DataFrame:
    """Summary with the field checklist, freshness, licence, limits and contact."""
    fresh = freshness(F.col("update_cycle"), F.to_date(F.col("modified_date").try_cast("date")), ref_date)
    more = [F.col("fields").alias("checklist"), fresh.alias("freshness"), F.col("license_code"), F.col("fee"), F.col("data_limits"), F.col("dept_phone")]
    return listings.select(*_short(), *more, *[F.col(c).isNotNull().alias(n) for c, n in KEY_FIELDS.items()])


def normalized_view(listings: DataFrame) -> DataFrame:
    return listings.drop("source_json", *[c for c in listings.columns if c.endswith("_count_raw") or c == "dept_phone_raw"])


def source_view(listings: DataFrame) -> DataFrame:
    """The untouched source row of each record, as columns of the original header."""
    schema = "struct<" + ",".join(f"`{h}`:string" for h in V.SNAPSHOT_COLUMNS) + ">"
    return listings.select("record_id", F.from_json("source_json", schema).alias("s")).select("record_id", "s.*")


def lookup(asked: DataFrame, listings: DataFrame) -> DataFrame:
    """asked(id) -> id, found, alternatives: an id that is no record id but a key gives the records of that key."""
    a = asked.select(F.col("id").cast("string").alias("id")).distinct()
    own = listings.select(F.col("record_id").cast("string").alias("id")).distinct().withColumn("found", F.lit(True))
    keyed = listings.select(F.col("list_key").cast("string").alias("id"), F.col("record_id").cast("string").alias("r"))
    a = a.join(own, "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    alt = a.where(~F.col("found")).join(keyed, "id").groupBy("id").agg(F.array_sort(F.collect_list("r")).alias("alternatives"))
    return a.join(alt, "id", "left")


def family_candidates(asked: DataFrame, families: DataFrame, members: DataFrame, listings: DataFrame, most: int = 10) -> DataFrame:
    """asked(record_id) -> its families with the first members by id and whether there are more."""
    of = asked.join(members.select("record_id", "family_id"), "record_id").join(families, "family_id")
    n = F.row_number().over(W.partitionBy("family_id").orderBy("record_id"))
    first = members.join(of.select("family_id").distinct(), "family_id", "left_semi").withColumn("n", n).where(F.col("n") <= most + 1)
    shown = first.join(listings.select("record_id", "title"), "record_id").groupBy("family_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("n", "record_id", "title"))), 1, most).alias("members"), (F.max("n") > most).alias("truncated")
    )
    return of.join(shown, "family_id")


def ingest_report(ingested: dict[str, DataFrame]) -> DataFrame:
    """One row: assets by status, tables, columns by example status, rejected rows by reason."""
    counted = lambda df, c: df.groupBy(F.col(c).alias("k")).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))))
    a = counted(ingested["assets"], "status").toDF("assets")
    c = counted(ingested["columns"], "example_status").toDF("columns")
    r = ingested["rejected"].agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("rejected"))
    t = ingested["tables"].agg(F.count("*").alias("tables"))
    return a.join(t, F.lit(True)).join(c, F.lit(True)).join(r, F.lit(True))


def worst(metrics: DataFrame, n: int = 5) -> DataFrame:
    """The queries of lowest ndcg among those with relevant documents, ties by id."""
    return metrics.where("relevant > 0").orderBy("ndcg", "query_id").limit(n)
