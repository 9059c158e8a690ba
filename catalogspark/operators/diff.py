"""Month-over-month change feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.functions.vocabulary import TRACKED


def snapshot_diff(prev: DataFrame, cur: DataFrame, key: str, tracked: list[str] = TRACKED, identity: tuple[str, ...] = ("title", "org_name"), prev_missing: DataFrame | None = None, withdrawn: DataFrame | None = None) -> DataFrame:
    """record_id, status, changed_fields: one row for each record that differs between the snapshots.

    Absence alone is never withdrawal: only ids in withdrawn(record_id) are OFFICIALLY_WITHDRAWN. Ids in
    prev_missing(record_id) come back as REAPPEARED. Nulls equal nulls.
    """
    side = lambda df, s: df.select(F.col(key).alias("record_id"), F.struct(*tracked).alias(s))
    both = side(prev, "p").join(side(cur, "c"), "record_id", "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"p.{t}").eqNullSafe(F.col(f"c.{t}")), F.lit(t)) for t in tracked]))
    both = both.select("record_id", F.col("p").isNull().alias("new"), F.col("c").isNull().alias("gone"), changed.alias("changed")).where(F.col("new") | F.col("gone") | (F.size("changed") > 0))
    for name, ids in (("back", prev_missing), ("out", withdrawn)):
        if ids is None:
            both = both.withColumn(name, F.lit(False))
        else:
            both = both.join(ids.select(F.col("record_id"), F.lit(True).alias(name)).distinct(), "record_id", "left")
    moved = F.lit(len(identity) > 0)
    for i in identity:
        moved = moved & F.array_contains("changed", i)
    status = (
        F.when(F.col("new"), F.when(F.col("back"), "REAPPEARED").otherwise("ADDED"))
        .when(F.col("gone"), F.when(F.col("out"), "OFFICIALLY_WITHDRAWN").otherwise("MISSING_FROM_SNAPSHOT"))
        .when(moved, "POSSIBLE_IDENTITY_CHANGE")
        .otherwise("MODIFIED")
    )
    kept = F.when(~F.col("new") & ~F.col("gone"), F.col("changed"))
    return both.select("record_id", status.alias("status"), kept.alias("changed_fields"))


def described(feed: DataFrame, prev: DataFrame, cur: DataFrame, base_snapshot: str) -> DataFrame:
    """The feed with list_key, title and org_name of each record, as it stands now or, where it is gone, as it stood, and the base."""
    names = ["list_key", "title", "org_name"]
    side = lambda df, s: df.select("record_id", F.struct(*names).alias(s))
    both = feed.join(side(cur, "c"), "record_id", "left").join(side(prev, "p"), "record_id", "left").withColumn("d", F.coalesce("c", "p"))
    return both.select("record_id", "status", "changed_fields", *[F.col(f"d.{n}").alias(n) for n in names], F.lit(base_snapshot).alias("base_snapshot"))


def feed_summary(feed: DataFrame | None, spark) -> DataFrame:
    """One row: base snapshot, rows by status, and why there is no base where there is none."""
    if feed is None:
        feed = spark.createDataFrame([], "status string, base_snapshot string")
    counts = feed.groupBy("status").agg(F.count("*").alias("n"), F.max("base_snapshot").alias("b"))
    row = counts.agg(F.max("b").alias("base_snapshot"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("summary"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return row.withColumn("base_unavailable", F.when(F.col("base_snapshot").isNull(), "FIRST_SNAPSHOT_OR_DIFF_NOT_GENERATED"))


def carried_forward(new_feed: DataFrame, stored_feed: DataFrame) -> DataFrame:
    """On a rebuild of the same snapshot the stored feed is kept if it has any row."""
    return new_feed if stored_feed.isEmpty() else stored_feed
