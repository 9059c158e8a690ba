"""Counts by an axis, and pages of ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def by_axis(df: DataFrame, axis: Column, limit: int | None = None) -> DataFrame:
    """value, n: count descending, ties by value."""
    out = df.groupBy(axis.alias("value")).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "value").limit(limit) if limit else out


def by_token(df: DataFrame, array: Column, limit: int | None = None) -> DataFrame:
    return by_axis(df.select(F.explode(array).alias("t")), F.col("t"), limit)


def page(df: DataFrame, order: list[Column], offset: int, size: int, group: list[str] | None = None) -> DataFrame:
    """Rows offset + 1 to offset + size of each group, numbered, with has_more.

    The row after the page is fetched too, so the rest of the group is never counted.
    """
    if not group:
        # the first rows are found in each task and merged; only they are numbered
        df = df.orderBy(*order).limit(offset + size + 1)
    ranked = df.withColumn("row_no", F.row_number().over(W.partitionBy(*(group or [F.lit(0)])).orderBy(*order)).cast("bigint"))
    near = ranked.where(F.col("row_no") <= offset + size + 1)
    last = F.max("row_no").over(W.partitionBy(*(group or [F.lit(0)])))
    return near.withColumn("has_more", last > offset + size).where((F.col("row_no") > offset) & (F.col("row_no") <= offset + size))
