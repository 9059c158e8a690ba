"""Filter interaction audit: what each filter removes after the others, in every order.

Four filters look at a text alone. The fifth, "same text as a smaller doc_id anywhere in the table", is an existential self-join: a row is marked
by a left-semi join on the text's hash, the exact text and the smaller doc_id. The right side is reduced to the smallest doc_id of each repeated text
before it is shuffled, and texts that hold over a HOT-th of all rows (at most HOT of them, so they are broadcast) are salted on both sides. The marked
rows are united with the other failures as (row, bit), the bits of a row are or-ed, and rows are counted by part and combination of bits. All
orders and steps are read from these at most 32 counts a part, so no order is run over the rows.

Defined results: a null text is empty, and empty texts are equal texts; a null doc_id is smaller or larger than nothing, so it neither fails the fifth
filter nor makes others fail; rows that share a doc_id aren't copies of one another; every row counts, repeated ones too; a null part is the empty
string; a document is good or toxic if any label row of its id says so, and neither without one or without an id; texts are read whole; an empty table gives no parts;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.sources.shared import written

FILTERS = "ABCDE"
#: A text of over one HOT-th of all rows is salted, into as many cells.
HOT = 256
_WORD_GAP = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> Column:
    """Bits 0 to 3: under 100 words; under 80 % distinct words; over 10 % capitals; a symbol of #$%&*|."""
    words = F.array_remove(F.split(text, _WORD_GAP), "")
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    sizes = lambda w: F.when(F.size(w) < 100, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(w)) < 80 * F.size(w), 2).otherwise(0)
    short = F.get(F.transform(F.array(words), sizes), F.lit(0))  # a bound variable: the words are made once
    return short + F.when(100 * capitals > 10 * F.length(text), 4).otherwise(0) + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)


def copies_of_smaller(rows: DataFrame, keep: list[str]) -> DataFrame:
    """rows(doc_id, h, text, ...) -> columns ``keep`` of the rows whose text a row of smaller doc_id holds as well."""
    first = rows.groupBy("h", "text").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    first = written(first.where("first < last"), "repeated_texts")
    total = first.agg(F.sum("n")).head()[0] or 0
    hot = F.broadcast(first.where(F.col("n") * HOT > total).select("h", F.lit(True).alias("hot")).distinct())  # fewer than HOT rows
    cells = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(HOT - 1))).otherwise(F.array(F.lit(0)))
    right = first.select("h", F.col("text").alias("t"), "first").join(hot, "h", "left").withColumn("cell", F.explode(cells)).alias("r")
    cell = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(HOT)).cast("int")).otherwise(0)
    left = rows.join(hot, "h", "left").withColumn("cell", cell).alias("l")
    same = (F.col("l.h") == F.col("r.h")) & (F.col("l.cell") == F.col("r.cell")) & (F.col("l.text") == F.col("r.t"))
    return left.join(right, same & (F.col("r.first") < F.col("l.doc_id")), "left_semi").select(*keep)


def failure_counts(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, mask (bit of each failed filter), n, good, toxic: counts of rows by combination of failures."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    # a row is known by its id, part and text's hash; rows alike in all are counted
    alone = written(rows.select("doc_id", "part", F.xxhash64("text").alias("h"), text_failures(F.col("text")).alias("bits")), "failures")
    hashed = rows.withColumn("h", F.xxhash64("text"))
    marked = copies_of_smaller(hashed, ["doc_id", "part", "h"]).distinct()
    failed = alone.select("doc_id", "part", "h", "bits", F.lit(1).cast("bigint").alias("n")).unionByName(marked.select("doc_id", "part", "h", F.lit(16).alias("bits"), F.lit(0).cast("bigint").alias("n")))
    masks = failed.groupBy("doc_id", "part", "h").agg(F.bit_or("bits").alias("mask"), F.sum("n").alias("n"))
    by_id = masks.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marks = labels.groupBy("doc_id").agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return by_id.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def orders_and_steps(counts: DataFrame) -> DataFrame:
    """failure_counts() -> for each part, order of filters and step what is kept, removed and so on."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    orders = list(map("".join, itertools.permutations(FILTERS)))
    steps = [{"filter_order": o, "step": k + 1, "bit": bit[o[k]], "before": sum(bit[x] for x in o[:k])} for o in orders for k in range(len(o))]
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, bit int, before int>>")
    each = counts.select("part", "mask", "n", "good", "toxic", F.explode(plan).alias("s")).select("part", "mask", "n", "good", "toxic", "s.*")
    fails = F.col("mask").bitwiseAND(F.col("bit")) > 0
    gone = F.col("mask").bitwiseAND(F.col("before")) > 0
    share = F.lit(len(orders)) / F.greatest(F.bit_count("mask"), F.lit(1))  # of all orders, those in which this filter comes first of the failed ones: whole for up to five
    total = lambda when, value, name: F.sum(F.when(when, value).otherwise(0)).cast("bigint").alias(name)
    return each.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone, F.col("n"), "kept"),
        total(fails & ~gone, F.col("n"), "removed"),
        total(fails & gone, F.col("n"), "redundant"),
        total(F.col("mask") == F.col("bit"), F.col("n"), "unique_fails"),
        total(fails & ~gone, F.col("good"), "good_lost"),
        total(fails & ~gone, F.col("toxic"), "toxic_lost"),
        total(fails, F.col("n") * share.cast("bigint"), "shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    return orders_and_steps(failure_counts(docs, labels, part))
