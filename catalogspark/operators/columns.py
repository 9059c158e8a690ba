"""Search for column names that hold keywords, by an index of their short substrings.

Each distinct name is posted under its substrings of one, two and three characters. A keyword of up to two characters is such a substring; a longer one
reads the postings of its rarest three-character substrings only, intersects them, and is then looked for in the names that are left. So
keywords meet names by equi-joins, and work follows the postings read, not names times keywords.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalogspark.functions.text import ascii_lower, ttrim
from catalogspark.operators.bm25 import in_shards, shard_of
from catalogspark.sources.shared import written

#: Characters of a posted substring, at most; postings of a keyword that are read and intersected.
GRAM = 3
READ = 2
#: Names that are sought, sent to all tasks; more are met by a shuffle.
MOST_SENT = 500_000
#: What a search may ask for.
MOST_KEYWORDS, MOST_CHARS, MOST_PAGE = 5, 50, 100


def _grams(text: Column, n: int) -> Column:
    """The different substrings of n characters."""
    at = F.sequence(F.lit(1), F.length(text) - (n - 1))
    return F.array_distinct(F.transform(F.when(F.length(text) >= n, at).otherwise(F.array().cast("array<int>")), lambda i: F.substring(text, i, F.lit(n))))


def name_grams(index: DataFrame, slices: int | None = None) -> DataFrame:
    """index(list_key, column_name) -> gram, column_name: the postings of the different names, which are dealt to slices first."""
    names = index.select("column_name").distinct().where("column_name is not null")
    folded = (names if slices is None else names.repartition(slices, "column_name")).withColumn("f", ascii_lower(F.col("column_name")))
    return folded.select("column_name", F.explode(F.concat(*[_grams(F.col("f"), n) for n in range(1, GRAM + 1)])).alias("gram"))


def write_grams(index: DataFrame, path: str) -> None:
    """The postings in folders by substring: made once a release. Names are shuffled, not their many postings."""
    slices = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stored = name_grams(index, slices).withColumn("shard", shard_of(F.col("gram")))
    stored.sortWithinPartitions("shard", "gram", "column_name").write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(path)


def read_grams(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def checked(asked: DataFrame) -> DataFrame:
    """asked(query_id, keyword) -> query_id, keywords (trimmed, without blanks and repeats), error."""
    said = F.collect_list(F.when(ttrim(F.col("keyword")) != "", ttrim(F.col("keyword"))))
    q = asked.groupBy("query_id").agg(said.alias("k"))
    long = F.exists("k", lambda k: F.length(k) > MOST_CHARS)
    error = F.when(F.size("k") == 0, "no keywords").when(F.size("k") > MOST_KEYWORDS, f"more than {MOST_KEYWORDS} keywords").when(long, f"a keyword of over {MOST_CHARS} characters")
    return q.select("query_id", F.array_distinct("k").alias("keywords"), error.alias("error"))


def names_with(keywords: DataFrame, grams: DataFrame) -> DataFrame:
    """keywords(keyword), grams as of name_grams() or read_grams() -> keyword, column_name of every name that holds the keyword, ASCII case aside."""
    k = keywords.select("keyword").distinct().withColumn("f", ascii_lower(F.col("keyword")))
    parts = F.when(F.length("f") < GRAM, F.array("f")).otherwise(_grams(F.col("f"), GRAM))
    asked = k.select("keyword", "f", F.explode(parts).alias("gram"))
    if "shard" in grams.columns:
        grams = in_shards(grams, asked.select(F.col("gram").alias("term")))
    grams = grams.join(asked.select("gram").distinct(), "gram", "left_semi")
    sizes = grams.groupBy("gram").agg(F.count("*").alias("names"))
    rare = F.row_number().over(W.partitionBy("keyword").orderBy("names", "gram"))
    known = asked.join(sizes, "gram", "left").withColumns({"rare": rare, "lost": F.max(F.col("names").isNull()).over(W.partitionBy("keyword"))})
    read = known.where((F.col("rare") <= READ) & ~F.col("lost")).select("keyword", "f", "gram")
    need = read.groupBy("keyword").agg(F.count("*").alias("need"))
    met = read.join(grams.select("gram", "column_name"), "gram").groupBy("keyword", "f", "column_name").agg(F.count("*").alias("n")).join(need, "keyword")
    return met.where((F.col("n") == F.col("need")) & F.contains(ascii_lower(F.col("column_name")), F.col("f"))).select("keyword", "column_name")


def column_search(asked: DataFrame, index: DataFrame, grams: DataFrame | None = None, evidence: int = 5) -> DataFrame:
    """asked(query_id, keyword), index(list_key, column_name) -> query_id, list_key, matched: every key that has, for each keyword, a column that holds it.

    matched has each keyword in the order of the query, with the first ``evidence`` names of the key that hold it.
    """
    good = checked(asked).where("error is null")
    each = good.select("query_id", F.size("keywords").alias("need"), F.posexplode("keywords").alias("at", "keyword"))
    met = names_with(each, name_grams(index) if grams is None else grams)
    hits = each.join(met, "keyword").join(index.select("list_key", "column_name").distinct(), "column_name")
    # ranks are limited in each task before the shuffle, so a key of any number of columns gathers a few
    place = F.row_number().over(W.partitionBy("query_id", "list_key", "at").orderBy("column_name"))
    few = hits.withColumn("place", place).where(F.col("place") <= evidence)
    one = few.groupBy("query_id", "need", "list_key", "at", "keyword").agg(F.array_sort(F.collect_list("column_name")).alias("columns"))
    found = one.groupBy("query_id", "need", "list_key").agg(F.array_sort(F.collect_list(F.struct("at", "keyword", "columns"))).alias("m"))
    return found.where(F.size("m") == F.col("need")).select("query_id", "list_key", F.transform("m", lambda x: F.struct(x["keyword"], x["columns"])).alias("matched"))


def write_names(index: DataFrame, path: str) -> None:
    """index(list_key, names array<string>): the different names of each key as a row, made once a release; a key may have several rows."""
    index.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """list_key, column_name."""
    return spark.read.parquet(path).select("list_key", F.explode("names").alias("column_name"))


def column_pages(asked: DataFrame, index: DataFrame, grams: DataFrame, listings: DataFrame, size: int = 20, evidence: int = 5) -> DataFrame:
    """column_page() of column_search(): which keys match is found from keywords alone, and evidence is gathered for the keys of the pages only."""
    good = checked(asked).where("error is null")
    each = written(good.select("query_id", F.size("keywords").alias("need"), F.posexplode("keywords").alias("at", "keyword")), "keywords")
    met = written(names_with(each, grams).groupBy("column_name").agg(F.collect_list("keyword").alias("k")), "names")
    # the index stays where it is as long as the names that are sought fit a broadcast
    names = F.broadcast(met) if met.count() <= MOST_SENT else met
    # a key's keywords are made one in each task before the shuffle
    has = index.join(names, "column_name").select("list_key", F.explode("k").alias("keyword")).distinct()
    found = has.join(each, "keyword").groupBy("query_id", "need", "list_key").agg(F.count("*").alias("n")).where("n = need")
    page = written(column_page(found.select("query_id", "list_key"), listings, size), "page")
    hits = index.join(F.broadcast(page.select("list_key").distinct()), "list_key", "left_semi").join(names, "column_name").select("list_key", "column_name", F.explode("k").alias("keyword")).distinct()
    place = F.row_number().over(W.partitionBy("list_key", "keyword").orderBy("column_name"))
    few = hits.withColumn("p", place).where(F.col("p") <= evidence).groupBy("list_key", "keyword").agg(F.array_sort(F.collect_list("column_name")).alias("columns"))
    matched = page.select("query_id", "list_key").join(each, "query_id").join(few, ["list_key", "keyword"])
    matched = matched.groupBy("query_id", "list_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "keyword", "columns"))), lambda x: F.struct(x["keyword"], x["columns"])).alias("matched"))
    return page.join(matched, ["query_id", "list_key"]).select("query_id", "place", "list_key", "record_id", "matched")


def column_page(found: DataFrame, listings: DataFrame, size: int = 20) -> DataFrame:
    """The first keys of each query, answered with a file listing of the key; keys without one leave a gap, as the page is cut before."""
    size = max(1, min(size, MOST_PAGE))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("list_key"))
    files = listings.where("list_type = 'FILE'").groupBy("list_key").agg(F.min("record_id").alias("record_id"))
    return found.withColumn("place", place).where(F.col("place") <= size).join(files, "list_key").select("query_id", "place", "list_key", "record_id", *[c for c in found.columns if c == "matched"])


def column_totals(asked: DataFrame, found: DataFrame, observed: DataFrame, listings: DataFrame, size: int = 20) -> DataFrame:
    """A row a query: its error, or how many keys match, whether a page leaves some out, and how much was searched: keys observed of all file listings."""
    size = max(1, min(size, MOST_PAGE))
    n = found.groupBy("query_id").agg(F.count("*").alias("n"))
    searched, files = observed.select("list_key").distinct().count(), listings.where("list_type = 'FILE'").count()
    good = F.col("error").isNull()
    total = F.when(good, F.coalesce("n", F.lit(0).cast("bigint")))
    out = checked(asked).join(n, "query_id", "left").withColumn("total", total)
    return out.select("query_id", "error", "total", (F.col("total") > size).alias("has_more"), F.when(good, F.lit(searched).cast("bigint")).alias("searched"), F.when(good, F.lit(files).cast("bigint")).alias("file_listings"))
