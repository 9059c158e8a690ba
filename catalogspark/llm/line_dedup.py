"""Line dedup over a whole table, in DataFrame functions only: keep bitmaps instead of texts.

Lines become narrow rows (document, position, 128-bit hash of the key). They are range-partitioned by hash and sorted by hash, then by document (largest
first) and position, and one pass over each partition streams them: the first document of a hash is the one that keeps its lines, the dense rank
counts its documents. A hash that holds over a HOT-th of all lines (fewer than HOT hashes, so they are broadcast) stays out of this: its documents are
counted with partial aggregation and its lines are judged where they are. What is to go comes back as positions, which each document packs into
a bitmap of run lengths: [kept, dropped, kept, ...], so a document without repeated lines is one number.

Defined results: a null or empty text is one empty line; rows that share a doc_id (null ids among them, as the smallest id) are one document when
documents are counted and the largest is chosen; bitmaps are one for each different (doc_id, text); repeated rows share theirs; a line that
repeats inside a document counts once there and goes or stays with all its places; texts are read whole; an empty table gives no bitmaps; columns of
docs stay when bitmaps are applied, but one with the new one's name is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogspark.sources.shared import drop_written, written

#: A key of over one HOT-th of all lines, and of over HOT_LINES lines, is judged without gathering its lines.
HOT = 1 << 14
HOT_LINES = 10_000
#: Bits of a hash that are counted first, to find the keys that may be hot.
_BITS = 18
_BLANK = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def whole_text(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def line_key(line: Column) -> Column:
    """The line without blanks at its ends and with A-Z in lower case."""
    bare = F.trim(line, F.lit(_BLANK))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def _lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """doc_id, th (hash of the text), pos, h, g (two hashes of the key): the lines that are long enough to count."""
    rows = docs.select("doc_id", whole_text().alias("text"))
    each = rows.select("doc_id", text_key(F.col("text")).alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = each.select("doc_id", "th", "pos", line_key(F.col("line")).alias("key"))
    return keyed.where(F.length("key") >= least_chars).select("doc_id", "th", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(7), "key").alias("g"))


def _hot(lines: DataFrame) -> DataFrame:
    """h, g of the keys that hold over a HOT-th of all lines: exact, from the counts of the hash's first bits, and fewer than HOT rows."""
    total = lines.count()
    much = (F.col("n") * HOT > total) & (F.col("n") > HOT_LINES)
    top = F.shiftrightunsigned("h", 64 - _BITS).alias("top")
    maybe = lines.groupBy(top).agg(F.count("*").alias("n")).where(much).select("top")
    return lines.withColumn("top", top).join(F.broadcast(maybe), "top", "left_semi").groupBy("h", "g").agg(F.count("*").alias("n")).where(much).select("h", "g")


def dropped_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """doc_id, th, pos: lines whose key is in at least ``least_docs`` documents, but for those of the largest doc_id that holds it."""
    lines = written(_lines(docs, least_chars), "lines")
    hot = F.broadcast(written(_hot(lines), "hot_keys"))
    doc = F.struct(F.col("doc_id").isNotNull(), "doc_id")  # null ids come first
    of_hot = lines.join(hot, ["h", "g"])
    held = of_hot.groupBy("h", "g", "doc_id").agg(doc.alias("doc")).groupBy("h", "g").agg(F.count("*").alias("n_docs"), F.max("doc").alias("largest"))
    many = F.broadcast(held.where(F.col("n_docs") >= least_docs))  # fewer than HOT rows
    earlier = of_hot.join(many, ["h", "g"]).where(doc < F.col("largest"))

    largest_first = F.desc_nulls_last("doc_id")
    cold = lines.join(hot, ["h", "g"], "left_anti").repartitionByRange("h", "g").sortWithinPartitions("h", "g", largest_first, "pos")
    key = Window.partitionBy("h", "g")
    streamed = cold.withColumn("at", F.dense_rank().over(key.orderBy(largest_first))).withColumn("n_docs", F.max("at").over(key))
    later = streamed.where((F.col("at") > 1) & (F.col("n_docs") >= least_docs))
    return earlier.select("doc_id", "th", "pos").unionByName(later.select("doc_id", "th", "pos"))


def _once(value: Column, use) -> Column:
    """use(value) with value evaluated once: a bound variable."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def run_lengths(dropped: Column, n_lines: Column) -> Column:
    """Sorted positions of dropped lines -> [kept, dropped, kept, ..., kept] lines in a row."""

    def runs(d: Column) -> Column:
        starts = F.filter(d, lambda x, i: (i == 0) | (F.get(d, i - 1) < x - 1))
        ends = F.filter(d, lambda x, i: (i == F.size(d) - 1) | (F.get(d, i + 1) > x + 1))

        def numbers(r: Column) -> Column:
            after = lambda i: F.coalesce(F.get(r["ends"], i - 1) + 1, F.lit(0))  # noqa: E731  the line after run i - 1
            pairs = F.transform(r["starts"], lambda s, i: F.array(s - after(i), F.get(r["ends"], i) - s + 1))
            return F.concat(F.flatten(pairs), F.array(n_lines - after(F.size(r["ends"]))))

        return _once(F.struct(starts.alias("starts"), ends.alias("ends")), numbers)

    return _once(dropped, runs)


def keep_bitmaps(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """doc_id, th, keep: the run lengths of each different document, by id and hash of the text."""
    text = whole_text()
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    heads = docs.select("doc_id", text_key(text).alias("th"), F.lit(None).cast("int").alias("pos"), n_lines.alias("n_lines"))
    gone = dropped_lines(docs, least_chars, least_docs).withColumn("n_lines", F.lit(None).cast("int"))
    each = heads.unionByName(gone).groupBy("doc_id", "th").agg(F.collect_set("pos").alias("dropped"), F.max("n_lines").alias("n_lines"))
    return each.select("doc_id", "th", run_lengths(F.array_sort("dropped"), F.col("n_lines")).alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """The lines of text that the run lengths keep."""
    flags = F.flatten(F.transform(keep, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    return _once(flags, lambda f: F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: F.get(f, i)), "\n"))


def with_keep(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, into: str = "keep") -> DataFrame:
    """docs with the bitmap of each row's text."""
    bitmaps = keep_bitmaps(docs, least_chars, least_docs).select(F.struct("doc_id", "th").alias("_of"), F.col("keep").alias("_keep"))
    keyed = docs.drop(into).withColumn("_row", F.struct("doc_id", text_key(whole_text()).alias("th")))
    return keyed.join(bitmaps, keyed["_row"].eqNullSafe(bitmaps["_of"])).drop("_row", "_of").withColumnRenamed("_keep", into)
