"""Sources of the catalog: raw manifests, encodings, snapshots, profiles and reviewed side inputs."""

from __future__ import annotations

import csv
import hashlib
import re

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from catalogspark.functions import vocabulary as V
from catalogspark.functions.text import ttrim
from catalogspark.sources.shared import written


class SourceError(ValueError):
    """A source that must not be built from."""


def _plain(path) -> Column:
    """A file's path without the ways that readers write its scheme."""
    return F.regexp_replace(path, "^file:/+", "/")


@F.arrow_udf(T.BooleanType())
def _is_cp949(lines: pa.Array) -> pa.Array:
    def ok(line: bytes) -> bool:
        try:
            line.decode("cp949")
        except UnicodeDecodeError:
            return False
        return True

    return pa.array([ok(x) for x in lines.to_pylist()])


def detect_encodings(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, encoding: UTF-8 where every line is valid, else CP949 where every line decodes, else null.

    Files are read by lines, in splits; only lines of files that aren't UTF-8 go to Python. An empty file is UTF-8.
    """
    files = spark.read.format("binaryFile").load(paths).select("path")
    lines = spark.read.text(paths).select(_plain(F.col("_metadata.file_path")).alias("p"), "value")
    utf8 = lines.groupBy("p").agg(F.bool_and(F.expr("is_valid_utf8(value)")).alias("utf8"))
    rest = lines.join(utf8.where("not utf8").select("p"), "p").groupBy("p").agg(F.bool_and(_is_cp949(F.col("value").cast("binary"))).alias("cp949"))
    known = files.join(utf8, _plain("path") == F.col("p"), "left").drop("p").join(rest, _plain("path") == F.col("p"), "left")
    return known.select("path", F.when(F.coalesce("utf8", F.lit(True)), "UTF-8").when(F.col("cp949"), "CP949").alias("encoding"))


_MANIFEST = "path string, bytes bigint, sha256 string, lines bigint"
#: Bytes of a file that a task holds at a time.
_CHUNK = 8 << 20


def _digested(batches):
    """Each file read once as a stream: bytes, digest and lines (ended by \\n, \\r or both)."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            fs, at = pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
            digest, size, lines, last = hashlib.sha256(), 0, 0, b""
            with fs.open_input_stream(at, compression=None) as source:
                while chunk := source.read(_CHUNK):
                    digest.update(chunk)
                    size += len(chunk)
                    lines += chunk.count(b"\n") + chunk.count(b"\r") - (last + chunk).count(b"\r\n")
                    last = chunk[-1:]
            lines += last not in (b"", b"\n", b"\r")
            yield pa.RecordBatch.from_pylist([{"path": path, "bytes": size, "sha256": digest.hexdigest(), "lines": lines}], schema=pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string()), ("lines", pa.int64())]))


def manifest(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, bytes, sha256, lines of raw files of any size: a task reads a file as a stream and holds a chunk of it."""
    # names only, empty files too: no content is read for them
    names = [(re.sub("^file:///", "file:/", x),) for x in spark.read.format("binaryFile").load(paths).inputFiles()]
    files = spark.createDataFrame(names, "path string")
    return files.repartition(max(1, spark.sparkContext.defaultParallelism), "path").mapInArrow(_digested, _MANIFEST)


def changed_files(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose stored manifest has another hash: a re-run must stop on any."""
    return new.join(stored.select("path", F.col("sha256").alias("was")), "path").where(F.col("sha256") != F.col("was"))


_QUOTE = b'"'
_LINES = "file string, block bigint, i bigint, rec bigint, whole boolean, ends boolean, line string"


def _records_of(encoding: str):
    """Lines of splits in order, with the state that each split begins in -> lines that belong to records, numbered by records ended before."""

    def run(batches):
        here, number, ended, inside = None, 0, 0, False
        for batch in batches:
            rows = zip(*(batch.column(n).to_pylist() for n in ("file", "block", "line", "inside")), strict=True)
            out: list[tuple] = []
            for file, block, line, begins_inside in rows:
                if here != (file, block):
                    here, number, ended, inside = (file, block), 0, 0, begins_inside
                number += 1
                after = inside ^ bool(line.count(_QUOTE) & 1)
                if inside or after or line.strip(b"\r"):  # a blank line between records is none
                    out.append((file, block, number, ended, not inside and not after, not after, line.decode(encoding)))
                    ended += not after
                inside = after
            columns = list(zip(*out, strict=True)) or [()] * 7
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["file", "block", "i", "rec", "whole", "ends", "line"])

    return run


def csv_records(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """file, rec (0 is the header), record: the records of CSV files whose quoted fields may hold line ends, read in splits.

    Whether a split begins inside a quoted field is the parity of all quotes before it in its file: quotes are counted by split, and the states and
    record numbers follow from running sums over the few splits. Only records of several lines are put together by a shuffle.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(_plain(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    splits = lines.groupBy("file", "block").agg(F.sum(quotes).alias("q")).withColumn("inside", F.coalesce(F.sum("q").over(before), F.lit(0)) % 2 == 1)
    opened = lines.join(F.broadcast(splits.select("file", "block", "inside")), ["file", "block"])  # a row a split
    python_name = "cp949" if encoding == "CP949" else "utf-8"
    numbered = written(opened.select("file", "block", F.col("value").cast("binary").alias("line"), "inside").mapInArrow(_records_of(python_name), _LINES), "lines")
    ends = numbered.groupBy("file", "block").agg(F.count_if("ends").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = numbered.join(F.broadcast(ends.select("file", "block", "base")), ["file", "block"]).withColumn("rec", F.col("base") + F.col("rec"))
    text = lambda c: F.regexp_replace(c, "\r$", "")
    whole = placed.where("whole").select("file", "rec", text("line").alias("record"))
    pieces = placed.where("not whole").groupBy("file", "rec").agg(F.array_sort(F.collect_list(F.struct("block", "i", "line"))).alias("l"))
    return whole.unionByName(pieces.select("file", "rec", text(F.array_join("l.line", "\n")).alias("record")))


def read_csv(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """The records as text columns named by the header, and row_no: the header is 1, and rows are numbered over all files in order of their names.

    The rows are written once, so that what follows reads neither the raw files nor the quotes again. Files of unlike headers stop it.
    """
    records = written(csv_records(spark, path, encoding), "records")
    option = {"quote": '"', "escape": '"'}
    heads = records.where("rec = 0").select(F.regexp_replace("record", "^\ufeff", "").alias("h")).distinct().limit(2).collect()
    if len(heads) > 1:
        raise SourceError("files of unlike headers")
    if not heads:
        raise SourceError("no header")
    width = len(next(csv.reader([heads[0]["h"]])))
    fields = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(width)])
    row = spark.createDataFrame([(heads[0]["h"],)], "h string").select(F.from_csv("h", fields.simpleString()[7:-1].replace(":", " "), option).alias("r")).head()["r"]
    names = list(row)
    sizes = records.groupBy("file").agg((F.count("*") - 1).alias("n"))
    offset = F.coalesce(F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a file
    data = records.where("rec > 0").join(F.broadcast(sizes.withColumn("offset", offset)), "file")
    parsed = data.select((F.col("rec") + F.col("offset") + 1).alias("row_no"), F.from_csv("record", fields.simpleString()[7:-1].replace(":", " "), option).alias("r"))
    return written(parsed.select(*[F.col(f"r._{i}").alias(n) for i, n in enumerate(names)], "row_no"), "rows")


def read_snapshot(spark: SparkSession, path: str, encoding: str = "UTF-8", min_rows: int = 1) -> DataFrame:
    """The snapshot as text columns and row_no (the header is 1). Missing columns, blank keys and too few rows stop it."""
    df = read_csv(spark, path, encoding)
    missing = [c for c in V.SNAPSHOT_COLUMNS if c not in df.columns]
    if missing:
        raise SourceError(f"missing columns: {missing}")
    key = next(c for c, n in V.SNAPSHOT_COLUMNS.items() if n == "list_key")
    r = df.agg(F.count("*").alias("n"), F.count_if(F.coalesce(ttrim(F.col(f"`{key}`")), F.lit("")) == "").alias("blank")).head()
    if r["blank"]:
        raise SourceError(f"{r['blank']} rows without a key")
    if r["n"] < min_rows:
        raise SourceError(f"{r['n']} rows, at least {min_rows} expected")
    return df


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """The column-profile export with internal names, row_no and whole-number ordinals."""
    df = read_csv(spark, path)
    df = df.select("row_no", *[F.col(f"`{c}`").alias(n) for c, n in V.PROFILE_COLUMNS.items() if c in df.columns])
    return df.withColumn("ordinal", ttrim("ordinal").try_cast("int"))


def read_json_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A reviewed side input; a missing file is an empty table."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_withdrawn(spark: SparkSession, path: str) -> DataFrame:
    return read_json_or_empty(spark, path, "recordIds array<string>").select(F.explode("recordIds").alias("record_id"))


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    rows = read_json_or_empty(spark, path, "families map<string,struct<reviewStatus:string,note:string>>")
    return rows.select(F.explode("families").alias("family_id", "r")).select("family_id", F.col("r.reviewStatus").alias("review"))


def read_review_sheet(spark: SparkSession, path: str) -> DataFrame:
    """family_id and the first column whose name starts with verdict."""
    df = spark.read.option("header", True).csv(path)
    verdict = next(c for c in df.columns if c.startswith("verdict"))
    return df.select("family_id", F.col(f"`{verdict}`").alias("review"))


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("multiLine", True).json(path)
    return rows.select(F.explode("queries").alias("q")).select("q.*")


def read_cases(spark: SparkSession, folder: str) -> DataFrame:
    """case-*.json, a row a case with its file name, in order of names."""
    return spark.read.option("multiLine", True).option("pathGlobFilter", "case-*.json").json(folder).withColumn("file", F.col("_metadata.file_name")).orderBy("file")
