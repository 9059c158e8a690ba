"""Query op7: all documents as GIF media, read back with colour histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.llm.gif import load_gif, store_gif
from catalogspark.sources.shared import table


def op7_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_gif(store_gif(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    payload = F.aggregate("image.frames", F.lit(bytearray()), lambda a, f: F.concat(a, f["samples"]))
    total = F.aggregate(
        F.transform("image.frames", lambda f: f["histogram"]),
        F.array_repeat(F.lit(0).cast("bigint"), 64),
        lambda a, h: F.zip_with(a, h, lambda x, y: x + y),
    )
    bins = F.filter(F.transform(total, lambda n, i: F.when(n > 0, F.concat_ws(":", i, n))), lambda x: x.isNotNull())
    read = docs.select("doc_id", "media", payload.alias("payload"), F.concat_ws("|", F.size("image.frames"), F.array_join(bins, ",")).alias("feature"), "image.note")
    return read.select(
        "doc_id",
        F.regexp_extract("note", r"n_bytes=(\d+)", 1).cast("bigint").alias("n_bytes"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


QUERIES = {"op7_gif_media": op7_gif_media}
ORACLES: dict = {}
