"""Tables in the folder that the whole cluster shares (``spark.checkpoint.dir``)."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where the session names none, a folder of our own in local mode and an error on a cluster, whose
    executors wouldn't see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="catalogspark-")
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/catalogspark-{uuid.uuid4().hex}-{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of df: write it as Parquet to the shared folder and read it again.

    An executor that is lost later costs nothing that was computed before this point.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let_shuffles_go(spark: SparkSession) -> None:
    """Have the driver look for tables that nothing refers to any more; Spark then deletes their shuffle files, which else stay until its heap fills."""
    gc.collect()
    spark._jvm.System.gc()


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a table made by written(), when nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/catalogspark-" in parent:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
