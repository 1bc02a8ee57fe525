"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Hadoop without its native library starts a process for each file and folder that it creates on a local disk; until that
#: runs its own program it counts as a second JVM. Other file systems take no notice.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "parquet.page.write-checksum.enabled": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a folder of our own only where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: on a cluster, intermediate tables need a folder that all of it shares")
        found = f"file://{tempfile.mkdtemp(prefix='orthoplan-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once, written as Parquet to the shared folder and read again: cuts lineage, survives lost executors.

    On a local disk without a second file of checksums beside each; the checksums of Parquet's pages are verified instead.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**PLAIN).parquet(path)
    return spark.read.schema(df.schema).option("parquet.page.verify-checksum.enabled", "true").parquet(path)


def removed(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes the files of written() tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
