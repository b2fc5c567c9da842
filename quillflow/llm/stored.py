"""Intermediate tables that cut lineage and survive lost executors."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder of spark.checkpoint.dir. Where it is unset, a temporary one is set, but only for a session on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='quillflow-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def stored(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{_folders[-1]}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_folders = ["tables"]


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Intermediate tables that are written within it are deleted at its end; results must have been written by then."""
    _folders.append(f"tables-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{_folders.pop()}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
