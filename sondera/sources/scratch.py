"""Tables that an operator writes for itself, in the folder that the whole cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Without it only a local session has one, its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "sondera-shared")
    return root.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def folder(spark: SparkSession, name: str):
    """A new shared folder, deleted with all it holds at the end."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        delete(spark, path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written and read back: a small result whose makings can go."""
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
