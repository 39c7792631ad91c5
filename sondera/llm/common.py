"""What the training-data operators share: shared scratch tables, text batches, row keys."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  binds pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once; longer texts are cut up by the operators.
CHUNK_BYTES = 1 << 21


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own only where none is named (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = "file://" + os.path.join(tempfile.gettempdir(), "sondera-scratch")
    return root.rstrip("/")


def _collect_garbage(spark: SparkSession) -> None:
    """Shuffle files of finished jobs go as soon as nothing refers to them."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, and a lost
    executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=partition_by)
    _collect_garbage(spark)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def row_key(*cols: str) -> Column:
    """A key of 128 bits (binary) for some columns of a row together, such as its id and text. Rows
    that repeat share it, and whatever holds for one of them holds for the other; equal ids with
    different texts stay apart."""
    half = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), *cols)), 16, "0")
    return F.unhex(F.concat(half(1), half(2)))


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores in front until none clashes with a column (case apart)."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but the six ASCII white-space characters, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows out evenly where a table has come in fewer splits than there are cores."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about `limit` bytes of the text column."""
    start = total = 0
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if batch.num_rows > start:
        yield batch.slice(start)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All of start, start+1, ... for each run, one after another."""
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


def covered(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Mask of length n of what the half-open runs cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.asarray(lo, np.int64), 1)
    np.add.at(edge, np.asarray(hi, np.int64), -1)
    return np.cumsum(edge[:-1]) > 0
