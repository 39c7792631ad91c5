"""Keyed state on streams: the first rows of each key, and reservoirs, held in list state.

A key's state never holds more than `cap` rows, whatever comes in, and what a trigger gives out is the
key's whole list, so a sink that keeps the last list of a key has the batch result of all rows so far,
in whatever order they came. State that no row has touched for `ttl_ms` goes (0: never).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.ipc  # noqa: F401  binds pa.ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from ..operators.replay import priority
from ..sources import io

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Buckets that keys are dealt to by their hash; a stream's for good.
BUCKETS = 256


class Least(StatefulProcessor):
    """The `cap` rows of a key that come first by (rank, item); a row that comes again counts once."""

    def __init__(self, cap: int, rank, ttl_ms: int = 0):
        self.cap, self.rank, self.ttl = cap, rank, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", StructType([StructField("rank", self.rank), StructField("item", LongType())]), self.ttl or None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {tuple(x) for x in self.held.get()} if self.held.exists() else set()
        for b in rows:
            held = set(sorted(held | set(zip(b["rank"].tolist(), b["item"].tolist())))[: self.cap])
        kept = sorted(held)
        self.held.put(kept)
        yield pd.DataFrame({"key": [key[0]], "items": [[x[1] for x in kept]]})

    def close(self) -> None:
        pass


class LeastOfMany(StatefulProcessor):
    """The same for all keys of a bucket at once, without a time to live: a trigger's cost is of its rows,
    not a call for each key. The state is one Arrow table (key, rank, item) of `cap` rows a key at most."""

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", StructType([StructField("rows", BinaryType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([self.first(b[["key", "rank", "item"]]) for b in rows], ignore_index=True)
        touched = new["key"].unique()
        if self.held.exists():
            new = pd.concat([pa.ipc.open_stream(self.held.get()[0]).read_pandas(), new], ignore_index=True)
        kept = self.first(new)
        out = pa.BufferOutputStream()
        table = pa.Table.from_pandas(kept, preserve_index=False)
        with pa.ipc.new_stream(out, table.schema) as writer:
            writer.write_table(table)
        self.held.update((out.getvalue().to_pybytes(),))
        kept = kept[kept["key"].isin(touched)]
        at = np.flatnonzero(np.r_[True, kept["key"].to_numpy()[1:] != kept["key"].to_numpy()[:-1]])
        yield pd.DataFrame({"key": kept["key"].to_numpy()[at], "items": np.split(kept["item"].to_numpy(), at[1:])})

    def first(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.drop_duplicates().sort_values(["key", "rank", "item"]).groupby("key", dropna=False).head(self.cap)

    def close(self) -> None:
        pass


def _least(rows: DataFrame, cap: int, rank, ttl_ms: int) -> DataFrame:
    """key, items of rows (key, rank, item). Without a time to live keys are met in BUCKETS."""
    if ttl_ms:
        return rows.groupBy("key").transformWithStateInPandas(Least(cap, rank, ttl_ms), "key string, items array<long>", "Update", "ProcessingTime")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int"))
    return rows.groupBy("bucket").transformWithStateInPandas(LeastOfMany(cap), "key string, items array<long>", "Update", "None")


def first_rows(df: DataFrame, key: str, order: str, cap: int, ttl_ms: int = 0) -> DataFrame:
    """key, items: of each key its first `cap` values of a whole number, in order: a quota a speaker."""
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("rank"), F.col(order).cast("long").alias("item"))
    return _least(rows, cap, LongType(), ttl_ms)


def reservoir(df: DataFrame, key: str, item: str, cap: int = 500, seed: int = 0, ttl_ms: int = 0) -> DataFrame:
    """key, items: the reservoir of replay.py (whole-number items) kept up to date on a stream."""
    rows = df.select(F.col(key).cast("string").alias("key"), priority(seed, key, item).alias("rank"), F.col(item).cast("long").alias("item"))
    return _least(rows, cap, StringType(), ttl_ms)


def run_to_table(spark: SparkSession, source: DataFrame, make, path: str, key: str = "key") -> DataFrame:
    """Run make(source) over all that a stream has now and keep the last row of each key at path.

    Triggers write by key, so one that runs again after a failure changes nothing. State and progress
    are below `path` too, in a folder that all executors share.
    """

    def put(batch, number):
        # the upsert reads a batch more than once: written first, or the state would be worked out each time
        batch.write.mode("overwrite").parquet(f"{path}/batches/{number}")
        io.upsert(spark, f"{path}/table", spark.read.schema(batch.schema).parquet(f"{path}/batches/{number}"), key)

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        query = make(source).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return io.keyed_table(spark, f"{path}/table")
