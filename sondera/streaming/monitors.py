"""Structured Streaming monitors; each also runs on a static frame, which the tests hold it against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fusion import Head, disagreement, probability


def _windowed(df: DataFrame, time: str, window: str, watermark: str):
    return (df.withWatermark(time, watermark) if df.isStreaming else df).groupBy(F.window(time, window))


def abstention(df: DataFrame, head: Head, time: str = "ts", window: str = "1 hour", watermark: str = "2 hours", synthetic: float = 0.85, suspicious: float = 0.5) -> DataFrame:
    """start, scans, abstention_rate per tumbling window; late rows beyond the watermark are left out."""
    p = probability(head)
    rows = df.withColumn("__in", ((p >= suspicious) & (p < synthetic)).cast("int"))
    return _windowed(rows, time, window, watermark).agg(F.count(F.lit(1)).alias("scans"), F.avg("__in").alias("abstention_rate")).select(F.col("window.start").alias("start"), "scans", "abstention_rate")


def disagreement_drift(df: DataFrame, time: str = "ts", window: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    rows = df.withColumn("__d", disagreement())
    return _windowed(rows, time, window, watermark).agg(F.count(F.lit(1)).alias("scans"), F.avg("__d").alias("disagreement")).select(F.col("window.start").alias("start"), "scans", "disagreement")


def streaming_reservoir(df: DataFrame, key: str, item: str, cap: int = 500, seed: int = 0) -> DataFrame:
    """The reservoir of replay.py on a stream: each key's state holds at most cap (priority, item)
    pairs; the last row of a key for each trigger is its whole buffer."""
    import pandas as pd

    from ..operators.replay import priority

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(item).cast("string").alias("item"), priority(seed, key, item).alias("priority"))

    def update(k, batches, state):
        held = list(zip(*state.get)) if state.exists else []
        for b in batches:
            held = sorted({*held, *zip(b["priority"], b["item"])})[:cap]
        state.update(([h[0] for h in held], [h[1] for h in held]))
        yield pd.DataFrame({"key": [k[0]], "items": [[h[1] for h in held]]})

    return rows.groupBy("key").applyInPandasWithState(update, "key string, items array<string>", "p array<string>, i array<string>", "update", "NoTimeout")
