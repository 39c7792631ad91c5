"""Rehearsal buffers, round-robin plans, inference-only classifier heads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .order import numbered


@dataclass(frozen=True)
class TrainConfig:
    """Record of a fine-tuning run. Fixed values."""

    lr: float = 1e-4
    head_lr: float = 1e-3
    epochs: int = 5
    batch_size: int = 64
    rehearsal_ratio: float = 0.5
    rank: int = 16
    alpha: int = 32


def priority(seed: int, *cols: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in cols)))


def reservoir(df: DataFrame, key: str, item: str, cap: int = 500, seed: int = 0) -> DataFrame:
    """key, item, priority: the cap rows of least hash priority of each key. A uniform sample
    without replacement, as a reservoir gives, but in any order of arrival, and mergeable: the
    reservoir of two reservoirs is that of all rows."""
    rows = df.select(key, item, priority(seed, key, item).alias("priority"))
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy("priority", item))).where(F.col("__r") <= cap).drop("__r")


def sample(buffer: DataFrame, key: str, item: str, n: int, exclude: str | None = None) -> DataFrame:
    """max(1, n // keys) rows of each key by priority, n in all at most."""
    rows = buffer if exclude is None else buffer.where(~F.col(key).eqNullSafe(F.lit(exclude)))
    keys = rows.select(key).distinct().count()
    if not keys:
        return rows
    per = max(1, n // keys)
    ranked = rows.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy("priority", item))).where(F.col("__r") <= per).drop("__r")
    return ranked.orderBy(key, "priority", item).limit(n)


def mixed_batch(new: DataFrame, buffer: DataFrame, key: str, item: str, ratio: float = 0.5) -> DataFrame:
    """New rows and int(n * ratio / (1 - ratio)) replayed ones, marked and in hash order."""
    n = int(new.count() * ratio / max(1e-9, 1 - ratio))
    old = sample(buffer, key, item, n).select(key, item).withColumn("replayed", F.lit(True))
    both = new.select(key, item).withColumn("replayed", F.lit(False)).unionByName(old)
    return both.orderBy(priority(1, item, key))


def round_robin(df: DataFrame, id_col: str, voices: list[str], engines: list[str]) -> DataFrame:
    """id, voice, engine: voices in turn over the sorted (whole-number) ids, each with every engine."""
    rows = numbered(df.select(id_col).distinct(), id_col, "__n")
    return rows.select(id_col, F.element_at(F.array(*map(F.lit, voices)), (F.col("__n") % len(voices) + 1).cast("int")).alias("voice"), F.explode(F.array(*map(F.lit, engines))).alias("engine"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_scores(df: DataFrame, vec: str, weights: list[list[float]], scale: float = 16.0) -> DataFrame:
    """df with `logits`: scaled cosines of a vector and each class's weights."""
    x = F.col(vec)
    norm = F.greatest(F.sqrt(dot(x, x)), F.lit(1e-12))
    outs = []
    for w in weights:
        length = max(sum(v * v for v in w) ** 0.5, 1e-12)
        outs.append(scale * dot(x, F.array(*(F.lit(v / length) for v in w))) / norm)
    return df.withColumn("logits", F.array(*outs))
