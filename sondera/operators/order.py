"""Order statistics and row numbers of whole tables without a task that sees all rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .metrics import RANGES, with_ranges


def quantiles(df: DataFrame, groups: list[str], value: str, wanted: dict[str, float], ranges: int = RANGES) -> DataFrame:
    """groups, n, lo, hi and the wanted quantiles (name -> share) of a number, exact, interpolated
    linearly between ranks; nulls take no part.

    Equal values are counted first. A few counts a range of values then tell which ranges hold a rank
    that is asked for, and only those, some 1 / `ranges` of the counts, are put in order. No buffer
    grows with the rows or with a group's distinct values, and rows are scanned once.
    """
    groups, x = list(groups), F.col(value).cast("double")
    counts = df.where(x.isNotNull()).groupBy(*groups, x.alias("s")).agg(F.count(F.lit(1)).alias("k")).where("k > 0")
    counts = with_ranges(counts, "s", ranges).withColumn("__g", F.struct(*groups, "r"))
    group = [F.col("__g")[g] for g in groups] or [F.lit(0)]
    per = counts.groupBy("__g").agg(F.sum("k").alias("rk"), F.min("s").alias("rlo"), F.max("s").alias("rhi"))
    before, every = W.partitionBy(*group).orderBy(F.col("__g.r")).rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*group)
    per = per.select("__g", "rk", F.coalesce(F.sum("rk").over(before), F.lit(0)).alias("b"), F.sum("rk").over(every).alias("n"), F.min("rlo").over(every).alias("lo"), F.max("rhi").over(every).alias("hi"))
    ranks = [f(F.lit(float(q)) * (F.col("n") - 1)) for q in wanted.values() for f in (F.floor, F.ceil)]
    held = per.where(_any((r >= F.col("b")) & (r < F.col("b") + F.col("rk")) for r in ranks))
    inside = W.partitionBy("__g").orderBy("s").rowsBetween(W.unboundedPreceding, 0)
    run = counts.join(held, "__g").withColumn("c", F.col("b") + F.sum("k").over(inside))
    at = lambda rank: F.max(F.when((F.col("c") - F.col("k") <= rank) & (rank < F.col("c")), F.col("s")))

    def one(q: float) -> Column:
        rank = F.lit(float(q)) * (F.col("n") - 1)
        low, high = at(F.floor(rank)), at(F.ceil(rank))
        return low + (high - low) * (F.max(rank) - F.floor(F.max(rank)))

    out = run.groupBy(*groups).agg(F.max("n").alias("n"), F.max("lo").alias("lo"), F.max("hi").alias("hi"), *(one(q).alias(name) for name, q in wanted.items()))
    return out if groups else out.where("n is not null")


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def numbered(df: DataFrame, by: str, name: str = "n", ranges: int = RANGES) -> DataFrame:
    """df with row numbers from 0 in order of a number (ties in any order): numbers inside ranges,
    and what lies before each range added."""
    rows = with_ranges(df.withColumn("__by", F.col(by).cast("double")), "__by", ranges)
    per = rows.groupBy("r").agg(F.count(F.lit(1)).alias("k"))
    per = per.select("r", F.coalesce(F.sum("k").over(W.partitionBy(F.lit(0)).orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    rows = rows.withColumn("__i", F.row_number().over(W.partitionBy("r").orderBy("__by", by)) - 1)
    return rows.join(F.broadcast(per), "r").withColumn(name, F.col("__i") + F.col("b")).drop("__by", "__i", "r", "b")


def covering_width(n: int, max_dist: int, bits: int = 64) -> tuple[int, int]:
    """(groups, taken): into how many groups of bits hashes are cut, and how many make a key, for the
    least work on n hashes: copies of each, and chance meetings in a key."""
    best = None
    for taken in range(1, 5):
        groups = max_dist + taken
        if groups > bits:
            break
        width, keys = bits * taken // groups, math.comb(groups, taken)
        work = keys * n * (1 + n / 2.0**width)
        if best is None or work < best[0]:
            best = (work, groups, taken)
    return best[1], best[2]
