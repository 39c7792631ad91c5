"""Probability calibration: temperature, Platt, isotonic, per segment; two-Gaussian open-set bands."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import band, clip, gaussian_llr, logit, sigmoid

EPS = 1e-6


def linspace(lo: float, hi: float, n: int) -> list[float]:
    return [lo + (hi - lo) * i / (n - 1) for i in range(n)]


def nll_grid(points: DataFrame, grid: list[float], groups: list[str] = ()) -> DataFrame:
    """groups, t, nll over the grid for points (groups, z, y, k): logits with labels and counts."""
    p = clip(sigmoid(F.col("z") / F.col("t")), EPS, 1 - EPS)
    loss = -(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p)) * F.col("k")
    each = points.withColumn("t", F.explode(F.array(*map(F.lit, grid))))
    return each.groupBy(*groups, "t").agg((F.sum(loss) / F.sum("k")).alias("nll"))


def _points(df: DataFrame, groups: list[str], label: str, score: str) -> DataFrame:
    # equal scores are summed first: the grid meets distinct scores, not rows
    return df.groupBy(*groups, logit(F.col(score), EPS).alias("z"), F.col(label).cast("double").alias("y")).agg(F.count(F.lit(1)).alias("k"))


def temperature(df: DataFrame, groups: list[str] = (), label: str = "label", score: str = "score", grid: list[float] | None = None) -> DataFrame:
    """groups, temperature, nll: the first grid point of least negative log-likelihood."""
    groups = list(groups)
    losses = nll_grid(_points(df, groups, label, score), grid or linspace(0.05, 10.0, 400), groups)
    best = losses.groupBy(*groups).agg(F.min(F.struct("nll", "t")).alias("b"))
    return best.select(*groups, F.col("b.t").alias("temperature"), F.col("b.nll").alias("nll"))


def segmented(df: DataFrame, segment: str, min_n: int = 200, label: str = "label", score: str = "score", grid: list[float] | None = None) -> DataFrame:
    """segment, n, own, temperature: a segment with min_n rows and both classes has its own
    temperature, any other the global one."""
    sizes = df.groupBy(segment).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.when(F.col(label).isin(0, 1), F.col(label))).alias("classes"))
    sizes = sizes.withColumn("own", (F.col("n") >= min_n) & (F.col("classes") == 2))
    own = temperature(df, [segment], label, score, grid).select(F.col(segment).alias("__s"), F.col("temperature").alias("__t"))
    every = temperature(df, [], label, score, grid).select(F.col("temperature").alias("__g"))
    out = sizes.join(own, sizes[segment].eqNullSafe(own["__s"]), "left").crossJoin(F.broadcast(every))
    return out.select(segment, "n", "own", F.when(F.col("own"), F.col("__t")).otherwise(F.col("__g")).alias("temperature"))


def platt(df: DataFrame, label: str = "label", score: str = "score", c: float = 1e6, steps: int = 50) -> tuple[float, float]:
    """(slope, intercept) of a logistic regression on the logit, slope^2 / 2 + c * log loss, by Newton's
    method: an iteration sums five numbers over the distinct scores."""
    points = _points(df, [], label, score)
    a, b = 0.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * F.col("z") + b)
        g, w = (p - F.col("y")) * F.col("k") * c, p * (1 - p) * F.col("k") * c
        z = F.col("z")
        r = points.agg(F.sum(g * z), F.sum(g), F.sum(w * z * z), F.sum(w * z), F.sum(w)).first()
        if r[0] is None:
            break
        ga, gb, aa, ab, bb = r[0] + a, r[1], r[2] + 1, r[3], r[4]
        det = aa * bb - ab * ab
        if not det > 0:
            break
        da, db = (bb * ga - ab * gb) / det, (aa * gb - ab * ga) / det
        a, b = a - da, b - db
        if max(abs(da), abs(db)) < 1e-10:
            break
    return a, b


def pooled(blocks):
    """Pool adjacent violators: (lo, hi, sum, weight) in order of lo -> the same with rising means."""
    stack: list[list[float]] = []
    for lo, hi, y, w in blocks:
        stack.append([lo, hi, y, w])
        while len(stack) > 1 and stack[-2][2] * stack[-1][3] >= stack[-1][2] * stack[-2][3]:
            _, hi, y, w = stack.pop()
            top = stack[-1]
            top[1], top[2], top[3] = hi, top[2] + y, top[3] + w
    return stack


def _pool(df: DataFrame, parts: int) -> DataFrame:
    """The blocks of each of `parts` ranges pooled, by streaming through them in order."""

    def run(batches):
        rows = (r for b in batches for r in zip(*(b[c].to_pylist() for c in ("lo", "hi", "y", "w"))))
        out = pooled(rows)
        yield pa.record_batch([pa.array([r[i] for r in out], pa.float64()) for i in range(4)], names=["lo", "hi", "y", "w"])

    return df.repartitionByRange(parts, "lo").sortWithinPartitions("lo").mapInArrow(run, "lo double, hi double, y double, w double")


def isotonic(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """lo, hi, value: the isotonic fit's blocks of scores, in any order.

    Violators are pooled inside score ranges first, on all cores, and what is left of each range is
    then pooled across ranges: pooling may begin anywhere and gives the same blocks. The last step is one
    task; blocks of 0/1 labels with rising means are fractions that all differ, so n rows leave n^(2/3)
    blocks at most, and usually some hundreds.
    """
    spark = df.sparkSession
    cells = df.groupBy(F.col(score).cast("double").alias("lo")).agg(F.sum(F.col(label).cast("double")).alias("y"), F.count(F.lit(1)).cast("double").alias("w"))
    ranged = _pool(cells.select("lo", F.col("lo").alias("hi"), "y", "w"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return _pool(ranged, 1).select("lo", "hi", (F.col("y") / F.col("w")).alias("value"))


def apply_isotonic(df: DataFrame, blocks: DataFrame, score: str = "score", out: str = "prob") -> DataFrame:
    """df with the fit's value: a block's inside it, between two blocks on the line from one to the
    other, beyond the ends the end's; clipped. The blocks (see their bound) go to each task."""
    rows = sorted(tuple(r) for r in blocks.collect())
    x = np.array([v for lo, hi, _ in rows for v in (lo, hi)])
    y = np.array([v for *_, v in rows for _ in (0, 1)])
    sent = df.sparkSession.sparkContext.broadcast((x, y))

    @F.pandas_udf("double")
    def value(s: pd.Series) -> pd.Series:
        x, y = sent.value
        return pd.Series(np.interp(s.to_numpy(float), x, y)).where(s.notna().to_numpy())

    return df.withColumn(out, clip(value(F.col(score).cast("double")), EPS, 1 - EPS))


def fit_calibrator(df: DataFrame, kind: str = "temperature", label: str = "label", score: str = "score", out: str = "prob"):
    """A function DataFrame -> DataFrame that adds `out`; kinds: temperature, platt, isotonic."""
    if kind == "temperature":
        t = temperature(df, (), label, score).first()["temperature"]
        return lambda x: x.withColumn(out, sigmoid(logit(F.col(score), EPS) / t))
    if kind == "platt":
        a, b = platt(df, label, score)
        return lambda x: x.withColumn(out, sigmoid(a * logit(F.col(score), EPS) + b))
    if kind == "isotonic":
        model = isotonic(df, label, score)
        return lambda x: apply_isotonic(x, model, score, out)
    raise ValueError(f"unknown calibrator: {kind}")


def gaussian_fit(df: DataFrame, label: str = "label", score: str = "score", eps: float = 1e-12) -> DataFrame:
    """m0, s0, m1, s1, n0, n1 of the logits by class; sample deviations of 0.001 at least. Fewer
    than three rows in a class raise when the plan runs."""
    z = logit(F.col(score), eps)
    aggs = []
    for c in (0, 1):
        zc = F.when(F.col(label) == c, z)
        n = F.count(zc)
        aggs += [
            F.when(n < 3, F.raise_error(F.lit("fewer than three rows in a class"))).otherwise(F.avg(zc)).alias(f"m{c}"),
            F.greatest(F.stddev_samp(zc), F.lit(1e-3)).alias(f"s{c}"),
            n.alias(f"n{c}"),
        ]
    return df.agg(*aggs)


def open_set(df: DataFrame, fit: DataFrame, score: str = "score", threshold: float = 0.5, abstain_sigma: float = 3.0, prior: float = 0.0, eps: float = 1e-12) -> DataFrame:
    """df with llr, posterior, sigmas_from_authentic, sigmas_from_spoof and band."""
    z = logit(F.col(score), eps)
    out = df.crossJoin(F.broadcast(fit))
    out = out.withColumn("llr", gaussian_llr(z, F.col("m0"), F.col("s0"), F.col("m1"), F.col("s1")))
    out = out.withColumn("posterior", sigmoid(F.col("llr") + prior)).withColumn("sigmas_from_authentic", F.abs(z - F.col("m0")) / F.col("s0")).withColumn("sigmas_from_spoof", F.abs(z - F.col("m1")) / F.col("s1"))
    return out.withColumn("band", band(F.col("posterior"), F.col("sigmas_from_authentic"), F.col("sigmas_from_spoof"), threshold, abstain_sigma)).drop("m0", "s0", "m1", "s1", "n0", "n1")


def boundaries(fit: DataFrame, prior: float = 0.0) -> DataFrame:
    """lo, hi: logits where llr + prior = 0, ascending; one is null if there is one, both if none."""
    a = 0.5 / (F.col("s0") * F.col("s0")) - 0.5 / (F.col("s1") * F.col("s1"))
    b = F.col("m1") / (F.col("s1") * F.col("s1")) - F.col("m0") / (F.col("s0") * F.col("s0"))
    c = 0.5 * F.col("m0") * F.col("m0") / (F.col("s0") * F.col("s0")) - 0.5 * F.col("m1") * F.col("m1") / (F.col("s1") * F.col("s1")) + F.log(F.col("s0") / F.col("s1")) + prior
    d = b * b - 4 * a * c
    root = lambda s: F.try_divide(-b + s * F.sqrt(F.greatest(d, F.lit(0.0))), 2 * a)
    linear = F.abs(a) < 1e-12
    lo = F.when(linear, F.try_divide(-c, b)).when(d >= 0, F.least(root(1), root(-1)))
    hi = F.when(~linear & (d > 0), F.greatest(root(1), root(-1)))
    return fit.select(lo.alias("lo"), hi.alias("hi"))
