"""Linear probes of all layers of a feature store at once.

Logistic regression by Newton's method, batched: an iteration is one job over the training rows of
every layer. Each task sums up gradient and Hessian of the layers it meets (a matrix product a
batch), Spark adds the tasks' sums up, and the driver solves one system a layer. What reaches it is
bounded by layers x dimension^2, whatever the rows; a task that is lost is run again alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import metrics as M
from .replay import dot

#: Newton steps at most, and the step that ends them.
STEPS, TOLERANCE = 50, 1e-9
#: What a probe must reach on validation and test rows.
GATE_VAL, GATE_TEST = 0.95, 0.90


def _summed(rows: DataFrame, keys: list[str], dim: int, of) -> dict:
    """key values -> sum of of(key, matrix of vectors, labels) (vectors of one length) over all rows."""
    kinds, arrow = [rows.schema[k].dataType.simpleString() for k in keys], [to_arrow_type(rows.schema[k].dataType) for k in keys]

    def run(batches):
        total: dict = {}
        for b in batches:
            names = list(zip(*(b[k].to_pylist() for k in keys)))
            x = b["vec"].values.to_numpy(zero_copy_only=False).astype(np.float64)[b["vec"].offsets[0].as_py() :][: b.num_rows * dim].reshape(-1, dim)
            y = b["y"].to_numpy(zero_copy_only=False).astype(np.float64)
            order: dict = {}
            for i, k in enumerate(names):
                order.setdefault(k, []).append(i)
            for k, at in order.items():
                part = of(k, x[at], y[at])
                total[k] = part if k not in total else total[k] + part
        if total:
            cols = [pa.array([k[i] for k in total], t) for i, t in enumerate(arrow)]
            yield pa.record_batch([*cols, pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=[*keys, "part"])

    parts = rows.select(*keys, F.col("vec").cast("array<double>").alias("vec"), F.col("y").cast("double").alias("y")).mapInArrow(run, ", ".join([*(f"{k} {t}" for k, t in zip(keys, kinds)), "part array<double>"]))
    got = parts.groupBy(*keys).agg(vector_to_array(Summarizer.sum(array_to_vector("part"))).alias("total")).collect()
    return {tuple(r[k] for k in keys): np.array(r["total"]) for r in got}


def standardised(train: DataFrame, dim: int) -> dict[tuple, tuple[np.ndarray, np.ndarray, float]]:
    """layer -> mean, population deviation (1 where it is 0), rows; in two passes, so that large means lose nothing."""
    first = _summed(train, ["layer"], dim, lambda k, x, y: np.r_[x.sum(0), len(x)])
    means = {k: v[:-1] / v[-1] for k, v in first.items()}
    second = _summed(train, ["layer"], dim, lambda k, x, y: ((x - means[k]) ** 2).sum(0))
    return {k: (means[k], np.where(s := np.sqrt(second[k] / first[k][-1]), s, 1.0), first[k][-1]) for k in first}


def _newton_parts(x, y, w):
    """Loss, gradient and Hessian (with the intercept last) of one batch, one after another."""
    x = np.c_[x, np.ones(len(x))]
    z = x @ w
    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    return np.r_[np.logaddexp(0, z).sum() - y @ z, x.T @ (p - y), ((x * (p * (1 - p))[:, None]).T @ x).ravel()]


def fit(train: DataFrame, dim: int, c: float = 1.0) -> dict[tuple, tuple[np.ndarray, float]]:
    """layer -> (weights, intercept) on the raw vectors: minimises |w|^2 / 2 + c * log loss over the
    vectors standardised by the layer's own mean and population deviation; the intercept is free.

    train: layer, vec, y (0 or 1). Steps are halved while they don't lower the loss, so separable
    layers converge, too. A layer of one class has no probe.
    """
    scale = standardised(train, dim)
    classes = _summed(train, ["layer"], dim, lambda k, x, y: np.array([(y == 0).sum(), (y == 1).sum()]))
    weights = {k: np.zeros(dim + 1) for k in scale if classes[k].min() > 0}
    step, best, open_ = {}, {}, set(weights)
    train = train.where(F.col("layer").isin([k[0] for k in weights])) if weights else train
    for _ in range(STEPS):
        if not open_:
            break
        now = dict(weights)
        rows = train.where(F.col("layer").isin([k[0] for k in open_]))
        sums = _summed(rows, ["layer"], dim, lambda k, x, y: _newton_parts((x - scale[k][0]) / scale[k][1], y, now[k]))
        for k in list(open_):
            w, s = weights[k], sums[k]
            loss = w[:-1] @ w[:-1] / 2 + c * s[0]
            if k in best and loss > best[k][0] + 1e-12 * abs(best[k][0]):  # too far: half of the last step
                step[k] = step[k] / 2
                weights[k] = best[k][1] + step[k]
                if np.abs(step[k]).max() < TOLERANCE:
                    open_.discard(k)
                continue
            best[k] = (loss, w)
            ridge = np.diag(np.r_[np.ones(dim), 0.0])
            g, h = c * s[1 : dim + 2] + ridge @ w, c * s[dim + 2 :].reshape(dim + 1, dim + 1) + ridge
            step[k] = -np.linalg.solve(h, g)
            weights[k] = w + step[k]
            if np.abs(step[k]).max() < TOLERANCE:
                open_.discard(k)
    out = {}
    for k, w in weights.items():
        mean, deviation, _ = scale[k]
        raw = w[:-1] / deviation
        out[k] = (raw, float(w[-1] - raw @ mean))
    return out


def scored(rows: DataFrame, probes: dict[tuple, tuple[np.ndarray, float]]) -> DataFrame:
    """rows with `score`, the logit of their layer's probe; rows of a layer without one are left out."""
    kind = rows.schema["layer"].dataType.simpleString()
    table = rows.sparkSession.createDataFrame([(k[0], w.tolist(), b) for k, (w, b) in probes.items()], f"layer {kind}, __w array<double>, __b double")
    return rows.join(F.broadcast(table), "layer").withColumn("score", dot(F.col("vec"), F.col("__w")) + F.col("__b")).drop("__w", "__b")


def centroid_scored(rows: DataFrame) -> DataFrame:
    """rows with `score`, the vector's product with the difference of the training classes' means: a
    probe without a fit. Rows: layer, split, y, vec."""
    at = rows.where("split = 'train'").select("layer", "y", F.posexplode("vec").alias("i", "x"))
    mean = at.groupBy("layer", "i").agg((F.avg(F.when(F.col("y") == 1, F.col("x").cast("double"))) - F.avg(F.when(F.col("y") == 0, F.col("x").cast("double")))).alias("d"))
    w = mean.groupBy("layer").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "d"))), lambda p: p["d"]).alias("__w"))
    return rows.join(F.broadcast(w), "layer").withColumn("score", dot(F.col("vec"), F.col("__w"))).drop("__w")


def report(scores: DataFrame, fpr: float = 0.1) -> DataFrame:
    """layer, and for val and test: auc, eer, tpr at the rate; gap: val less test AUC. From scored rows
    (layer, split, y, score), all layers in one histogram."""
    tpr = f"tpr_{M.name(fpr)}"
    each = M.ranking(scores.where(F.col("split").isin("val", "test")), ["layer", "split"], (fpr,), label="y")
    of = lambda split, c, alias: F.max(F.when(F.col("split") == split, F.col(c))).alias(alias)
    out = each.groupBy("layer").agg(*(of(s, c, f"{s}_{a}") for s in ("val", "test") for c, a in (("auc", "auc"), ("eer", "eer"), (tpr, "tpr"))))
    return out.withColumn("gap", F.col("val_auc") - F.col("test_auc"))


def gated(table: DataFrame, val: float = GATE_VAL, test: float = GATE_TEST) -> DataFrame:
    """A report with `passed`; false where an AUC is missing."""
    return table.withColumn("passed", F.coalesce((F.col("val_auc") >= val) & (F.col("test_auc") >= test), F.lit(False)))


def choice(table: DataFrame) -> DataFrame:
    """One row: the layer of the best test AUC and that of the smallest gap, the first of equal ones."""
    return table.agg(F.max_by("layer", F.struct("test_auc", -F.col("layer"))).alias("best_layer"), F.min_by("layer", F.struct(F.abs("gap").alias("g"), "layer")).alias("stable_layer"))
