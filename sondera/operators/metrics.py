"""Ranking and calibration metrics from score histograms.

One aggregate takes (label, score) to a histogram of distinct scores, (groups, score) -> p, n;
running sums over it give every ranking metric. A running sum over all distinct scores would be one
task, so scores are first cut into ranges at approximate quantiles: sums run inside (group, range),
and the ranges' totals, a few rows a group, carry over. Where the cuts lie does not change a result.
Cuts, totals and sums are branches of one plan over one exchange; rows are scanned once.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGES = 64


def checked(df: DataFrame, score: str = "score") -> DataFrame:
    """Raises when the plan runs over a NaN score."""
    return df.withColumn(score, F.when(F.isnan(score), F.raise_error(F.lit("score is NaN"))).otherwise(F.col(score)))


def input_contract(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row: rows, nan_scores, null_scores, other_labels (null or neither 0 nor 1), without raising."""
    s, y = F.col(score).cast("double"), F.col(label)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.isnan(s)).alias("nan_scores"), F.count_if(s.isNull()).alias("null_scores"), F.count_if(~F.coalesce(y.isin(0, 1), F.lit(False))).alias("other_labels"))


def histogram(df: DataFrame, groups: list[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """groups, s, p, n: positives and negatives at each distinct score. Other labels count in neither."""
    return (
        df.select(*groups, F.col(score).cast("double").alias("s"), F.col(label).alias("__label"))
        .groupBy(*groups, "s")
        .agg(F.sum(F.when(F.col("__label") == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col("__label") == 0, 1).otherwise(0)).alias("n"))
    )


def with_ranges(df: DataFrame, column: str = "s", ranges: int = RANGES) -> DataFrame:
    """df with `r`, the number of quantile cuts below the score: 0 .. ranges - 1. The cuts are a row
    that the same plan computes; nothing runs before the plan does."""
    cuts = df.agg(F.percentile_approx(column, [i / ranges for i in range(1, ranges)], 1000).alias("__cuts"))
    below = F.size(F.filter(F.coalesce("__cuts", F.array().cast("array<double>")), lambda c: c < F.col(column)))
    return df.crossJoin(F.broadcast(cuts)).withColumn("r", below).drop("__cuts")


def cumulated(hist: DataFrame, groups: list[str] = ()) -> DataFrame:
    """hist with cp, cn (running sums over a group's scores to this one inclusive), ps, ns (positives and
    negatives at this score) and the group's totals all_p, all_n. Several rows of a group may share a score.

    The cuts and the ranges' totals come from the histogram that the plan has anyhow: all branches
    need p and n, for the filter, so they read one exchange and the rows behind it are scanned once.
    Cells of other labels only are left out.
    """
    groups = list(groups)
    hist = with_ranges(hist.where(F.col("p") + F.col("n") > 0)).withColumn("__g", F.struct(*groups, "r"))
    per = hist.groupBy("__g").agg(F.sum("p").alias("rp"), F.sum("n").alias("rn"))
    group = [F.col("__g")[g] for g in groups] or [F.lit(0)]
    before, every = W.partitionBy(*group).orderBy(F.col("__g.r")).rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*group)
    per = per.select(
        "__g",
        F.coalesce(F.sum("rp").over(before), F.lit(0)).alias("bp"),
        F.coalesce(F.sum("rn").over(before), F.lit(0)).alias("bn"),
        F.sum("rp").over(every).alias("all_p"),
        F.sum("rn").over(every).alias("all_n"),
    )
    inside, at = W.partitionBy("__g").orderBy("s").rangeBetween(W.unboundedPreceding, W.currentRow), W.partitionBy("__g").orderBy("s").rangeBetween(W.currentRow, W.currentRow)
    run = hist.withColumn("ip", F.sum("p").over(inside)).withColumn("in", F.sum("n").over(inside)).withColumn("ns", F.sum("n").over(at)).withColumn("ps", F.sum("p").over(at))
    return run.join(per, "__g").withColumn("cp", F.col("ip") + F.col("bp")).withColumn("cn", F.col("in") + F.col("bn")).drop("__g", "r", "ip", "in", "bp", "bn")


def _auc() -> Column:
    """Of the rows' positives against all negatives of their peers."""
    d = lambda c: F.col(c).cast("double")
    return F.try_divide(F.sum(d("p") * (d("cn") - d("ns") + d("ns") / 2)), F.sum(d("p")) * F.max(d("all_n"))).alias("auc")


def _eer() -> Column:
    far, frr = F.try_divide(F.col("all_n") - F.col("cn") + F.col("ns"), F.col("all_n")), F.try_divide(F.col("cp") - F.col("ps"), F.col("all_p"))
    return F.min(F.when(F.col("all_p") * F.col("all_n") > 0, F.struct(F.abs(far - frr).alias("gap"), F.col("s").alias("thr"), ((far + frr) / 2).alias("eer"))))


def threshold_rank(fpr: float) -> Column:
    """k = floor(fpr * N) in binary floating point; N is of the cumulated histogram."""
    return F.floor(F.lit(float(fpr)) * F.col("all_n").cast("double"))


def _at_fpr(fpr: float, strict: bool = False) -> list[Column]:
    """Threshold, whether only scores above it count, and the share of positives that do.

    The threshold is the (N - k + 1)-th smallest negative score: the least score with as many
    negatives up to it. So `score >= threshold` is a matter of running counts, and no second look at
    the histogram is needed. strict: of scores that tie with the threshold none count unless all
    negatives there are within the budget.
    """
    want = F.col("all_n") - F.greatest(threshold_rank(fpr), F.lit(1)) + 1
    found, none = (F.col("cn") >= want) & (F.col("cn") - F.col("ns") < want), threshold_rank(fpr) < 1
    over = none | (F.col("all_n") - F.col("cn") + F.col("ns") > threshold_rank(fpr)) if strict else none
    above = F.when(F.col("cn") - F.col("ns") >= want, True).when(F.col("cn") >= want, ~over)
    k = name(fpr)
    return [
        F.max(F.when(found & (F.col("ns") > 0), F.col("s"))).alias(f"thr_{k}"),
        F.max(F.when(found & (F.col("ns") > 0), over)).alias(f"strict_{k}"),
        F.try_divide(F.sum(F.when(above, F.col("p")).otherwise(0)).cast("double"), F.sum("p").cast("double")).alias(f"tpr_{k}"),
    ]


def ranking(df: DataFrame, groups: list[str] = (), fprs: tuple[float, ...] = (0.001, 0.01, 0.05), label: str = "label", score: str = "score", strict: bool = False) -> DataFrame:
    """A row a group: n_pos, n_neg, auc, eer, eer_thr and for each FPR its threshold and TPR.

    Where the FPR allows no negative (k = 0) the threshold is reported as the greatest negative
    score and `strict_<fpr>` is true: only scores above it count, as with the next number above it.
    Metrics of a group with an empty class are null. Ties at a threshold count as flagged (>=), which
    may overrun the budget; with strict=True they count only if all negatives among them fit into it.
    """
    return from_histogram(histogram(df, groups, label, score), groups, fprs, strict=strict)


def from_histogram(hist: DataFrame, groups: list[str] = (), fprs: tuple[float, ...] = (), peers: list[str] | None = None, strict: bool = False) -> DataFrame:
    """The same from a histogram (groups, s, p, n). peers: the columns within which negatives (and the
    EER's positives) are counted, if other than the groups themselves."""
    groups = list(groups)
    run = cumulated(hist, groups if peers is None else peers)
    aggs = [F.sum("p").alias("n_pos"), F.max("all_n").alias("n_neg"), _auc(), _eer().alias("e"), *(c for f in fprs for c in _at_fpr(f, strict))]
    out = run.groupBy(*groups).agg(*aggs)
    each = lambda what: [f"{what}_{name(f)}" for f in fprs]
    return out.select(*groups, "n_pos", "n_neg", "auc", F.col("e.eer").alias("eer"), F.col("e.thr").alias("eer_thr"), *(c for pair in zip(each("thr"), each("strict")) for c in pair), *each("tpr"))


def levels(df: DataFrame, keys: dict[str, str | None], scores: dict[str, str], fprs: tuple[float, ...] = (), shared: tuple[str, ...] = (), label: str = "label") -> DataFrame:
    """model, level, key and the metrics of `ranking`, for every score and every way to group, from
    one scan and one histogram.

    keys: level -> its column, None for all rows. scores: model -> its column. At the levels in
    `shared` a row is of a key's positives against all negatives of the frame; at others each key has
    its own. Null keys are the key `nan`; null scores take no part.
    """
    # rows are counted by all keys at once; the ways to group meet those cells, not rows, and needn't sum
    # them up again, as rows of a histogram may share a score
    cols = {c: f"__k{i}" for i, c in enumerate(dict.fromkeys(c for c in keys.values() if c))}
    what = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("s")) for m, c in scores.items())))
    rows = df.where(F.col(label).isin(0, 1)).select(F.col(label).alias("label"), *(F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(k) for c, k in cols.items()), what.alias("m"))
    cells = histogram(rows.where("m.s is not null").select("m.model", *cols.values(), F.col("m.s").alias("score"), "label"), ["model", *cols.values()])
    where = F.explode(F.array(*(F.struct(F.lit(v).alias("level"), (F.col(cols[c]) if c else F.lit("all")).alias("key")) for v, c in keys.items())))
    hist = cells.select("model", where.alias("w"), "s", "p", "n").select("model", "w.level", "w.key", "s", "p", "n")
    hist = hist.withColumn("peer", F.when(F.col("level").isin(*shared), F.lit("")).otherwise(F.col("key")) if shared else F.col("key"))
    out = from_histogram(hist, ["model", "level", "key"], fprs, ["model", "level", "peer"])
    return out.where(~F.col("level").isin(*shared) | (F.col("n_pos") > 0)) if shared else out


def name(fpr: float) -> str:
    return f"{fpr:g}".replace("0.", "").replace(".", "_")


def partial_auc(df: DataFrame, tiebreak: str, max_fpr: float = 0.1, standardize: bool = True, label: str = "label", score: str = "score") -> DataFrame:
    """One row, `pauc`: trapezoids under the row-by-row ROC steps up to max_fpr, the last one cut by
    linear interpolation, rescaled so that chance is 0.5 (McClish). Rows with equal scores are taken
    in the order of `tiebreak`, which is why one must be given."""
    rows = df.select(F.col(score).cast("double").alias("s"), F.col(tiebreak).alias("tie"), F.col(label).alias("y"))
    rows = with_ranges(rows.withColumn("neg_s", -F.col("s")), "neg_s")
    one = rows.withColumn("p", F.when(F.col("y") == 1, 1).otherwise(0)).withColumn("n", F.when(F.col("y") == 0, 1).otherwise(0))
    per = one.groupBy("r").agg(F.sum("p").alias("rp"), F.sum("n").alias("rn"))
    before, every = W.partitionBy(F.lit(0)).orderBy("r").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(0))
    per = per.select("r", F.coalesce(F.sum("rp").over(before), F.lit(0)).alias("bp"), F.coalesce(F.sum("rn").over(before), F.lit(0)).alias("bn"), F.sum("rp").over(every).alias("all_p"), F.sum("rn").over(every).alias("all_n"))
    inside = W.partitionBy("r").orderBy("neg_s", "tie").rowsBetween(W.unboundedPreceding, 0)
    run = one.withColumn("tp", F.sum("p").over(inside)).withColumn("fp", F.sum("n").over(inside)).join(F.broadcast(per), "r")
    y1, x1 = (F.col("tp") + F.col("bp")) / F.col("all_p"), (F.col("fp") + F.col("bn")) / F.col("all_n")
    y0, x0 = y1 - F.col("p") / F.col("all_p"), x1 - F.col("n") / F.col("all_n")
    m = F.lit(float(max_fpr))
    cut = F.when(x1 <= m, (x1 - x0) * (y0 + y1) / 2).when(x0 < m, (m - x0) * (y0 + (y0 + (y1 - y0) * F.try_divide(m - x0, x1 - x0))) / 2).otherwise(0.0)
    area = F.sum(cut)
    if not standardize:
        return run.agg((area / m).alias("pauc"))
    low = m * m / 2
    return run.agg((0.5 * (1 + (area - low) / (m - low))).alias("pauc"))


def ece(df: DataFrame, n_bins: int = 15, label: str = "label", prob: str = "prob", groups: list[str] = ()) -> DataFrame:
    """Expected calibration error and Brier score; probabilities outside [0, 1] raise."""
    from ..functions.scalars import ece_bin

    groups = list(groups)
    p = F.when((F.col(prob) < 0) | (F.col(prob) > 1), F.raise_error(F.lit("probability outside [0, 1]"))).otherwise(F.col(prob))
    bins = df.select(*groups, F.col(label).cast("double").alias("y"), p.alias("p")).groupBy(*groups, ece_bin(F.col("p"), n_bins).alias("bin"))
    bins = bins.agg(F.count(F.lit(1)).alias("k"), F.avg("y").alias("my"), F.avg("p").alias("mp"), F.sum((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("sq"))
    return bins.groupBy(*groups).agg((F.sum(F.col("k") * F.abs(F.col("my") - F.col("mp"))) / F.sum("k")).alias("ece"), (F.sum("sq") / F.sum("k")).alias("brier"))


def confusion(df: DataFrame, threshold: float, label: str = "label", score: str = "score") -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, fpr, fdr at `score >= threshold`; 0 on empty ratios."""
    hit, y = F.col(score) >= F.lit(float(threshold)), F.col(label) == 1
    c = df.agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(fp, fp + tn).alias("fpr"), ratio(fp, tp + fp).alias("fdr"))


# --- bootstrap ---------------------------------------------------------------------------------------

#: Cells of up to so many equal rows draw by the inverse of the distribution, larger ones by a normal deviate.
EXACT = 16
_MASK, _SPREAD, _FIRST, _SECOND, _OTHER = 0xFFFFFFFF, 2654435761, 2146121005, 1812433253, 1540483477
#: Cells that a task draws for at once, all replicates of each.
CHUNK = 512


def poisson_cuts(k: int) -> list[int]:
    """c[j]: a 32-bit draw of at least c[j] is more than j, for a Poisson number of mean k."""
    out, term, total, j = [], math.exp(-k), 0.0, 0
    while True:
        total += term
        cut = round(total * 4294967296)
        if cut > _MASK:
            return out
        out.append(cut)
        j += 1
        term *= k / j


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers whose outputs look unrelated; x is overwritten."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(_FIRST)
    x ^= x >> np.uint32(15)
    x *= np.uint32(_SECOND)
    x ^= x >> np.uint32(16)
    return x


def _passed(u: np.ndarray, cuts: list[int]) -> np.ndarray:
    """How many of the rising cuts each number reaches. Once few numbers are left above a cut, only those
    are held against the next ones."""
    w, above, left = np.zeros(u.shape, np.uint8), None, u
    for c in cuts:
        hit = left >= np.uint32(c)
        if above is None:
            w += hit
            if 8 * np.count_nonzero(hit) < len(u):
                above = np.flatnonzero(hit)
                left = u[above]
        else:
            above, left = above[hit], left[hit]
            w[above] += 1
    return w


def draws(cell: np.ndarray, count: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """Cells by replicates: how often the rows of each cell are drawn, Poisson of mean `count`.

    cell: 64 bits that name a cell. A cell of k equal rows draws the sum of k Poisson(1) numbers at
    once, so equal rows are never told apart; the same cell draws the same in every replicate
    wherever it is, which is what pairs two scores.
    """
    low, high = (cell & _MASK).astype(np.uint32), ((cell >> 32) & _MASK).astype(np.uint32)
    key = ((replicates.astype(np.uint64) + 1) * _SPREAD + seed * _OTHER & _MASK).astype(np.uint32)
    u = _mix(_mix(low[:, None] ^ key[None, :]) ^ high[:, None])
    out = np.zeros(u.shape, np.int64 if len(count) and count.max() > 1 << 20 else np.int32)
    for k in np.unique(count).tolist():
        at = np.flatnonzero(count == k)
        here = u if len(at) == len(u) else u[at]
        if k <= EXACT:
            w = _passed(here.ravel(), poisson_cuts(k)).reshape(here.shape)
        else:
            v = _mix(here ^ np.uint32(_OTHER))
            z = np.sqrt(-2 * np.log((here + 0.5) / 4294967296.0)) * np.cos(2 * math.pi * ((v + 0.5) / 4294967296.0))
            w = np.maximum(0, np.floor(k + math.sqrt(k) * z + (z * z - 1) / 6 + 0.5))  # with its skewness
        out[at] = w
    return out


def cells(df: DataFrame, label: str = "label", scores: tuple[str, ...] = ("score",), cell: Column | None = None) -> DataFrame:
    """y, scores, k rows that are equal in all of these, and `cell`, 64 bits that name them."""
    out = df.where(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int").alias("y"), *(F.col(s).cast("double").alias(s) for s in scores)).agg(F.count(F.lit(1)).alias("k"))
    return out.withColumn("cell", F.xxhash64("y", *scores) if cell is None else cell)


def _auc_parts(table: DataFrame, score: str, replicates: int, seed: int) -> DataFrame:
    """rep, part, p, n, a: of each range of scores and replicate the drawn positives and negatives,
    and the pairs in order (a positive above a negative, ties half) inside the range."""
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = table.select(F.col(score).alias("s"), "y", "k", "cell").repartitionByRange(parts, "s").sortWithinPartitions("s")

    def run(batches):
        from pyspark import TaskContext

        reps = np.arange(replicates)
        p, n, won, tied_p, tied_n, last = *(np.zeros(replicates) for _ in range(5)), None

        def close():
            np.add(won, tied_p * (n + tied_n / 2), out=won)
            np.add(p, tied_p, out=p)
            np.add(n, tied_n, out=n)

        for b in batches:
            s, y, k, cell = (b[c].to_numpy() for c in ("s", "y", "k", "cell"))
            for at in range(0, len(s), CHUNK):
                here = slice(at, at + CHUNK)
                w = draws(cell[here], k[here], reps, seed)
                edge = np.flatnonzero(np.r_[True, s[here][1:] != s[here][:-1]])
                of_p = w * (y[here] == 1)[:, None]  # cells are of label 1 or 0
                if len(edge) < len(w):
                    of_p, w = np.add.reduceat(of_p, edge, axis=0), np.add.reduceat(w, edge, axis=0)
                of_p, of_n = of_p.astype(np.float64), (w - of_p).astype(np.float64)
                if last is not None and s[at] == last:  # the score goes on from the rows before
                    of_p[0] += tied_p
                    of_n[0] += tied_n
                elif last is not None:
                    close()
                below = n + np.cumsum(of_n[:-1], axis=0)  # negatives up to each closed score
                if len(below):
                    won += (of_p[:-1] * (below - of_n[:-1] / 2)).sum(axis=0)
                    p += of_p[:-1].sum(axis=0)
                    n += of_n[:-1].sum(axis=0)
                tied_p, tied_n, last = of_p[-1], of_n[-1], s[here][-1]
        if last is not None:
            close()
            yield pa.record_batch([pa.array(reps, pa.int32()), pa.array(np.full(replicates, TaskContext.get().partitionId()), pa.int32()), *map(pa.array, (p, n, won))], names=["rep", "part", "p", "n", "a"])

    return rows.mapInArrow(run, "rep int, part int, p double, n double, a double")


def _auc_of_replicates(table: DataFrame, score: str, replicates: int, seed: int) -> DataFrame:
    parts = _auc_parts(table, score, replicates, seed)
    before = W.partitionBy("rep").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("won", F.col("a") + F.col("p") * F.coalesce(F.sum("n").over(before), F.lit(0.0)))
    return parts.groupBy("rep").agg(F.try_divide(F.sum("won"), F.sum("p") * F.sum("n")).alias("value"))


def resampled_histograms(table: DataFrame, score: str, replicates: int, seed: int) -> DataFrame:
    """rep, s, p, n: the weighted histogram of each replicate, for metrics of any kind."""
    rows = table.select(F.col(score).alias("s"), "y", "k", "cell")

    def run(batches):
        for b in batches:
            y, k, cell = (b[c].to_numpy() for c in ("y", "k", "cell"))
            for at in range(0, len(y), CHUNK):
                here = slice(at, at + CHUNK)
                w = draws(cell[here], k[here], np.arange(replicates), seed)
                i, rep = np.nonzero(w)
                w = w[i, rep].astype(np.int64)
                yield pa.record_batch([b["s"].take(pa.array(at + i)), pa.array(rep, pa.int32()), pa.array(w * (y[at + i] == 1)), pa.array(w * (y[at + i] == 0))], names=["s", "rep", "p", "n"])

    return rows.mapInArrow(run, "s double, rep int, p long, n long").groupBy("rep", "s").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))


def bootstrap_ci(df: DataFrame, replicates: int = 1000, alpha: float = 0.05, label: str = "label", scores: tuple[str, ...] = ("score",), seed: int = 0, fn: Callable[[DataFrame], DataFrame] | None = None, cell: Column | None = None) -> DataFrame:
    """lo, mid, hi, kept: percentile interval of a metric (one score) or of its difference (two, the
    second less the first) over Poisson resamples of the rows; single-class resamples are dropped.

    Rows are first counted into cells of equal label and scores; cells draw, rows are never copied.
    Without fn the metric is the AUC, and no drawn number leaves its task: score ranges are
    summed up to (positives, negatives, pairs in order) a replicate, and the ranges are put together.
    fn: takes a DataFrame (rep, s, p, n) of all replicates' weighted histograms and returns (rep,
    value), as `lambda h: from_histogram(h, ["rep"]).select("rep", F.col("eer").alias("value"))`.
    No row is left if a class is empty: the bounds are null and kept is 0. cell: 64 bits that name a
    cell, if other than the hash of its values.
    """
    table = cells(df, label, scores, cell)
    values = None
    for i, s in enumerate(scores):
        if fn is None:
            one = _auc_of_replicates(table, s, replicates, seed)
        else:
            one = fn(resampled_histograms(table, s, replicates, seed)).select("rep", "value")
        one = one.withColumnRenamed("value", f"v{i}")
        values = one if values is None else values.join(one, "rep")
    value = (F.col("v1") - F.col("v0")) if len(scores) == 2 else F.col("v0")
    q = F.percentile(value, F.array(F.lit(alpha / 2), F.lit(0.5), F.lit(1 - alpha / 2)))
    return values.where(value.isNotNull()).agg(q.alias("q"), F.count(F.lit(1)).alias("kept")).select(F.col("q")[0].alias("lo"), F.col("q")[1].alias("mid"), F.col("q")[2].alias("hi"), "kept")
