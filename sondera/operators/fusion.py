"""Missing-aware evidence fusion. Evidence has a score and an availability column per dimension."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import DIMENSIONS, card_verdict, logit, sigmoid, verdict
from .calibrate import linspace, nll_grid


@dataclass(frozen=True)
class Head:
    weights: dict[str, float] = field(default_factory=lambda: {d: 1.0 / len(DIMENSIONS) for d in DIMENSIONS})
    bias: float = 0.0
    temperature: float = 1.0


def vector(df: DataFrame, scores: str = "scores", available: str = "available") -> DataFrame:
    """s_<dim>, a_<dim> from maps: no score is 0.5, no availability is none."""
    out = df
    for d in DIMENSIONS:
        out = out.withColumn(f"s_{d}", F.coalesce(F.try_element_at(F.col(scores), F.lit(d)), F.lit(0.5)))
        out = out.withColumn(f"a_{d}", F.coalesce(F.try_element_at(F.col(available), F.lit(d)), F.lit(False)))
    return out


def contribution(d: str, head: Head) -> Column:
    return F.when(F.col(f"a_{d}"), logit(F.col(f"s_{d}")) * head.weights[d]).otherwise(0.0)


def raw_logit(head: Head) -> Column:
    return sum((contribution(d, head) for d in DIMENSIONS), F.lit(0.0)) + head.bias


def probability(head: Head) -> Column:
    return sigmoid(raw_logit(head) / head.temperature)


def score_scans(df: DataFrame, head: Head, synthetic: float = 0.85, suspicious: float = 0.5) -> DataFrame:
    """df with confidence, verdict, evidence (cards by falling absolute contribution, equal ones in
    the order of dimensions) and driver, the first card's dimension."""
    # each logit once a row: the projections below refer to these columns more than once
    df = df.withColumns({f"__c_{d}": contribution(d, head) for d in DIMENSIONS})
    raw = sum((F.col(f"__c_{d}") for d in DIMENSIONS), F.lit(0.0)) + head.bias
    df = df.withColumn("confidence", sigmoid(raw / head.temperature))
    cards = []
    for i, d in enumerate(DIMENSIONS):
        share = F.col(f"__c_{d}") / max(head.temperature, 1e-9)
        cards.append(
            F.struct(
                (-F.abs(share)).alias("order"),
                F.lit(i).alias("place"),
                F.lit(d).alias("dimension"),
                F.when(F.col(f"a_{d}"), F.col(f"s_{d}")).alias("score"),
                card_verdict(F.col(f"s_{d}"), F.col(f"a_{d}"), F.lit(d)).alias("verdict"),
                share.alias("contribution"),
            )
        )
    cards = F.transform(F.array_sort(F.array(*cards)), lambda c: F.struct(c["dimension"].alias("dimension"), c["score"].alias("score"), c["verdict"].alias("verdict"), c["contribution"].alias("contribution")))
    out = df.withColumn("verdict", verdict(F.col("confidence"), synthetic, suspicious)).withColumn("evidence", cards)
    return out.withColumn("driver", F.col("evidence")[0]["dimension"]).drop(*(f"__c_{d}" for d in DIMENSIONS))


def abstention_rate(df: DataFrame, head: Head, synthetic: float = 0.85, suspicious: float = 0.5) -> DataFrame:
    p = probability(head)
    return df.agg(F.avg(((p >= suspicious) & (p < synthetic)).cast("int")).alias("abstention_rate"))


def disagreement() -> Column:
    """Population deviation over the available cards; 0 for one or none."""
    n = sum((F.col(f"a_{d}").cast("int") for d in DIMENSIONS), F.lit(0))
    s = sum((F.when(F.col(f"a_{d}"), F.col(f"s_{d}")).otherwise(0.0) for d in DIMENSIONS), F.lit(0.0))
    mean = s / F.greatest(n, F.lit(1))
    sq = sum((F.when(F.col(f"a_{d}"), (F.col(f"s_{d}") - mean) * (F.col(f"s_{d}") - mean)).otherwise(0.0) for d in DIMENSIONS), F.lit(0.0))
    return F.when(n > 1, F.sqrt(sq / F.greatest(n, F.lit(1)))).otherwise(0.0)


def fit_temperature(df: DataFrame, head: Head, label: str = "label") -> DataFrame:
    """temperature, nll: the first of 300 grid points of least loss for the head's logits."""
    points = df.groupBy(raw_logit(head).alias("z"), F.col(label).cast("double").alias("y")).agg(F.count(F.lit(1)).alias("k"))
    best = nll_grid(points, linspace(0.2, 6.0, 300)).agg(F.min(F.struct("nll", "t")).alias("b"))
    return best.select(F.col("b.t").alias("temperature"), F.col("b.nll").alias("nll"))


def fit(df: DataFrame, row_id: str, label: str = "label", epochs: int = 300, rate: float = 0.1, l2: float = 1e-3, dropout: float = 0.3, reps: int = 4, seed: int = 0) -> Head:
    """Batch gradient descent with modality dropout: each epoch is one aggregate of seven sums; the
    masks come from hashes of (row, repeat, dimension), so a retried task sees the same ones. A row
    whose available dimensions would all be dropped keeps them all.

    A row is kept once, with a bit mask a repeat; repeats part only inside an epoch. The weights come
    as a row that is joined, not as literals: all epochs run the same compiled plan."""
    spark, bits = df.sparkSession, {d: 1 << i for i, d in enumerate(DIMENSIONS)}
    cores = spark.sparkContext.defaultParallelism
    base = df.select(F.col(row_id).cast("string").alias("id"), F.col(label).cast("double").alias("y"), *(F.when(F.col(f"a_{d}"), logit(F.col(f"s_{d}"))).otherwise(0.0).alias(f"x_{d}") for d in DIMENSIONS), sum((F.when(F.col(f"a_{d}"), k).otherwise(0) for d, k in bits.items()), F.lit(0)).alias("has"))
    if df.rdd.getNumPartitions() < cores:
        base = base.repartition(2 * cores, "id")
    # hash_uniform(...) >= dropout, as its eight hexadecimal digits in their order as text
    least = f"{math.ceil(min(max(dropout, 0.0), 1.0) * 2**32):08x}"
    over = lambda d, r: F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}|{d}"), F.col("id"), F.lit(str(r)))), 1, 8) >= least if len(least) == 8 else F.lit(False)
    drawn = lambda r: sum((F.when(over(d, r), k).otherwise(0) for d, k in bits.items()), F.lit(0))
    base = base.withColumns({f"k_{r}": drawn(r) for r in range(reps)})
    # by what is available, not by its logit: a score of one half is a card like any other
    kept = {f"k_{r}": F.when(F.col(f"k_{r}").bitwiseAND(F.col("has")) == 0, sum(bits.values())).otherwise(F.col(f"k_{r}")).cast("int") for r in range(reps)}
    rows = base.select("y", *(f"x_{d}" for d in DIMENSIONS), *(c.alias(k) for k, c in kept.items())).persist()
    n, w, b = max(1, rows.count() * reps), {d: 1.0 / len(DIMENSIONS) for d in DIMENSIONS}, 0.0
    each = rows.select("y", *(f"x_{d}" for d in DIMENSIONS), F.explode(F.array(*kept)).alias("k"))
    each = each.select("y", *(F.when(F.col("k").bitwiseAND(F.lit(k)) != 0, F.col(f"x_{d}")).otherwise(0.0).alias(d) for d, k in bits.items()))
    z, sums = sum((F.col(d) * F.col(f"w_{d}") for d in DIMENSIONS), F.col("w_b")), [*(F.sum(F.col("err") * F.col(d)).alias(d) for d in DIMENSIONS), F.sum("err").alias("b")]
    for _ in range(epochs):
        now = spark.sql(f"SELECT * FROM VALUES ({', '.join(f'{float(v)!r}D' for v in (*w.values(), b))}) AS t({', '.join(f'w_{d}' for d in w)}, w_b)")
        errors = each.crossJoin(F.broadcast(now)).select(*DIMENSIONS, "y", z.alias("z")).select(*DIMENSIONS, (sigmoid(F.col("z")) - F.col("y")).alias("err"))
        g = errors.agg(*sums).collect()[0]
        # the data term is a mean over rows and repeats, the penalty is a share of the rows alone
        w = {d: w[d] - rate * ((g[d] or 0.0) / n + l2 * w[d] * reps / n) for d in DIMENSIONS}
        b -= rate * (g["b"] or 0.0) / n
    rows.unpersist()
    return Head(w, b)
