"""Evaluation harness: overall and per-group metrics, release gate, report."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics as M


@dataclass(frozen=True)
class EvalConfig:
    fprs: tuple[float, ...] = (0.001, 0.01, 0.05)
    primary_fpr: float = 0.01
    bootstrap: int = 500
    seed: int = 0
    min_rows: int = 30

    @property
    def all_fprs(self) -> tuple[float, ...]:
        """The primary rate is always among those that are measured."""
        return tuple(sorted({*self.fprs, self.primary_fpr}))


def complete(df: DataFrame) -> DataFrame:
    """A scored frame with the optional columns filled; missing required ones raise."""
    missing = [c for c in ("label", "score", "generator") if c not in df.columns]
    if missing:
        raise ValueError(f"scored frame lacks columns: {missing}")
    for c in ("family", "quality", "degradation"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit("unknown"))
    return df


#: level -> column of the optional groupings, and those measured against the negatives of the whole frame
LEVELS = {"overall": None, "generator": "generator", "family": "family", "quality": "quality", "degradation": "degradation"}
SHARED = ("generator", "family")


def measure(df: DataFrame, cfg: EvalConfig = EvalConfig(), levels: tuple[str, ...] = tuple(LEVELS), scores: dict[str, str] | None = None) -> DataFrame:
    """model, level, key, n, n_pos, n_neg, auc, eer, eer_thr, thr_*, strict_*, tpr_*, low_n: everything that
    a report needs, from one scan and one histogram.

    generator and family: positives of the key against all negatives, n counts positives. The other
    levels: the key's own rows, and keys of a single class are left out. Null keys are `nan`.
    """
    out = M.levels(df, {v: LEVELS[v] for v in levels}, scores or {"score": "score"}, cfg.all_fprs, tuple(v for v in levels if v in SHARED))
    shared = F.col("level").isin(*SHARED)
    n = F.when(shared, F.col("n_pos")).otherwise(F.col("n_pos") + F.col("n_neg"))
    out = out.where(shared | (F.col("level") == "overall") | ((F.col("n_pos") > 0) & (F.col("n_neg") > 0)))
    return out.withColumn("eer", F.when(~shared, F.col("eer"))).withColumn("eer_thr", F.when(~shared, F.col("eer_thr"))).withColumn("n", n).withColumn("low_n", n < cfg.min_rows)


def _tprs(cfg: EvalConfig) -> list[str]:
    return [f"tpr_{M.name(f)}" for f in cfg.all_fprs]


def group_metrics(df: DataFrame, key: str, cfg: EvalConfig = EvalConfig()) -> DataFrame:
    """A row for each value of key among the positives: n, auc and TPRs against the negatives of the
    whole frame, low_n."""
    out = M.levels(df, {"group": key}, {"score": "score"}, cfg.all_fprs, ("group",))
    return out.select("key", F.col("n_pos").alias("n"), "auc", *_tprs(cfg)).withColumn("low_n", F.col("n") < cfg.min_rows)


def robustness(df: DataFrame, cfg: EvalConfig = EvalConfig()) -> DataFrame:
    """degradation, n, auc, tpr at the primary rate against its own negatives; single-class groups
    are left out; best AUC first."""
    return _robustness(measure(df, cfg, ("degradation",)), cfg)


def _robustness(measured: DataFrame, cfg: EvalConfig) -> DataFrame:
    return measured.where("level = 'degradation'").select(F.col("key").alias("degradation"), "n", "auc", F.col(f"tpr_{M.name(cfg.primary_fpr)}").alias("tpr")).orderBy(F.desc("auc"), "degradation")


def per_quality(df: DataFrame, prob: str | None = None) -> DataFrame:
    """quality, n, auc and, with a probability, ece of each quality of two classes."""
    return _per_quality(measure(df, levels=("quality",)), df, prob)


def _per_quality(measured: DataFrame, df: DataFrame, prob: str | None) -> DataFrame:
    out = measured.where("level = 'quality'").select(F.col("key").alias("quality"), "n", "auc")
    if prob:
        keyed = df.withColumn("quality", F.coalesce(F.col("quality").cast("string"), F.lit("nan")))
        out = out.join(M.ece(keyed, prob=prob, groups=["quality"]).select("quality", "ece"), "quality")
    return out.orderBy("quality")


def evaluate(df: DataFrame, cfg: EvalConfig = EvalConfig(), prob: str | None = None, ci: bool = False) -> dict[str, DataFrame]:
    """overall, per_generator, per_family, per_quality, robustness, and the AUC's bootstrap interval
    (auc_ci) on demand; lazily, each one small table cut out of one measured histogram."""
    df = M.checked(complete(df))
    measured = measure(df, cfg)
    primary = F.asc(f"tpr_{M.name(cfg.primary_fpr)}")
    rates = [f"{what}_{M.name(f)}" for what in ("thr", "strict", "tpr") for f in cfg.all_fprs]
    overall = measured.where("level = 'overall'").select("n_pos", "n_neg", "auc", "eer", "eer_thr", *rates)
    if prob:
        overall = overall.crossJoin(M.ece(df, prob=prob))
    grouped = lambda level: measured.where(F.col("level") == level).select("key", "n", "auc", *_tprs(cfg), "low_n").orderBy(primary, "key")
    out = {"overall": overall, "per_generator": grouped("generator"), "per_family": grouped("family"), "per_quality": _per_quality(measured, df, prob), "robustness": _robustness(measured, cfg)}
    if ci:
        out["auc_ci"] = M.bootstrap_ci(df, cfg.bootstrap, seed=cfg.seed)
    return out


def evaluate_table(df: DataFrame, cfg: EvalConfig = EvalConfig(), prob: str | None = None, cell=None) -> DataFrame:
    """The whole evaluation as one table: the rows of `measure`, with ece and brier of the overall and
    the quality rows where a probability is given, and the AUC's interval (auc_lo, auc_hi) of the overall row."""
    df = M.checked(complete(df))
    out = measure(df, cfg).drop("model")
    ci = M.bootstrap_ci(df, cfg.bootstrap, seed=cfg.seed, cell=cell).select(F.lit("overall").alias("level"), F.lit("all").alias("key"), F.col("lo").alias("auc_lo"), F.col("hi").alias("auc_hi"))
    out = out.join(F.broadcast(ci), ["level", "key"], "left")
    if prob:
        keys = F.explode(F.array(*(F.struct(F.lit(v).alias("level"), (F.coalesce(F.col(c).cast("string"), F.lit("nan")) if c else F.lit("all")).alias("key")) for v, c in (("overall", None), ("quality", "quality")))))
        e = M.ece(df.select("label", prob, keys.alias("w")).select("label", prob, "w.level", "w.key"), prob=prob, groups=["level", "key"])
        out = out.join(e, ["level", "key"], "left")
    return out


def release_gate(candidate: DataFrame, incumbent: DataFrame, cand_tpr: DataFrame, inc_tpr: DataFrame, cfg: EvalConfig = EvalConfig(), max_drop: float = 0.03) -> DataFrame:
    """blocked, reasons from two per-generator frames and two overall ones. Blocks if the overall
    primary TPR falls, or that of any generator (not low_n, known to the incumbent) by over max_drop."""
    t = f"tpr_{M.name(cfg.primary_fpr)}"
    named = lambda model, level, df: df.select(F.lit(model).alias("model"), F.lit(level).alias("level"), "key" if "key" in df.columns else F.lit("all").alias("key"), t, "low_n" if "low_n" in df.columns else F.lit(False).alias("low_n"))
    rows = named("candidate", "generator", candidate).unionByName(named("incumbent", "generator", incumbent)).unionByName(named("candidate", "overall", cand_tpr)).unionByName(named("incumbent", "overall", inc_tpr))
    return gate(rows, cfg, max_drop)


def gate(measured: DataFrame, cfg: EvalConfig = EvalConfig(), max_drop: float = 0.03) -> DataFrame:
    """blocked, reasons from the measured rows (levels overall and generator) of the models `candidate`
    and `incumbent`, in two aggregates: one row a key with both models, then one of all."""
    t = F.col(f"tpr_{M.name(cfg.primary_fpr)}")
    of = lambda model, c: F.max(F.when(F.col("model") == model, c))
    both = measured.groupBy("level", "key").agg(of("candidate", t).alias("c"), of("incumbent", t).alias("i"), of("candidate", F.col("low_n")).alias("low_n"))
    overall = F.bool_or((F.col("level") == "overall") & (F.col("c") < F.col("i") - 1e-9))
    falls = (F.col("level") == "generator") & ~F.col("low_n") & (F.col("i") - F.col("c") > max_drop)
    out = both.agg(F.coalesce(overall, F.lit(False)).alias("overall"), F.array_sort(F.collect_list(F.when(falls, F.col("key")))).alias("keys"))
    reasons = F.array_compact(F.concat(F.array(F.when(F.col("overall"), F.lit("overall"))), F.col("keys")))
    return out.select((F.col("overall") | (F.size("keys") > 0)).alias("blocked"), F.array_join(reasons, ",").alias("reasons"))


def markdown_table(df: DataFrame, floats: str = "{:.3f}") -> str:
    """A small result as a table in Markdown; missing numbers are blank."""
    show = lambda v: "" if v is None or v != v else floats.format(v) if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in df.collect()])


def flagged(groups: DataFrame) -> DataFrame:
    """groups with `flag`: low n, BLIND (AUC under 0.6), weak (under 0.8) or nothing."""
    return groups.withColumn("flag", F.when(F.col("low_n"), "low n").when(F.col("auc") < 0.6, "BLIND").when(F.col("auc") < 0.8, "weak").otherwise(""))


def report(result: dict[str, DataFrame], cfg: EvalConfig = EvalConfig(), title: str = "Evaluation") -> str:
    """Markdown of a result: generators worst first, marked BLIND (AUC under 0.6) or weak (0.8)."""
    parts = [f"# {title}", f"Settings: {asdict(cfg)}"]
    for k, frame in result.items():
        parts += [f"## {k}", markdown_table(flagged(frame) if "low_n" in frame.columns else frame)]
    gaps = [r["key"] for r in result["per_generator"].where("low_n").collect()]
    return "\n\n".join([*parts, "## Coverage gaps", ", ".join(gaps) or "none"]) + "\n"
