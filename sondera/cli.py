"""Evaluate a scored table: python -m sondera.cli --scores DIR_OR_CSV --out DIR [--baseline CSV].

Writes eval.json and eval.md below --out (a path that Spark's file system layer can open) and exits
with 1 when the release gate blocks.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import harness as H
from .operators import metrics as M


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, or CSV with a header; label and score get their types."""
    df = spark.read.csv(path, header=True) if path.endswith(".csv") else spark.read.parquet(path)
    return df.withColumn("label", F.col("label").cast("int")).withColumn("score", F.col("score").cast("double"))


def as_json(result: dict[str, DataFrame]) -> str:
    """Each small table of a result as a list of objects, by name."""
    return json.dumps({k: [r.asDict(recursive=True) for r in df.collect()] for k, df in result.items()}, indent=1)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--scores", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--baseline")
    p.add_argument("--primary-fpr", type=float, default=0.01)
    p.add_argument("--bootstrap", type=int, default=0)
    p.add_argument("--title", default="Evaluation")
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    cfg = H.EvalConfig(primary_fpr=a.primary_fpr, bootstrap=a.bootstrap)
    df = read_scores(spark, a.scores)
    result = H.evaluate(df, cfg, ci=a.bootstrap > 0)
    text, blocked = H.report(result, cfg, a.title), False
    if a.baseline:
        old = read_scores(spark, a.baseline)
        scored = lambda model, x: H.complete(x).select(F.lit(model).alias("model"), "label", "score", "generator")
        both = scored("candidate", df).unionByName(scored("incumbent", old))
        models = {m: F.when(F.col("model") == m, F.col("score")) for m in ("candidate", "incumbent")}
        gate = H.gate(H.measure(both.withColumns(models), cfg, ("overall", "generator"), {m: m for m in models}), cfg).first()
        blocked = gate["blocked"]
        text += f"\nRelease gate: {'BLOCKED: ' + gate['reasons'] if blocked else 'passed'}\n"
    write_text(spark, f"{a.out.rstrip('/')}/eval.json", as_json(result))
    write_text(spark, f"{a.out.rstrip('/')}/eval.md", text)
    return int(blocked)


if __name__ == "__main__":
    sys.exit(main())
