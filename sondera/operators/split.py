"""Manifest validation, leakage-safe splitting, leakage and balance reports."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = ("path", "label", "generator", "family", "source_id", "media_type", "quality", "split")


@dataclass(frozen=True)
class SplitSpec:
    holdout_generators: tuple[str, ...] = ()
    val_fraction: float = 0.2
    test_fraction: float = 0.2
    seed: int = 0


def manifest_problems(df: DataFrame, require_split: bool = False) -> DataFrame:
    """One row: bad_labels, duplicate_paths, authentic_positives, rows. Missing columns raise."""
    missing = [c for c in MANIFEST if c not in df.columns and (c != "split" or require_split)]
    if missing:
        raise ValueError(f"manifest lacks columns: {missing}")
    per_path = df.groupBy("path").agg(
        F.count(F.lit(1)).alias("k"),
        F.count_if(F.col("label").isNull() | ~F.col("label").isin(0, 1)).alias("bad"),
        F.count_if((F.col("generator") == "authentic") & (F.col("label") != 0)).alias("wrong"),
    )
    return per_path.agg(
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_labels"),
        F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("duplicate_paths"),
        F.coalesce(F.sum("wrong"), F.lit(0)).alias("authentic_positives"),
        F.coalesce(F.sum("k"), F.lit(0)).alias("rows"),
    )


def validate_manifest(df: DataFrame, require_split: bool = False) -> DataFrame:
    """df, or ValueError with what is wrong (one small aggregate is collected)."""
    p = manifest_problems(df, require_split).first()
    bad = [k for k in ("bad_labels", "duplicate_paths", "authentic_positives") if p[k]]
    if bad:
        raise ValueError("; ".join(f"{k}: {p[k]}" for k in bad))
    return df


def hash_fraction(col: Column) -> Column:
    """[0, 1) from the first 8 hexadecimal digits of the md5, native on all engines."""
    return F.conv(F.substring(F.md5(col.cast("string")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def blake_fraction(col: Column) -> Column:
    """[0, 1) from the big-endian 8-byte blake2b of the id as text, where parity is asked for."""

    @F.pandas_udf(T.DoubleType())
    def fraction(ids):
        return ids.astype(str).map(lambda x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") / 2**64)

    return fraction(col)


def group_split(df: DataFrame, spec: SplitSpec, fraction=hash_fraction) -> DataFrame:
    """df with `split`: test are the held-out generators and the authentic rows of sources whose
    fraction is below test_fraction; val is max(1, int(n * val_fraction)) of the n other sources, in
    the order of a seeded hash; train is the rest. Sources never straddle train and val."""
    held = F.col("generator").isin(*spec.holdout_generators) if spec.holdout_generators else F.lit(False)
    test = held | ((F.col("generator") == "authentic") & (fraction(F.col("source_id")) < spec.test_fraction))
    marked = df.withColumn("__test", test)
    rest = marked.where(~F.col("__test")).select("source_id").distinct()
    order = F.md5(F.concat_ws("|", F.lit(str(spec.seed)), F.col("source_id").cast("string")))
    n = rest.count()
    # the n_val smallest hashes: a top-k, no global sort
    val = rest.orderBy(order, "source_id").limit(max(1, int(n * spec.val_fraction)) if n else 0).withColumn("__val", F.lit(True))
    out = marked.join(val, "source_id", "left")
    return out.withColumn("split", F.when(F.col("__test"), "test").when(F.col("__val"), "val").otherwise("train")).drop("__test", "__val")


def leakage(df: DataFrame) -> DataFrame:
    """pair, shared_sources, shared_generators (sorted names of positives), problem, a row a pair."""
    sources = df.groupBy("source_id").agg(F.collect_set("split").alias("in"))
    gens = df.where("label = 1").groupBy("generator").agg(F.collect_set("split").alias("in"))
    out = None
    for a, b in (("train", "val"), ("train", "test"), ("val", "test")):
        both = F.array_contains("in", a) & F.array_contains("in", b)
        s = sources.agg(F.count_if(both).alias("shared_sources"))
        g = gens.agg(F.array_join(F.array_sort(F.collect_list(F.when(both, F.col("generator")))), ",").alias("shared_generators"))
        row = s.crossJoin(F.broadcast(g)).select(F.lit(f"{a}|{b}").alias("pair"), "*")
        row = row.withColumn("problem", (F.col("shared_sources") > 0) | (F.lit((a, b) == ("train", "test")) & (F.col("shared_generators") != "")))
        out = row if out is None else out.unionByName(row)
    return out


def check_leakage(df: DataFrame) -> DataFrame:
    """The leakage report; ValueError if it has a problem."""
    report = leakage(df)
    bad = [r["pair"] for r in report.where("problem").collect()]
    if bad:
        raise ValueError(f"splits leak: {bad}")
    return report


def balance(df: DataFrame) -> DataFrame:
    """split, family, n_0, n_1."""
    return df.groupBy("split", "family").agg(F.count_if(F.col("label") == 0).alias("n_0"), F.count_if(F.col("label") == 1).alias("n_1"))


def coverage(df: DataFrame) -> DataFrame:
    """split, n_0, n_1, single_class."""
    out = df.groupBy("split").agg(F.count_if(F.col("label") == 0).alias("n_0"), F.count_if(F.col("label") == 1).alias("n_1"))
    return out.withColumn("single_class", (F.col("n_0") == 0) | (F.col("n_1") == 0))


def quota(df: DataFrame, key: str, seq: str, n_keys: int, per_key: int, keep: Column) -> DataFrame:
    """The first per_key rows that pass `keep` of each of the first n_keys keys, in order of seq."""
    ok = df.where(keep)
    first = ok.groupBy(key).agg(F.min(seq).alias("__first")).orderBy("__first", key).limit(n_keys).select(key)
    ranked = ok.join(F.broadcast(first) if n_keys <= 100_000 else first, key).withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(seq)))
    return ranked.where(F.col("__r") <= per_key).drop("__r")


def lookup(df: DataFrame, store: DataFrame, on: dict[str, str], message: str = "key is missing from the store") -> DataFrame:
    """df with the columns of store, joined by key (column of df -> column of store, unique there).
    A row whose key the store lacks fails the job when it is read."""
    held = store.withColumn("__held", F.lit(True))
    met = df.join(held, [df[a] == held[b] for a, b in on.items()], "left")
    first = store.columns[0]
    checked = F.when(F.col("__held").isNull(), F.raise_error(F.concat_ws(" ", F.lit(message + ":"), *(F.col(a).cast("string") for a in on)))).otherwise(F.col(first))
    return met.withColumn(first, checked).drop("__held")
