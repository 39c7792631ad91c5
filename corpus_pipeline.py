"""A training corpus from the documents table, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all that its predecessor kept; each
result is written as Parquet and read again before the next stage. All but the last return the
columns of documents; other columns are left out. Stages tell rows apart by all these columns, never
by the id alone, so rows with a null id, or with an id that stands elsewhere too, are rows like any
other. An empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondera.llm import decontaminate, line_dedup, mixing, near_copies, quality
from sondera.llm.common import materialize, read, release, row_key

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: SQL can't express the trained and the iterative stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on these documents, does not reject. Null,
    empty and blank texts go; repeated rows fare alike."""
    scored = quality.score(docs.select(*COLUMNS), quality.train(docs), "text", "quality_score")
    return scored.where(F.col("quality_score") >= quality.THRESHOLD).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with lines that stand elsewhere first taken out; one that loses lines and has
    nothing left goes. Null and empty texts lose nothing. Rows that repeat whole count as one."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    out = out.where((F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8 or more): that of the
    least id, nulls last. SimHash fingerprints of four differing bits at most name pairs first, bands of
    min-hashes those that a fingerprint can't tell; all are verified on their shingles. Rows with a null id or with an id that stands elsewhere are rows like any other."""
    return near_copies.one_of_each(docs.select(*COLUMNS))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, F.hex(row_key(*COLUMNS)).alias("row"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item stands in; null and empty texts hold none. Rows that share an
    id with a leaking one stay unless they leak themselves."""
    docs = _keyed(docs)
    found = decontaminate.contaminated(docs, read(spark, sf_dir, "benchmark"), id_col="row").select("row").distinct()
    return docs.join(found, "row", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that a document is taken, with its text. Texts without words are never
    taken; null languages and sources are leaves of their own. Each of several equal rows is taken by
    itself."""
    docs = _keyed(docs)
    taken = mixing.mix(docs, id_col="row").groupBy("row", "domain", "epoch", "n_tokens").agg(F.count(F.lit(1)).cast("int").alias("times"))
    met = docs.dropDuplicates(["row"]).join(taken, "row")
    return met.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS, "domain", "epoch", "n_tokens")


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", one_of_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = read(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs, before = stage(spark, docs, sf_dir), path
        if i < len(STAGES) - 1:
            docs, path = materialize(docs, f"pipeline-{i}")
            release(spark, *([before] if before else []))
    return docs
