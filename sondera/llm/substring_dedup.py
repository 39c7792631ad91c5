"""Word-level substring removal with a log-structured fingerprint index.

The index holds fingerprints of windows. Consecutive windows with the same anchor (repeats.py) make
one entry, a run: anchor hash, 128-bit digest of all the words, occurrences, one occurrence's place.
An entry for each single window would be 14 rows where this is one, and its hashes and places alone
4 times the size of the texts; every window is in one entry either way.

A batch of texts becomes one immutable run of the index, a table sorted by fingerprint and bucketed
by it, written once. Before it is in, it is merge-joined with each run of history; buckets are alike,
so neither side is shuffled. What history holds is repeated in the batch; an entry that stood alone
in history until now is repeated there too, and its place is in the entry, so no old text is read
again. Runs of about the same size are then compacted into one by a merge-join that sums occurrences.

Fingerprints are verified by the digest of all their words (128 bits beside the anchor's 64). Entries
that share an anchor but differ are compared window by window, each window by 128 bits of its words.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import covered, materialize, read, release, row_key, scratch_root, words_of
from .repeats import RUN, by_text, classes_of, in_question, runs_of

WINDOW, GRAM, BATCHES, SALT = 35, 8, 2, 16


def word_tokens(text: str | None):
    words = words_of(text)
    if not words:
        return None
    tokens = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return tokens, tokens.tobytes(), 8


class FingerprintIndex:
    """Sorted, bucketed, immutable runs in the shared folder; (level, table name, path) each."""

    #: Runs of one level that are merged into one of the next.
    FANOUT = 2

    def __init__(self, spark: SparkSession, window: int = WINDOW, gram: int = GRAM):
        self.spark, self.window, self.gram = spark, window, min(gram, window)
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[tuple[int, str, str]] = []

    def _write(self, entries: DataFrame, level: int) -> tuple[int, str, str]:
        """entries must be dealt by fingerprint already: a task then writes one bucket, one file."""
        name = f"index_run_{uuid.uuid4().hex}"
        path = f"{scratch_root(self.spark)}/{name}"
        entries.write.option("path", path).option("compression", "zstd").bucketBy(self.buckets, *RUN).sortBy(*RUN).saveAsTable(name)
        return level, name, path

    def _drop(self, *runs: tuple[int, str, str]) -> None:
        for _, name, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            release(self.spark, path)

    def _met(self, x: str, y: str, how: str) -> DataFrame:
        """Merge-join of two runs by fingerprint."""
        a, b = self.spark.table(x).alias("x"), self.spark.table(y).alias("y").hint("merge")
        return a.join(b, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in RUN], how)

    def _merged(self, x: str, y: str) -> DataFrame:
        """Two runs as one: each fingerprint once, with the occurrences of both."""
        return self._met(x, y, "full_outer").select(
            *(F.coalesce(f"x.{c}", f"y.{c}").alias(c) for c in RUN),
            (F.coalesce("x.c", F.lit(0)) + F.coalesce("y.c", F.lit(0))).alias("c"),
            F.least("x.rep", "y.rep").alias("rep"),
        )

    def sorted_run(self, runs: DataFrame) -> tuple[int, str, str]:
        """The sorted run of one batch, not yet in the index."""
        return self._write(classes_of(runs).repartition(self.buckets, *RUN), 0)

    def known(self, run: tuple[int, str, str]) -> DataFrame:
        """Fingerprints of a batch's run that history holds, with history's count and place: one
        merge-join with each run of history."""
        out = None
        for _, name, _ in self.levels:
            hit = self._met(run[1], name, "inner").select(*(f"x.{c}" for c in RUN), F.col("y.c").alias("c"), F.col("y.rep").alias("rep"))
            out = hit if out is None else out.unionByName(hit)
        return out if out is not None else self.spark.table(run[1]).select(*RUN, "c", "rep").where(F.lit(False))

    def add(self, run: tuple[int, str, str]) -> None:
        """A batch's run comes in; levels that are full are compacted."""
        while (same := [x for x in self.levels if x[0] == run[0]]) and len(same) >= self.FANOUT - 1:
            for x in same:
                self.levels.remove(x)
                merged = self._write(self._merged(x[1], run[1]), run[0] + 1)
                self._drop(x, run)
                run = merged
        self.levels.append(run)

    def compact(self) -> DataFrame:
        """All runs as one."""
        while len(self.levels) > 1:
            a, b = self.levels.pop(), self.levels.pop()
            self.levels.append(self._write(self._merged(b[1], a[1]), max(a[0], b[0]) + 1))
            self._drop(a, b)
        return self.spark.table(self.levels[0][1])

    def drop(self) -> None:
        self._drop(*self.levels)
        self.levels = []


def repeats_with_history(index: FingerprintIndex, runs: DataFrame) -> tuple[DataFrame, str]:
    """key, lo, n of what a batch's runs make a repeat, in the batch and in history; the batch is in
    the index afterwards. Also the path of the written rows."""
    run = index.sorted_run(runs)
    known, path = materialize(index.known(run), "index-known")
    twice = index.spark.table(run[1]).where("c > 1").select(*RUN).unionByName(known.select(*RUN)).distinct()
    # a run that a third of all rows share is met in SALT tasks
    twice = twice.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    here = runs.withColumn("salt", F.pmod(F.xxhash64("key", "lo"), F.lit(SALT)).cast("int")).join(twice, [*RUN, "salt"]).select("key", "lo", "n")
    # what stood alone in history no longer does; what stood there twice has been told before
    there = known.where("c = 1").select("rep.key", "rep.lo", "rep.n")
    out = materialize(here.unionByName(there), "index-repeats")
    index.add(run)
    release(index.spark, path)
    return out


def _single_windows(docs: DataFrame, asked: DataFrame, window: int) -> DataFrame:
    """w1, w2, key, at, c of every window of the runs in question."""
    per_text = by_text(asked, "lo", "n", "c")

    def run(batches):
        for b in batches:
            w1, w2, keys, at, c = [], [], [], [], []
            for key, text, found in zip(b[0].to_pylist(), b[1], b[2].to_pylist()):
                raw, digest = word_tokens(text.as_py())[1], xxhash.xxh3_128_intdigest
                for r in found:
                    for i in range(r["lo"], r["lo"] + r["n"]):
                        d = digest(raw[8 * i : 8 * (i + window)])
                        w1.append(d >> 65)
                        w2.append(d & ((1 << 63) - 1))
                        at.append(i)
                    keys += [key] * r["n"]
                    c += [r["c"]] * r["n"]
            yield pa.record_batch([pa.array(x, pa.binary() if x is keys else pa.int64()) for x in (w1, w2, keys, at, c)], names=["w1", "w2", "key", "at", "c"])

    return docs.join(per_text.hint("shuffle_hash"), "key").select("key", "text", "runs").mapInArrow(run, "w1 long, w2 long, key binary, at long, c long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, batches: int = BATCHES, keep_text: bool = False) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 of every row, and the kept words joined by spaces
    (`kept`) where asked for. Texts come into the index in `batches` batches, by a hash.

    A null text has no words. Texts are taken whole, however long; those shorter than the window lose
    nothing. Rows that repeat, id and text alike, repeat each other and all lose what is covered; a
    null id is an id like any other. An empty table gives an empty result. Extra columns are left out.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    docs = docs.withColumn("key", row_key("id", "text"))
    index = FingerprintIndex(spark, window)
    all_runs = runs_of(docs, word_tokens, window, index.gram).withColumn("batch", F.pmod(F.xxhash64("key"), F.lit(batches)).cast("int"))
    runs, runs_path = materialize(all_runs, "index-batches", partition_by="batch")
    found, known = [], None
    for i in range(batches):
        told, path = repeats_with_history(index, runs.where(F.col("batch") == i).drop("batch"))
        known = told if known is None else known.unionByName(told)
        found.append(path)
    release(spark, runs_path)
    classes = index.compact()
    asked, asked_path = materialize(in_question(classes), "index-asked")
    index.drop()
    single, single_path = materialize(_single_windows(docs, asked, window), "index-windows")
    twice = single.groupBy("w1", "w2").agg(F.sum("c").alias("t")).where("t > 1").select("w1", "w2")
    new, _ = materialize(single.where("c = 1").join(twice, ["w1", "w2"]).select("key", F.col("at").alias("lo"), F.lit(1).alias("n")), "index-new")
    release(spark, asked_path, single_path)
    per_text = by_text(known.unionByName(new), "lo", "n")
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches_):
        for b in batches_:
            out = [[], [], [], []]
            for text, found in zip(b[1], b[2]):
                words = words_of(text.as_py())
                n, removed = len(words), 0
                if found.is_valid:
                    v = found.values
                    lo, k = v.field("lo").to_numpy(), v.field("n").to_numpy()
                    gone = covered(n, lo, lo + k + window - 1)
                    removed = int(gone.sum())
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                kept = b" ".join(words)
                for column, x in zip(out, (n, removed, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if keep_text else None)):
                    column.append(x)
            cols = [b[0], pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())] + ([pa.array(out[3], pa.string())] if keep_text else [])
            yield pa.record_batch(cols, names=[id_col, "n_words", "n_removed", "kept_sha256"] + ["kept"] * keep_text)

    joined = docs.join(per_text.hint("shuffle_hash"), "key", "left").select("id", "text", "runs")
    return joined.mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))
