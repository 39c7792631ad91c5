"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight (position, byte) postings. Two fingerprints at Hamming distance d
differ in at most d positions, so a pair within `max_bits` (4) shares at least 8 - 4 = 4 of its
positional bytes: the guaranteed minimum count. The list of one posting holds N / 256 fingerprints,
and tallying all pairs of such lists is work of N^2 / 64. So lists are kept for small sets of
postings, chosen such that every four positions contain one of the sets (`covering`): any pair whose
tally reaches four stands together in one of the lists, which hold N / 2^24 unrelated fingerprints.
In each list the shared positional bytes of every pair are tallied, pairs below the minimum are
dropped, and the rest are verified on their bits; a pair that meets in several lists counts in the
first of them. Only a spanning forest of a list's links leaves it.

A list of over BLOCK fingerprints is cut into blocks, and each pair of blocks is a cell of its own,
so that no task holds more than two blocks, however many fingerprints share three bytes.

Equal fingerprints are collapsed before the index, so copies make one entry however many they are.
Components: large-star / small-star rounds on distinct fingerprints, each round a written table.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, release, spread

SHINGLE_WORDS, MAX_BITS, SEED, SALT = 4, 4, 42, 16
BLOCK = 1024


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """SimHash of one whole text; 0 for a null text or one without words."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    k = max(1, len(w) - words + 1)
    starts = [0, *(ends[: k - 1] + 1).tolist()]
    stops = ends[min(words, len(w)) - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, k, 1 << 16):
        h = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)])]
        bits = np.unpackbits(np.array(h, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        # in steps of 255 rows the sums fit a byte
        whole = len(bits) // 255 * 255
        ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[whole:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > k).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (the fingerprint's bits as a signed long) of every row."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_py()) for t in b[1]]
            yield pa.record_batch([b[0].cast(pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())], names=["id", "fp"])

    return spread(docs.select(F.col(id_col).cast("long"), F.col(text_col))).mapInArrow(run, "id long, fp long")


def covering(most: int, take: int = 3) -> list[tuple[int, ...]]:
    """Sets of `take` byte positions such that any 8 - most of the 8 positions contain one of them:
    greedily, the set that settles most of what is still open. most: 7 at most."""
    need = 8 - most
    size = min(take, need)
    open_, out = {frozenset(x) for x in combinations(range(8), need)}, []
    if size == need:
        return list(combinations(range(8), need))
    while open_:
        best = max(combinations(range(8), size), key=lambda x: (sum(set(x) <= y for y in open_), tuple(-i for i in x)))
        open_ = {y for y in open_ if not set(best) <= y}
        out.append(best)
    return out


def _cell_links(x: np.ndarray, y: np.ndarray | None, sets: list[tuple[int, ...]], here: int, max_bits: int) -> list[tuple[int, int]]:
    """Spanning links between the fingerprints of two blocks (or in one) of the list `here`."""
    same_block = y is None
    y = x if same_block else y
    bx, by = (z.astype(">u8").view(np.uint8).reshape(-1, 8) for z in (x, y))
    shared = np.zeros((len(x), len(y)), np.uint8)
    for p in range(8):
        shared += bx[:, None, p] == by[None, :, p]
    enough = shared >= 8 - max_bits
    if same_block:
        enough = np.triu(enough, 1)
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while parent.setdefault(i, i) != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    i, j = np.nonzero(enough)
    near = np.bitwise_count(x[i] ^ y[j]) <= max_bits
    i, j = i[near], j[near]
    equal = bx[i] == by[j]
    earlier = np.zeros(len(i), bool)
    for s in sets[:here]:
        earlier |= equal[:, s].all(axis=1)
    out = []
    for a, z in zip(x[i[~earlier]].tolist(), y[j[~earlier]].tolist()):
        if a != z and (p := root(a)) != (q := root(z)):
            parent[max(p, q)] = min(p, q)
            out.append((a, z))
    return out


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) whose closure equals that of all
    pairs within max_bits bits."""
    sets = covering(max_bits)
    key = [
        F.struct(
            F.lit(n).cast("byte").alias("set"),
            sum((F.shiftleft(F.shiftright("fp", 56 - 8 * p).bitwiseAND(0xFF), 8 * i) for i, p in enumerate(s)), F.lit(0).cast("long")).alias("bytes"),
        )
        for n, s in enumerate(sets)
    ]
    # by number, so that AQE does not pack the few bytes of all fingerprints into a task or two
    tasks = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * distinct.sparkSession.sparkContext.defaultParallelism)
    postings = distinct.repartition(tasks, "fp").select("fp", F.explode(F.array(*key)).alias("key")).select("fp", "key.set", "key.bytes")
    sizes = postings.groupBy("set", "bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    large = sizes.where(F.col("n") > BLOCK).select("set", "bytes", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    large, large_path = materialize(large, "simhash-large")
    small = postings.join(large, ["set", "bytes"], "left_anti") if (crowded := not large.isEmpty()) else postings
    lists = small.groupBy("set", "bytes").agg(F.collect_list("fp").alias("x")).where(F.size("x") > 1).select("set", "x", F.lit(None).cast("array<long>").alias("y"))
    if crowded:
        dealt = postings.join(large, ["set", "bytes"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        dealt = dealt.groupBy("set", "bytes", "blocks", "own").agg(F.collect_list("fp").alias("fps"))
        # each block goes into the cells (least, greatest) that it is a side of
        other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cells = other.groupBy("set", "bytes", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(
            F.max(F.when(F.col("own") <= F.col("other"), F.struct("own", "fps"))).alias("l"), F.max(F.when(F.col("own") > F.col("other"), F.struct("own", "fps"))).alias("h")
        )
        lists = lists.unionByName(cells.select("set", F.col("l.fps").alias("x"), F.when(F.col("i") < F.col("j"), F.col("h.fps")).alias("y"), F.col("i"), F.col("j")).where("x is not null and (i = j or y is not null)").drop("i", "j"))

    def run(batches):
        for b in batches:
            a, z = [], []
            for s, x, y in zip(b[0].to_pylist(), b[1], b[2]):
                fps = [v.values.to_numpy(zero_copy_only=False).view(np.uint64) if v.is_valid else None for v in (x, y)]
                if fps[1] is None and len(fps[0]) == 2:  # the usual list
                    p, q = fps[0].tolist()
                    got = [(p, q)] if _first_list(p, q, sets, max_bits) == s else []
                else:
                    got = _cell_links(*fps, sets, s, max_bits)
                for i, j in got:
                    a.append(i)
                    z.append(j)
            yield pa.record_batch([pa.array(np.array(v, np.uint64).view(np.int64), pa.int64()) for v in (a, z)], names=["a", "b"])

    out, _ = materialize(lists.select("set", "x", "y").mapInArrow(run, "a long, b long"), "simhash-pairs")
    release(distinct.sparkSession, large_path)
    return out


def _first_list(a: int, b: int, sets: list[tuple[int, ...]], max_bits: int) -> int:
    """The first list that two fingerprints share, -1 if they are no link."""
    differ = a ^ b
    if differ.bit_count() > max_bits:
        return -1
    same = [not differ >> (56 - 8 * p) & 0xFF for p in range(8)]
    if sum(same) < 8 - max_bits:
        return -1
    return next(n for n, s in enumerate(sets) if all(same[p] for p in s))


def components(edges: DataFrame, label: str = "components") -> tuple[DataFrame, list[str]]:
    """node, root for every node of an edge table (a, b) but the roots: the least node reachable. Large-star and
    small-star rounds until neither changes an edge; also the scratch paths to release."""
    spark = edges.sparkSession
    cur, path = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    state = None
    while True:
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        nxt, nxt_path = materialize(small, label)
        row = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(spark, path)
        cur, path = nxt, nxt_path
        if (now := tuple(row)) == state:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root")), [path]
        state = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id, the least id whose
    fingerprint is reachable over links of at most max_bits differing bits.

    Words are lower-cased in A-Z alone. Null and empty texts have fingerprint zero and link like any other. A null id keeps its row; it
    never names a component unless all ids there are null. Repeated rows stay. An empty table gives
    an empty result. Extra columns are left out.
    """
    spark = docs.sparkSession
    rows, rows_path = materialize(fingerprints(docs, id_col, text_col), "simhash-rows")
    distinct = rows.groupBy("fp").agg(F.min("id").alias("least_id"))
    distinct, distinct_path = materialize(distinct, "simhash-distinct")
    pairs = links(distinct.select("fp"), max_bits)
    roots, paths = components(pairs, "simhash-links")
    paths.append(distinct_path)
    # nodes without links name themselves; only those with links meet their components
    linked = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    grouped, grouped_path = materialize(distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left"), "simhash-roots")
    named = grouped.where("root is not null").groupBy("root").agg(F.min("least_id").alias("component_id"))
    salted = grouped.where("root is not null").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALT)).cast("int"))
    named = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    by_fp = grouped.where("root is null").select("fp", F.col("least_id").alias("component_id")).unionByName(salted.join(named, ["root", "salt"]).select("fp", "component_id"))
    by_fp, by_fp_path = materialize(by_fp.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), "simhash-groups")
    # a fingerprint that a third of all rows share is met in SALT tasks
    out = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).join(by_fp, ["fp", "salt"])
    release(spark, grouped_path, *paths)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
