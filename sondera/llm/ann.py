"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Vectors are scaled by the largest norm M and given one more component, sqrt(1 - |x|^2 / M^2); a query
is scaled to length one and given a zero there. Then the largest inner product is the smallest
Euclidean distance, for which p-stable (Gaussian) projections floor((a.v + b) / w) are a locality
sensitive hash.

The index is fitted on bounded samples, by one rule at every size (`fit`): SAMPLE_QUERIES queries are
answered exactly in one pass, which gives the radius (median distance of the last neighbour due);
w is WIDTH radii; the number k of functions a table is the least at which SAMPLE_ROWS rows, scaled to
the table, share buckets of OCCUPANCY rows (MOST at most); `reach` is the least at which TARGET of the sample's true
neighbours are met. All rows are indexed.

A query visits, in each table, its own bucket and perturbed ones in order of the estimated success
probability: that a neighbour at distance `radius` falls there, a product over the functions of
normal probabilities of the slots. It stops when these sum to `reach`. Candidates of all tables are
ranked by the exact inner product in double precision and merged.

Equal vectors are one entry that carries its smallest ids, as many as a result can hold, so a vector
that a third of the rows share makes no large bucket; a bucket of many different vectors is cut into
blocks, and queries meet blocks in batches: one matrix product each, of which the best stay. A query
that has found fewer than it is due meets all rows, in numbered blocks.
"""


from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, read, release

TABLES, WIDTH, OCCUPANCY, TARGET, SEED = 2, 2.5, 64, 0.94, 11
SAMPLE_QUERIES, SAMPLE_ROWS, DRAWS = 96, 4096, 1000
#: Functions a table at most: the probes of a query grow about as 2 to their number.
MOST = 9
TOP, QUERY_MOD, BLOCK, BATCH = 20, 20, 2048, 256


@dataclass(frozen=True)
class Index:
    """Projections (tables, dim + 1, k) and offsets of the hash functions, slot width, radius, reach."""

    a: np.ndarray
    b: np.ndarray
    width: float
    radius: float
    reach: float
    scale: float

    def places(self, vectors: np.ndarray, t: int, query: bool) -> np.ndarray:
        """Places of vectors on table t's lines, in slots."""
        if query:
            x = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
            x = np.column_stack([x, np.zeros(len(x))])
        else:
            x = vectors / self.scale
            x = np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))])
        return x @ self.a[t] / self.width + self.b[t]


def projections(dim: int, k: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(size=(TABLES, dim + 1, MOST))[:, :, :k], rng.uniform(0, 1, size=(TABLES, MOST))[:, :k]


def bucket_ids(slots: np.ndarray) -> np.ndarray:
    """One number for each row of slot numbers."""
    out = np.full(slots.shape[:-1], 1469598103934665603, np.uint64)
    for i in range(slots.shape[-1]):
        out = (out ^ slots[..., i].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


_erf = np.vectorize(math.erf)


def probe_slots(place: np.ndarray, width: float, radius: float, reach: float) -> tuple[list[np.ndarray], list[float]]:
    """Slot vectors in order of estimated success, until their probabilities sum to `reach`, and
    these sums. place: (a.q + b / w) of one query, k numbers in units of slots."""
    k = len(place)
    own = np.floor(place).astype(np.int64)
    steps = np.arange(-4, 5)
    edge = (own[:, None] + steps - place[:, None]) * width / (radius * math.sqrt(2))
    high = edge + width / (radius * math.sqrt(2))
    prob = np.maximum((_erf(high) - _erf(edge)) / 2, 1e-12)
    order = np.argsort(-prob, axis=1)
    log_p = np.log(np.take_along_axis(prob, order, axis=1))
    costs = (log_p[:, :-1] - log_p[:, 1:]).tolist()
    heap, out, sums, total = [(-float(log_p[:, 0].sum()), (0,) * k, 0)], [], [], 0.0
    while heap and total < reach:
        # each vector of ranks is made once: only places from the last that was raised on are raised
        cost, ranks, last = heapq.heappop(heap)
        total += math.exp(-cost)
        out.append(ranks)
        sums.append(total)
        for i in range(last, k):
            if ranks[i] < len(steps) - 1:
                heapq.heappush(heap, (cost + costs[i][ranks[i]], (*ranks[:i], ranks[i] + 1, *ranks[i + 1 :]), i))
    return list(own + steps[order[np.arange(k), np.array(out, np.int64).reshape(-1, k)]]), sums


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim), flat.dtype)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _nearest_of_sample(vectors: DataFrame, ids: np.ndarray, asked: np.ndarray, top: int) -> DataFrame:
    """q, score, v: the best `top` entries of each sampled query in each task, then of all."""
    dim = asked.shape[1]

    def run(batches):
        best_s, best_v = np.full((len(asked), 0), 0.0), np.zeros((len(asked), 0, dim))
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b[1], dim).astype(np.float64)
            s = asked @ x.T
            own = b[0].to_pylist()
            for j, of in enumerate(own):
                if len(of) == 1:
                    s[ids == of[0], j] = -np.inf
            s = np.concatenate([best_s, s], axis=1)
            keep = np.argsort(-s, axis=1, kind="stable")[:, :top]
            held = best_s.shape[1]
            best_v = np.stack([np.stack([best_v[q, j] if j < held else x[j - held] for j in row]) for q, row in enumerate(keep)])
            best_s = np.take_along_axis(s, keep, 1)
        q, j = np.nonzero(np.isfinite(best_s))
        yield pa.record_batch([pa.array(q, pa.int32()), pa.array(best_s[q, j]), pa.array(list(best_v[q, j]), pa.list_(pa.float64()))], names=["q", "score", "v"])

    got = vectors.select("ids", "v").mapInArrow(run, "q int, score double, v array<double>")
    return got.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "v"))).where(F.col("r") <= top).drop("r")


def _log_success(slots: np.ndarray, place: np.ndarray, width: float) -> np.ndarray:
    """Log of the estimated success probability of each slot vector; width in radii."""
    low = (slots - place) * width / math.sqrt(2)
    return np.log(np.maximum((_erf(low + width / math.sqrt(2)) - _erf(low)) / 2, 1e-12)).sum(axis=1)


def _least_hashes(vectors: DataFrame, size: int) -> list:
    """SAMPLE_ROWS of the `size` distinct vectors, those of the smallest hashes. Only about twice as
    many are sorted, so that what tasks send to the driver does not grow with their number."""
    first = lambda df: df.orderBy(F.xxhash64("v"), "v").limit(SAMPLE_ROWS).select("v").collect()
    share = 2 * SAMPLE_ROWS / max(1, size)
    if share < 1 and len(out := first(vectors.where(F.xxhash64("v") < int(share * 2.0**64) - (1 << 63)))) == SAMPLE_ROWS:
        return out
    return first(vectors)


def fit(vectors: DataFrame, asked: DataFrame, size: int, dim: int, scale: float, top: int = TOP, target: float = TARGET) -> Index:
    """An index's parameters, from at most SAMPLE_QUERIES queries and SAMPLE_ROWS rows, those of the
    smallest hashes."""
    sample = asked.orderBy(F.xxhash64("qid", "v"), "qid").limit(SAMPLE_QUERIES).collect()
    pad = lambda v: np.pad(np.array(v, float), (0, dim - len(v)))
    q = np.array([pad(r["v"]) for r in sample]).reshape(-1, dim)
    rows = np.array([pad(r["v"]) for r in _least_hashes(vectors, size)]).reshape(-1, dim)
    near = _nearest_of_sample(vectors, np.array([r["qid"] for r in sample]), q, top).collect() if len(q) else []
    at = np.array([r["q"] for r in near], int)
    score, v = np.array([r["score"] for r in near]), np.array([r["v"] for r in near]).reshape(-1, dim)
    distance = np.sqrt(np.maximum(2 - 2 * score / (np.linalg.norm(q[at], axis=1) * scale), 0)) if len(near) else np.ones(1)
    last = np.array([distance[at == i].max() for i in range(len(q)) if (at == i).any()]) if len(near) else distance
    radius = max(float(np.median(last)), 1e-3)
    width = WIDTH * radius
    for k in range(2, MOST + 1):
        a, b = projections(dim, k)
        index = Index(a, b, width, radius, 1.0, scale)
        count = np.unique(bucket_ids(np.floor(index.places(rows, 0, False))), return_counts=True)[1]
        # chance that two rows share a bucket, from the pairs of the sample
        if size * float((count * (count - 1)).sum()) / max(1, len(rows) * (len(rows) - 1)) <= OCCUPANCY:
            break
    # what must be reached for each true neighbour, in the table that meets it first: the share of
    # drawn displacements that fall into likelier slots than the neighbour's
    need = np.full(len(near), 1.0)
    drawn = np.random.default_rng(SEED).normal(size=(DRAWS, k)) * radius / width
    for t in range(TABLES if len(near) else 0):
        place, own = index.places(q, t, True), np.floor(index.places(v, t, False))
        for i in np.unique(at):
            mine = np.flatnonzero(at == i)
            likely = np.sort(_log_success(np.floor(place[i] + drawn), place[i], width / radius))
            got = _log_success(own[mine], place[i], width / radius)
            need[mine] = np.minimum(need[mine], 1 - np.searchsorted(likely, got - 1e-9) / DRAWS)
    reach = float(np.quantile(need, target)) if len(near) else 1.0
    return Index(a, b, width, radius, min(reach, 0.99), scale)


def _hashed(vectors: DataFrame, index: Index, dim: int, kind: str) -> DataFrame:
    """vectors (ids, v) with a row for each table: t, bucket."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch[1], dim)
            v = pa.array(list(x), batch[1].type)
            for t in range(len(index.a)):
                bucket = bucket_ids(np.floor(index.places(x.astype(np.float64), t, False)))
                yield pa.record_batch([pa.array(np.full(len(x), t, np.int32)), pa.array(bucket), batch[0], v], names=["t", "bucket", "ids", "v"])

    return vectors.select("ids", "v").mapInArrow(run, f"t int, bucket long, ids array<bigint>, v array<{kind}>")


def _probed(queries: DataFrame, index: Index, dim: int, kind: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            x = _matrix(batch[1], dim)
            v = pa.array(list(x), batch[1].type)
            for t in range(len(index.a) if len(x) else 0):
                buckets, at = [], []
                for i, place in enumerate(index.places(x.astype(np.float64), t, True)):
                    got = bucket_ids(np.array(probe_slots(place, index.width, index.radius, index.reach)[0]))
                    buckets.append(got)
                    at += [i] * len(got)
                take = pa.array(at, pa.int64())
                yield pa.record_batch([pa.array(np.full(len(at), t, np.int32)), pa.array(np.concatenate(buckets), pa.int64()), batch[0].take(take), v.take(take)], names=["t", "bucket", "qid", "v"])

    # few bytes are much work here: dealt by number, so that they are not packed into a task or two
    dealt = queries.select("qid", "v").repartition(2 * queries.sparkSession.sparkContext.defaultParallelism, "qid")
    return dealt.mapInArrow(run, f"t int, bucket long, qid long, v array<{kind}>")


def _packed(rows: DataFrame, most: int, ids: str, kind: str, name: str, dim: int, real: type) -> DataFrame:
    """Rows of one bucket in packs of `most` at most, each with its vectors as one binary."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a bucket of many rows is dealt to several tasks; the counts are one small row a bucket
    large = rows.groupBy("t", "bucket").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts")).where("parts > 1")
    salted = rows.join(large, ["t", "bucket"], "left").withColumn("salt", F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1))))
    dealt = salted.repartition(n, "t", "bucket", "salt").sortWithinPartitions("t", "bucket", "salt")

    def run(batches):
        key, held_ids, held_v = None, [], []

        def out():
            v = np.array(held_v, real)
            return pa.record_batch([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([held_ids], pa.list_(kind_type)), pa.array([v.tobytes()], pa.binary())], names=["t", "bucket", name, name + "_v"])

        kind_type = pa.list_(pa.int64()) if kind == "array<bigint>" else pa.int64()
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b["v"], dim)
            for i, row in enumerate(zip(b["t"].to_pylist(), b["bucket"].to_pylist(), b[ids].to_pylist())):
                if key != row[:2] or len(held_ids) >= most:
                    if held_ids:
                        yield out()
                    key, held_ids, held_v = row[:2], [], []
                held_ids.append(row[2])
                held_v.append(v[i])
        if held_ids:
            yield out()

    return dealt.select("t", "bucket", ids, "v").mapInArrow(run, f"t int, bucket long, {name} array<{kind}>, {name}_v binary")


def _meeting(probes: DataFrame, packs: DataFrame, keys: list[str]) -> DataFrame:
    """Packs of queries with packs of entries. Spark judges the size of either side by the rows before
    they were probed or repeated, some hundred times fewer, and would send it through the driver to
    every task: the join is told to deal both sides out."""
    return probes.hint("merge").join(packs.hint("merge"), keys)


def _top(q: np.ndarray, s: np.ndarray, low: np.ndarray, keep: int) -> np.ndarray:
    """Places of the best `keep` different entries of each query, by score, then smallest id."""
    order = np.lexsort((low, -s, q))
    q, low = q[order], low[order]
    new = np.ones(len(q), bool)
    # an entry that several tables gave stands side by side: its score is the same within rounding
    new[1:] = (q[1:] != q[:-1]) | (low[1:] != low[:-1])
    order, q = order[new], q[new]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, int)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    return order[rank < keep + 3]


def _best(pairs: DataFrame, dim: int, keep: int, real: type) -> DataFrame:
    """qid, ids, score: for each query the best entries of the packs that it meets in a task."""
    # partial results are kept a task, so a few tasks a core make fewer of them than one a partition
    pairs = pairs.select("qs", "qs_v", "es", "es_v").coalesce(2 * pairs.sparkSession.sparkContext.defaultParallelism)

    def run(batches):
        qs, ss, lows, lists = [], [], [], {}
        held = 0

        def settle():
            q, s, low = np.concatenate(qs), np.concatenate(ss), np.concatenate(lows)
            at = _top(q, s, low, keep)
            return q[at], s[at], low[at]

        def out(q, s, low):
            return pa.record_batch([pa.array(q), pa.array([lists[x] for x in low.tolist()], pa.list_(pa.int64())), pa.array(s)], names=["qid", "ids", "score"])

        for b in batches:
            for q_ids, q_v, ids, v in zip(*(b[c] for c in ("qs", "qs_v", "es", "es_v"))):
                q = np.frombuffer(q_v.as_py(), real).reshape(-1, dim).astype(np.float64)
                e = np.frombuffer(v.as_py(), real).reshape(-1, dim).astype(np.float64)
                ids, q_ids = ids.as_py(), q_ids.values.to_numpy()
                low = np.array([x[0] for x in ids], np.int64)
                scores = q @ e.T
                if len(e) > keep:
                    edge = np.partition(scores, len(e) - keep, axis=1)[:, len(e) - keep]
                    # those that tie with the last one, within rounding, stay in, for the ids to decide
                    row, column = np.nonzero(scores >= (edge - 1e-12 * np.abs(edge))[:, None])
                else:
                    row, column = np.divmod(np.arange(scores.size), len(e))
                qs.append(q_ids[row])
                # a product of matrices rounds by their shapes: what counts is each pair's own product
                ss.append(np.einsum("ij,ij->i", q[row], e[column]))
                lows.append(low[column])
                for c in np.unique(column).tolist():
                    lists[ids[c][0]] = ids[c]
                held += len(row)
                if held > 2_000_000:
                    q, s, low = settle()
                    if len(q) > 1_000_000:
                        yield out(q, s, low)
                        qs, ss, lows, lists, held = [], [], [], {}, 0
                    else:
                        qs, ss, lows, held = [q], [s], [low], len(q)
                        live = set(low.tolist())
                        lists = {k: x for k, x in lists.items() if k in live}
        if qs:
            yield out(*settle())

    return pairs.mapInArrow(run, "qid long, ids array<bigint>, score double")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """One row a (query, id): the best `top` of each query in order of score, then id."""
    flat = found.select("qid", F.explode("ids").alias("vec_id"), "score").where("qid <> vec_id")
    flat = flat.groupBy("qid", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    return flat.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def neighbours(rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", top: int = TOP, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` nearest found of each query among rows other than
    its own, nearest first, ties to the smaller id. `target` is the recall that the index is fitted to.

    Null vectors, empty or zero ones, those with a null or non-finite component or without an id take
    no part, as queries or candidates. Vectors of unequal lengths meet as if the shorter ended in
    zeros. Doubles stay doubles. Repeated rows count once; an id with several vectors is a candidate,
    or a query, by its best. An empty table gives an empty result. Extra columns are left out.
    """
    spark = rows.sparkSession
    number = F.col("v")
    single = all(df.schema[vec_col].dataType.simpleString() == "array<float>" for df in (rows, queries))
    kind, real = ("float", np.float32) if single else ("double", np.float64)
    fit_for = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(number, lambda x: x != 0)
    prepare = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{kind}>").alias("v")).where(fit_for)
    entries, asked = prepare(rows), prepare(queries)
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    most = entries.agg(F.max(F.size("v")).alias("dim"), F.max(norm).alias("m")).first()
    if most["dim"] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, scale = most["dim"], math.sqrt(most["m"])
    dim = max(dim, asked.agg(F.max(F.size("v"))).first()[0] or 0)
    # the smallest ids of each distinct vector: no more of them can be in one result
    few = W.partitionBy("v").orderBy("vec_id")
    distinct = entries.groupBy("v", "vec_id").agg(F.lit(1)).select("v", "vec_id").withColumn("r", F.row_number().over(few)).where(F.col("r") <= top + 1)
    distinct = distinct.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    distinct, distinct_path = materialize(distinct, "ann-vectors")
    asked = asked.select(F.col("vec_id").alias("qid"), "v").dropDuplicates()
    index = fit(distinct, asked, distinct.count(), dim, scale, top, target)
    packs, packs_path = materialize(_packed(_hashed(distinct, index, dim, kind), BLOCK, "ids", "array<bigint>", "es", dim, real), "ann-index")
    probes = _packed(_probed(asked, index, dim, kind), BATCH, "qid", "bigint", "qs", dim, real)
    pairs = _meeting(probes, packs, ["t", "bucket"])
    found, found_path = materialize(_ranked(_best(pairs, dim, top + 1, real), top), "ann-found")
    # a query that has found fewer than it is due meets the first table, whole, in numbered blocks
    have = found.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    short = asked.join(have, "qid", "left").where(F.coalesce("n", F.lit(0)) < top).select("qid", "v")
    if short.count():
        whole = packs.where("t = 0").select("es", "es_v")
        blocks = max(1, whole.count() // 16)
        rest = _packed(short.withColumn("t", F.lit(0)).withColumn("bucket", F.pmod(F.xxhash64("qid"), F.lit(64))), BATCH, "qid", "bigint", "qs", dim, real).select("qs", "qs_v")
        rest = rest.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        met = _meeting(rest, whole.withColumn("block", F.pmod(F.xxhash64("es_v"), F.lit(blocks)).cast("int")), ["block"])
        again = _ranked(_best(met, dim, top + 1, real), top)
        found = found.join(short.select("qid").distinct(), "qid", "left_anti").select("qid", "rank", "vec_id", "score").unionByName(again.select("qid", "rank", "vec_id", "score"))
        found, again_path = materialize(found, "ann-found")
        release(spark, found_path)
    release(spark, distinct_path, packs_path)
    return found.select(F.col("qid").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_multiprobe_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return neighbours(rows, rows.where(F.col("vec_id") % QUERY_MOD == 0))
