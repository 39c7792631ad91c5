"""Ranked lexical search over inverted treaps.

The index has, for every shard of the corpus and every term in it, a treap of the term's postings:
a binary tree in search order of the document id and in heap order of the impact, so that a
subtree's root bears the largest impact of its range of documents. Impacts hold all of the score but
the term's weight, which depends on the query's terms alone.

A search traverses the treaps of all terms of a query at once. A state is a range of documents with
the root of each term's subtree for it; the weighted sum of the roots' impacts bounds the score of
every document of the range, and a state whose bound cannot enter the k best is dropped with all
that lies below. Of the others, the document of the heaviest root is the pivot: each treap is split
there, on one path down, which gives the subtrees left and right of the pivot and the pivot's own
impact. States of all queries of a block move together, wave by wave, as arrays.

Building: one pass counts N and L, a second one cuts the texts of each task into shards of about
SHARD_TERMS terms, makes their treaps (all lists of a shard at once, by pointer jumping to the next
larger impact on either side) and writes a row a shard. Document frequencies of a block's terms are
summed over all shards. A first search over a few shards only sets the score that a document must
reach (a lower bound of the k-th best, whichever shards they are); the full one then lets out few
rows, and each task at most k a query. Queries come in blocks of bounded size, a search each.

Ranking (integers, division rounding down): w = floor(1000 ln((2N+2)/(2df+1))), m = 75 + 25 n N / L,
score = sum over the query's terms, repeats included, of w * (10^9 tf / (1000 tf + 12 m)).
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize, ranges, read, release, row_key, scratch_root, slices, spread

TOP = 20
SHARD_TERMS = 1 << 20
#: (query, term) pairs of a block of queries.
BLOCK_TERMS = 200_000
#: Shards of the first search are one in so many, and so many at most.
SEED_SHARE, SEED_SHARDS = 12, 64
#: Subtrees in a wave: the most promising ranges first, the others when those are done.
WAVE = 1 << 16
#: Stands for a null document id inside; such rows come after all others of their score.
NULL_ID = (1 << 63) - 1
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters (A-Z lower-cased, no others) and all that lies beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def _hash(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term)


def weight(n_docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


def treaps(starts: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """root of each list, left and right of each posting (positions, -1 for none) for lists one after
    another that begin at `starts`, each in order of document. Of equal impacts the first is on top."""
    n = len(impacts)
    value = np.r_[impacts.astype(np.int64), np.int64(1) << 62]
    at = np.arange(n)
    first = np.zeros(n, bool)
    first[starts] = True

    def reach(near: np.ndarray, smaller) -> np.ndarray:
        """Nearest posting of the list on one side that is not smaller; n if there is none. All
        between a posting and the one pointed at is smaller, so a pointer may take over its goal's."""
        near = np.r_[near, n]
        open_ = at
        while len(open_):
            open_ = open_[smaller(value[near[open_]], value[open_])]
            near[open_] = near[near[open_]]
        return near[:n]

    before = reach(np.where(first, n, at - 1), np.less)
    after = reach(np.where(np.r_[first[1:], True][:n], n, at + 1), np.less_equal)
    is_left = (after < n) & ((before == n) | (value[after] <= value[before]))
    is_right = ~is_left & (before < n)
    left, right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    left[after[is_left]] = at[is_left]
    right[before[is_right]] = at[is_right]
    return at[~is_left & ~is_right].astype(np.int32), left, right


def _split(docs, left, right, node, d, low, high):
    """For each treap (the root of its part in low <= document < high) and a document d in there:
    roots of the parts before and after d, and d's own posting; -1 for none. The topmost posting of
    either part lies on the path down to d, or below d on the way to its neighbour."""
    lo, hi, hit = (np.full(len(node), -1, np.int32) for _ in range(3))
    who, cur = np.arange(len(node)), node
    while len(who):
        here, want = docs[cur], d[who]
        below, above = here < want, here > want
        for found, mask in ((lo, below & (here >= low[who])), (hi, above & (here < high[who]))):
            w, c = who[mask], cur[mask]
            new = found[w] < 0
            found[w[new]] = c[new]
        same = ~(below | above)
        hit[who[same]] = cur[same]
        cur = np.where(below, right[cur], left[cur])
        go = ~same & (cur >= 0)
        who, cur = who[go], cur[go]
    for found, first, then, inside in ((lo, left, right, lambda doc, w: doc >= low[w]), (hi, right, left, lambda doc, w: doc < high[w])):
        who = np.flatnonzero((hit >= 0) & (found < 0))
        cur = first[hit[who]]
        who, cur = who[cur >= 0], cur[cur >= 0]
        while len(who):
            good = inside(docs[cur], who)
            found[who[good]] = cur[good]
            cur = then[cur]
            go = ~good & (cur >= 0)
            who, cur = who[go], cur[go]
    return lo, hi, hit


class Best:
    """The k best (score, document id) of every query so far, in order; ties to smaller ids."""

    def __init__(self, n: int, k: int, bounds: list[tuple[int, int]] | None = None):
        self.k, self.found = k, [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in range(n)]
        # a document must have more than `least`, or as much and an id of at most `last`
        self.least = np.array([b[0] for b in bounds] if bounds else [0] * n, np.int64)
        self.last = np.array([b[1] for b in bounds] if bounds else [-(1 << 63)] * n, np.int64)

    def hopeful(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return (score > self.least[query]) | ((score == self.least[query]) & (doc <= self.last[query]))

    def add(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        keep = self.hopeful(query, score, doc)
        order = np.flatnonzero(keep)[np.argsort(query[keep], kind="stable")]
        for part in np.split(order, np.flatnonzero(np.diff(query[order])) + 1) if len(order) else []:
            q = query[part[0]]
            s, d = (np.concatenate(x) for x in zip(self.found[q], (score[part], doc[part])))
            top = np.lexsort((d, -s))[: self.k]
            self.found[q] = s[top], d[top]
            if len(top) == self.k:
                self.least[q], self.last[q] = s[top[-1]], d[top[-1]]


class Shard:
    """Postings of one shard, as written; arrays are views of the row's bytes."""

    def __init__(self, row: dict):
        number = lambda name, kind: np.frombuffer(row[name], kind)
        self.ids = number("doc_ids", "<i8")
        self.hashes, self.ends, self.sizes, self.roots = number("hashes", "<u8"), number("ends", "<i4"), number("sizes", "<i4"), number("roots", "<i4")
        self.terms = row["terms"]
        if "docs" in row:
            self.docs, self.impacts, self.left, self.right = (number(x, "<i4") for x in ("docs", "impacts", "left", "right"))

    def find(self, terms: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """Number of each term in the shard, -1 if it has none."""
        at, out = np.searchsorted(self.hashes, hashes), np.full(len(terms), -1, np.int64)
        for i in np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes).tolist():
            j = int(at[i])
            while j < len(self.hashes) and self.hashes[j] == hashes[i]:  # more than once if hashes collide
                if self.terms[self.ends[j - 1] if j else 0 : self.ends[j]] == terms[i]:
                    out[i] = j
                j += 1
        return out

    def search(self, query: np.ndarray, node: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Put the documents of this shard that can be among the best of their query into `best`.
        One row for each query's term: query (ascending), root of its treap, weight. Returns the
        number of subtrees met."""
        state = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[state, len(query)])
        waves = [(query[state], np.zeros(len(state), np.int32), np.full(len(state), len(self.ids), np.int32), sizes, node, weights)]
        met = 0
        while waves:
            q, low, high, sizes, node, weights = waves.pop()
            if not len(q):
                continue
            part = weights * self.impacts[node]
            starts = np.cumsum(sizes) - sizes
            bound = np.add.reduceat(part, starts)
            alive = np.flatnonzero((bound > 0) & best.hopeful(q, bound, self.ids[low]))
            if sizes[alive].sum() > WAVE:  # the most promising ones first, the rest when they are done
                alive = alive[np.argsort(-bound[alive], kind="stable")]
                many = int(np.searchsorted(np.cumsum(sizes[alive]), WAVE)) + 1
                rest = np.sort(alive[many:])
                if len(rest):
                    take = ranges(starts[rest], sizes[rest])
                    waves.append((q[rest], low[rest], high[rest], sizes[rest], node[take], weights[take]))
                alive = np.sort(alive[:many])
            if not len(alive):
                continue
            take = ranges(starts[alive], sizes[alive])
            q, low, high, sizes, node, weights, part = q[alive], low[alive], high[alive], sizes[alive], node[take], weights[take], part[take]
            met += len(node)
            starts = np.cumsum(sizes) - sizes
            owner = np.repeat(np.arange(len(q)), sizes)
            # the pivot: the document of the first of the heaviest roots
            heavy = np.flatnonzero(part == np.maximum.reduceat(part, starts)[owner])
            pivot = self.docs[node[heavy[np.searchsorted(heavy, starts)]]]
            lo, hi, hit = _split(self.docs, self.left, self.right, node, pivot[owner], low[owner], high[owner])
            score = np.add.reduceat(np.where(hit >= 0, weights * self.impacts[hit], 0), starts)
            best.add(q, score, self.ids[pivot])
            below = []
            for child, least, most in ((lo, low, pivot), (hi, pivot + 1, high)):
                there = child >= 0
                count = np.bincount(owner[there], minlength=len(q))
                some = count > 0
                below.append((q[some], least[some], most[some], count[some], child[there], weights[there]))
            waves.append(tuple(map(np.concatenate, zip(*below))))
        return met


_STORED = "doc_ids binary, terms binary, hashes binary, ends binary, sizes binary, roots binary, docs binary, impacts binary, left binary, right binary"


class _Build:
    """Collects documents until they fill a shard."""

    def __init__(self, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.clear()

    def clear(self):
        self.numbers: dict[bytes, int] = {}
        self.rows, self.count = [], 0

    def add(self, doc: int, text: str | None) -> None:
        words = terms_of(text)
        if not words:
            return
        tally, numbers = Counter(words), self.numbers
        for t in tally:
            if t not in numbers:
                numbers[t] = len(numbers)
        self.rows.append((doc, len(words), np.fromiter(map(numbers.__getitem__, tally), np.int32, len(tally)), np.fromiter(tally.values(), np.int64, len(tally))))
        self.count += len(words)

    def row(self) -> dict[str, bytes]:
        self.rows.sort(key=lambda r: r[0])
        term = np.concatenate([r[2] for r in self.rows])
        doc = np.repeat(np.arange(len(self.rows)), [len(r[2]) for r in self.rows])
        tf = np.concatenate([r[3] for r in self.rows])
        names = list(self.numbers)
        hashes = np.array([_hash(t) for t in names], np.uint64)
        by_hash = np.argsort(hashes, kind="stable")
        place = np.empty(len(names), np.int64)
        place[by_hash] = np.arange(len(names))
        term = place[term]
        order = np.argsort(term, kind="stable")
        term, doc, tf = term[order], doc[order], tf[order]
        m = np.array([75 + 25 * r[1] * self.n_docs // self.n_terms for r in self.rows], np.int64)
        impacts = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
        sizes = np.bincount(term, minlength=len(names))
        roots, left, right = treaps(np.cumsum(sizes) - sizes, impacts)
        names = [names[i] for i in by_hash.tolist()]
        ends = np.cumsum([len(t) for t in names])
        numbers = {"hashes": hashes[by_hash].astype("<u8"), "ends": ends, "sizes": sizes, "roots": roots, "docs": doc, "impacts": impacts, "left": left, "right": right}
        out = {"doc_ids": np.array([r[0] for r in self.rows], "<i8").tobytes(), "terms": b"".join(names)}
        out |= {k: (v if k == "hashes" else v.astype("<i4")).tobytes() for k, v in numbers.items()}
        self.clear()
        return out


@contextmanager
def _one_by_one(spark: SparkSession):
    """Rows of some megabytes, such as shards, are read and sent to Python one at a time, not by the thousand."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "1")
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


class TreapIndex:
    """A written index: `path` (a folder of Parquet), N and L of the ranking."""

    def __init__(self, spark: SparkSession, path: str, n_docs: int, n_terms: int):
        self.spark, self.path, self.n_docs, self.n_terms = spark, path, n_docs, n_terms

    @classmethod
    def build(cls, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shard_terms: int = SHARD_TERMS) -> "TreapIndex":
        """Index all rows of docs at `path`, a shared folder that does not exist yet.

        Texts are indexed whole, and a text longer than a shard is a shard of its own. Null and
        empty texts, and those without terms, are left out of the index and its counts. Rows that
        repeat, or share an id, are documents each; null ids rank last among equal scores. An empty
        table gives an empty index. Extra columns are left out.
        """
        spark = docs.sparkSession
        rows = spread(docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").alias("t")))

        def count(batches):
            for b in batches:
                n = [len(terms_of(x.as_py())) for x in b["t"]]
                yield pa.record_batch([pa.array([sum(x > 0 for x in n)], pa.int64()), pa.array([sum(n)], pa.int64())], names=["docs", "terms"])

        total = rows.select("t").mapInArrow(count, "docs long, terms long").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
        n_docs, n_terms = int(total[0]), int(total[1])

        def shards(batches):
            shard = _Build(n_docs, n_terms)
            for batch in batches:
                for b in slices(batch, "t"):
                    for i, t in zip(b["i"].fill_null(NULL_ID).to_pylist(), b["t"]):
                        shard.add(i, t.as_py())
                        if shard.count >= shard_terms:
                            yield _batch(shard.row())
            if shard.count:
                yield _batch(shard.row())

        plain = {"compression": "zstd", "parquet.enable.dictionary": "false", "parquet.block.size": str(1 << 24)}
        rows.mapInArrow(shards, _STORED).write.options(**plain).parquet(f"{path}/shards")
        spark.createDataFrame([(n_docs, n_terms)], "docs long, terms long").write.parquet(f"{path}/counts")
        return cls(spark, path, n_docs, n_terms)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "TreapIndex":
        row = spark.read.schema("docs long, terms long").parquet(f"{path}/counts").first()
        return cls(spark, path, row["docs"], row["terms"])

    def shards(self) -> DataFrame:
        return self.spark.read.schema(_STORED).parquet(f"{self.path}/shards")

    def frequencies(self, terms: list[bytes]) -> dict[bytes, int]:
        """Number of documents that hold each of some terms (a bounded list); reads no postings."""
        sent = self.spark.sparkContext.broadcast((terms, np.array([_hash(t) for t in terms], np.uint64)))

        def run(batches):
            names, hashes = sent.value
            total = np.zeros(len(names), np.int64)
            for b in batches:
                for row in b.to_pylist():
                    shard = Shard(row)
                    at = shard.find(names, hashes)
                    total[at >= 0] += shard.sizes[at[at >= 0]]
            some = np.flatnonzero(total)
            yield pa.record_batch([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["term", "df"])

        got = self.shards().select("doc_ids", "terms", "hashes", "ends", "sizes", "roots").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
        return {terms[r["term"]]: r["df"] for r in got}

    def _search(self, shards: DataFrame, queries: list[list[tuple[bytes, int]]], k: int, bounds: list[tuple[int, int]] | None = None) -> DataFrame:
        """query (its number), doc_id, score: k at most of each task and query."""
        names = sorted({t for q in queries for t, _ in q})
        number = {t: i for i, t in enumerate(names)}
        owner = np.repeat(np.arange(len(queries)), [len(q) for q in queries])
        which = np.array([number[t] for q in queries for t, _ in q], np.int64)
        weights = np.array([w for q in queries for _, w in q], np.int64)
        sent = self.spark.sparkContext.broadcast((names, np.array([_hash(t) for t in names], np.uint64), owner, which, weights, bounds, len(queries)))

        def run(batches):
            names, hashes, owner, which, weights, bounds, n = sent.value
            best = Best(n, k, bounds)
            for b in batches:
                for i in range(b.num_rows):
                    shard = Shard(b.slice(i, 1).to_pylist()[0])
                    at = shard.find(names, hashes)[which]
                    there = at >= 0
                    shard.search(owner[there], shard.roots[at[there]], weights[there], best)
            query = np.repeat(np.arange(n), [len(s) for s, _ in best.found])
            score, doc = (np.concatenate([np.empty(0, np.int64), *(f[j] for f in best.found)]) for j in (0, 1))
            yield pa.record_batch([pa.array(query, pa.int64()), pa.array(doc, pa.int64(), mask=doc == NULL_ID), pa.array(score, pa.int64())], names=["query", "doc_id", "score"])

        return shards.mapInArrow(run, "query long, doc_id long, score long")

    def search(self, items: DataFrame, k: int = TOP, item_id: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
        """item_id, rank (int, from 1), doc_id, score: the k documents of highest score above 0 of
        each item; equal scores by ascending id.

        Every distinct (id, text) is an item, so repeated rows count once, and an id with several
        texts has a ranking for each. Null and empty texts, and texts without a term of the corpus,
        have no rows. Items of any length are taken whole. Item ids may be of any type, null too.
        """
        spark, kind = self.spark, items.schema[item_id].dataType
        rows = items.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{item_text}`").alias("t")).dropDuplicates(["i", "t"]).withColumn("q", row_key("i", "t"))

        def tally(batches):
            for b in batches:
                found = [sorted(Counter(terms_of(t)).items()) for t in b["t"].to_pylist()]
                cols = [pa.array([[t for t, _ in f] for f in found], pa.list_(pa.binary())), pa.array([[n for _, n in f] for f in found], pa.list_(pa.int64())), pa.array([len(f) for f in found], pa.int64())]
                yield pa.record_batch([b["q"], b["i"].cast(to_arrow_type(kind)), *cols], names=["q", "i", "terms", "times", "n"])

        rows, rows_path = materialize(rows.mapInArrow(tally, f"q binary, i {kind.simpleString()}, terms array<binary>, times array<long>, n long").where("n > 0"), "search-items")
        blocks = math.ceil((rows.agg(F.sum("n")).first()[0] or 0) / block_terms)
        dealt = F.pmod(F.xxhash64("q"), F.lit(max(1, blocks)))
        shards, n_shards = self.shards(), self.shards().select("sizes").count()
        out = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
        paths = [rows_path]
        for block in range(blocks if self.n_docs else 0):
            with _one_by_one(spark):
                found = self._ranked_block(rows.where(dealt == block), shards, n_shards, k, kind.simpleString())
            if found is not None:
                paths.append(found[1])
                out = out.unionByName(found[0])
        if len(paths) > 1:
            out, _ = materialize(out, "search-ranked")
        release(spark, *paths)
        return out

    def _ranked_block(self, rows: DataFrame, shards: DataFrame, n_shards: int, k: int, kind: str) -> tuple[DataFrame, str] | None:
        """The written ranking of one block of queries, and its path."""
        spark = self.spark
        mine = sorted(rows.collect(), key=lambda r: bytes(r["q"]))
        if not mine:
            return None
        df = self.frequencies(sorted({bytes(t) for r in mine for t in r["terms"]}))
        queries = [[(bytes(t), n * weight(self.n_docs, df[bytes(t)])) for t, n in zip(r["terms"], r["times"]) if bytes(t) in df] for r in mine]
        # a first look at a few shards: what the k-th best document has at least
        seeds, bounds = min(SEED_SHARDS, n_shards // SEED_SHARE), None
        if seeds:
            few = shards.where(F.pmod(F.xxhash64("doc_ids"), F.lit(n_shards // seeds)) == 0)
            bounds = [(0, -(1 << 63))] * len(queries)
            for r in self._ranked(self._search(few, queries, k), k).where(F.col("rank") == k).collect():
                bounds[r["query"]] = (r["score"], NULL_ID if r["doc_id"] is None else r["doc_id"])
        ids = spark.createDataFrame([(n, r["i"]) for n, r in enumerate(mine)], f"query long, item_id {kind}")
        found = self._ranked(self._search(shards, queries, k, bounds), k).join(F.broadcast(ids), "query").select("item_id", "rank", "doc_id", "score")
        return materialize(found, "search-found")

    @staticmethod
    def _ranked(found: DataFrame, k: int) -> DataFrame:
        order = W.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _batch(row: dict[str, bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([row[c.split()[0]]], pa.binary()) for c in _STORED.split(", ")], names=[c.split()[0] for c in _STORED.split(", ")])


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_root(spark)}/treaps-{uuid.uuid4().hex}"
    out = TreapIndex.build(read(spark, sf_dir, "documents"), path).search(read(spark, sf_dir, "benchmark"))
    release(spark, path)
    return out


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id), total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
m AS (SELECT doc_id, 75 + (25 * n * docs) // terms AS m FROM sizes, total),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, docs),
item AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
scores AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM item JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}"""
